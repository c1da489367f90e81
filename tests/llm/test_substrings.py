"""Substring dedup against every window of every text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallygraph.llm import common, substrings


def brute(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {j for a in range(len(w) - length + 1) if seen[tuple(w[a : a + length])] > 1 for j in range(a, a + length)}
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return Counter(out)


def run(df, **options):
    return Counter(tuple(r) for r in substrings.dedup_substrings(df, **options).collect())


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    want = Counter((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(rows, 35))
    assert Counter(tuple(r) for r in substrings.op13_substring_dedup(spark, sf).collect()) == want
    assert sum(g for _, _, g, _ in want) > 1000


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("length, anchor", [(5, 2), (7, 7), (6, 1), (9, 4)])
def test_random_texts_of_few_words(spark, seed, length, anchor):
    """Two to four different words, so that windows overlap themselves, cross
    and share only parts."""
    rng = random.Random(seed)
    vocabulary = "abcd"[: 2 + seed % 3]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(25)]
    shared = " ".join(f"s{i}" for i in range(14))
    rows += [(100 + i, f"x{i} {shared} y{i}" if i % 3 else " ".join(shared.split()[i % 5 : 11])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df, length=length, anchor=anchor) == brute(rows, length)


def test_spans_and_pieces_change_nothing(spark, monkeypatch):
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(90))
    rows = [(i, " ".join([" ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 400))), passage[: 350 - i * 3], "tail " * i])) for i in range(12)]
    rows.append((50, "one two " * 300))
    want = brute(rows, 35)
    for span, piece in ((1 << 16, 1 << 20), (50, 40), (7, 1)):
        monkeypatch.setattr(substrings, "SPAN", span)
        monkeypatch.setattr(substrings, "PIECE", piece)
        known, rolling = substrings.Hashes(), substrings.Rolling(35)
        x = substrings.word_hashes(rows[3][1].encode(), known)
        a, g, s, m = substrings.blocks(x, 35, 8, rolling)
        assert m.sum() == len(x) - 34 and (np.diff(s) == m[:-1]).all()
        every = np.arange(len(x) - 34)
        h = substrings.windows(x, every, 35, rolling)
        same = {}
        for i in every.tolist():
            same.setdefault(tuple(x[i : i + 35].tolist()), set()).add(int(h[i]))
        assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(h.tolist()))
    monkeypatch.undo()
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(i, f"head{i} {shared} tail{i}") for i in range(40)] + [(7, f"head7 {shared} tail7")] * 9 + [(100, shared + " alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(df) == brute(rows, 35)


def test_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [
        (1, ""), (2, None), (3, "one"), (4, text), (4, text), (None, text), (None, None), (5, "  \t\n\x0b "), (6, " ".join("ab") + " é漢 \U0001f600"),
        (7, " ".join(f"u{i}" for i in range(70_000))), (8, text.upper()), (9, " ".join(f"u{i}" for i in range(300, 334))), (10, "w " * 36), (11, "z " * 35), (12, text.replace(" ", "\n\n")),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS k", "3 AS node", "4 AS a", "5 AS g", "6 AS s", "7 AS m", "8 AS h", "'x' AS spans", "9 AS n")
    assert run(df) == brute(rows, 35)
    assert run(df.limit(0)) == Counter()
    with pytest.raises(ValueError):
        substrings.dedup_substrings(df, length=3, anchor=4)
