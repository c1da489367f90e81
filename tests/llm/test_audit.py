"""Filter audit against every row in every order."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallygraph.llm import audit, common


def naive_mask(rows):
    """{row number: mask}"""
    out = {}
    for n, (i, _, text) in enumerate(rows):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t) is not None,
            i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in rows),
        )
        out[n] = sum(1 << k for k, f in enumerate(fails) if f)
    return out


def naive_audit(rows, labels):
    masks = naive_mask(rows)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    out, shapley = {}, Counter()
    for part in {p or "" for _, p, _ in rows}:
        mine = [(i, masks[n]) for n, (i, p, _) in enumerate(rows) if (p or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                bit = 1 << "ABCDE".index(c)
                gone, stay = [x for x in left if x[1] & bit], [x for x in left if not x[1] & bit]
                fails = [x for x in mine if x[1] & bit]
                shapley[part, c] += len(gone)
                out[part, "".join(order), step] = (len(stay), len(gone), len(fails) - len(gone), sum(m == bit for _, m in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                left = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.lang, r.text) for r in common.table(spark, sf, "documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in common.table(spark, sf, "labels").collect()]
    assert got(audit.op12_filter_audit(spark, sf)) == naive_audit(rows, labels)


def odd_rows():
    rng = random.Random(4)
    many = " ".join(f"w{i}" for i in range(210))
    texts = ["", None, many, many + " #", many.upper(), "a " * 250, "é漢\U0001f600 x", "Z", "copy of a line", "w " * 70_000]
    rows = [(i, rng.choice(["en", "de", None, ""]), rng.choice(texts)) for i in range(120)]
    rows += [(500 + i, "en", "copy of a line") for i in range(200)]  # a group that is larger than a partition
    rows += [(3, "en", "copy of a line")] * 60 + [(None, "en", "copy of a line")] * 3 + [(None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("fingerprint", [F.xxhash64, lambda c: F.lit(7).cast("long"), lambda c: F.length(c).cast("long")])
@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_odd_rows_and_colliding_fingerprints(spark, fingerprint, partitions):
    rows = odd_rows()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 700, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5).selectExpr("*", "1 AS id", "'p' AS part", "2 AS fp", "3 AS place", "4 AS mask", "5 AS first", "6 AS least")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'g' AS good", "9 AS id", "'p' AS part")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        masks = naive_mask(rows)
        want = Counter((i, p or "", masks[n]) for n, (i, p, _) in enumerate(rows))
        found = audit.failure_masks(df, fingerprint=fingerprint)
        assert Counter((r.id, r.part, r.mask) for r in found.collect()) == want
        assert got(audit.audit(df, marks, fingerprint=fingerprint)) == naive_audit(rows, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(empty, none).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, lang string, text string")
    rows = audit.audit(one, none).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert sum(r.removed for r in rows) == 120


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "x", "Aa"), (2, "x", "aa"), (3, "y", "aa")], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = audit.audit(docs, labels, filters={"U": lambda f: f.upper > 0}).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r.part][r.filter_order, r.step] = (r.kept, r.removed, r.shapley, r.good_lost)
    assert by["x"] == {("UE", 1): (1, 1, 2, 0), ("UE", 2): (1, 0, 0, 0), ("EU", 1): (2, 0, 0, 0), ("EU", 2): (1, 1, 2, 0)}
    assert by["y"]["UE", 2] == (0, 1, 2, 1)
    with pytest.raises(ValueError):
        audit.audit(docs, labels, filters={"E": lambda f: True})
