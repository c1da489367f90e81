"""Line dedup by pairwise alignment.

Documents are paired through shared lines: a line of at most ``RARE`` places in
the corpus pairs all its holders, a commoner one each later holder with its
first.  So that a passage of nothing but common lines is found too, the
shortest runs of adjacent lines of ``min_words`` words or more, one from each
line on and one up to each line, pair documents in the same way as common
lines.  Pairs grow with the lines and not with the square of a frequency.

Each pair is aligned by patience diff: lines that stand once in both documents
and rise in both are anchors, anchors grow along equal neighbours, and the gaps
between them are aligned alike.  An aligned block is extended along its diagonal
over all equal lines, also those beside which another anchor stood, and then
leaves the pair, and what is left is aligned again until no equal line is left.
So passages that repeat or stand in another order are not missed.  Aligned blocks
of ``min_words`` words or more are deleted from the later document.

Only matching places travel, never whole documents, so a long document that
shares a passage with many others costs no more than that passage.  Lines and
runs are compared by 128 bits of hash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words in an aligned block from which it is deleted.
MIN_WORDS = 20
#: Places in the corpus up to which a line is rare and pairs all its holders.
RARE = 6
#: End of the last range of lines that stay.
FAR = (1 << 31) - 1

Match = tuple[int, int]


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of ``pairs`` (sorted by the first) whose second
    members rise."""
    tails, ends, back = [], [], [-1] * len(pairs)
    for k, (_, e) in enumerate(pairs):
        at = bisect_left(tails, e)
        if at == len(tails):
            tails.append(e)
            ends.append(k)
        else:
            tails[at], ends[at] = e, k
        back[k] = ends[at - 1] if at else -1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def grown(anchors: list[Match], have: set[Match]) -> list[Match]:
    """``anchors``, which rise in both, with the equal neighbours before and
    after each that do not cross another."""
    out: list[Match] = []
    for at, (l, e) in enumerate(anchors):
        low = out[-1] if out else (-1, -1)
        if l <= low[0] or e <= low[1]:
            continue
        back, m = [], (l - 1, e - 1)
        while m in have and m[0] > low[0] and m[1] > low[1]:
            back.append(m)
            m = m[0] - 1, m[1] - 1
        out += back[::-1]
        out.append((l, e))
        high = anchors[at + 1] if at + 1 < len(anchors) else (FAR, FAR)
        m = l + 1, e + 1
        while m in have and m[0] < high[0] and m[1] < high[1]:
            out.append(m)
            m = m[0] + 1, m[1] + 1
    return out


def common_runs(matches) -> list[list[Match]]:
    """Runs of matches that are one apart in both documents."""
    out: list[list[Match]] = []
    for m in sorted(matches, key=lambda m: (m[1] - m[0], m[0])):
        if out and out[-1][-1] == (m[0] - 1, m[1] - 1):
            out[-1].append(m)
        else:
            out.append([m])
    return out


def extended(m: Match, have) -> list[Match]:
    """The run of ``have`` that holds ``m``, as far as it goes both ways."""
    first = m
    while (first[0] - 1, first[1] - 1) in have:
        first = first[0] - 1, first[1] - 1
    run = [first]
    while (run[-1][0] + 1, run[-1][1] + 1) in have:
        run.append((run[-1][0] + 1, run[-1][1] + 1))
    return run


def without_anchors(part: list[Match]) -> list[Match]:
    """Alignment of a gap in which no line is unique: its common runs, longest
    first, those that cross a longer one left out."""
    kept: list[list[Match]] = []
    for run in sorted(common_runs(part), key=lambda r: (-len(r), r[0])):
        at = bisect_left(kept, run)
        if at and not (kept[at - 1][-1][0] < run[0][0] and kept[at - 1][-1][1] < run[0][1]):
            continue
        if at < len(kept) and not (run[-1][0] < kept[at][0][0] and run[-1][1] < kept[at][0][1]):
            continue
        kept.insert(at, run)
    return [m for run in kept for m in run]


def patience(matches: list[Match], once: set[Match]) -> list[Match]:
    """Patience diff: aligned (line in the later, line in the earlier document),
    rising in both.

    ``once``: matches of lines that stand once in both documents, the first
    anchors.  Within a gap a line is unique if it has one match there."""
    out, waiting = [], [(sorted(matches), once)]
    while waiting:
        part, unique = waiting.pop()
        if unique is None:
            later, earlier = Counter(l for l, _ in part), Counter(e for _, e in part)
            unique = {(l, e) for l, e in part if later[l] == earlier[e] == 1}
        anchors = chain([m for m in part if m in unique])
        if not anchors:
            if unique is once and part:
                waiting.append((part, None))
            else:
                out += without_anchors(part)
            continue
        found = grown(anchors, set(part))
        out += found
        starts, gaps = [l for l, _ in found], {}
        for m in part:
            at = bisect_left(starts, m[0])
            if (at == len(found) or (m[0] < found[at][0] and m[1] < found[at][1])) and (not at or m[1] > found[at - 1][1]):
                gaps.setdefault(at, []).append(m)
        waiting += [(gap, None) for gap in gaps.values()]
    return sorted(out)


def aligned_blocks(matches: list[tuple], min_words: int) -> list[tuple[int, int]]:
    """Ranges [first, end) of the later document's lines, by ordinal, to delete.

    ``matches``: (ordinal in the later, ordinal in the earlier document, words,
    whether the line stands once in both)."""
    words = {(l, e): w for l, e, w, _ in matches}
    once = {(l, e) for l, e, _, alone in matches if alone}

    found, left = [], set(words)
    while left:
        aligned = patience(sorted(left), once & left)
        for m in aligned:
            if m in left:
                run = extended(m, words)
                left.difference_update(run)
                if sum(words[x] for x in run) >= min_words:
                    found.append((run[0][0], run[-1][0] + 1))
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if merged and lo <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(hi, merged[-1][1])
        else:
            merged.append((lo, hi))
    return merged


def runs(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Ranges [first, end) of lines: the shortest run of ``min_words`` words or
    more from each line on, and the shortest up to each line."""
    total = list(accumulate(words, initial=0))
    out, end, first = set(), 0, 0
    for a in range(len(words)):
        end = max(end, a + 1)
        while end <= len(words) and total[end] - total[a] < min_words:
            end += 1
        if end > len(words):
            break
        out.add((a, end))
    for b in range(1, len(words) + 1):
        while first + 1 < b and total[b] - total[first + 1] >= min_words:
            first += 1
        if total[b] - total[first] >= min_words:
            out.add((first, b))
    return sorted(out)


def _keys(min_words: int):
    """Documents to their keys: each line and each run of several lines, with
    the words and the places of its lines, and whether each stands once in its
    document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import xxhash

        digest = xxhash.xxh3_128_digest
        for part in batches:
            out = []
            for i, k, h, g, words, pos in zip(*(part[c].tolist() for c in ("id", "k", "h", "g", "words", "pos"))):
                both = np.column_stack((h, g))
                raw = both.tobytes()
                lines = [raw[a : a + 16] for a in range(0, len(raw), 16)]
                held = Counter(lines)
                alone = [held[x] == 1 for x in lines]
                for a, b in [*((a, a + 1) for a in range(len(lines))), *(r for r in runs(words.tolist(), min_words) if r[1] > r[0] + 1)]:
                    key = np.frombuffer(digest(raw[16 * a : 16 * b]), "<i8")
                    out.append((i, k, a, key[0], key[1], alone[a:b], words[a:b], pos[a:b]))
            yield pd.DataFrame(out, columns=["id", "k", "ord", "h", "g", "once", "words", "pos"])

    return run


def _edits(min_words: int):
    keys = ["id", "k"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in common.whole_groups(batches, keys, rows=1 << 13):
            out = []
            cols = [part[c].tolist() for c in ("id", "k", "fid", "fk", "ord", "ford", "once", "words", "pos")]
            n, a = len(part), 0
            while a < n:
                b = a
                gone, pos_of = set(), {}
                while b < n and cols[0][b] == cols[0][a] and cols[1][b] == cols[1][a]:
                    c, found = b, {}
                    while c < n and all(cols[i][c] == cols[i][b] for i in range(4)):
                        for j, (alone, w, p) in enumerate(zip(cols[6][c], cols[7][c], cols[8][c])):
                            l, e = cols[4][c] + j, cols[5][c] + j
                            pos_of[l] = p
                            found[l, e] = int(w), bool(alone)
                        c += 1
                    for lo, hi in aligned_blocks([(*m, *w) for m, w in found.items()], min_words):
                        gone.update(range(lo, hi))
                    b = c
                if gone:
                    lines, starts, sizes, at = sorted(pos_of[o] for o in gone), [], [], 0
                    for p in lines:
                        if p > at:
                            starts.append(at)
                            sizes.append(p - at)
                        at = p + 1
                    starts.append(at)
                    sizes.append(FAR - at)
                    out.append((cols[0][a], cols[1][a], len(lines), starts, sizes))
                a = b
            yield pd.DataFrame(out, columns=["id", "k", "gone", "starts", "sizes"])

    return run


def matching_places(rows: DataFrame, rare: int = RARE) -> DataFrame:
    """(id, k, fid, fk, ord, ford, once, words, pos): the places at which a
    document and an earlier one hold the same key, ``rows`` as of ``_keys``."""
    info = rows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("id", "k", "ord", "once")).alias("f"), F.max(F.struct("id", "k")).alias("l"))
    info = common.cut(info.where("f.id <> l.id or f.k <> l.k").drop("l"))
    held = common.cut(common.keyed_join(rows, info, ["h", "g"], "n"))
    firsts = held.where("id <> f.id or k <> f.k").select("id", "k", F.col("f.id").alias("fid"), F.col("f.k").alias("fk"), "ord", F.col("f.ord").alias("ford"), F.zip_with("once", "f.once", lambda x, y: x & y).alias("once"), "words", "pos")
    # Rare lines pair all their holders; with two places the first is all.
    few = held.where(F.col("n").between(3, rare) & (F.size("words") == 1))
    few = few.groupBy("h", "g").agg(F.first("f").alias("f"), F.collect_list(F.struct("id", "k", "ord", "once", "words", "pos")).alias("x"))
    few = few.select("f", "x", F.explode("x").alias("a")).select("f", "a", F.explode("x").alias("b"))
    earlier = F.struct("b.id", "b.k") < F.struct("a.id", "a.k")
    others = F.struct("b.id", "b.k") > F.struct("f.id", "f.k")
    pairs = few.where(earlier & others).select("a.id", "a.k", F.col("b.id").alias("fid"), F.col("b.k").alias("fk"), "a.ord", F.col("b.ord").alias("ford"), F.zip_with("a.once", "b.once", lambda x, y: x & y).alias("once"), "a.words", "a.pos")
    return firsts.union(pairs)


def edits(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, k, gone, starts, sizes): the number of lines deleted and the ranges
    of lines that stay, one row per edited (id, hash of text)."""
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("t"))), lambda x: x["t"] != "")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    rows = rows.select("id", F.xxhash64("text").alias("k"), lines.alias("x"))
    words = lambda x: F.length(x["t"]) - F.length(F.translate(x["t"], " ", "")) + 1
    rows = rows.select(
        "id", "k", F.transform("x", lambda x: F.xxhash64(x["t"])).alias("h"), F.transform("x", lambda x: F.xxhash64(F.lit("second"), x["t"])).alias("g"),
        F.transform("x", words).alias("words"), F.col("x.pos").alias("pos"),
    )
    rows = common.cut(rows.mapInPandas(_keys(min_words), "id long, k long, ord int, h long, g long, once array<boolean>, words array<int>, pos array<int>"))
    shared = matching_places(rows)
    dealt = shared.repartition("id", "k").sortWithinPartitions("id", "k", "fid", "fk", "ord")
    return dealt.mapInPandas(_edits(min_words), "id long, k long, gone int, starts array<int>, sizes array<int>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, count_col: str | None = None) -> DataFrame:
    """``docs`` with repeated blocks of lines deleted from later documents.

    "Later" is by id, then by hash of the text.  Rows that repeat both are one
    document and are edited alike; rows with a null id or text stay as they
    are; an exact copy loses its long blocks and may become empty.  Lines are
    compared without blanks at their ends, blank lines are not compared and
    stay.  Rows and columns stay, n_chars follows the text; ``count_col`` adds
    the number of lines deleted.  An empty table gives no rows."""
    common.configure(docs.sparkSession)
    i, k, gone, starts, sizes, new = common.fresh(docs, "id", "k", "gone", "starts", "sizes", "new")
    found = edits(docs, id_col, text_col, min_words).toDF(i, k, gone, starts, sizes)
    t = F.col(text_col)
    kept = F.flatten(F.zip_with(starts, sizes, lambda s, n: F.slice(F.split(t, "\n"), s + 1, n)))
    joined = docs.join(found, (F.col(id_col).cast("long") == F.col(i)) & (F.xxhash64(t) == F.col(k)), "left")
    joined = joined.withColumn(new, F.when(F.col(gone).isNull(), t).otherwise(F.array_join(kept, "\n")))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col(new).alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(new)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    if count_col:
        cols.append(F.coalesce(gone, F.lit(0)).cast("long").alias(count_col))
    return joined.select(cols)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, count_col="lines_deleted")


#: The result by its definition: a line goes if it stands in a run of
#: ``MIN_WORDS`` words that an earlier document holds; shortest runs cover all.
ORACLE_SQL = f"""WITH ln AS (SELECT doc_id, i AS pos, l[i] AS raw, trim(l[i], ' ') AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) d, unnest(range(1, len(l) + 1)) r(i)),
nb AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY o) AS upto FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS o, length(t) - length(replace(t, ' ', '')) + 1 AS w FROM ln WHERE t <> '') x),
pr AS (SELECT a.doc_id, a.o AS a, b.o AS b FROM nb a JOIN nb b ON b.doc_id = a.doc_id AND b.o BETWEEN a.o AND a.o + {MIN_WORDS - 1} WHERE b.upto - a.upto + a.w >= {MIN_WORDS}),
runs AS (SELECT doc_id, a, min(b) AS b FROM pr GROUP BY doc_id, a UNION SELECT doc_id, max(a) AS a, b FROM pr GROUP BY doc_id, b),
keyed AS (SELECT r.doc_id, r.a, r.b, string_agg(n.t, chr(10) ORDER BY n.o) AS words FROM runs r JOIN nb n ON n.doc_id = r.doc_id AND n.o BETWEEN r.a AND r.b GROUP BY r.doc_id, r.a, r.b),
held AS (SELECT doc_id, a, b FROM (SELECT *, min(doc_id) OVER (PARTITION BY words) AS first FROM keyed) k WHERE first < doc_id),
gone AS (SELECT DISTINCT n.doc_id, n.pos FROM held h JOIN nb n ON n.doc_id = h.doc_id AND n.o BETWEEN h.a AND h.b),
kept AS (SELECT ln.doc_id, string_agg(ln.raw, chr(10) ORDER BY ln.pos) FILTER (g.pos IS NULL) AS text, count(g.pos) AS n FROM ln LEFT JOIN gone g ON g.doc_id = ln.doc_id AND g.pos = ln.pos GROUP BY ln.doc_id)
SELECT d.doc_id, CASE WHEN kept.n > 0 THEN coalesce(kept.text, '') ELSE d.text END AS text, coalesce(kept.n, 0) AS lines_deleted FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id"""
