"""SimHash near-duplicate classes by pigeonhole blocks.

Fingerprints of 64 bits are cut into ``BLOCKS`` blocks.  Two fingerprints that
differ in at most ``distance`` bits leave at least ``BLOCKS - distance`` blocks
equal, so each such pair meets under at least one key made of that many blocks.
Groups of one key are verified by Hamming distance, and only a spanning forest
of the links found leaves the group, so a group of n near copies emits fewer
than n links and not n*n/2.  Exact copies share a fingerprint and are collapsed
before any join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = 6
#: Largest group that one task compares as a whole; larger groups are dealt out
#: as pairs of chunks of this size.
GROUP = 1024
#: Rows of shingles whose bits are counted at a time.
SPAN = 1 << 15
#: A table of hot keys is broadcast up to this many rows (16 bytes each).
HOT_ROWS = 50_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the text's word shingles; 0 without words.

    Only A-Z are lower-cased; words end at ASCII white space.  Memory beyond
    the text's words is bounded by ``SPAN``.
    """
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = len(words)
    if n <= shingle:
        total = 1
        h = np.array([xxhash.xxh64_intdigest(flat, seed)], dtype=np.uint64)
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    else:
        del words
        gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.concatenate((gaps, [len(flat)]))
        total = n - shingle + 1
        ones = np.zeros(64, dtype=np.int64)
        digest = xxhash.xxh64_intdigest
        for lo in range(0, total, SPAN):
            hi = min(total, lo + SPAN)
            a, b = starts[lo:hi].tolist(), ends[lo + shingle - 1 : hi + shingle - 1].tolist()
            h = np.array([digest(flat[x:y], seed) for x, y in zip(a, b)], dtype=np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > total).astype(np.uint8)
    return int(np.packbits(bits).view(np.int64)[0])


def fingerprints(text: Column | str, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    return udf(text)


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _masks(blocks: int, keep: int) -> list[int]:
    """Signed masks, one for each choice of ``keep`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    found = [sum(c) for c in combinations(parts, keep)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _verified(distance: int):
    """Batches sorted by group to links (a, b) that span each group's links."""

    def links(key, fp) -> list[tuple]:
        import numpy as np

        out = []
        if len(fp) < 2:
            return out
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        sizes = np.diff(np.concatenate((new, [len(fp)])))
        group = np.repeat(np.arange(len(new)), sizes)
        small = np.flatnonzero((sizes > 1) & (sizes <= 8))
        keep = np.isin(group, small)
        g, v = group[keep], fp[keep]
        for d in range(1, 8):  # all pairs of small groups, vectorised over groups
            if len(v) <= d:
                break
            hit = (g[d:] == g[:-d]) & (np.bitwise_count(v[d:] ^ v[:-d]) <= distance)
            out += zip(v[d:][hit].tolist(), v[:-d][hit].tolist())
        for k in np.flatnonzero(sizes > 8):
            x = np.unique(fp[new[k] : new[k] + sizes[k]])
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= distance
            np.fill_diagonal(near, False)
            out += [(int(x[a]), int(x[b])) for a, b in common.forest(near, np.arange(len(x)))]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows):
            return pd.DataFrame(rows, columns=["a", "b"], dtype="int64").drop_duplicates()

        for part in common.whole_groups(batches, ["i", "k", "c", "d"]):
            yield frame(links(part[["i", "k", "c", "d"]].to_numpy(dtype="int64"), part["fp"].to_numpy(dtype="int64")))

    return run


def hamming_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """Links (a, b) that connect every pair of values of ``fp`` (distinct longs)
    within ``distance`` bits, directly or through other such links."""
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_masks(blocks, blocks - distance))])
    rows = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.i", "x.k")
    hot = common.cut(rows.groupBy("i", "k").count().where(F.col("count") > group))
    n_hot = hot.count()
    if n_hot:
        side = hot.select("i", "k", F.ceil(F.col("count") / group).cast("int").alias("p"))
        rows = rows.join(F.broadcast(side) if n_hot <= HOT_ROWS else side, ["i", "k"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("p")).cast("int")
        rows = (
            rows.withColumn("own", F.when(F.col("p").isNull(), 0).otherwise(own))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("p"), F.lit(1)) - 1)))
            .withColumn("c", F.least("own", "other")).withColumn("d", F.greatest("own", "other"))
        )
    else:
        rows = rows.withColumn("c", F.lit(0)).withColumn("d", F.lit(0))
    dealt = rows.select("i", "k", "c", "d", "fp").repartition("i", "k", "c", "d").sortWithinPartitions("i", "k", "c", "d")
    return dealt.mapInPandas(_verified(distance), "a long, b long")


def linked(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE, blocks: int = BLOCKS,
) -> DataFrame:
    """(id, k, fp, first), one row per input row: ``k`` is the hash of the text,
    ``first`` the least (id, k) of the row's component, null if no row of it has
    an id."""
    base = common.cut(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k"), fingerprints(F.col(text_col), shingle, seed).alias("fp")))
    classes = common.cut(base.groupBy("fp").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "k"))).alias("first"), F.count("*").alias("many")))
    comp = common.connected_components(hamming_links(classes.select("fp"), distance, blocks))
    named = common.cut(classes.join(comp, classes.fp == comp.node, "left").select("fp", "first", "many", F.coalesce("component", "fp").alias("root")))
    least = common.cut(named.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("size")))
    by_fp = common.cut(common.keyed_join(named.select("fp", "root", "many"), least, ["root"], "size").select("fp", "many", "first"))
    return common.keyed_join(base, by_fp, ["fp"], "many").select("id", "k", "fp", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, fingerprint, component_id), one row per input row; ``options`` as of
    ``linked``.

    Null and wordless texts have fingerprint zero and link like any other.
    Repeated rows and copies get equal values; a null id keeps its row and is
    never a component id unless the whole component has none.  Other columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    found = linked(docs, id_col, text_col, **options)
    return found.select(F.col("id").alias(id_col), hexed(F.col("fp")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their class: of each component the
    row of the smallest id, and of several texts of that id the one of the
    smallest hash.  A document is an id and a text: texts that share an id but
    no component are all kept, rows that repeat both stay once; rows without an
    id stay; null and wordless texts are one class; an empty table gives no rows.

    Links join fingerprints within ``distance`` bits or, if a ``similarity`` is
    given, texts of that Jaccard similarity or more on shingles of five words:
    fingerprints then propose pairs, with the help of the sets' minima where 64
    bits do not reach, and the whole sets decide."""
    from . import nearcopies  # which takes the blocks from here

    common.configure(docs.sparkSession)
    at, i, h = common.fresh(docs, "k", "gone_id", "gone_k")
    named = docs.where(F.col(id_col).isNotNull()).withColumn(at, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    find = linked if similarity is None else nearcopies.linked
    more = options if similarity is None else options | {"similarity": similarity}
    found = find(named, id_col, text_col, **more)
    gone = found.where(F.struct("id", "k") != F.col("first")).select(F.col("id").alias(i), F.col("k").alias(h)).distinct()
    kept = named.join(gone, (F.col(id_col).cast("long") == F.col(i)) & (F.col(at) == F.col(h)), "left_anti")
    return kept.dropDuplicates([id_col, at]).drop(at).unionByName(docs.where(F.col(id_col).isNull()))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
