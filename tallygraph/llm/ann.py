"""Approximate nearest neighbours by shifted space-filling curves.

Each of ``curves`` random projections, shifted and laid on a grid, gives every
vector a position on a Hilbert curve.  Spark range-partitions the positions of
a curve, which yields each vector's rank on it.  A query meets the vectors whose
rank differs from its own by the window's reach or less, on every curve, and
what the windows found is merged and ranked by the inner product of the
original vectors.  Ranks are cut into blocks only to deal out the work: which
pairs are compared does not depend on them.  Equal vectors are one row, with
their smallest ids.

No curve keeps the neighbourhoods of vectors that fill all their dimensions
evenly, so the window is a share of the rows there, ``fraction``; for vectors
of low intrinsic dimension a fixed ``window`` is enough and ``fraction`` may be
zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .embdedup import real, usable
from .hilbert import hilbert_keys

K = 20
CURVES = 16
DIMS, BITS = 6, 10
#: Ranks to either side of a query that are searched: the larger of both.
WINDOW, FRACTION = 64, 0.05
#: Most rows per block, which bounds a task's memory; no result depends on it.
BLOCK = 2048
#: Rows from which the mean and spread of the projections are taken.
FIT_SAMPLE = 4096
SEED = 20


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
    curves: int = CURVES, window: int = WINDOW, fraction: float = FRACTION,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query.

    ``queries`` holds ids of rows of ``vectors``.  Ties go to the smaller id;
    fewer candidates give fewer rows.  Rows with a null id, or a vector that is
    null, zero or holds null or non-finite components, take no part.  A query
    is compared with vectors of its own width.  Rows that repeat an id and
    vector count once.  Other columns are ignored; empty tables give no rows.
    """
    common.configure(vectors.sparkSession)
    base = vectors.select(F.col(id_col).cast("long").alias("id"), real(vectors, vec_col).alias("vec"))
    base = base.where("id is not null").where(usable("vec"))
    ranked = base.distinct().withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = ranked.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes, node = common.numbered(classes, "vec")
    classes = classes.select("node", "vec", "ids", F.col("ids")[0].alias("first"))
    asked = base.join(queries.select(F.col(queries.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi")
    asked = common.cut(asked.select(F.col("id").alias("query_id"), node.alias("node"), F.size("vec").alias("w")).distinct())
    tops = None
    for w, n in sorted((r.w, r.n) for r in classes.groupBy(F.size("vec").alias("w")).agg(F.count("*").alias("n")).collect()):
        top = _search(classes.where(F.size("vec") == w), asked.where(F.col("w") == w), n, k, curves, window, fraction)
        tops = top if tops is None else tops.unionByName(top)
    if tops is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tops = common.cut(tops)
    found = tops.select("qnode", F.explode(F.arrays_zip("nodes", "scores")).alias("x")).select("qnode", F.col("x.nodes").alias("node"), F.col("x.scores").alias("score"))
    found = found.join(classes.select("node", "ids"), "node").select("qnode", "score", F.explode("ids").alias("vec_id"))
    rows = asked.join(found, asked.node == found.qnode).where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(classes: DataFrame, asked: DataFrame, n: int, k: int, curves: int, window: int, fraction: float) -> DataFrame:
    spark = classes.sparkSession
    fit = np.array([r.vec for r in classes.orderBy("node").limit(FIT_SAMPLE).select("vec").collect()], dtype=float)
    width, rng = fit.shape[1], np.random.default_rng(SEED)
    dims = min(DIMS, width)
    plan = []
    for _ in range(curves):
        axes = np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims]
        y = fit @ axes
        plan.append((axes, y.mean(axis=0), max(float(y.std()), 1e-12), rng.uniform(-0.125, 0.125, size=dims)))
    sent = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("array<long>")
    def positions(vecs: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype=object)
        x, keys = np.array(vecs.tolist(), dtype=float), []
        for axes, mean, spread, shift in sent.value:
            cell = ((x @ axes - mean) / (8 * spread) + 0.5 + shift) * (1 << BITS)
            keys.append(hilbert_keys(np.clip(cell, 0, (1 << BITS) - 1).astype(np.int64), BITS).astype(np.int64))
        return pd.Series(list(np.array(keys).T))

    rows = classes.select("node", F.posexplode(positions("vec")).alias("curve", "key"))
    rows = rows.repartitionByRange("curve", "key", "node").sortWithinPartitions("curve", "key", "node")
    at = F.monotonically_increasing_id()
    # Fixed from here on: range borders come from a sample of the rows.
    rows = common.cut(rows.select("curve", "node", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("pos")))
    # One row per partition.
    sizes = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, m in sizes:
        offsets.append((part, total))
        total += m
    before = spark.createDataFrame(offsets, "part long, before long")
    ranks = rows.join(F.broadcast(before), "part").select("curve", "node", (F.col("pos") + F.col("before") - F.col("curve") * n).alias("rank"))
    reach = max(window, int(np.ceil(fraction * n)))
    block = min(BLOCK, reach)
    last = (n - 1) // block
    qnodes = asked.select("node").distinct()
    visits = ranks.join(qnodes, "node", "left_semi").select(
        "curve", "node", "rank",
        F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("rank") - reach) / block)), F.least(F.lit(last), F.floor((F.col("rank") + reach) / block)))).alias("block"),
    )
    vecs = classes.select("node", "vec", "first")
    left = visits.join(vecs, "node").select("curve", "block", "node", "rank", "vec", "first", F.lit(True).alias("asks"))
    right = ranks.join(vecs, "node").select("curve", F.floor(F.col("rank") / block).alias("block"), "node", "rank", "vec", "first", F.lit(False).alias("asks"))
    kept = k + 1  # the query's own class may be among them

    def best(both: pd.DataFrame) -> pd.DataFrame:
        q, c = both[both["asks"]], both[~both["asks"]]
        out = []
        if len(q) and len(c):
            c = c.sort_values("rank")
            x, y = np.array(q.vec.tolist(), dtype=float), np.array(c.vec.tolist(), dtype=float)
            nodes, first, at = c.node.to_numpy(), c["first"].to_numpy(), c["rank"].to_numpy()
            s = x @ y.T
            lows, highs = np.searchsorted(at, q["rank"].to_numpy() - reach), np.searchsorted(at, q["rank"].to_numpy() + reach, "right")
            for i, (node, lo, hi) in enumerate(zip(q.node, lows, highs)):
                if lo == hi:
                    continue
                near = s[i, lo:hi]
                # all that may be among the best, whatever the order of addition
                edge = np.partition(near, -kept)[-kept] - 1e-9 * (1 + np.abs(near).max()) if hi - lo > kept else -np.inf
                j = lo + np.flatnonzero(near >= edge)
                exact = (y[j] * x[i]).sum(axis=1)
                o = np.lexsort((first[j], -exact))[:kept]
                out.append((node, nodes[j][o], exact[o], first[j][o], hi - lo))
        return pd.DataFrame(out, columns=["qnode", "nodes", "scores", "firsts", "met"])

    lists = "qnode long, nodes array<long>, scores array<double>, firsts array<long>, met long"
    found = left.union(right).groupBy("curve", "block").applyInPandas(best, lists).drop("met")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate(pdf.nodes.tolist()), return_index=True)
        scores, first = np.concatenate(pdf.scores.tolist())[at], np.concatenate(pdf.firsts.tolist())[at]
        o = np.lexsort((first, -scores))[:kept]
        return pd.DataFrame({"qnode": [pdf.qnode.iloc[0]], "nodes": [nodes[o]], "scores": [scores[o]]})

    return found.groupBy("qnode").applyInPandas(merged, "qnode long, nodes array<long>, scores array<double>")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"))
