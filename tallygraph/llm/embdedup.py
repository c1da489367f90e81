"""Embedding near-duplicates: an exact metric range join.

Unit vectors are dealt to the cell of their nearest pivot.  For a pair within
chord ``eps`` of each other whose homes are cells i and j, the triangle
inequality bounds how far either lies beyond the border of the other's cell:
x is copied to cell j only if (|x-pj|^2 - |x-pi|^2) / (2|pi-pj|) <= eps and
|x-pj| <= radius(j) + eps.  A pair is joined in the cell of the lower number
only, so rows travel to lower cells; both ends count the link there.  Within a
cell rows are sorted by their distance to the pivot, and a strip of them meets
only rows whose distance differs by eps or less, by the triangle inequality
again.  Equal vectors are one row with a multiplicity.  Large cells are dealt
out as pairs of chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COSINE = 0.95
#: Pivots come from the rows of smallest hash; at most this many are compared.
PIVOT_SAMPLE = 4096
#: Pivots: the square root of the rows times ``DENSITY``, between these bounds
#: (their table, 8 bytes x width each, is sent to every executor).
DENSITY, MIN_PIVOTS, MAX_PIVOTS = 0.125, 4, 2048
#: Rows of one side of a task's join, and rows of a strip within it.
CHUNK, STRIP = 2048, 128
SLACK = 1e-9


def usable(vec: str = "embedding"):
    """Column: a vector with a direction: not null, no null or non-finite
    component, not all zero."""
    v = F.col(vec)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def real(vectors: DataFrame, vec_col: str):
    """The vectors as floats if they are floats, else as doubles."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    return F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")


def _pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """Far-apart pivots from a bounded sample: each is the row farthest from
    those before it."""
    rows = vectors.orderBy(F.xxhash64("vec"), "first").limit(PIVOT_SAMPLE).select("vec").collect()
    x = np.array([r.vec for r in rows], dtype=float).reshape(len(rows), -1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int(min(MAX_PIVOTS, max(MIN_PIVOTS, n**0.5 * DENSITY), len(x)))
    chosen, best = [0], x @ x[0]
    while len(chosen) < want:
        k = int(np.argmin(best))
        if best[k] > 1 - 1e-12:
            break
        chosen.append(k)
        best = np.maximum(best, x @ x[k])
    return x[chosen]


def range_join(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row.

    Links join rows with cosine >= ``cosine`` in double precision; n_links
    counts other rows linked directly, component_id is the smallest id
    reachable.  Rows with an unusable vector, and rows whose width differs from
    that of a partner, link with nothing.  Repeated ids count as rows of their
    own.  Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    common.configure(spark)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), real(vectors, vec_col).alias("vec"))
    src = src.withColumn("ok", usable("vec"))
    classes = src.where("ok").groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("many"))
    classes, node = common.numbered(classes, "vec")
    out = []
    widths = [r.w for r in classes.select(F.size("vec").alias("w")).distinct().collect()]
    for w in widths:
        out.append(_join_width(classes.where(F.size("vec") == w), cosine))
    if not out:
        done = src.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        found = out[0]
        for x in out[1:]:
            found = found.unionByName(x)
        found = common.cut(found)
        counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
        comp = common.connected_components(found.where("b is not null").select("a", "b"))
        named = common.cut(
            classes.join(counts, classes.node == counts.a, "left").drop("a")
            .join(comp.withColumnRenamed("node", "cnode"), F.col("node") == F.col("cnode"), "left")
            .select("node", "first", "many", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
        )
        least = common.cut(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size")))
        named = common.cut(common.keyed_join(named.drop("first"), least, ["root"], "size").select("node", "many", "n_links", "component_id"))
        rows = src.where("ok").select("id", node.alias("node"))
        good = common.keyed_join(rows, named, ["node"], "many").select("id", "n_links", "component_id")
        done = good.union(src.where("not ok").select("id", F.lit(0).cast("long"), "id"))
    return done.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _join_width(classes: DataFrame, cosine: float) -> DataFrame:
    """Counts (a, null, n) and spanning links (a, b, null) over vectors of one
    width."""
    spark = classes.sparkSession
    n = classes.count()
    pivots = _pivots(classes, n)
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    sent = spark.sparkContext.broadcast(pivots)

    def unit(vecs) -> np.ndarray:
        x = np.array(vecs.tolist(), dtype=float)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    @F.pandas_udf("struct<home: int, far: double>")
    def homes(vecs: pd.Series) -> pd.DataFrame:
        if not len(vecs):
            return pd.DataFrame({"home": [], "far": []})
        s = unit(vecs) @ sent.value.T
        best = s.argmax(axis=1)
        return pd.DataFrame({"home": best, "far": np.sqrt(np.maximum(0, 2 - 2 * s[np.arange(len(s)), best]))})

    homed = common.cut(classes.select("node", "many", "vec", homes("vec").alias("h")).select("node", "many", "vec", "h.home", "h.far"))
    # One row per pivot, so at most MAX_PIVOTS.
    info = {r.home: (r.r, r.n) for r in homed.groupBy("home").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect()}
    radius = np.array([info[j][0] if j in info else -10.0 for j in range(len(pivots))])
    apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))
    shared = spark.sparkContext.broadcast((radius, apart))

    @F.pandas_udf("array<int>")
    def cells(vecs: pd.Series, home: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype=object)
        r, ap = shared.value
        h = home.to_numpy()
        d2 = np.maximum(0, 2 - 2 * (unit(vecs) @ sent.value.T))
        own = d2[np.arange(len(h)), h]
        near = (d2 - own[:, None] <= 2 * ap[h] * eps + SLACK) & (np.sqrt(d2) <= r[None, :] + eps)
        near &= np.arange(len(r))[None, :] < h[:, None]  # a pair meets in the lower cell
        near[np.arange(len(h)), h] = True
        return pd.Series([np.flatnonzero(x).astype("int32") for x in near])

    dealt = common.cut(homed.select("node", "many", "vec", "home", F.explode(cells("vec", "home")).alias("cell")))
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("all"), F.count_if(F.col("home") == F.col("cell")).alias("own"))
    parts = sizes.select("cell", F.ceil(F.col("own") / CHUNK).cast("int").alias("po"), F.ceil(F.col("all") / CHUNK).cast("int").alias("pa")).where("po > 0")
    cut_rows = dealt.join(F.broadcast(parts), "cell").withColumn("guest", F.col("home") != F.col("cell"))  # at most MAX_PIVOTS rows
    left = (
        cut_rows.where("home = cell")
        .withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("po")).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pa") - 1)))
    )
    right = (
        cut_rows.withColumn("j", F.pmod(F.xxhash64("node", F.lit(2)), F.col("pa")).cast("int"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("po") - 1)))
    )
    cols = ["cell", "i", "j", "node", "many", "vec", "guest"]

    def join(both: pd.DataFrame) -> pd.DataFrame:
        a, b = both[both["home"]], both[~both["home"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        pivot = sent.value[int(both.cell.iloc[0])]

        def sorted_by_pivot(x: pd.DataFrame):
            v = unit(x.vec)
            far = np.sqrt(np.maximum(0, 2 - 2 * (v @ pivot)))
            o = np.argsort(far, kind="stable")
            return v[o], far[o], x.node.to_numpy()[o], x.many.to_numpy()[o], x.guest.to_numpy()[o]

        xa, fa, na, ma, _ = sorted_by_pivot(a)
        xb, fb, nb, mb, guest = sorted_by_pivot(b)
        rows, cols_ = [], []
        for lo in range(0, len(xa), STRIP):
            hi = min(len(xa), lo + STRIP)
            first, last = np.searchsorted(fb, (fa[lo] - eps, fa[hi - 1] + eps + SLACK))
            r, c = np.nonzero((xa[lo:hi] @ xb[first:last].T >= cosine) & (na[lo:hi, None] != nb[None, first:last]))
            rows.append(r + lo)
            cols_.append(c + first)
        r, c = np.concatenate(rows), np.concatenate(cols_)
        # home rows count all their links here, guests theirs with home rows
        away = guest[c]
        ends = np.concatenate((na[r], nb[c[away]]))
        weights = np.concatenate((mb[c], ma[r[away]]))
        counted, at = np.unique(ends, return_inverse=True)
        n = np.bincount(at, weights=weights, minlength=len(counted)).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        # a forest over the rows of both sides that have a link
        nodes, inv = np.unique(np.concatenate((na[r], nb[c])), return_inverse=True)
        links = np.zeros((len(nodes), len(nodes)), dtype=bool)
        links[inv[: len(r)], inv[len(r) :]] = True
        links |= links.T
        star = common.forest(links, np.arange(len(nodes)))
        return pd.concat([
            pd.DataFrame({"a": counted, "b": pd.array([pd.NA] * len(counted), dtype="Int64"), "n": pd.array(n, dtype="Int64")}),
            pd.DataFrame({"a": nodes[[x for x, _ in star]], "b": pd.array(nodes[[y for _, y in star]], dtype="Int64"), "n": pd.array([pd.NA] * len(star), dtype="Int64")}),
        ])

    both = left.select(*cols, F.lit(True).alias("home")).union(right.select(*cols, F.lit(False).alias("home")))
    return both.groupBy("cell", "i", "j").applyInPandas(join, "a long, b long, n long")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(common.table(spark, sf_dir, "embeddings"))


#: The result by its definition, every pair compared.
ORACLE_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}), r AS (SELECT a AS n, b AS m FROM l UNION SELECT r.n, l.b AS m FROM r JOIN l ON l.a = r.m),
c AS (SELECT n, least(n, min(m)) AS component_id FROM r GROUP BY n), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(k.n_links, 0) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id, coalesce(c.component_id, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN k ON k.a = v.vec_id LEFT JOIN c ON c.n = v.vec_id"""
