"""Centroid clustering in integers, screened in float32.

Vectors and centroids are integers, so every distance has one right value and a
tie is a tie.  Each pass first multiplies them as float32 matrices.  The product
of two vectors of width w is off by at most g(w + 4) times the product of their
lengths, g(n) = n u / (1 - n u) and u = 2 ** -24, whatever the order of the sums:
two roundings of the operands and w of the products and sums.  That gives an
interval for each distance.  A centroid whose interval lies above another's is
out; where more than one is left, those are compared in exact integers, and the
lowest number wins a tie.

A pass is one scan: tasks add up their vectors by cluster, and Spark adds up the
tasks' sums.  The driver holds the centroids and their sums, ``k`` rows of
``width`` numbers, however many vectors there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, embdedup

K, ROUNDS, WIDTH, SCALE, SALT = 8, 10, 64, 1024, 3
#: Bits of a limb: sums travel as limbs, so that no number of vectors or tasks
#: (up to 2 ** 23) overflows a long.
LIMB = 40
#: Numbers in a float matrix of vectors by centroids.
CELLS = 1 << 20
ROUNDING = 2.0**-24


def whole_limit(width: int) -> int:
    """Components below this give squared distances that fit in a long."""
    return math.isqrt((2**63 - 1) // max(width, 1)) // 2


def integers(x: np.ndarray, scale: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) as int64, and which rows lie below ``limit``; of others
    the integers are not valid."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    fits = (np.abs(y) < limit).all(axis=1)
    return np.where(fits[:, None], y, 0).astype(np.int64), fits


def large_integers(row, scale: int) -> list[int]:
    out = []
    for v in row:
        p = float(v) * scale
        out.append(math.floor(p) if math.isfinite(p) else int(v) * scale)
    return out


def exact(v: list[int], c: list[int]) -> int:
    return sum((a - b) ** 2 for a, b in zip(v, c))


class Screen:
    """Centroids ready for comparison with many vectors."""

    def __init__(self, centroids: list[list[int]], scale: int):
        self.rows, self.scale = centroids, scale
        width = len(centroids[0])
        self.limit = whole_limit(width)
        self.fits = all(abs(x) < self.limit for c in centroids for x in c)
        if self.fits:
            self.whole = np.array(centroids, dtype=np.int64)
            self.single = self.whole.astype(np.float32)
            self.square = np.array([float(sum(x * x for x in c)) for c in centroids])
            self.length = np.sqrt(self.square) * (1 + 2.0**-40)
            n = (width + 4) * ROUNDING
            self.gamma = n / (1 - n)

    def candidates(self, v: np.ndarray) -> np.ndarray:
        """Boolean matrix: centroids that may be the nearest of each row of ``v``
        (int64 below the limit)."""
        x = v.astype(np.float64)
        length = np.sqrt((x * x).sum(axis=1)) * (1 + 2.0**-40)
        product = (v.astype(np.float32) @ self.single.T).astype(np.float64)
        both = length[:, None] * self.length[None, :]
        middle = self.square[None, :] - 2 * product  # the distance without |v|^2
        error = 2 * self.gamma * both + 2.0**-50 * (self.square[None, :] + 2 * both)
        return middle - error <= (middle + error).min(axis=1)[:, None]

    def small(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label, far = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
        step = max(1, CELLS // len(self.rows))
        for lo in range(0, len(v), step):
            part = v[lo : lo + step]
            may = self.candidates(part)
            best = may.argmax(axis=1)
            open_ = np.flatnonzero(may.sum(axis=1) > 1)
            if len(open_):
                r, c = np.nonzero(may[open_])
                d = part[open_[r]] - self.whole[c]
                table = np.full((len(open_), len(self.rows)), np.iinfo(np.int64).max)
                table[r, c] = (d * d).sum(axis=1)
                best[open_] = table.argmin(axis=1)  # the first of equals
            d = part - self.whole[best]
            label[lo : lo + step], far[lo : lo + step] = best, (d * d).sum(axis=1)
        return label, far

    def assign(self, x: np.ndarray):
        """(label, distance, integers) of vectors ``x``.  Distances and integers
        are int64, or Python integers where some do not fit."""
        v, fits = integers(x, self.scale, self.limit)
        if self.fits and fits.all():
            return *self.small(v), v
        label, far, rows = np.zeros(len(x), np.int64), np.zeros(len(x), object), v.astype(object)
        if self.fits and fits.any():
            label[fits], far[fits] = self.small(v[fits])
        for i in range(len(x)) if not self.fits else np.flatnonzero(~fits):
            row = large_integers(x[i], self.scale)
            d = [exact(row, c) for c in self.rows]
            label[i], far[i], rows[i] = d.index(min(d)), min(d), row
        return label, far, rows


def matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def limbs(total: int) -> Iterator[tuple[int, int]]:
    i = 0
    while not -(1 << LIMB) < total < 1 << LIMB:
        yield i, total & ((1 << LIMB) - 1)
        total, i = total >> LIMB, i + 1
    yield i, total


def sums(kept: DataFrame, screen: Screen, width: int) -> dict[int, list[int]]:
    """For each cluster that has vectors: the sums of its components, the number
    of its vectors and the sum of their distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            label, far, v = screen.assign(matrix(b.column("vec"), width))
            for j in np.unique(label):
                at = label == j
                # a batch is small, so that int64 holds its sums of components;
                # distances are summed as Python integers
                row = np.array([*v[at].sum(axis=0).tolist(), int(at.sum()), sum(far[at].tolist())], dtype=object)
                totals[int(j)] = totals.get(int(j), 0) + row
        out = [(j, d, i, x) for j, row in totals.items() for d, total in enumerate(row) for i, x in limbs(int(total))]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "place", "limb", "x"])

    found = kept.select("vec").mapInArrow(run, "cluster int, place int, limb int, x long").groupBy("cluster", "place", "limb").agg(F.sum("x").alias("x"))
    out: dict[int, list[int]] = {}
    for r in found.collect():  # k x (width + 2) rows of a few limbs
        out.setdefault(r.cluster, [0] * (width + 2))[r.place] += r.x << (LIMB * r.limb)
    return out


def clusters(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
    k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, salt: int = SALT,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one
    row per kept vector.

    Kept are vectors of exactly ``width`` components, none null or non-finite;
    others give no row.  A component x becomes floor(scale * x).  The first
    centroids are the ``k`` kept vectors of smallest sha256 of "salt:id" (of
    equal ids the smaller vector first; rows without an id take part but start
    nothing; with fewer vectors there are fewer centroids).  In each of
    ``rounds`` rounds a centroid becomes the floor of its vectors' mean, one
    without vectors stays.  Rows that repeat count as vectors of their own.  A
    distance or sum that is larger than a long is null, the cluster is exact all
    the same.  Other columns are ignored; an empty table gives no rows."""
    common.configure(vectors.sparkSession)
    v = F.col("vec")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), embdedup.real(vectors, vec_col).alias("vec")).where(v.isNotNull() & (F.size(v) == width) & sound)
    starts = kept.where("id is not null").select("vec", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).alias("h")).orderBy("h", "vec").limit(k).collect()
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = [large_integers(r.vec, scale) for r in starts]
    for _ in range(rounds):
        for j, total in sums(kept, Screen(centroids, scale), width).items():
            centroids[j] = [s // total[width] for s in total[:width]]
    screen = Screen(centroids, scale)
    inertia = {j: total[-1] for j, total in sums(kept, screen, width).items()}

    def long(x) -> int | None:
        return int(x) if x < 1 << 63 else None

    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of, whole = [long(inertia.get(j, 0)) for j in range(len(centroids))], long(sum(inertia.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, far, _ = screen.assign(matrix(b.column("vec"), width))
            at = label.tolist()
            columns = [b.column("id"), pa.array(at, pa.int32()), pa.array([long(x) for x in far.tolist()], pa.int64()), pa.array([of[j] for j in at], pa.int64()), pa.array([whole] * len(at), pa.int64()), pa.array([named[j] for j in at], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    out = kept.mapInArrow(run, schema.replace(f"{id_col} ", "id ", 1))
    return out.withColumnRenamed("id", id_col)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(common.table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The result by its definition: every vector with every centroid, in
    integers, each round a table."""
    sql = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT) for x in embedding] AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(embedding) = {WIDTH} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, e FROM (SELECT sha256('{SALT}:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {K}) s)"""
    pairs = "SELECT v.r, v.vec_id, v.e, c.j, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.e, c.e)]) AS d FROM v, c{r} c"
    nearest = "SELECT r, vec_id, e, arg_min(j, d * 1000 + j) AS j, min(d) AS d FROM ({pairs}) p GROUP BY r, vec_id, e"
    for r in range(ROUNDS + 1):
        sql += f",\na{r} AS MATERIALIZED ({nearest.format(pairs=pairs.format(r=r))})"
        if r < ROUNDS:
            sql += f""",
s{r} AS (SELECT j, i, sum(e[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, {WIDTH + 1})) t(i) GROUP BY j, i),
c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{r} GROUP BY j) m USING (j))"""
    return sql + f"""
SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.j = a.j"""


ORACLE_SQL = _oracle()
