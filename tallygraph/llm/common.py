"""Helpers shared by the corpus operators: durable cuts of lineage, link
graphs, and readers of the driver's tables.

Every operator takes and returns DataFrames.  Nothing here collects rows whose
number grows with the input.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch.  Texts can be long, so batches are kept short.
ARROW_ROWS = 512
#: Rows of a key from which ``keyed_join`` takes it as hot, and the largest
#: number of hot keys that it broadcasts (of the order of 100 bytes each).
HOT, HOT_KEYS = 4096, 50_000


def configure(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on (idempotent)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))  # local sessions, as in tests
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    The copy is in shared storage, so the loss of an executor costs a re-read
    and not a re-computation, and random or order-dependent steps before it are
    never run twice with different results.
    """
    configure(df.sparkSession)
    return df.checkpoint(eager=True)


def keyed_join(rows: DataFrame, info: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner equi-join of ``rows`` with one row of ``info`` for each key.

    ``info`` has the number of its key's rows in ``count``.  Keys of more than
    ``HOT`` rows are joined where their rows are, by a broadcast of at most
    ``HOT_KEYS`` of them; with more hot keys than that the join shuffles and
    skewed partitions are split as they are read.  ``info`` is read twice."""
    hot = info.where(F.col(count) > HOT)
    if 0 < hot.count() <= HOT_KEYS:
        return rows.join(info.where(F.col(count) <= HOT), keys).unionByName(rows.join(F.broadcast(hot), keys))
    return rows.join(info, keys)


def numbered(classes: DataFrame, *values: str) -> tuple[DataFrame, Column]:
    """``classes`` (distinct ``values``) with a column ``node``, and the column
    that gives the same number to any row of these values.

    The number is a 64-bit hash under the first salt that gives all classes
    numbers of their own, so it stands for the values exactly."""
    for salt in range(16):
        node = F.xxhash64(F.lit(salt), *[F.col(v) for v in values])
        out = cut(classes.withColumn("node", node))
        if out.groupBy("node").count().where("count > 1").isEmpty():
            return out, node
    raise RuntimeError("no salt numbers the classes apart")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator wrote, on whatever file system it is."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` has
    it (Spark takes no notice of case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def held_out(key: str, modulus: int, remainder: int):
    """Column: crc32 of the id as text, modulo ``modulus``, equals ``remainder``
    (false for a null id)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected link graph, as (node, component).

    ``edges``: columns a, b (long).  ``component`` is the smallest node id that
    can be reached.  Nodes without a link other than to themselves are absent.
    Large-star and small-star steps alternate until the links stop changing,
    in O(log n) rounds; each is one minimum by key, pre-aggregated map-side, and
    one equi-join, in which the links of a hub stay where they are and its
    minimum is sent to them.  The links are cut to the checkpoint folder after
    each round.
    """
    e = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = cut(
            keyed_join(both.where("v > u"), low, ["u"], "n")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = (
            keyed_join(large, least, ["u"], "n")
            .select(F.greatest("v", "m").alias("x"), F.col("m").alias("y"))
            .where("x <> y")
            .union(least.select("u", "m"))
            .distinct()
            .toDF("u", "v")
        )
        e = cut(small)
        state = e.agg(
            F.count("*"), F.expr("bit_xor(xxhash64(u, v))")
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def forest(linked, order) -> list[tuple[int, int]]:
    """Star edges (member, representative) of the components of a boolean
    link matrix; ``order`` ranks the rows, the least of a component stands for
    it.  Emits fewer edges than rows, however dense the matrix is."""
    import numpy as np

    n = len(order)
    label = np.argsort(np.argsort(order, kind="stable"), kind="stable")
    at = np.argsort(order, kind="stable")
    busy = np.flatnonzero(linked.any(axis=1))
    if not len(busy):
        return []
    sub = linked[np.ix_(busy, busy)]
    lab = label[busy].copy()
    while True:
        new = np.minimum(lab, np.where(sub, lab[None, :], n).min(axis=1))
        # pointer jumping: a row takes the label of the row it points at
        where = np.full(n, n)
        where[label[busy]] = new
        new = np.minimum(new, where[new])
        if (new == lab).all():
            break
        lab = new
    return [(int(r), int(at[m])) for r, m in zip(busy, lab) if at[m] != r]


def whole_groups(batches, keys: list[str], rows: int = 1 << 16, size=len):
    """Frames of about ``rows`` rows from batches that are sorted by ``keys``,
    cut only between groups.  A task that needs no more than one group at a
    time can so be vectorised over many small ones.  ``size`` of a frame may
    count something else than its rows."""
    import pandas as pd

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += size(b)
        if n >= rows:
            x = pd.concat(held, ignore_index=True)
            last = x[keys].to_numpy()
            differs = (last != last[-1]).any(axis=1).nonzero()[0]
            at = int(differs[-1]) + 1 if len(differs) else 0
            if at:
                yield x.iloc[:at]
            held, n = [x.iloc[at:]], size(x.iloc[at:])
    if any(len(h) for h in held):
        yield pd.concat(held, ignore_index=True)
