"""Hash trees of files: built from the leaves up, compared from the root down.

A level of a tree is one folder of Parquet, so a comparison that has come to a
level reads that level only, and of it the children of folders that differ.  The
hash of a folder is over its children dealt into buckets, so that a folder of any
size is never one row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import shared_folder

#: Hex digits of a child's bucket.
BUCKET = 2


def digest(lines) -> F.Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256)


@dataclass
class Tree:
    """Levels 0 (the root, with an empty path) to ``depth`` of nodes (path,
    parent, hash, is_file)."""

    spark: SparkSession
    folder: str
    depth: int

    def level(self, depth: int) -> DataFrame:
        return self.spark.read.schema("path string, parent string, hash string, is_file boolean").parquet(f"{self.folder}/level={depth}")

    def nodes(self) -> DataFrame:
        return self.spark.read.option("basePath", self.folder).parquet(*[f"{self.folder}/level={d}" for d in range(self.depth + 1)]).withColumnRenamed("level", "depth")


def build(files: DataFrame) -> Tree:
    """The tree of files (path, hash), in as many rounds as the longest path has
    parts.  Empty parts of a path do not count; of rows of one path the least
    hash is taken; a null path or hash is no file.  Without files there is a root
    over nothing."""
    spark = files.sparkSession
    folder = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    flat = files.where("path is not null and hash is not null").select(F.array_join(parts, "/").alias("path"), "hash").where("path <> ''")
    flat = flat.groupBy("path").agg(F.min("hash").alias("hash"))
    flat.select(F.size(F.split("path", "/")).alias("at"), "path", "hash").write.partitionBy("at").parquet(f"{folder}/files")
    found = spark.read.schema("path string, hash string, at int").parquet(f"{folder}/files")
    depths = [r.at for r in found.select("at").distinct().collect()]  # one row per depth
    tree, below = Tree(spark, folder, max(depths, default=0)), None
    name = F.substring_index("path", "/", -1)
    up = F.left("path", F.greatest(F.length("path") - F.length(name) - 1, F.lit(0)))
    for depth in range(tree.depth, -1, -1):
        here = found.where(F.col("at") == depth).select("path", "hash", F.lit(True).alias("is_file"))
        if below is not None:
            line = F.concat(name, F.lit(":"), F.when(F.col("is_file"), "f").otherwise("d"), F.lit(":"), "hash")
            buckets = below.groupBy("parent", F.left(F.md5(name), F.lit(BUCKET)).alias("bucket")).agg(digest(line).alias("h"))
            folders = buckets.groupBy(F.col("parent").alias("path")).agg(digest(F.concat("bucket", F.lit(":"), "h")).alias("hash"))
            here = here.union(folders.select("path", "hash", F.lit(False)))
        if depth == 0:
            here = here.union(spark.createDataFrame([("",)], "path string").join(here.select("path"), "path", "left_anti").select("path", F.sha2(F.lit(""), 256), F.lit(False)))
        here.select("path", F.when(F.lit(depth > 0), up).alias("parent"), "hash", "is_file").write.parquet(f"{folder}/level={depth}")
        below = tree.level(depth)
    return tree


def subtree_root(files: DataFrame, prefix: str) -> DataFrame:
    """(prefix, root): one hash over all files (path, hash) below a prefix, as
    sorted lines, over nothing if there are none."""
    lines = files.where(F.startswith(F.col("path"), F.lit(prefix))).select(F.concat("path", F.lit(":"), "hash").alias("l"))
    buckets = lines.groupBy(F.left(F.md5("l"), F.lit(BUCKET)).alias("bucket")).agg(digest(F.col("l")).alias("h"))
    return buckets.agg(digest(F.concat("bucket", F.lit(":"), "h")).alias("root")).select(F.lit(prefix).alias("prefix"), "root")


def descent(a: Tree, b: Tree) -> Iterator[DataFrame]:
    """Level by level, the children of folders that differ: (path, mine, theirs,
    my_file, their_file).  A level is written before the next is read."""
    front, folder = None, f"{shared_folder(a.spark)}/descent-{uuid.uuid4().hex}"
    for depth in range(max(a.depth, b.depth) + 1):
        sides = []
        for tree, own, file in ((a, "mine", "my_file"), (b, "theirs", "their_file")):
            rows = tree.level(depth) if depth <= tree.depth else tree.level(0).limit(0)
            if front is not None:
                rows = rows.join(front, "parent", "left_semi")
            sides.append(rows.select("path", F.col("hash").alias(own), F.col("is_file").alias(file)))
        sides[0].join(sides[1], "path", "full").write.parquet(f"{folder}/{depth}")
        met = a.spark.read.schema("path string, mine string, my_file boolean, theirs string, their_file boolean").parquet(f"{folder}/{depth}")
        yield met
        front = met.where(~F.col("mine").eqNullSafe(F.col("theirs")) & (~F.col("my_file") | ~F.col("their_file"))).select(F.col("path").alias("parent"))
        if front.isEmpty():
            return


def diverging(a: Tree, b: Tree) -> DataFrame:
    """(path, mine, theirs): files of two trees whose hashes differ, null where
    a tree has no such file."""
    out = None
    for met in descent(a, b):
        file = lambda h, f: F.when(F.col(f), F.col(h))
        rows = met.select("path", file("mine", "my_file").alias("mine"), file("theirs", "their_file").alias("theirs")).where(~F.col("mine").eqNullSafe(F.col("theirs")))
        out = rows if out is None else out.union(rows)
    return out


#: Two checkouts of one tree of parts: the second has other contents here and
#: there, lacks some files and has some more.
def _checkouts(s, d) -> tuple[DataFrame, DataFrame]:
    key = F.col("p_partkey")
    digits = F.array_join(F.regexp_extract_all(key.cast("string"), F.lit("[0-9]"), F.lit(0)), "/")
    # few tasks read the file; paths and hashes are made after it is dealt out
    rows = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand", "p_name").repartition("p_partkey")
    part = rows.select("p_partkey", F.concat(F.replace("p_brand", F.lit("#")), F.lit("/"), F.when(key % 5 == 0, "deep/er/").otherwise(""), digits).alias("dir"), F.md5("p_name").alias("hash"))
    mine = part.select(F.concat("dir", F.lit("/f.py")).alias("path"), "hash")
    theirs = part.where(key % 89 != 3).select(F.concat("dir", F.lit("/f.py")).alias("path"), F.when(key % 97 == 5, "other").otherwise(F.col("hash")).alias("hash"))
    return mine, theirs.union(part.where(key % 83 == 7).select(F.concat("dir", F.lit("/g.py")), "hash"))


QUERIES = {
    "u1_tree_diff": lambda s, d: diverging(*map(build, _checkouts(s, d))),
    "m6_tree": lambda s, d: build(_checkouts(s, d)[0]).nodes(),
    "m6_subtree_root": lambda s, d: subtree_root(_checkouts(s, d)[1], "Brand1"),
}
_DIR = "replace(p_brand, '#', '') || '/' || CASE WHEN p_partkey % 5 = 0 THEN 'deep/er/' ELSE '' END || array_to_string(regexp_extract_all(CAST(p_partkey AS VARCHAR), '[0-9]'), '/')"
_MINE = f"SELECT {_DIR} || '/f.py' AS path, md5(p_name) AS hash FROM part"
_THEIRS = f"SELECT {_DIR} || '/f.py' AS path, CASE WHEN p_partkey % 97 = 5 THEN 'other' ELSE md5(p_name) END AS hash FROM part WHERE p_partkey % 89 <> 3 UNION ALL SELECT {_DIR} || '/g.py', md5(p_name) FROM part WHERE p_partkey % 83 = 7"


def _unrolled(deepest: int = 12) -> str:
    """Every level as a table of its own, from the deepest up."""
    sql = f"WITH f AS (SELECT path, min(hash) AS hash, len(string_split(path, '/')) AS depth FROM ({_MINE}) m GROUP BY path), n{deepest + 1} AS (SELECT path, hash, true AS is_file, depth FROM f WHERE false)"
    for d in range(deepest, -1, -1):
        sql += f""",
n{d} AS MATERIALIZED (SELECT path, hash, true AS is_file, {d} AS depth FROM f WHERE depth = {d} UNION ALL SELECT up, sha256(string_agg(bucket || ':' || h, chr(10) ORDER BY bucket)), false, {d} FROM (SELECT up, bucket, sha256(string_agg(l, chr(10) ORDER BY l)) AS h FROM
(SELECT array_to_string(string_split(path, '/')[:-2], '/') AS up, left(md5(string_split(path, '/')[-1]), 2) AS bucket, string_split(path, '/')[-1] || CASE WHEN is_file THEN ':f:' ELSE ':d:' END || hash AS l FROM n{d + 1}) x GROUP BY up, bucket) y GROUP BY up)"""
    every = " UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(deepest + 1))
    return sql + f" SELECT path, CASE WHEN depth > 0 THEN array_to_string(string_split(path, '/')[:-2], '/') END AS parent, hash, is_file, CAST(depth AS INTEGER) AS depth FROM ({every}) e"


ORACLE = {
    "u1_tree_diff": f"SELECT coalesce(a.path, b.path) AS path, a.hash AS mine, b.hash AS theirs FROM ({_MINE}) a FULL OUTER JOIN ({_THEIRS}) b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash",
    "m6_tree": _unrolled(),
    "m6_subtree_root": f"SELECT 'Brand1' AS prefix, sha256(string_agg(bucket || ':' || h, chr(10) ORDER BY bucket)) AS root FROM (SELECT left(md5(l), 2) AS bucket, sha256(string_agg(l, chr(10) ORDER BY l)) AS h FROM (SELECT path || ':' || hash AS l FROM ({_THEIRS}) t WHERE path LIKE 'Brand1%') x GROUP BY 1) y",
}
