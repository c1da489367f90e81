"""Hash trees by hand, and how much of them a comparison reads."""

import hashlib
import random

import pytest

from tallygraph.operators import trees


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def folder(children):
    """Hash of a folder of {name: (kind, hash)}."""
    buckets = {}
    for name, (kind, h) in children.items():
        buckets.setdefault(hashlib.md5(name.encode()).hexdigest()[:2], []).append(f"{name}:{kind}:{h}")
    return sha("\n".join(f"{b}:{sha(chr(10).join(sorted(lines)))}" for b, lines in sorted(buckets.items())))


def naive(files):
    """{path: hash} of all nodes."""
    nested, out = {}, {}
    for path, h in files.items():
        at = nested
        *dirs, name = path.split("/")
        for d in dirs:
            at = at.setdefault(d, {})
        at[name] = h

    def walk(node, path):
        children = {}
        for name, x in node.items():
            here = f"{path}/{name}" if path else name
            if isinstance(x, dict):
                children[name] = ("d", walk(x, here))
            else:
                children[name], out[here] = ("f", x), x
        out[path] = folder(children)
        return out[path]

    walk(nested, "")
    return out


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, hash string")


def test_hashes_of_paths_of_one_to_eight_parts(spark):
    rng = random.Random(1)
    files = {"/".join([f"d{rng.randrange(3)}" for _ in range(n)] + [f"f{i}"]): f"h{i}" for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 7] * 6)}
    tree = trees.build(table(spark, files))
    assert {r.path: r.hash for r in tree.nodes().collect()} == naive(files) and tree.depth == 8
    assert all(r.parent == "/".join(r.path.split("/")[:-1]) for r in tree.nodes().where("depth > 0").collect())


def test_odd_files(spark):
    rows = [("a//b", "1"), ("/a/b", "0"), (None, "x"), ("c", None), ("", "y")]
    tree = trees.build(spark.createDataFrame(rows, "path string, hash string"))
    assert {r.path: r.hash for r in tree.nodes().collect()} == naive({"a/b": "0"})
    none = trees.build(spark.createDataFrame([], "path string, hash string"))
    assert [tuple(r) for r in none.nodes().collect()] == [("", None, sha(""), False, 0)]
    assert trees.diverging(none, none).count() == 0
    assert [tuple(r) for r in trees.diverging(tree, none).collect()] == [("a/b", "0", None)]


def test_files_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    files = {f"d{i % 3}/e/f{i}": "h" for i in range(20)}
    tree = trees.build(table(spark, files).mapInPandas(count, "path string, hash string"))
    assert seen.value == 20 and tree.depth == 3


def test_equal_folders_are_not_read(spark):
    files = {f"d{a}/e{b}/f{c}": f"h{a}{b}{c}" for a in range(6) for b in range(5) for c in range(8)}
    a = trees.build(table(spark, files))
    reads = []
    for changed in ([], ["d1/e1/f1"], ["d1/e1/f1", "d4/e0/f2"], list(files)):
        b = trees.build(table(spark, files | {p: "new" for p in changed}))
        assert sorted(r.path for r in trees.diverging(a, b).collect()) == sorted(changed)
        reads.append(sum(level.count() for level in trees.descent(a, b)))
    assert reads == [1, 1 + 6 + 5 + 8, 1 + 6 + 10 + 16, 1 + 6 + 30 + 240]


def test_a_file_where_the_other_has_a_folder(spark):
    a, b = trees.build(table(spark, {"x": "1", "y/z": "2"})), trees.build(table(spark, {"x/w": "1", "y/z": "2"}))
    assert sorted((r.path, r.mine, r.theirs) for r in trees.diverging(a, b).collect()) == [("x", "1", None), ("x/w", None, "1")]
