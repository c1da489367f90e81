"""Folds and Arrow functions on small hand-made inputs and brute force."""

from decimal import ROUND_HALF_EVEN, Decimal

import pytest

from tallygraph.functions import arrow
from tallygraph.operators import folds


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


F, G = ("def f(a, b)", "1"), ("def g(a, b)", "2")


def test_removal_needs_two_clean_parses():
    got = folds.fold_parses([(1, 0.0, "clean", {"f": F, "g": G}), (2, 1.0, "clean", {"g": G}), (3, 2.0, "partial", {}), (4, 3.0, "clean", {"g": G})])
    assert [(s, n, k) for s, n, k, _, _ in got] == [(2, "f", "unknown"), (4, "f", "removed")]


def test_return_before_removal_is_no_removal():
    got = folds.fold_parses([(1, 0.0, "clean", {"f": F, "g": G}), (2, 1.0, "clean", {"g": G}), (3, 2.0, "clean", {"f": F, "g": G}), (4, 3.0, "clean", {"f": F, "g": G})])
    assert [k for _, _, k, _, _ in got] == ["unknown", "added"]


@pytest.mark.parametrize("gap, kinds", [(3600.0, ["renamed"]), (6 * 3600.0 + 1, ["unknown", "added"])])
def test_rename_only_when_recent(gap, kinds):
    got = folds.fold_parses([(1, 0.0, "clean", {"f": F}), (2, gap, "clean", {"h": ("def h(a, b)", "1")})])
    assert [k for _, _, k, _, _ in got] == kinds


def test_cooldown_is_greedy(spark):
    rows = [("u", 1, 0.0), ("u", 2, 899.0), ("u", 3, 900.0), ("u", 4, 1700.0), ("v", 5, 10.0)]
    got = folds.cooldown(spark.createDataFrame(rows, "usr string, seq long, ts double"), ["usr"]).collect()
    assert sorted((r.usr, r.seq) for r in got) == [("u", 1), ("u", 3), ("v", 5)]


def test_budget_passes_over_what_does_not_fit(spark):
    rows = [("a", 1, 6), ("a", 2, 5), ("a", 3, 4), ("b", 1, 99)]
    got = folds.fit_budget(spark.createDataFrame(rows, "path string, place long, bytes long"), "path", 10).collect()
    assert sorted((r.path, r.place) for r in got) == [("a", 1), ("a", 3)]


def test_common_dir(spark):
    rows = [(1, "a/b/c.py"), (1, "a/b/d/e.py"), (2, "a/x.py"), (2, "b/x.py"), (3, "a/b/c.py"), (4, "ab/c.py"), (4, "ac/c.py")]
    got = folds.common_dir(spark.createDataFrame(rows, "usr int, path string"), "usr").collect()
    assert {r.usr: r.dir for r in got} == {1: "a/b/", 2: "", 3: "a/b/", 4: ""}


def test_exact_round(spark):
    values = [2.675, 0.8125, -2.675, 1e300, 0.5, 1.5, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.selectExpr("x").select(arrow.exact_round("x", __import__("pyspark").sql.functions.lit(2))).collect()]
    want = [float(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) if v is not None and abs(v) < 1e9 else v for v in values]
    assert got[:7] == want[:7] and (got[7] is None or got[7] != got[7])


def test_canonical_and_redacted():
    assert arrow.canonical('{"b": [1, {"z": 1, "a": "é"}], "a": null}') == '{"a":null,"b":[1,{"a":"\\u00e9","z":1}]}'
    assert arrow.canonical("not json") is None and arrow.canonical(None) is None
    assert arrow.redacted({"k": 1, "x": [{"k": 2, "y": 3}]}, frozenset("k")) == {"x": [{"y": 3}]}


def test_hunks_cut_after_eight():
    old = [str(i) for i in range(40)]
    new = [x if i % 2 else f"n{x}" for i, x in enumerate(old)]
    got = arrow.hunks(old, new, new)
    assert len(got) == 9 and got[-1][0] == "truncated" and got[0][:5] == ("replace", 1, 1, 1, 1)
    assert arrow.hunks([], new, new) == [] and arrow.hunks(old, old, old) == []


def test_structure():
    s = arrow.structure("import os\nfrom a.b import c as d\nclass A(d):\n    def m(self, x: int) -> A:\n        return os.path.join(x)\ndef f(a, *, b=1):\n    'Doc.'\n    return A().m(a)\n")
    by = {x["name"]: x for x in s["symbols"]}
    assert s["status"] == "clean" and [*by] == ["A", "A.m", "f"]
    assert by["f"]["params"] == ["a", "b"] and by["f"]["doc"] == "Doc." and by["f"]["edges"] == [("A", "calls")]
    assert ("d", "inherits") in by["A"]["edges"] and s["imports"] == [["os", "os", ""], ["a.b", "d", "c"]]
    broken = arrow.structure("def ok(): pass\ndef (")
    assert broken["status"] == "partial" and not broken["symbols"]


def test_parse_events(spark):
    rows = [("u", "p", 1, 0.0, "clean", '{"f": ["def f(a)", "1"]}'), ("u", "p", 3, 2.0, "clean", "{}"), ("u", "p", 2, 1.0, "clean", '{"f": ["def f(a)", "2"]}'), ("v", "p", 4, 0.0, "clean", None)]
    got = folds.parse_events(spark.createDataFrame(rows, "usr string, path string, seq long, ts double, status string, symbols string")).collect()
    assert [(r.seq, r.symbol, r.kind) for r in sorted(got, key=lambda r: r.seq)] == [(2, "f", "modified"), (3, "f", "unknown")]


def test_texts_reach_python_in_short_batches(spark):
    """The batches of a line diff are bounded, whatever the rows of a task."""
    import pandas as pd
    from pyspark.sql import functions as F

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(name)
    try:
        folds.QUERIES["m4_line_diff"](spark, "/root/testdata/sf0.001")
        rows = F.pandas_udf(lambda x: pd.Series([len(x)] * len(x)), "long")
        assert spark.range(3000, numPartitions=1).agg(F.max(rows("id"))).first()[0] <= folds.TEXT_ROWS
    finally:
        spark.conf.unset(name)


def test_every_version_meets_the_one_before_it(spark, tmp_path):
    """Texts of any length and language are beside the one before them of their
    source, over the ends of stretches too; against a plain fold."""
    import random

    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "", "long " * 9]) + "x" * rng.randrange(200), rng.choice(["en", "de"]), rng.choice(["s1", "s1", "s1", "s2", "", None])) for i in range(300)]
    rows += [(400, None, "en", "s1"), (401, "after none", "en", "s1"), (402, "b", "en", "s1"), (402, "a", "de", "s1"), (403, "last", "de", "s1"), (7, "once", "en", "alone")]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want, last = [], {}
    for i, text, _, source in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        want.append((i, text, last.get(source)))
        last[source] = text
    got = [(r.doc_id, r.text, r.before) for r in folds._versions(spark, str(tmp_path)).collect()]
    plain = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=plain) == sorted(want, key=plain)
    none = spark.createDataFrame([], "k string, o long, v string")
    assert folds.with_before(none, "k", "o", "v").collect() == []
