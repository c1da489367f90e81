"""Plans that a query must not have, filters that must reach the scan, and rules
with parameters on the callable surface."""

import pytest

from tallygraph import catalog, tools
from tallygraph.plans import rules
from tallygraph.sources.adapters import pushed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a22_known_unseen", "u3_absent_dirs", "j22_gate", "m11_scars", "m16_reverses", "f17_confidence", "o8_briefing_rank", "j26_visible_intents", "s29_index_plan", "a12_coedit", "w3_running_max"])
def test_no_cartesian_null_aware_or_unpartitioned_step(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not [x for x in text.split("\n") if "LeftAnti" in x and x.rstrip().endswith("true")]  # null-aware
    for row in text.split("\n"):
        if (at := row.find("Window [")) >= 0:  # expressions, partition, order
            depth, groups = 0, [""]
            for c in row[at + len("Window ") :]:
                depth += (c == "[") - (c == "]")
                groups[-1] += c
                if c == "]" and depth == 0:
                    groups.append("")
            assert len(groups) > 2 and " ASC" not in groups[1] and " DESC" not in groups[1], row  # a partition comes second


@pytest.mark.parametrize(("name", "column"), [("s1_scan_since", "ts"), ("s2_scan_kinds", "event_type"), ("o7_why", "event_type"), ("a9_ownership", "event_type"), ("s4_after_seq", "event_id")])
def test_filters_reach_parquet(spark, name, column):
    text = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    scans = [x for x in text.split("\n") if "FileScan parquet" in x]
    assert any(column in x.split("PushedFilters:")[1].split("]")[0].replace("IsNotNull", "") for x in scans)


def test_joins_by_time_do_not_meet_all_rows_of_a_key(spark):
    """A covering intent is found without a join; what is known joins by scope
    and user or scope and stretch, never by scope alone."""
    assert "Join" not in plan(catalog.QUERIES["j16_covering_intent"](spark, SF))
    joins = [x for x in plan(catalog.QUERIES["a22_known_unseen"](spark, SF)).split("\n") if "SortMergeJoin" in x or "HashJoin" in x]
    assert joins and all("," in x.split("[", 1)[1].split("]")[0] for x in joins)


def test_tools_narrow_what_they_are_asked(spark):
    more = SF.replace("0.001", "0.01")  # the smallest table has no two writes of one number
    every = tools.call(spark, more, "claim").collect()
    one = every[0]
    some = tools.call(spark, more, "claim", scope=one.scope).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in every if r.scope == one.scope)
    assert all((r.dir, r.number) == (one.dir, one.number) for r in tools.call(spark, more, "claim", dir=one.dir, number=one.number).collect())
    pending = tools.call(spark, SF, "pending_reconciliations", usr="alpha-1").collect()
    assert pending and {r.usr for r in pending} == {"alpha-1"}
    units = [{"path": "d3/f3.py"}, {"path": "d5/f21.py", "symbol": "x", "op": "rename"}, {"path": "gone.py", "symbol": "x", "op": "rename"}, {"path": "d1/f9.py"}]
    got = {r.grp: (r.units, r.why) for r in tools.call(spark, SF, "plan_work", units=units).collect()}
    assert got == {0: (3, "shared impact"), 3: (1, "independent")}  # p21 depends on p3


def test_pushed_adds_only_what_follows():
    assert pushed("SELECT 1 FROM ledger WHERE kind = 'edit_reported' OR seq = 1") == "SELECT 1 FROM ledger WHERE kind = 'edit_reported' OR seq = 1"
    assert "etype IN ('click', 'purchase') AND kind IN" in pushed("SELECT 1 FROM act WHERE kind IN ('rationale', 'edit_reported')")
    assert pushed("SELECT 1 FROM act WHERE kind = 'unheard_of'").count("etype") == 0
    assert "(SELECT 1 FROM ledger l WHERE l.etype IN ('error') AND l.kind = 'gate_block')" in pushed("(SELECT 1 FROM ledger l WHERE l.kind = 'gate_block')")


def test_rules_take_parameters(spark):
    assert "900" in rules.sql("w1_sessions", gap=900) and "$gap" not in rules.sql("w1_sessions")
    with pytest.raises(TypeError):
        rules.sql("w1_sessions", nothing=1)
    assert "'it''s'" in rules.sql("o7_why", path="it's")
    assert not [n for n in rules.RULES if "$" in rules.sql(n).replace("'$.", "'").replace("]+)?$'", "").replace("$'", "'") and any(f"${p}" in rules.sql(n) for p in rules.RULES[n][1])]


def test_every_tool_is_named(spark):
    assert len(tools.TOOLS) + len(tools.WRITES) == 36 and not set(tools.TOOLS) & tools.WRITES
    with pytest.raises(ValueError):
        tools.call(spark, SF, "move_repo")
    with pytest.raises(KeyError):
        tools.call(spark, SF, "nothing")
    with pytest.raises(TypeError):
        tools.call(spark, SF, "recall", nothing=1)
    got = tools.call(spark, SF, "graph_path", start="p9", end="p150").orderBy("step").collect()
    assert got[0].node == "p9" and got[-1].node == "p150"
    assert tools.call(spark, SF, "blast_radius", node="p3", depth=1).first().total == 7
    assert tools.call(spark, SF, "get_symbol", path="d1/f9.py").count() >= 0


def test_sessions_split_on_silence_longer_than_the_gap(spark):
    """Rows at 0, 1800 and 3601 seconds: two sessions."""
    from tallygraph.operators.folds import broken_links, buckets, chained

    rows = spark.createDataFrame([("u", 1, 1000.0), ("u", 2, 2500.0), ("u", 3, 2900.0)], "skey string, seq long, ts double")
    assert {r.seq: r.start for r in buckets(rows, "skey").collect()} == {1: 1000.0, 2: 1000.0, 3: 2900.0}
    chain = chained(spark.createDataFrame([("a", i, f"row {i}") for i in range(9)], "k string, seq long, payload string"), "k")
    assert broken_links(chain, "k").count() == 0
    forged = chain.selectExpr("k", "seq", "CASE WHEN seq = 4 THEN 'forged' ELSE payload END AS payload", "prev_hash", "hash")
    assert [(r.seq, r.why) for r in broken_links(forged, "k").collect()] == [(4, "content")]
    assert [(r.seq, r.why) for r in broken_links(chain.where("seq <> 6"), "k").collect()] == [(7, "link")]


@pytest.mark.parametrize("name", ["a17_outcomes", "f17_confidence", "m11_scars"])
def test_no_window_over_all_that_follows(spark, name):
    """Spark fills such a frame anew for every row, quadratic in a path's rows."""
    assert "unboundedfollowing" not in plan(catalog.QUERIES[name](spark, SF)).replace("specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())", "")


@pytest.mark.parametrize(("tail", "want"), [(47, []), (48, [(1, 15)]), (49, [(1, 15)]), (500, [(1, 15)])])
def test_a_row_that_begins_where_the_tail_does_counts(spark, tmp_path, tail, want):
    """The last row has 48 characters: it is whole in a tail of 48, not of 47."""
    assert len('{"role": "assistant", "usage": 15, "text": "ok"}') == 48
    spark.createDataFrame([(1, 0, "user", "first"), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in catalog.QUERIES["s19_last_usage"](spark, str(tmp_path), tail=tail).collect()] == want


@pytest.mark.parametrize("name", ["s17_parse_source", "s26_name_edges", "s27_symbols", "s18_round_trip"])
def test_files_are_dealt_out_before_they_are_parsed(spark, name):
    """The part table is one small row group, which would be one task."""
    text = plan(catalog.QUERIES[name](spark, SF))
    parse, deal = text.index("ArrowEvalPython"), text.index("REPARTITION_BY_NUM")
    assert parse < deal and "hashpartitioning(p_partkey#" in text[deal - 60 : deal]


def test_slices_do_not_spread_two_steps(spark):
    """No step of the plan makes a row of each two references of a node."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = catalog.QUERIES["g18_slices"](spark, SF)
        df._jdf.collectToPython()
        made, nodes = [], [df._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            rows = node.metrics().get("numOutputRows")
            made += [rows.get().value()] if rows.isDefined() else []
            below = node.children()
            nodes += [below.apply(i) for i in range(below.size())]
        spread = spark.read.parquet(f"{SF}/lineitem.parquet").count()
        assert made and max(made) <= 2 * spread
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
