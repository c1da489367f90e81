"""The callable query surface: one function per named tool.

``call(spark, sf_dir, name, **params)`` returns a DataFrame; parameters that a
tool does not have are a TypeError.  Tools that write to a live server are named
in ``WRITES``; the ones among them that answer a question first (who conflicts,
who is told) stand in ``TOOLS`` with that question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import communities, graph, lifecycles
from .plans import rules
from .sources import graphio
from .sources.adapters import spark_sql, view


def _rule(name: str) -> Callable[..., DataFrame]:
    def run(spark: SparkSession, sf_dir: str, **params) -> DataFrame:
        return spark_sql(spark, sf_dir, rules.sql(name, **params))

    return run


def _symbol(spark, sf_dir, path: str, symbol: str = "") -> DataFrame:
    """The newest clean record of a file's symbols."""
    rows = view(spark, sf_dir, "act").where((f"kind = 'edit_reported' AND parse = 'clean'"))
    rows = rows.where(rows.path == path)
    return (rows.where(rows.symbol == symbol) if symbol else rows).groupBy("path", "symbol").agg({"seq": "max"}).toDF("path", "symbol", "seq")


def _some(rows: DataFrame, **equal) -> DataFrame:
    """``rows`` where each named column has the value given for it, if any is."""
    for name, value in equal.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def _claim(spark, sf_dir, scope: str | None = None, dir: str | None = None, number: int | None = None, usr: str | None = None) -> DataFrame:
    """What became of claims, of one scope, directory, number or owner if asked."""
    claims, writes = lifecycles._claims(spark, sf_dir)
    asked = {"scope": scope, "dir": dir, "number": number}
    return lifecycles.claim_outcomes(_some(claims, **asked, usr=usr), _some(writes, **asked))


def _pending(spark, sf_dir, scope: str | None = None, path: str | None = None, usr: str | None = None) -> DataFrame:
    """Open findings, of one scope, path or user if asked."""
    return lifecycles.pending(_some(lifecycles._reports(spark, sf_dir), scope=scope, path=path, usr=usr))


def _plan_work(spark, sf_dir, units: list[dict] | None = None, depth: int = 1) -> DataFrame:
    """The groups of ``units`` (path, symbol, op), or of the declared intents if
    none are given; a unit touches its file and what depends on it."""
    if units is None:
        return communities.work_plan(*communities._work(spark, sf_dir))
    rows = [(i, u.get("path") or "", u.get("symbol") or "", u.get("op") or "") for i, u in enumerate(units)]
    asked = spark.createDataFrame(rows, "unit long, path string, symbol string, op string")
    nodes, edges = graph._nodes(spark, sf_dir), view(spark, sf_dir, "dep")
    hit = None
    for path in sorted({r[1] for r in rows} - {""}):  # as many walks as paths were named
        start = nodes.where(nodes.path == path).select("node").first()
        near = graph.blast_radius(edges, start.node, depth).join(nodes, "node").select(F.lit(path).alias("path"), F.col("path").alias("file")) if start else None
        hit = near if hit is None else hit if near is None else hit.union(near)
    impact = asked.where("path <> ''").select("unit", F.col("path").alias("file"))
    if hit is not None:
        impact = impact.union(asked.join(hit, "path").select("unit", "file"))
    return communities.work_plan(impact, asked)


#: Tool: what answers it.
TOOLS: dict[str, Callable[..., DataFrame]] = {
    "check_collisions": _rule("j4_collisions"),
    "declare_intent": _rule("j5_predicted"),
    "complete_intent": _rule("j29_turn_notes"),
    "get_briefing": _rule("o8_briefing"),
    "recall": _rule("o5_recall"),
    "simulate_merge": _rule("j7_merge"),
    "differential_check": _rule("j8_interfaces"),
    "blind_spots": _rule("a25_blind_spots"),
    "get_symbol": _symbol,
    "blast_radius": lambda s, d, node, depth=3: graph.blast_view(view(s, d, "dep"), graph._nodes(s, d), node, depth),
    "plan_work": _plan_work,
    "graph_neighbors": lambda s, d, node, depth=1: graph.neighbours(view(s, d, "dep"), node, depth),
    "graph_path": lambda s, d, start, end: graph.shortest_path(view(s, d, "dep"), start, end),
    "repo_map": _rule("a18_repo_map"),
    "list_activity": _rule("p20_focus"),
    "compliance_report": _rule("a7_compliance"),
    "recap": _rule("a3_recap"),
    "send_agent_message": _rule("j10_recipients"),
    "claim": _claim,
    "inbox_ack": _rule("o15_inbox"),
    "pending_reconciliations": _pending,
    "explain_code": _rule("o7_why"),
    "graph_export": lambda s, d, form="json": graphio.lines(*graphio._graph(s, d), form),
    "graph_import": lambda s, d, lines: graphio.read_graph(lines),
}
#: Tools that only change a live server, a repository or a machine.
WRITES = frozenset("report_edit heartbeat defer_intent remember setup sync_agents_block install_hooks connect_agents open_dashboard move_repo remove_repo switch_workspace".split())


def call(spark: SparkSession, sf_dir: str, name: str, **params) -> DataFrame:
    if name in WRITES:
        raise ValueError(f"{name} writes; only queries are called here")
    if name not in TOOLS:
        raise KeyError(name)
    return TOOLS[name](spark, sf_dir, **params)


_CALLS = {
    "x3_recap": ("recap", "a3_recap", {"days": 0.25, "gap": 900}),
    "x3_recall": ("recall", "o5_recall", {"query": "of 9", "scope": "ws:r0", "limit": 7}),
    "x3_explain_code": ("explain_code", "o7_why", {"path": "d1/f9.py", "symbol": "f3", "limit": 12}),
    "x3_compliance": ("compliance_report", "a7_compliance", {"since": 7200}),
}
QUERIES = {key: (lambda s, d, tool=tool, params=params: call(s, d, tool, **params)) for key, (tool, _, params) in _CALLS.items()}
QUERIES["x3_path"] = lambda s, d: call(s, d, "graph_path", start="p9", end="p150")
ORACLE = {key: rules.twin(rule, **params) for key, (_, rule, params) in _CALLS.items()}
ORACLE["x3_path"] = graph.ORACLE["g8_shortest_path"].replace("'p120'", "'p9'").replace("'p61'", "'p150'")
