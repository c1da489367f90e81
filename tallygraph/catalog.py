"""Queries and their DuckDB twins, by name."""

from __future__ import annotations

from . import tools
from .operators import aliases, communities, folds, graph, lifecycles, modules, trees
from .plans import briefing, declared, rules, temporal, twins as texts, workflow  # noqa: F401  (three of them add rules and texts)
from .sources import graphio
from .sources.adapters import duck_sql, spark_sql
from .streaming import keyed, live, stateful, twins

# A declared query is a rule whose literals are its parameters.
rules.RULES |= {name: rules.lifted(sql) for name, sql in (declared.Q | workflow.Q).items()}
QUERIES: dict = {name: (lambda spark, sf_dir, name=name, **params: spark_sql(spark, sf_dir, rules.sql(name, **params))) for name in rules.RULES}
ORACLE_SQL: dict[str, str] = {name: duck_sql(rules.twin(name)) for name in rules.RULES}
for _part in (graph, folds, lifecycles, aliases, communities, modules, trees, tools, graphio, twins, stateful, live, keyed):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= {k: duck_sql(v) for k, v in _part.ORACLE.items()}

# the stream of calls gives what windows give over the whole ledger
ORACLE_SQL["st3_stream_calls"] = ORACLE_SQL["st3_unseen_by_call"]
