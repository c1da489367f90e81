"""Live state as streams: presence and tripwires.

A step folds a key's rows into its state by ``seq`` and returns what it emits.
Each state is bounded: by a count (history) or by what is still open (wires).
Keys are a user or a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .stateful import _rows, _stateful

#: Fixed value of the rule: actions kept per user.
HISTORY = 30


def presence_step(state: dict, rows) -> list[tuple]:
    """A user's last ``HISTORY`` actions and focus.  A block reads: (seq, held,
    focus)."""
    out, history = [], state.setdefault("history", [])
    for seq, _, kind, _, path in rows:
        history.append([seq, kind])
        del history[:-HISTORY]
        if kind == "check_performed":
            state["focus"] = path
        if kind == "gate_block":
            out.append((seq, len(history), state.get("focus", "")))
    return out


def wire_step(state: list, rows) -> list[tuple]:
    """Wires (intents) on a path fire once, at the first edit after them.  Emits
    (seq, fired)."""
    out = []
    for seq, _, kind, _, _ in rows:
        if kind == "intent_declared":
            state.append(seq)
        elif kind == "edit_reported":
            out += [(w, seq) for w in state]
            state.clear()
    return out


_COLUMNS = ("seq", "usr", "kind", "ts", "path")


def _live(key: str, step, empty: str, out: str):
    names = [x.split()[0] for x in out.split(", ")]

    def query(spark, sf_dir) -> DataFrame:
        return _stateful(_rows(spark, sf_dir), key, step, empty, f"{key} string, {out}", names, _COLUMNS).drop(key)

    return query


QUERIES = {
    "st9_presence": _live("usr", presence_step, "{}", "seq long, held int, focus string"),
    "st12_tripwires": _live("path", wire_step, "[]", "seq long, fired long"),
}
ORACLE = {
    "st9_presence": """SELECT seq, CAST(least(30, rn) AS INTEGER) AS held, coalesce(focus, '') AS focus FROM (SELECT l.seq, l.kind, row_number() OVER (PARTITION BY l.usr ORDER BY l.seq) AS rn, last_value(CASE WHEN l.kind = 'check_performed' THEN l.path END IGNORE NULLS) OVER (PARTITION BY l.usr ORDER BY l.seq) AS focus FROM ledger l) t WHERE kind = 'gate_block'""",
    "st12_tripwires": "SELECT w.seq, min(e.seq) AS fired FROM ledger w JOIN ledger e ON e.path = w.path AND e.kind = 'edit_reported' AND e.seq > w.seq WHERE w.kind = 'intent_declared' GROUP BY w.seq",
}
