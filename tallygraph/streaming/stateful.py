"""Stateful streams: calls with a cursor, waiting imports, live fan-out.

State is kept per key by ``applyInPandasWithState``.  Who waits is kept per
(scope, path) until served, however many paths a user waits for; cursors are kept
per (scope, user) group of a scope, so they grow with the users ever seen there
and not with the events.  Within a batch rows are handled by ``seq``, so a key's
rows of one micro-batch are held together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .twins import _drained, _events

#: Paths waited for per user, the oldest go first, in a live session's memory (the
#: query has no such bound); unseen events shown; rows of a micro-batch that a live
#: reader has room for.
WAITING, SHOWN, BOUND = 40, 15, 256
_KIND = "CASE event_type WHEN 'purchase' THEN 'edit_reported' WHEN 'view' THEN 'check_performed' WHEN 'click' THEN 'intent_declared' WHEN 'signup' THEN 'intent_completed' ELSE 'gate_block' END"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as a stream (seq, ts, scope, usr, path, kind)."""
    k = "get_json_object(props, '$.k')"
    return _events(spark, sf_dir).selectExpr(
        "event_id AS seq", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS ts", "concat('ws:r', CAST(user_id % 4 AS STRING)) AS scope", "concat('u', CAST(user_id AS STRING)) AS usr",
        f"concat('d', CAST(CAST({k} AS BIGINT) % 8 AS STRING), '/f', {k}, '.py') AS path", f"{_KIND} AS kind", "ts AS event_time",
    )


def call_step(state: dict, rows) -> list[tuple]:
    """Folds (seq, usr, kind) into ``state`` {total, own: {usr: n}, cursor:
    {usr: foreign}}; returns (usr, seq, shown) per call.  A first call shows
    nothing, own events never count."""
    out = []
    own, cursor = state.setdefault("own", {}), state.setdefault("cursor", {})
    for seq, usr, kind in rows:
        state["total"] = state.get("total", 0) + 1
        own[usr] = own.get(usr, 0) + 1
        if kind == "check_performed":
            foreign = state["total"] - own[usr]
            out.append((usr, seq, min(SHOWN, foreign - cursor.get(usr, foreign))))
            cursor[usr] = foreign
    return out


def wait_step(state: dict, rows, most: int | None = WAITING) -> list[tuple]:
    """Folds (seq, usr, kind, ts, path) of one scope into ``state`` {usr: paths
    waited for, oldest first}; returns (usr, path, seq) when another's completed
    work satisfies who waits.  Past ``most`` paths of a user the oldest is evicted,
    with None none is; a path waited for is not added again, and a user who waits
    for none is let go.

    ``waiters`` names who waits for a path by the order in which users came, so
    completed work meets those users only and not all of the scope."""
    out: list[tuple] = []
    order, users = {usr: i for i, usr in enumerate(state)}, list(state)
    waiters: dict[str, set[int]] = {}
    for usr, waiting in state.items():
        for path in waiting:
            waiters.setdefault(path, set()).add(order[usr])
    for seq, usr, kind, _, path in rows:
        if kind == "intent_declared":
            if usr not in order:
                order[usr] = len(users)
                users.append(usr)
            waiting = state.setdefault(usr, [])
            if path not in waiting:
                waiting.append(path)
                waiters.setdefault(path, set()).add(order[usr])
                for gone in waiting[:-most] if most else ():
                    waiters[gone].discard(order[usr])
                    waiting.remove(gone)
        elif kind == "intent_completed":
            own = order.get(usr)
            for other in sorted(x for x in waiters.get(path, ()) if x != own):
                state[users[other]].remove(path)
                if not state[users[other]]:
                    del state[users[other]]
                waiters[path].discard(other)
                out.append((users[other], path, seq))
    return out


def newest_step(state: dict, rows) -> list[tuple]:
    """Rows of one micro-batch as a reader with room for ``BOUND`` gets them:
    the newest, with the number that it lagged behind and skipped."""
    rows = list(rows)
    skipped = max(0, len(rows) - BOUND)
    state["skipped"] = state.get("skipped", 0) + skipped
    return [(seq, kind, usr, skipped) for seq, usr, kind in rows[skipped:]]


def _stateful(stream: DataFrame, key: str | list[str], step, empty: str, schema: str, names: list[str], columns: tuple = ("seq", "usr", "kind")) -> DataFrame:
    """Drains ``stream`` through ``step``, by one key or several."""
    keys = [key] if isinstance(key, str) else key

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0] if state.exists else empty)
        rows = sorted(r for b in batches for r in b[list(columns)].astype({"seq": int}).itertuples(index=False, name=None))
        out = step(held, rows)
        state.update((json.dumps(held),))
        yield pd.DataFrame([(*k, *o) for o in out], columns=[*keys, *names])

    done = stream.groupBy(*keys).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.NoTimeout)
    return _drained(done, "append")


def unseen_by_call(stream: DataFrame) -> DataFrame:
    """(scope, usr, seq, shown): events of others since a user's last call."""
    return _stateful(stream, "scope", call_step, "{}", "scope string, usr string, seq long, shown long", ["usr", "seq", "shown"])


def waiting_imports(stream: DataFrame) -> DataFrame:
    """(scope, usr, path, seq): who waited for a path and the row that satisfied
    it.  Nobody is evicted, so the paths of a scope do not meet and each is a key
    of its own, whose state is the users who wait for it."""

    def step(state: dict, rows) -> list[tuple]:
        return [(usr, seq) for usr, _, seq in wait_step(state, rows, None)]

    rows = stream.where("kind in ('intent_declared', 'intent_completed') and scope is not null and path is not null and usr is not null")
    done = _stateful(rows, ["scope", "path"], step, "{}", "scope string, path string, usr string, seq long", ["usr", "seq"], ("seq", "usr", "kind", "ts", "path"))
    return done.select("scope", "usr", "path", "seq")


def fan_out(stream: DataFrame, scope: str | None = None) -> DataFrame:
    """(scope, seq, kind, usr, skipped): live rows per scope, micro-batch by
    micro-batch; of a batch a slow reader gets the newest ``BOUND``."""
    rows = stream if scope is None else stream.where(F.col("scope") == scope)
    return _stateful(rows, "scope", newest_step, "{}", "scope string, seq long, kind string, usr string, skipped long", ["seq", "kind", "usr", "skipped"])


QUERIES = {
    "st1_fan_out": lambda s, d: fan_out(_rows(s, d)),
    "st3_stream_calls": lambda s, d: unseen_by_call(_rows(s, d)),
    "st8_waiting_imports": lambda s, d: waiting_imports(_rows(s, d)),
}
ORACLE = {
    "st8_waiting_imports": """WITH d AS (SELECT scope, path, usr, seq FROM ledger WHERE kind = 'intent_declared'), c AS (SELECT scope, path, usr, seq FROM ledger WHERE kind = 'intent_completed') SELECT DISTINCT d.scope, d.usr, d.path, c.seq FROM d JOIN c ON c.scope = d.scope AND c.path = d.path AND c.usr <> d.usr AND c.seq > d.seq
WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.scope = d.scope AND x.path = d.path AND x.usr <> d.usr AND x.seq > d.seq AND x.seq < c.seq)""",
    # what there is arrives as one batch
    "st1_fan_out": "SELECT scope, seq, kind, usr, greatest(0, n - 256) AS skipped FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq DESC) AS back, count(*) OVER (PARTITION BY scope) AS n FROM ledger) t WHERE back <= 256",
}
