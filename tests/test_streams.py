"""Stateful steps on hand-made rows, and streams against a plain fold."""

import pytest

from tallygraph.sources.adapters import view
from tallygraph.streaming import keyed, live, stateful
from tallygraph.streaming.twins import _drained

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def ring_fold(state, row):
    seq, usr, kind, ts = row[:4]
    ring = state.setdefault("ring", [])
    if ring and ts - state["last"] > keyed.RING_TTL:
        ring.clear()
    state["last"], focus = ts, kind == "check_performed"
    if focus and ring and ring[-1][1] == usr and ring[-1][2]:
        ring[-1] = (seq, usr, True)
    else:
        ring.append((seq, usr, focus))
        del ring[:-7]
    return [(seq, len(ring), ring[0][0])] if kind == "gate_block" else []


def tail_fold(state, row):
    times = state.setdefault("times", [])
    times.append(row[3])
    times[:] = [t for t in times if t >= row[3] - keyed.TAIL_S][-40:]
    return [(row[0], len(times))] if row[2] == "gate_block" else []


def touch_fold(state, row):
    seq, _, kind, ts, path = row
    for p in [p for p, (last, _) in state.items() if ts - last > keyed.WORKING_S]:
        del state[p]
    if kind in ("edit_reported", "check_performed"):
        state[path] = (ts, state.get(path, (0, False))[1] or kind == "edit_reported")
        if kind == "check_performed":
            return [(seq, path, state[path][1])]
    return []


def expiring_fold(state, row):
    seq, usr, kind, ts = row[:4]
    out = [(seq, state["v"][0] if "v" in state and state["v"][1] > ts else None)] if kind == "check_performed" else []
    if kind == "intent_declared":
        state["v"] = (usr, ts + 86_400.0)
    return out


def hand_off_fold(state, row):
    seq, _, kind, ts = row[:4]
    out = []
    if kind == "gate_block":
        state[seq] = ts
    elif kind == "check_performed":
        for m, at in sorted(state.items()):
            if ts - at > keyed.MAX_AGE_S or ts - at >= keyed.GRACE_S:
                del state[m]
                if ts - at <= keyed.MAX_AGE_S:
                    out.append((m, seq))
    return out


FOLDS = {"st2_ring": ring_fold, "st4_expiring_values": expiring_fold, "st5_recent_tail": tail_fold, "st7_working_set": touch_fold, "st11_hand_off": hand_off_fold}


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    """Rows of six hours in ten files, time order not being that of the numbers
    within a file, and the files."""
    import random

    rng, rows = random.Random(4), []
    for i in range(900):
        ts = 1_704_067_200 + i * 24 + rng.choice([0, 0.5, 7, 100, 900])
        kind = rng.choice(["check_performed", "check_performed", "edit_reported", "gate_block", "intent_declared"])
        rows.append((i, float(ts + (90_000 if i > 700 else 0)), "s", f"u{rng.randrange(3)}", f"p{rng.randrange(4)}", kind))
    folder = tmp_path_factory.mktemp("rows")
    schema = "seq long, ts double, scope string, usr string, path string, kind string"
    for part in range(10):
        rows_ = rows[part * 90 : part * 90 + 90]
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(folder / f"part{part}"))
    return rows, folder, schema


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_micro_batches_do_not_matter(spark, busy, name, tmp_path):
    """One micro-batch and ten give the rows of a plain fold in time order, and
    the store holds what the rule keeps."""
    import time

    rows, folder, schema = busy
    key, kind_of, out = keyed.RULES[name]
    options = {"st2_ring": {"size": 7}, "st5_recent_tail": {"most": 40}}.get(name, {})
    processor = lambda: kind_of(cell=1800, **options)
    end = max(r[1] for r in rows) - keyed.LATE_S
    want, states = [], {}
    for seq, ts, scope, usr, path, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        if (ts // 1800 + 1) * 1800 <= end:
            k = {"scope": scope, "usr": usr, "path": path}[key]
            want += [(k, *o) for o in FOLDS[name](states.setdefault(k, {}), (seq, usr, kind, ts, path))]
    # files are read in the order of their age
    import os

    for part in range(10):
        for f in (folder / f"part{part}").iterdir():
            os.utime(f, (time.time() - 1000 + part,) * 2)
    for batches in (1, 10):
        files = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 10 // batches)
        stream = files.parquet(str(folder)).selectExpr("*", "timestamp_micros(CAST(ts * 1e6 AS BIGINT)) AS event_time")
        at = str(tmp_path / f"{batches}")
        got = _drained(keyed.keyed(stream, key, processor(), out), "append", at)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert want
    if name == "st2_ring":
        held = spark.read.format("statestore").option("stateVarName", "cells").load(f"{at}/state").selectExpr("user_map_value.seq AS seq").collect()
        assert {r.seq for r in held} == {x[0] for x in states["s"]["ring"]}


class Held(dict):
    """A map of the state store, in memory."""

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


def test_elements_are_read_and_written_once():
    store = Held({(1,): ("a",), (2,): ("b",)})
    e = keyed.Elements(store)
    assert e.get(1) == ("a",) and e.get(9) is None
    e.put(2, None)
    e.put(3, ("c",))
    e.put(4, ("d",))
    e.put(4, None)
    assert sorted(e.items()) == [(1, ("a",)), (3, ("c",))]
    e.flush()
    assert store == {(1,): ("a",), (3,): ("c",)}
    assert sorted(e.items()) == [(1, ("a",)), (3, ("c",))]


def test_values_expire():
    p = keyed.Expiring(ttl=10.0)
    p.value = keyed.Elements(Held())
    rows = [(1, "a", "check_performed", 0.0, "p"), (2, "b", "intent_declared", 1.0, "p"), (3, "c", "check_performed", 5.0, "p"), (4, "c", "check_performed", 11.0, "p")]
    assert [x for r in rows for x in p.step(r)] == [(1, None), (3, "b"), (4, None)] and not p.value.items()


def test_first_call_shows_nothing():
    state = {}
    rows = [(1, "a", "edit_reported"), (2, "b", "check_performed"), (3, "a", "edit_reported"), (4, "b", "edit_reported"), (5, "b", "check_performed")]
    assert stateful.call_step(state, rows) == [("b", 2, 0), ("b", 5, 1)]
    more = [(5 + i, "a", "edit_reported") for i in range(1, 30)] + [(40, "b", "check_performed")]
    assert stateful.call_step(state, more) == [("b", 40, stateful.SHOWN)]


def test_waiting_is_bounded_and_oldest_goes():
    state = {}
    stateful.wait_step(state, [(i, "a", "intent_declared", float(i), f"p{i}") for i in range(50)])
    assert len(state["a"]) == stateful.WAITING and state["a"][0] == "p10"
    stateful.wait_step(state, [(60, "b", "intent_declared", 60.0, "p20")])
    got = stateful.wait_step(state, [(99, "b", "intent_completed", 99.0, "p20"), (100, "c", "intent_completed", 100.0, "p0")])
    assert got == [("a", "p20", 99)] and state["b"] == ["p20"] and "p20" not in state["a"]


def test_completed_work_meets_only_who_waits():
    """The users of a scope are gone through once and not for every completion."""

    class Counted(dict):
        walks = 0

        def items(self):
            Counted.walks += 1
            return super().items()

    state = Counted({f"u{i}": [f"p{i}", "q"] for i in range(200)})
    got = stateful.wait_step(state, [(i, "z", "intent_completed", float(i), f"p{i}") for i in range(200)])
    assert got == [(f"u{i}", f"p{i}", i) for i in range(200)] and Counted.walks == 1
    assert [x[0] for x in stateful.wait_step(state, [(300, "u0", "intent_completed", 300.0, "q")])] == [f"u{i}" for i in range(1, 200)] and state["u0"] == ["q"]


def test_waiting_imports_equal_a_plain_fold(spark):
    want, scopes = [], {}
    for r in sorted(view(spark, SF, "ledger").select("seq", "usr", "path", "kind", "scope", "ts").collect(), key=lambda r: r.seq):
        if r.kind in ("intent_declared", "intent_completed"):
            want += [(r.scope, *x) for x in stateful.wait_step(scopes.setdefault(r.scope, {}), [(r.seq, r.usr, r.kind, r.ts, r.path)])]
    got = [(r.scope, r.usr, r.path, r.seq) for r in stateful.waiting_imports(stateful._rows(spark, SF)).collect()]
    assert got and sorted(got) == sorted(want)


def test_no_waiting_path_is_evicted(spark, tmp_path):
    """More paths than a live session remembers, the oldest of them completed, and
    a path waited for twice."""
    n = 2 * stateful.WAITING + 5
    rows = [(i, "a", "intent_declared", i) for i in range(n)] + [(n, "b", "intent_declared", 0)]
    rows += [(n + 1 + i, "b", "intent_completed", i) for i in range(n)] + [(3 * n, "a", "intent_declared", 0), (3 * n + 1, "c", "intent_completed", 0)]
    df = spark.createDataFrame([(seq, float(seq), "ws:r0", usr, f"p{p}", kind) for seq, usr, kind, p in rows], "seq long, ts double, scope string, usr string, path string, kind string")
    df.coalesce(1).write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/rows")
    got = [tuple(r) for r in stateful.waiting_imports(stream).collect()]
    want = [("ws:r0", "a", f"p{i}", n + 1 + i) for i in range(n)] + [("ws:r0", u, "p0", 3 * n + 1) for u in "ab"]
    assert sorted(got) == sorted(want)


def test_who_waits_for_nothing_is_let_go():
    state = {}
    stateful.wait_step(state, [(1, "a", "intent_declared", 1.0, "p"), (2, "b", "intent_completed", 2.0, "p")], None)
    assert state == {}


def test_slow_readers_skip():
    state = {}
    rows = [(i, "u", "k") for i in range(stateful.BOUND + 7)]
    got = stateful.newest_step(state, rows)
    assert len(got) == stateful.BOUND and got[0] == (7, "k", "u", 7) and state == {"skipped": 7}


def test_wires_fire_once():
    state = []
    rows = [(1, "a", "intent_declared", 0.0, "p"), (2, "b", "intent_declared", 0.0, "p"), (3, "c", "edit_reported", 0.0, "p"), (4, "c", "edit_reported", 0.0, "p")]
    assert live.wire_step(state, rows) == [(1, 3), (2, 3)]


def test_history_is_bounded():
    state = {}
    live.presence_step(state, [(i, "a", "edit_reported", 0.0, "p") for i in range(99)])
    assert len(state["history"]) == live.HISTORY


class Store:
    """A handle whose states are in memory and count the calls to them."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def _counted(self, state, names):
        def counted(f):
            def call(*args):
                self.calls += 1
                return f(*args)

            return call

        for name in names:
            setattr(state, name, counted(getattr(state, name)))
        return state

    def getMapState(self, *_):
        return self._counted(Held(), ("containsKey", "getValue", "updateValue", "removeKey", "iterator", "keys"))

    def getListState(self, *_):
        from types import SimpleNamespace

        rows: list = []
        return self._counted(SimpleNamespace(get=lambda: list(rows), appendValue=rows.append, put=lambda x: rows.__setitem__(slice(None), x), clear=rows.clear), ("get", "appendValue", "put", "clear"))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


@pytest.mark.parametrize("name", ["st7_working_set", "st4_expiring_values", "st5_recent_tail"])
def test_calls_to_the_store_do_not_go_with_days(name):
    """A key with rows on many days costs as many calls as one with rows on few,
    and what each day gives is the same."""
    from types import SimpleNamespace

    import pandas as pd

    def run(days):
        kinds = ("intent_declared", "edit_reported", "gate_block" if name == "st5_recent_tail" else "check_performed")
        rows = [(10 * d + i, "u", kinds[i], 86_400.0 * d + 60 * i, "p") for d in range(days) for i in range(3)]
        store, processor = Store(), keyed.RULES[name][1]()
        processor.init(store)
        assert not sum(map(len, processor.handleInputRows(("u",), iter([pd.DataFrame(rows, columns=keyed.NAMES)]), None)))
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 86_400_000 * (days - 1) + 1)
        out: list = []
        while due := sorted(t for t in store.timers if t < now.getCurrentWatermarkInMs()):
            out += [r for b in processor.handleExpiredTimer(("u",), now, SimpleNamespace(getExpiryTimeInMs=lambda: due[0])) for r in b.itertuples(index=False, name=None)]
            store.timers.discard(due[0])
        return store, out

    (few, _), (many, out) = run(3), run(60)
    assert [r[1] for r in out] == [10 * d + 2 for d in range(59)]  # the last day is not due
    assert many.timers == {60 * 86_400_000} and many.calls <= few.calls + 2


def test_elements_that_come_and_go_are_let_go():
    store = Held({(0,): (0.0,)})
    e = keyed.Elements(store)
    e.get(0)
    for i in range(3 * keyed.SEEN):
        e.put(i, (1.0,))
        e.put(i, None)
    e.put(-1, (2.0,))
    e.trim()
    assert e.seen == {0: None, -1: (2.0,)}
    e.flush()
    assert store == {(-1,): (2.0,)}
