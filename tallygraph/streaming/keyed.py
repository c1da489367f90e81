"""Live state, element by element: the ring, expiring values, the recent tail,
working sets and message hand-off on ``transformWithStateInPandas``.

Rows of a key wait in cells of ``CELL_S`` seconds (a parameter) until the watermark has passed
their cell, and are then taken in the order of time and number.  What they do so
depends on their times and numbers only, and not on how files fell into
micro-batches; rows of the newest cell and the last hour are not due yet.  Rows
later than the watermark are dropped, as in any windowed aggregation.

A key's state is a map of small rows in the state store.  All cells of a key that
are due are taken at one timer, and read and write the elements that they touch,
each once, and not what else the key holds.  A cell of a few rows has no entry of
its own: a key's small cells lie together, so calls to the store go with the keys
and not with their days.  What runs out goes by its time, so a key keeps what its
rule bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .stateful import _rows
from .twins import _drained

#: Fixed values of the rules: entries of the ring and seconds of silence after
#: which it is empty; seconds and rows of the tail; seconds that a path stays in
#: a working set; seconds before and until a message may be taken.
RING, RING_TTL = 100, 86_400
TAIL_S, TAIL_ROWS = 3600, 50_000
WORKING_S = 7200
GRACE_S, MAX_AGE_S = 20, 86_400
#: How late a row may be, and seconds of a cell of waiting rows.
LATE, LATE_S, CELL_S = "1 hour", 3600, 86_400
ROW = "seq long, usr string, kind string, ts double, path string"
NAMES = [c.split()[0] for c in ROW.split(", ")]
#: Waiting rows as they are stored, and rows of a micro-batch from which a cell
#: has an entry of its own.
COLUMNS = ", ".join("{} array<{}>".format(*c.split()) for c in ROW.split(", "))
LARGE = 256
#: Elements in memory after which those that are gone are let go, and rows of output
#: that leave together.
SEEN, OUT = 4096, 10_000


class Elements:
    """A map in the state store; what is read or written between two ``flush``
    is read once and written once.  A key that the store may hold is read before
    it is put."""

    def __init__(self, state) -> None:
        self.state, self.seen, self.stored, self.whole = state, {}, set(), False

    def get(self, key):
        if key not in self.seen:
            if self.whole:
                return None
            held = self.state.containsKey((key,))
            self.seen[key] = tuple(self.state.getValue((key,))) if held else None
            if held:
                self.stored.add(key)
        return self.seen[key]

    def put(self, key, value) -> None:
        if value is None:
            self.get(key)  # so that it is known whether the store has it
            if self.whole and key not in self.stored:
                self.seen.pop(key, None)
                return
        self.seen[key] = value

    def items(self) -> list:
        """All elements; what was put before stays put."""
        if not self.whole:
            for (key,), value in self.state.iterator():
                self.stored.add(key)
                self.seen.setdefault(key, tuple(value))
            self.whole = True
        return [(k, v) for k, v in self.seen.items() if v is not None]

    def trim(self) -> None:
        """Lets go of elements that came and went since the last ``flush``."""
        if len(self.seen) > SEEN:
            self.seen = {k: v for k, v in self.seen.items() if v is not None or k in self.stored}

    def flush(self) -> None:
        for key, value in self.seen.items():
            if value is not None:
                self.state.updateValue((key,), value)
            elif key in self.stored:
                self.state.removeKey((key,))
        self.seen, self.stored, self.whole = {}, set(), False


class Ordered(StatefulProcessor):
    """Rows of a key in the order of their time and number.  A subclass says in
    ``begin`` what state it has, and in ``step`` what a row does to it."""

    out: list[str] = []

    def __init__(self, cell: int = CELL_S) -> None:
        self.cell = cell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.few = handle.getListState("few", COLUMNS)
        self.waiting = handle.getMapState("waiting", "cell long", COLUMNS)
        self.maps = self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> list[Elements]:
        raise NotImplementedError

    def step(self, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cells: dict[int, list] = {}
        for b in rows:
            for row in zip(*(b[c].tolist() for c in NAMES)):
                cells.setdefault(int(row[3] // self.cell), []).append(row)
        few: list[tuple] = []
        for cell, new in cells.items():
            if len(new) < LARGE:
                few += new
            else:
                held = list(zip(*self.waiting.getValue((cell,)))) if self.waiting.containsKey((cell,)) else []
                self.waiting.updateValue((cell,), _columns(held + new))
        if few:
            self.few.appendValue(_columns(few))
        if cells:
            self._wake(min(cells))
        yield from ()

    def _wake(self, cell: int) -> None:
        self.handle.registerTimer((cell + 1) * self.cell * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        end = passed // 1000 // self.cell  # cells below it are due
        small: dict[int, list] = {}
        for chunk in self.few.get():
            for row in zip(*chunk):
                small.setdefault(int(row[3] // self.cell), []).append(row)
        large = {cell for (cell,) in self.waiting.keys()}
        later = [row for cell, rows in small.items() if cell >= end for row in rows]
        due, rest = sorted(c for c in large | small.keys() if c < end), [c for c in large | small.keys() if c >= end]
        if not due:
            return
        if later:
            self.few.put([_columns(later)])
        elif small:
            self.few.clear()
        out: list[tuple] = []
        for cell in due:
            rows = small.pop(cell, [])
            if cell in large:
                rows += zip(*self.waiting.getValue((cell,)))
                self.waiting.removeKey((cell,))
            for row in sorted(rows, key=lambda r: (r[3], r[0])):
                out += self.step(row)
            for elements in self.maps:
                elements.trim()
            if len(out) >= OUT:
                yield self._frame(key, out)
                out = []
        for elements in self.maps:
            elements.flush()
        if rest:
            self._wake(min(rest))
        if out:
            yield self._frame(key, out)

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *o) for o in out], columns=["key", *self.out])


def _columns(rows: list[tuple]) -> tuple:
    return tuple(list(c) for c in zip(*rows))


class Ring(Ordered):
    """The newest ``size`` events, empty after a silence of ``ttl``; a focus
    (check) takes the place of the one before it if that is the same user's.  A
    block reads (seq, held, oldest)."""

    out = ["seq", "held", "oldest"]

    def __init__(self, size: int = RING, ttl: float = RING_TTL, **options) -> None:
        super().__init__(**options)
        self.size, self.ttl = size, ttl

    def begin(self, handle):
        self.cells = Elements(handle.getMapState("cells", "place long", "seq long"))
        self.ends = Elements(handle.getMapState("ends", "one long", "first long, next long, last double, usr string, focus boolean"))
        return [self.cells, self.ends]

    def step(self, row):
        seq, usr, kind, ts, _ = row
        first, free, last, who, was = self.ends.get(0) or (0, 0, ts, "", False)
        if ts - last > self.ttl:
            for place in range(first, free):
                self.cells.put(place, None)
            first, who, was = free, "", False
        focus = kind == "check_performed"
        if focus and was and who == usr and free > first:
            free -= 1
            self.cells.get(free)  # the store may hold it
        self.cells.put(free, (seq,))
        free += 1
        if free - first > self.size:
            self.cells.put(first, None)
            first += 1
        self.ends.put(0, (first, free, ts, usr, focus))
        return [(seq, free - first, self.cells.get(first)[0])] if kind == "gate_block" else []


class Tail(Ordered):
    """Events of the last ``span`` seconds, ``most`` at most.  A block reads
    (seq, held)."""

    out = ["seq", "held"]

    def __init__(self, span: float = TAIL_S, most: int = TAIL_ROWS, **options) -> None:
        super().__init__(**options)
        self.span, self.most = span, most

    def begin(self, handle):
        self.times = Elements(handle.getMapState("times", "place long", "ts double"))
        self.ends = Elements(handle.getMapState("ends", "one long", "first long, next long"))
        return [self.times, self.ends]

    def step(self, row):
        seq, _, kind, ts, _ = row
        first, free = self.ends.get(0) or (0, 0)
        self.times.put(free, (ts,))
        free += 1
        while free - first > self.most or self.times.get(first)[0] < ts - self.span:
            self.times.put(first, None)
            first += 1
        self.ends.put(0, (first, free))
        return [(seq, free - first)] if kind == "gate_block" else []


class WorkingSet(Ordered):
    """Paths that a user read or wrote within ``span`` seconds; a write sticks
    while the path stays.  A check reads (seq, path, wrote)."""

    out = ["seq", "path", "wrote"]

    def __init__(self, span: float = WORKING_S, **options) -> None:
        super().__init__(**options)
        self.span = span

    def begin(self, handle):
        self.paths = Elements(handle.getMapState("paths", "path string", "last double, wrote boolean"))
        self.swept = Elements(handle.getMapState("swept", "one long", "ts double"))
        return [self.paths, self.swept]

    def step(self, row):
        seq, _, kind, ts, path = row
        if kind not in ("edit_reported", "check_performed"):
            return []
        if ts - (self.swept.get(0) or (float("-inf"),))[0] > self.span:  # once in a span, so that what ran out does not stay
            for p, (seen, _) in self.paths.items():
                if ts - seen > self.span:
                    self.paths.put(p, None)
            self.swept.put(0, (ts,))
        seen, wrote = self.paths.get(path) or (ts, False)
        wrote = (wrote and ts - seen <= self.span) or kind == "edit_reported"
        self.paths.put(path, (ts, wrote))
        return [(seq, path, wrote)] if kind == "check_performed" else []


class Expiring(Ordered):
    """A value that an intent sets for ``ttl`` seconds; a check reads (seq,
    value), null if unset or run out."""

    out = ["seq", "value"]

    def __init__(self, ttl: float = 86_400.0, **options) -> None:
        super().__init__(**options)
        self.ttl = ttl

    def begin(self, handle):
        self.value = Elements(handle.getMapState("value", "one long", "value string, until double"))
        return [self.value]

    def step(self, row):
        seq, usr, kind, ts, _ = row
        value, until = self.value.get(0) or (None, ts)
        if value is not None and until <= ts:
            self.value.put(0, None)
            value = None
        if kind == "intent_declared":
            self.value.put(0, (usr, ts + self.ttl))
        return [(seq, value)] if kind == "check_performed" else []


class HandOff(Ordered):
    """Messages (blocks) about a path wait for one taker, the first check after
    ``grace`` seconds; older than ``age`` they are dropped.  Emits (seq,
    taken_by)."""

    out = ["seq", "taken_by"]

    def __init__(self, grace: float = GRACE_S, age: float = MAX_AGE_S, **options) -> None:
        super().__init__(**options)
        self.grace, self.age = grace, age

    def begin(self, handle):
        self.messages = Elements(handle.getMapState("messages", "seq long", "ts double"))
        return [self.messages]

    def step(self, row):
        seq, _, kind, ts, _ = row
        if kind == "gate_block":
            self.messages.put(seq, (ts,))
        out = []
        if kind == "check_performed":
            for message, (at,) in sorted(self.messages.items()):
                if ts - at > self.age:
                    self.messages.put(message, None)
                elif ts - at >= self.grace:
                    self.messages.put(message, None)
                    out.append((message, seq))
        return out


def keyed(stream: DataFrame, key: str, processor: Ordered, out: str, late: str = LATE) -> DataFrame:
    """What ``processor`` emits for rows of ``stream`` (``_rows``) by ``key``."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.withWatermark("event_time", late).select(F.col(key).alias("key"), *NAMES, "event_time")
    return rows.groupBy("key").transformWithStateInPandas(processor, f"key string, {out}", "append", "EventTime")


#: name: key, processor, what it emits
RULES = {
    "st2_ring": ("scope", Ring, "seq long, held int, oldest long"),
    "st4_expiring_values": ("path", Expiring, "seq long, value string"),
    "st5_recent_tail": ("scope", Tail, "seq long, held int"),
    "st7_working_set": ("usr", WorkingSet, "seq long, path string, wrote boolean"),
    "st11_hand_off": ("path", HandOff, "seq long, taken_by long"),
}


def _query(name: str):
    key, processor, out = RULES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = _drained(keyed(_rows(spark, sf_dir), key, processor(), out), "append")
        return done.withColumnRenamed("key", key) if name == "st4_expiring_values" else done.drop("key")

    return run


QUERIES = {name: _query(name) for name in RULES}
#: Rows whose cell the last watermark has passed.
_DUE = f"due AS MATERIALIZED (SELECT * FROM ledger WHERE (floor(ts / {CELL_S}) + 1) * {CELL_S} <= (SELECT max(ts) FROM ledger) - {LATE_S})"
ORACLE = {
    "st2_ring": f"""WITH {_DUE}, n AS (SELECT *, lead(kind) OVER w AS nk, lead(usr) OVER w AS nu, CASE WHEN ts - lag(ts) OVER w > {RING_TTL} THEN 1 ELSE 0 END AS quiet FROM due WINDOW w AS (PARTITION BY scope ORDER BY ts, seq)),
g AS (SELECT *, sum(quiet) OVER (PARTITION BY scope ORDER BY ts, seq) AS era FROM n), k AS (SELECT scope, era, seq, kind, row_number() OVER (PARTITION BY scope, era ORDER BY ts, seq) AS rn FROM g WHERE NOT (kind = 'check_performed' AND nk IS NOT DISTINCT FROM 'check_performed' AND nu = usr))
SELECT k.seq, CAST(least({RING}, k.rn) AS INTEGER) AS held, o.seq AS oldest FROM k JOIN k o ON o.scope = k.scope AND o.era = k.era AND o.rn = greatest(1, k.rn - {RING - 1}) WHERE k.kind = 'gate_block'""",
    "st4_expiring_values": f"""WITH {_DUE}, r AS (SELECT *, last_value(CASE WHEN kind = 'intent_declared' THEN seq END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ts, seq) AS put FROM due)
SELECT r.path, r.seq, CASE WHEN r.ts - p.ts < 86400 THEN p.usr END AS value FROM r LEFT JOIN due p ON p.seq = r.put WHERE r.kind = 'check_performed'""",
    "st5_recent_tail": f"WITH {_DUE} SELECT seq, CAST(held AS INTEGER) AS held FROM (SELECT seq, kind, count(*) OVER (PARTITION BY scope ORDER BY ts RANGE BETWEEN {TAIL_S} PRECEDING AND CURRENT ROW) AS held FROM due) t WHERE kind = 'gate_block'",
    "st7_working_set": f"""WITH {_DUE}, t AS (SELECT usr, path, seq, ts, kind, lag(ts) OVER (PARTITION BY usr, path ORDER BY ts, seq) AS before FROM due WHERE kind IN ('edit_reported', 'check_performed')), i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > {WORKING_S} THEN 1 ELSE 0 END) OVER (PARTITION BY usr, path ORDER BY ts, seq) AS isle FROM t)
SELECT seq, path, wrote FROM (SELECT seq, path, kind, bool_or(kind = 'edit_reported') OVER (PARTITION BY usr, path, isle ORDER BY ts, seq) AS wrote FROM i) u WHERE kind = 'check_performed'""",
    "st11_hand_off": f"WITH {_DUE} SELECT m.seq, arg_min(c.seq, (c.ts, c.seq)) AS taken_by FROM due m JOIN due c ON c.path = m.path AND c.kind = 'check_performed' AND c.ts - m.ts BETWEEN {GRACE_S} AND {MAX_AGE_S} WHERE m.kind = 'gate_block' GROUP BY m.seq",
}
