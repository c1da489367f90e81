"""Filter interaction audit: what each filter removes at each place of each order.

Duplicates are found by sorting.  Rows are range-partitioned by (fingerprint of
the text, id, place), so that a large group of copies is spread, and sorted
by fingerprint, whole text and id within a partition.  Rows of one text are then
neighbours, smallest id first, and a row fails if its group began with a smaller
id.  Only a fingerprint that goes on from one partition to the next leaves a
doubt, about the rows that begin a text's group in the first fingerprint of a
partition: they wait, each partition tells the texts and smallest ids of its last
fingerprint, and the two are joined.  Nothing but these few rows meets twice.

The failures of a row are bits of a mask.  Counts by part and mask add up, and
everything the audit tells follows from them, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
#: Bytes that go on with a code point.
CONTINUED = bytes(range(0x80, 0xC0))
WORDS = 200


class Facts(NamedTuple):
    """What the filters ask of one text; words end at ASCII white space."""

    words: int
    distinct: int
    upper: int
    points: int
    marks: int


def facts(text: bytes) -> Facts:
    words = text.split()
    n = len(text)
    return Facts(len(words), len(set(words)), n - len(text.translate(None, UPPER)), len(text.translate(None, CONTINUED)), n - len(text.translate(None, MARKS)))


Filters = dict[str, Callable[[Facts], bool]]
#: When a text fails a filter.
FILTERS: Filters = {
    "A": lambda x: x.words < WORDS,
    "B": lambda x: 100 * x.distinct < 50 * x.words,
    "C": lambda x: 100 * x.upper > 3 * x.points,
    "D": lambda x: x.marks > 0,
}
#: The filter that rows fail which repeat the text of a smaller id; the last bit.
DUPLICATE = "E"
#: Evidence of so many rows is broadcast (about 150 bytes each).
EVIDENCE = 50_000


def _masks(filters: Filters):
    """Sorted rows to masks.  ``fp`` and ``digest`` are given for a row that
    waits, and with ``least`` for evidence, which is not a row."""
    bits = [(1 << i, f) for i, f in enumerate(filters.values())]
    copy = 1 << len(bits)
    schema = pa.schema([("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("fp", pa.int64()), ("digest", pa.binary()), ("least", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = fp = text = least = None  # first fingerprint; those of the group at hand, and its smallest id
        mask = 0
        ended: dict[bytes, int] = {}  # smallest ids of groups of this fingerprint that are over: collisions only
        for b in batches:
            out = []
            for i, part, f, t in zip(*(b.column(c).to_pylist() for c in ("id", "part", "fp", "text"))):
                if f != fp or t != text:
                    if f == fp and least is not None:
                        ended[hashlib.sha256(text).digest()] = least
                    elif f != fp:
                        ended = {}
                    fp, text, least = f, t, None
                    head = f if head is None else head
                    x = facts(t)
                    mask = sum(bit for bit, fails in bits if fails(x))
                if i is None or (least is not None and i > least):
                    out.append((i, part, mask | (0 if i is None else copy), None, None, None))
                    continue
                least = i
                waits = f == head
                out.append((i, part, mask, f if waits else None, hashlib.sha256(t).digest() if waits else None, None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), s.type) for c, s in zip(zip(*out) if out else [[]] * 6, schema)], schema=schema)
        if least is not None:
            ended[hashlib.sha256(text).digest()] = least
        if ended:
            out = [(None, None, 0, fp, d, i) for d, i in ended.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), s.type) for c, s in zip(zip(*out), schema)], schema=schema)

    return run


def failure_masks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    filters: Filters = FILTERS, fingerprint: Callable[[str], Column] = F.xxhash64,
) -> DataFrame:
    """(id, part, mask), one row per input row: bit i is set if the row fails
    the i-th of ``filters``, the bit after the last if a smaller id of the table
    holds an identical text.

    Null texts are empty texts, null parts the empty string.  Rows of one id do
    not make each other copies; a row without an id is no copy and makes none.
    Other columns are ignored; an empty table gives no rows."""
    common.configure(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("fp", fingerprint("text")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("fp", "id", "place").sortWithinPartitions("fp", "text", "id").select("id", "part", "fp", F.col("text").cast("binary").alias("text"))
    found = common.cut(rows.mapInArrow(_masks(filters), "id long, part string, mask int, fp long, digest binary, least long"))
    evidence = common.cut(found.where("least is not null").groupBy("fp", "digest").agg(F.min("least").alias("first")))
    waiting = found.where("fp is not null and least is null").drop("least")
    decided = waiting.join(F.broadcast(evidence) if evidence.count() <= EVIDENCE else evidence, ["fp", "digest"], "left")
    copy = F.when(F.col("first") < F.col("id"), 1 << len(filters)).otherwise(0)
    return found.where("fp is null").select("id", "part", "mask").union(decided.select("id", "part", F.col("mask").bitwiseOR(copy).cast("int")))


def counters(masks: DataFrame, labels: DataFrame, label_id: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): rows, and those labelled 1; an id with
    several labels has each that any of them gives."""
    marks = labels.select(F.col(label_id).cast("long").alias("id"), F.col(good_col).alias("good"), F.col(toxic_col).alias("toxic")).where("id is not null")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    joined = masks.join(marks.groupBy("id").agg(one("good"), one("toxic")), "id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: Filters = FILTERS, **options) -> DataFrame:
    """One row per part, order of the filters and step: ``kept``, ``removed``,
    ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``.

    Removed are rows that fail the step's filter and none before it; redundant
    those that fail it and one before.  ``shapley`` adds what the filter removes
    in all orders: a row that fails m filters is lost to each of them in one m-th
    of the orders.  Odd rows as in ``failure_masks``; a table without rows has no
    parts."""
    names = [*filters, DUPLICATE]
    if len(set(names)) < len(names):
        raise ValueError(f"{DUPLICATE} is the filter of copies")
    bit = {c: 1 << i for i, c in enumerate(names)}
    orders = [("".join(p), i + 1, sum(bit[c] for c in p[:i]), bit[c]) for p in permutations(names) for i, c in enumerate(p)]
    states = sorted({(before, own) for _, _, before, own in orders})
    counts = counters(failure_masks(docs, id_col, text_col, part_col, filters, **options), labels)
    # a fixed number of states for each of a part's masks
    each = counts.select("part", "mask", "n", "good", "toxic", F.explode(F.array(*[F.struct(F.lit(s).alias("before"), F.lit(f).alias("own")) for s, f in states])).alias("x"))
    each = each.select("part", "mask", "n", "good", "toxic", "x.before", "x.own")
    mask, before, own = F.col("mask"), F.col("before"), F.col("own")
    fails, earlier = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0
    total = lambda when, what, name: F.sum(F.when(when, what).otherwise(0)).cast("long").alias(name)
    share = F.expr(f"n * {factorial(len(names))} div bit_count(mask)")
    cells = each.groupBy("part", "before", "own").agg(
        total(~fails & ~earlier, F.col("n"), "kept"), total(fails & ~earlier, F.col("n"), "removed"), total(fails & earlier, F.col("n"), "redundant"), total(mask == own, F.col("n"), "unique_fails"),
        total(fails & ~earlier, F.col("good"), "good_lost"), total(fails & ~earlier, F.col("toxic"), "toxic_lost"), total(fails, share, "shapley"),
    )
    steps = docs.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, own int")
    return cells.join(F.broadcast(steps), ["before", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


#: The result by its definition: every row goes through every order.
ORACLE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS MATERIALIZED (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)] AS f, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id),
c AS MATERIALIZED (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, f),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS own, [ascii(filter_order[y]) - 64 for y in range(1, step)] AS earlier FROM o, unnest(range(1, 6)) r(step)),
r AS (SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails, len([y for y in earlier if f[y]]) > 0 AS gone, len([y for y in f if y]) AS many FROM c, s),
p AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
coalesce(sum(n) FILTER (fails AND many = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM p"""
