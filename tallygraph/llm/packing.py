"""Packing documents into token sequences by cutting-stock column generation.

A document's tokens are cut into pieces of one full sequence and a rest.  The
rests' length histogram, rounded up to classes, is a cutting-stock problem: a
linear program over patterns (how many rests of each class share a sequence),
whose columns are priced by an integer knapsack.  Its solution is rounded down,
what is left is filled largest first, and the pieces of each class, ranked,
take the patterns' places in order.

The driver sees only class counts and patterns, whose number depends on the
sequence length and not on the input.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LENGTH = 2048
END = 1
#: Tokens per length class.
STEP = 16
#: Pieces of a class that are ranked by one task, about.
RANKED = 2_000
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def public_encoder(name: str = RANKS, tokenizer: str = TOKENIZER):
    """Function: text to ids, as ``tokenizers`` gives them from ``tokenizer``.

    Both files hold one vocabulary; the ranks encode several times faster.  The
    special tokens that ``tokenizer`` adds are read from it, and a text that
    holds one is encoded accordingly."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    enc = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in added):
            return np.array(enc.encode(text, allowed_special="all"), dtype="<u4")
        return np.array(enc.encode_ordinary(text), dtype="<u4")

    return encode


def pieces(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", encoder=public_encoder) -> DataFrame:
    """(doc_id, row, start, length, ids_crc32, doc_tokens): each row's tokens,
    the end token last, cut into full sequences and a rest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(), np.array([END], dtype="<u4")
        for pdf in batches:
            out = []
            for doc, row, text in zip(pdf["doc_id"], pdf["row"], pdf["text"]):
                ids = np.concatenate((encode(text), end)) if text else end
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    out.append((doc, row, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            done = pd.DataFrame(out, columns=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])
            done["doc_id"] = done["doc_id"].astype("Int64")
            yield done

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long")


def _knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best multiset of classes (repeats allowed) whose sizes fit ``room``."""
    best, took = [0.0] * (room + 1), [-1] * (room + 1)
    worth, sizes = value.tolist(), size.tolist()
    for k in sorted(range(len(sizes)), key=lambda k: -worth[k] / sizes[k]):
        v, s = worth[k], sizes[k]
        if v <= 1e-12:
            break
        for r in range(s, room + 1):
            if best[r - s] + v > best[r] + 1e-12:
                best[r], took[r] = best[r - s] + v, k
    pattern, r = np.zeros(len(sizes), dtype=np.int64), room
    while r > 0 and took[r] >= 0:
        pattern[took[r]] += 1
        r -= sizes[took[r]]
    return best[room], pattern


def plan_patterns(sizes: list[int], demand: list[int], room: int, max_columns: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering ``demand`` pieces of each
    of ``sizes`` units in sequences of ``room`` units.

    Revised simplex on  min sum x, A x = demand, x >= 0: the basis starts with
    one pattern per class, the knapsack over the dual prices finds the entering
    column, the ratio test the leaving one.  Ends when no pattern is worth more
    than one sequence; a program that takes more than ``max_columns`` columns is
    packed as far as it came, with a warning.
    """
    size, need = np.array(sizes), np.array(demand, dtype=float)
    m = len(size)
    each = np.maximum(1, room // size)
    basis, inverse, x = np.diag(each).astype(float), np.diag(1.0 / each), need / each
    for _ in range(max_columns):
        worth, column = _knapsack(inverse.sum(axis=0), size, room)
        if worth <= 1 + 1e-9:
            break
        step = (inverse * column).sum(axis=1)
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(x[up], 0) / step[up]
        k = int(ratio.argmin())
        basis[:, k] = column
        # product form: the inverse of the new basis by one pivot
        row, by = inverse[k] / step[k], ratio[k]
        inverse -= step[:, None] * row
        inverse[k] = row
        x = x - by * step
        x[k] = by
    else:
        warnings.warn(f"{max_columns} columns did not end the linear program of {m} classes; the packing may be a little wider", stacklevel=2)
    x = np.maximum(0, x)
    left, out = np.array(demand, dtype=np.int64), []
    for k in np.argsort(-x, kind="stable"):
        pattern = np.rint(basis[:, k]).astype(np.int64)
        used = pattern > 0
        times = int(min(np.floor(x[k] + 1e-9), (left[used] // pattern[used]).min()))
        if times > 0:
            out.append((pattern, times))
            left -= pattern * times
    while left.any():  # fewer pieces than the basis has columns, times its patterns
        pattern, r = np.zeros(m, dtype=np.int64), room
        for k in np.argsort(-size, kind="stable"):
            n = min(int(left[k]), r // int(size[k]))
            pattern[k] += n
            r -= n * int(size[k])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        out.append((pattern, times))
        left -= pattern * times
    return out


def pack(docs: DataFrame, length: int = LENGTH, step: int = STEP, id_col: str = "doc_id", text_col: str = "text", encoder=public_encoder) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one
    row per piece.

    Null and empty texts are one piece, the end token.  Rows that repeat an id
    are packed each for itself; a null id keeps its row; very long texts become
    many pieces.  Other columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    common.configure(spark)
    cut = common.cut(pieces(docs, length, id_col, text_col, encoder))
    room = -(-length // step)
    unit = F.ceil(F.col("length") / step).cast("int")
    cut = cut.withColumn("class", unit)
    counts = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most ``room`` rows
    if not counts:
        return cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    sizes = sorted(counts)
    plan = plan_patterns(sizes, [counts[s] for s in sizes], room)
    places, sequence, given = [], 0, dict.fromkeys(sizes, 0)
    for pattern, times in plan:
        slot = 0
        for s, n in zip(sizes, pattern.tolist()):
            if n:
                places.append((s, given[s], given[s] + n * times, n, sequence, slot))
                given[s] += n * times
                slot += n
        sequence += times
    # Bounded by the classes and patterns, both set by ``length`` and ``step``.
    where = spark.createDataFrame(places, "class int, lo long, hi long, per long, first long, slot long")

    # Exact ranks within a class, however many pieces it has: ranks within
    # buckets of a class, plus the sizes of the buckets before.
    buckets = F.create_map(*[F.lit(int(x)) for c, n in counts.items() for x in (c, max(1, n // RANKED))])
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("row", "start"), buckets[F.col("class")]).cast("int"))
    held = dealt.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = held.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("class", "bucket").orderBy("row", "start")) - 1)
    ranked = ranked.join(before, ["class", "bucket"]).withColumn("r", F.col("r") + F.col("before"))
    put = ranked.join(F.broadcast(where), "class").where("r >= lo AND r < hi")
    put = put.withColumn("sequence_id", F.col("first") + F.floor((F.col("r") - F.col("lo")) / F.col("per")))
    put = put.withColumn("slot", F.col("slot") + (F.col("r") - F.col("lo")) % F.col("per"))
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    put = put.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    return put.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
