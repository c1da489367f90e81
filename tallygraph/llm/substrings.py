"""Substring dedup: seed and extend on winnowed anchors.

Words of ``length`` in a row are a window.  Each window picks one anchor, the run
of ``ANCHOR`` words in it whose hash is least (the last of equals), so windows of
equal words pick equal anchors at equal places, wherever they stand.  Windows
that pick the same place of a document are a block; about one word in twelve
begins one.

Seeds: anchors that stand in two places or more, found by one count over the
blocks; all others are done with.  Extension to both sides: if all blocks of an
anchor hold the same words around it, all their windows repeat.  Where they
differ, at the edges of a repeat, the anchor is extended to each of its windows,
so many words to the left and the rest to the right, and a window that another
place of the same anchor holds too is a match.  What windows cover, joined, are
the maximal repeats of ``length`` words or more; no pairs of documents are made,
so a passage in n documents costs n and not n * n.

Words have 64-bit hashes; windows are compared by 128 bits, those of the anchor
and of the window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 35
#: Words of an anchor.
ANCHOR = 8
#: Windows hashed at a time, and bytes of a text that are split at a time.
SPAN, PIECE = 1 << 16, 1 << 20
#: Words whose hashes a worker remembers.
KNOWN = 1 << 19
BASE = 0x9E3779B97F4A7C15
MASK = np.uint64((1 << 17) - 1)
SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) >= KNOWN:
            self.clear()
        self[word] = found
        return found


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a part of it at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            space = SPACE.search(text, end)
            end = space.start() if space else len(text)
        yield text[at:end].split()
        at = end


def word_hashes(text: bytes, known: Hashes) -> np.ndarray:
    parts = [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in pieces(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Rolling:
    """Hashes of any stretch of up to ``SPAN`` + ``length`` words."""

    def __init__(self, length: int):
        n = SPAN + 2 * length
        self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)

    def sums(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[: len(x)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, start, end) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if have < width else keys


def blocks(x: np.ndarray, length: int, anchor: int, rolling: Rolling):
    """(anchor, hash of the block, first window, windows) of a document's
    blocks, as arrays."""
    out = []
    for lo in range(0, len(x) - length + 1, SPAN):
        part = x[lo : lo + SPAN + length - 1]
        sums = rolling.sums(part)
        runs = np.arange(len(part) - anchor + 1)
        value = mixed(rolling.stretch(sums, runs, runs + anchor))
        place = MASK - runs.astype(np.uint64)
        picked = (MASK - (least((value & ~MASK) | place, length - anchor + 1) & MASK)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(picked[1:] != picked[:-1]) + 1))
        many = np.diff(np.concatenate((first, [len(picked)])))
        whole = rolling.stretch(sums, first, first + many + length - 1)
        # blocks of equal words may differ in where the anchor stands
        whole = mixed(whole + mixed((picked[first] - first).astype(np.uint64) * MASK + many.astype(np.uint64)))
        out.append((value[picked[first]].view(np.int64), whole.view(np.int64), first + lo, many))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4


def windows(x: np.ndarray, starts: np.ndarray, length: int, rolling: Rolling) -> np.ndarray:
    """Hashes of the windows at rising ``starts``."""
    out = []
    for lo in range(0, len(x), SPAN):
        a, b = np.searchsorted(starts, (lo, lo + SPAN))
        if a < b:
            at = starts[a:b] - lo
            out.append(rolling.stretch(rolling.sums(x[lo : lo + SPAN + length - 1]), at, at + length))
    return mixed(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def _lists(rows: list, kind) -> pa.Array:
    sizes = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=sizes[1:])
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.astype(kind)))


def _blocks(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling = Hashes(), Rolling(length)
        for b in batches:
            found = [blocks(word_hashes(t, known), length, anchor, rolling) for t in b.column("text").to_pylist()]
            columns = list(zip(*found)) if found else [[]] * 4
            lists = [_lists(list(c), kind) for c, kind in zip(columns, ("i8", "i8", "i4", "i4"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k"), *lists], names=["id", "k", "a", "g", "s", "m"])

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling = Hashes(), Rolling(length)
        for b in batches:
            nodes, anchors, firsts, hashes = [], [], [], []
            for node, t, asked in zip(*(b.column(c).to_pylist() for c in ("node", "text", "asked"))):
                asked.sort(key=lambda r: r["s"])
                s, m = np.array([r["s"] for r in asked], np.int64), np.array([r["m"] for r in asked], np.int64)
                ends = np.cumsum(m)
                starts = np.repeat(s - (ends - m), m) + np.arange(ends[-1])
                h = windows(word_hashes(t, known), starts, length, rolling)
                nodes += [node] * len(asked)
                anchors += [r["a"] for r in asked]
                firsts.append(s)
                hashes += np.split(h, ends[:-1])
            first = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(anchors, pa.int64()), pa.array(first, pa.int32()), _lists(hashes, "i8")], names=["node", "a", "s", "h"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("k"), text.cast("binary").alias("text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> tuple[DataFrame, Column]:
    """(node, spans) of documents that hold repeats, spans an array of (s, m):
    the ``m`` windows from word ``s`` on repeat; and the column that gives the
    node of a row of (id, k), k the hash of its text."""
    common.configure(docs.sparkSession)
    if not 0 < anchor <= length:
        raise ValueError("an anchor is a part of a window")
    texts = _texts(docs, id_col, text_col)
    rows = common.cut(texts.mapInArrow(_blocks(length, anchor), "id long, k long, a array<long>, g array<long>, s array<int>, m array<int>"))
    _, node = common.numbered(rows.select("id", "k").distinct(), "id", "k")
    each = rows.select(node.alias("node"), F.inline(F.arrays_zip("a", "g", "s", "m")))
    seeds = common.cut(each.groupBy("a").agg(F.count("*").alias("n"), (F.min("g") != F.max("g")).alias("edge")).where("n > 1"))
    found = common.keyed_join(each.select("node", "a", "s", "m"), seeds, ["a"], "n")
    seeded = common.cut(found.groupBy("node").agg(F.collect_set(F.struct("s", "m", "a", "edge")).alias("seeds")))
    asked = seeded.select("node", F.filter("seeds", lambda x: x["edge"]).alias("asked")).where(F.size("asked") > 0)
    edges = texts.select(node.alias("node"), "text").join(asked, "node").mapInArrow(_windows(length), "node long, a long, s int, h array<long>")
    edges = common.cut(edges)
    single = edges.select("node", "a", F.posexplode("h").alias("i", "h"), "s").select("node", "a", "h", (F.col("s") + F.col("i")).alias("s"))
    again = common.cut(single.groupBy("a", "h").agg(F.count("*").alias("n")).where("n > 1"))
    matched = common.keyed_join(single, again, ["a", "h"], "n").select("node", "s", F.lit(1).alias("m"))
    sure = seeded.select("node", F.explode(F.filter("seeds", lambda x: ~x["edge"])).alias("x")).select("node", "x.s", "x.m")
    return sure.union(matched).groupBy("node").agg(F.collect_set(F.struct("s", "m")).alias("spans")), node


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, kept = [], [], []
            spans = b.column("spans")
            flat = spans.flatten()
            s, m = (flat.field(c).to_numpy() for c in ("s", "m")) if len(flat) else (None, None)
            at = 0
            for t, size in zip(b.column("text").to_pylist(), spans.value_lengths().to_pylist()):
                if not size:
                    words = [w for part in pieces(t) for w in part]
                    total.append(len(words))
                    gone.append(0)
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                    continue
                n = sum(map(len, pieces(t)))
                steps = np.zeros(n + 1, np.int64)
                np.add.at(steps, s[at : at + size], 1)
                np.add.at(steps, np.minimum(s[at : at + size] + m[at : at + size] + length - 1, n), -1)
                at += size
                stays = np.cumsum(steps[:n]) == 0
                out, done = [], 0
                for words in pieces(t):
                    out += compress(words, stays[done : done + len(words)].tolist())
                    done += len(words)
                total.append(n)
                gone.append(n - int(stays.sum()))
                kept.append(b" ".join(out).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(id, n_words, n_removed, kept), one row per input row: its words that no
    repeated window covers, joined by one blank.

    Words end at ASCII white space and are not changed.  A window repeats if its
    words start anywhere else too, in the same document, in another one or in a
    row that repeats; all its copies go, and what goes is judged on the input.
    Null texts have no words; rows with a null id are documents like others;
    texts of fewer than ``length`` words stay.  Other columns are ignored; an
    empty table gives no rows."""
    spans, node = repeats(docs, id_col, text_col, length, anchor)
    rows = _texts(docs, id_col, text_col).withColumn("node", node)
    joined = rows.join(spans, "node", "left").select("id", "text", F.coalesce("spans", F.expr("cast(array() AS array<struct<s: int, m: int>>)")).alias("spans"))
    return joined.mapInArrow(_kept(length), "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The result by its definition, every window as a text.
ORACLE_SQL = rf"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + {LENGTH - 1}], ' ') AS t FROM d, unnest(range(1, len(w) - {LENGTH - 2})) r(i)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY t) AS n FROM s) c WHERE n > 1),
g AS (SELECT DISTINCT doc_id, i + j AS pos FROM h, unnest(range(0, {LENGTH})) r(j)),
k AS (SELECT p.doc_id, count(g.pos) AS n, string_agg(p.w, ' ' ORDER BY p.pos) FILTER (g.pos IS NULL) AS kept FROM (SELECT doc_id, pos, w[pos] AS w FROM d, unnest(range(1, len(w) + 1)) r(pos)) p LEFT JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
