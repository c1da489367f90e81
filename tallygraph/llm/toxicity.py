"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and the first 4, 5 and 6 letters
of longer ones, hashed to 32 bits.  The machine has a weight for each kept term
and a weight for each pair of terms, the inner product of their factors, so a
pair can mean what neither term does alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows fitted at most: those whose ids have the smallest hashes.
MAX_LABELLED = 12_000
#: Terms kept, by strength of their relation to the label, and the documents
#: that a term must occur in.
TERMS, MIN_DOCS = 4096, 3
FACTORS, EPOCHS, RATE, DECAY = 8, 12, 0.1, 2e-4
PREFIXES = (4, 5, 6)
#: Held out of the fit: crc32 of the id as text, modulo 5, is 0.
HOLD_OUT = (5, 0)
#: Words whose terms a worker remembers; memory only.
REMEMBERED, WHOLE = 500_000, 1 << 20
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words; long texts are read piece by piece."""
    if not text:
        return set()
    text = text.lower()
    if len(text) <= WHOLE:
        return set(_WORD.findall(text))
    return {m[0] for m in _WORD.finditer(text)}


def terms_of(word: str) -> list[int]:
    b = zlib.crc32(word.encode("utf-8", "replace"))
    return [b] + [zlib.crc32(f"{n}:{word[:n]}".encode("utf-8", "replace")) for n in PREFIXES if len(word) > n]


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for y, group in pdf.groupby("y"):
            found = [np.fromiter({h for w in words_of(t) for h in terms_of(w)}, dtype=np.int64) for t in group["text"]]
            term, n = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
            yield pd.DataFrame({"term": term, "pos": n * int(y), "neg": n * (1 - int(y))})


def fit_machine(rows: list[tuple[np.ndarray, int]], n_terms: int, seed: int = 7) -> dict:
    """Adagrad on the logistic loss; ``rows`` are (indices of terms, label)."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, FACTORS))
    gw, gv, b, gb = np.full(n_terms, 1e-6), np.full((n_terms, FACTORS), 1e-6), 0.0, 1e-6
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            x, y = rows[k]
            s = v[x].sum(axis=0)
            z = b + w[x].sum() + 0.5 * float(s @ s - (v[x] ** 2).sum())
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            gb += d * d
            b -= RATE * d / np.sqrt(gb)
            if len(x):
                dw = d + DECAY * w[x]
                gw[x] += dw * dw
                w[x] -= RATE * dw / np.sqrt(gw[x])
                dv = d * (s - v[x]) + DECAY * v[x]
                gv[x] += dv * dv
                v[x] -= 0.5 * RATE * dv / np.sqrt(gv[x])
    return {"w": w, "v": v, "b": float(b)}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """A model from labelled rows that are not held out, at most
    ``MAX_LABELLED``.  Null labels are left out, of repeated ones the largest
    counts; without rows the model says 0.5 always."""
    common.configure(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~common.held_out(id_col, *HOLD_OUT))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    # one document for each of at most MAX_LABELLED ids, however often it repeats
    sample = common.cut(texts.groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text")).select("y", "text"))
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    empty = {"terms": np.zeros(0, dtype=np.int64), "w": np.zeros(0), "v": np.zeros((0, FACTORS)), "b": 0.0}
    if not pos + neg:
        return empty
    counts = sample.mapInPandas(_count_terms, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    # strength: chi-square of the two by two table
    a, b, c, d = F.col("a"), F.col("b"), F.lit(pos) - F.col("a"), F.lit(neg) - F.col("b")
    top = (a * d - b * c).cast("double")
    chi = top * top / F.greatest((a + b).cast("double") * (c + d) * pos * neg, F.lit(1e-9))
    best = counts.where(a + b >= MIN_DOCS).withColumn("chi", chi).orderBy(F.desc("chi"), "term").limit(TERMS)
    terms = np.array(sorted(r.term for r in best.select("term").collect()), dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def active(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = _Active(sent.value)
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "x": [look.of(t).tolist() for t in pdf["text"]]})

    rows = [(np.array(r.x, dtype=np.int64), r.y) for r in sample.mapInPandas(active, "y int, x array<int>").collect()]
    rows.sort(key=lambda r: (r[1], r[0].tolist()))  # one order, however the tasks end
    return {"terms": terms} | fit_machine(rows, len(terms))


class _Active:
    """Indices of the kept terms of a text."""

    def __init__(self, terms: np.ndarray) -> None:
        self.at = {int(t): i for i, t in enumerate(terms)}
        self.memory: dict[str, tuple] = {}

    def of(self, text: str | None) -> np.ndarray:
        found, memory, at = set(), self.memory, self.at
        for w in words_of(text):
            x = memory.get(w)
            if x is None:
                x = tuple(at[h] for h in terms_of(w) if h in at)
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[w] = x
            if x:
                found.update(x)
        return np.array(sorted(found), dtype=np.int64)


def scorer(spark: SparkSession, model: dict):
    """Pandas UDF: text to probability of label 1; null and empty texts get
    that of a text without terms."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        look, w, v = _Active(m["terms"]), m["w"], m["v"]
        for batch in texts:
            z = np.full(len(batch), m["b"])
            for i, t in enumerate(batch):
                x = look.of(t)
                if len(x):
                    s = v[x].sum(axis=0)
                    z[i] += w[x].sum() + 0.5 * float(s @ s - (v[x] ** 2).sum())
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted), one row per input row.

    Whole texts are scored; repeated rows score alike, a null id is not held
    out, other columns are ignored, an empty table gives no rows."""
    score = scorer(docs.sparkSession, fit(docs, labels, id_col, text_col))
    rows = docs.select(id_col, common.held_out(id_col, *HOLD_OUT).alias("held_out"), score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; a score equal to it
    rejects.  Null and empty texts score as texts without terms, rows that
    repeat go or stay together, a null id makes no difference, columns stay as
    they are, and an empty table gives no rows."""
    score = scorer(docs.sparkSession, fit(docs, labels, id_col, text_col))
    return docs.where(score(F.col(text_col)) < threshold)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
