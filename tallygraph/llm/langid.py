"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, and every run of characters other than letters becomes
one space.  For each language there is a model of order ``ORDER``.  The n-grams
of all models stand, by 64-bit hash, in one sorted array per order, each with
its interpolated log-probability under every language; contexts stand likewise
with their back-off weights.  The language of the lowest cross-entropy per
character is chosen.  Temperature and rejection limit are set on documents kept
out of the counts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 5
#: Documents per language that are expected in the sample for the models; a
#: document is in it by the hash of its id.  One in ten is for calibration.
SAMPLE = 500
#: Documents in a language's sample below which none of them is for calibration.
FEW = 20
#: Held out of the fit: crc32 of the id as text, modulo 3, is 1.
HOLD_OUT = (3, 1)
#: Characters of all languages' names together, and rows, up to which the shares
#: are broadcast; beyond that the join shuffles.
BROADCAST_CHARS, BROADCAST_ROWS = 1 << 20, 1 << 14
#: Characters scored at a time, and scores of characters under languages held at
#: a time, which lowers the former where there are many languages.
SPAN, LEAST_SPAN, CELLS = 1 << 20, 1 << 12, 1 << 25
PAD, SPACE = 0, 32
_MUL = np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to itself if a letter, else to a space; once per process."""
    if not _tables:
        t = np.full(sys.maxunicode + 1, SPACE, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                t[c] = c
        t[PAD] = PAD
        _tables.append(t)
    return _tables[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts one after the other, each behind ORDER - 1 pads,
    and the index of the text that each symbol is from."""
    pad = "\0" * (ORDER - 1)
    lowered = [t.lower().replace("\0", " ") for t in texts]
    flat = np.frombuffer((pad + pad.join(lowered)).encode("utf-32-le", "replace"), dtype="<u4") if lowered else np.zeros(0, "<u4")
    s = _letters()[flat]
    owner = np.repeat(np.arange(len(texts)), [len(t) + ORDER - 1 for t in lowered])
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = ~((s[1:] == SPACE) & ((s[:-1] == SPACE) | (s[:-1] == PAD)))
    return s[keep], owner[keep]


def cleaned(text: str, span: int) -> Iterator[np.ndarray]:
    """Symbols of a text, from ``span`` characters at a time; all together they
    are those of the whole text."""
    text = text.lower().replace("\0", " ")
    last = PAD
    for a in range(0, len(text), span):
        s = _letters()[np.frombuffer(text[a : a + span].encode("utf-32-le", "replace"), dtype="<u4")]
        before = np.concatenate(([last], s[:-1]))
        s = s[(s != SPACE) | ((before != SPACE) & (before != PAD))]
        if len(s):
            last = s[-1]
            yield s


def hashes(s: np.ndarray) -> list[np.ndarray]:
    """For n of 1 to ORDER, the hash of the n symbols that end at each place."""
    x = (s.astype(np.uint64) + np.uint64(1)) * _MUL
    x ^= x >> np.uint64(29)
    out = [x]
    for _ in range(1, ORDER):
        h = out[-1] * _MUL
        h[1:] = h[:-1].copy()
        h[:1] = 0
        out.append(h * np.uint64(0xBF58476D1CE4E5B9) + x)
    return out


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, group in pdf.groupby("lang"):
            s, _ = symbols(list(group["text"]))
            h = hashes(s)[-1]
            real = np.flatnonzero(s != PAD)
            if not len(real):
                continue
            _, at, n = np.unique(h[real], return_index=True, return_counts=True)
            rows = real[at][:, None] + np.arange(1 - ORDER, 1)
            grams = np.ascontiguousarray(s[rows].astype("<u4")).view(f"<U{ORDER}").ravel()
            yield pd.DataFrame({"lang": lang, "gram": grams.astype(object), "n": n})


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def build(counts: pd.DataFrame) -> dict:
    """Sorted hash arrays from counts of ORDER-grams (lang, gram, n)."""
    langs = sorted(counts["lang"].unique().tolist())
    code = {x: i for i, x in enumerate(langs)}
    k, m = len(langs), len(counts)
    # a gram ends in no pad, so its width is kept
    chars = np.zeros((m, ORDER), dtype=np.uint32)
    if m:
        chars[:] = np.array(counts["gram"].tolist(), dtype=f"<U{ORDER}").view("<u4").reshape(m, ORDER)
    lang = counts["lang"].map(code).to_numpy(dtype=np.int64)

    def hashed(c: np.ndarray) -> np.ndarray:
        x = (c.astype(np.uint64) + np.uint64(1)) * _MUL
        x ^= x >> np.uint64(29)
        h = x[:, 0]
        for j in range(1, c.shape[1]):
            h = h * _MUL * np.uint64(0xBF58476D1CE4E5B9) + x[:, j]
        return h

    model = {"langs": langs, "keys": {}, "logp": {}, "ctx": {}, "logg": {}}
    # counts of each order: as seen at the top, kinds of left neighbours below
    per = {ORDER: (chars, lang, counts["n"].to_numpy(dtype=float))}
    for n in range(ORDER - 1, 0, -1):
        c, l, _ = per[n + 1]
        frame = pd.DataFrame({"h": hashed(c[:, 1:]), "l": l})
        sizes = frame.groupby(["h", "l"], sort=False).ngroup().to_numpy()
        first = np.unique(sizes, return_index=True)[1]
        per[n] = (c[first, 1:], l[first], np.bincount(sizes).astype(float))
    lower, lower_keys = None, None
    for n in range(1, ORDER + 1):
        c, l, count = per[n]
        keys, at = np.unique(hashed(c), return_inverse=True)
        table = np.zeros((len(keys), k))
        table[at, l] = count
        ones, twos = (table == 1).sum(axis=0), (table == 2).sum(axis=0)
        discount = np.clip(ones / np.maximum(1, ones + 2 * twos), 0.1, 0.95)
        example = np.zeros((len(keys), n), dtype=np.uint32)
        example[at] = c
        if n == 1:
            ctx_of, n_ctx = np.zeros(len(keys), dtype=np.int64), 1
            ctx = np.zeros(1, dtype=np.uint64)
        else:
            ctx, ctx_of = np.unique(hashed(example[:, :-1]), return_inverse=True)
            n_ctx = len(ctx)
        total, kinds = np.zeros((n_ctx, k)), np.zeros((n_ctx, k))
        np.add.at(total, ctx_of, table)
        np.add.at(kinds, ctx_of, table > 0)
        gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1e-12), 1.0)
        if n == 1:
            below = np.full((len(keys), k), 1.0 / (len(keys) + 1))
        else:
            below = lower[np.searchsorted(lower_keys, hashed(example[:, 1:]))]
        p = np.maximum(table - discount, 0) / np.maximum(total[ctx_of], 1e-12) + gamma[ctx_of] * below
        model["keys"][n], model["logp"][n] = keys, np.log(p).astype(np.float32)
        model["ctx"][n], model["logg"][n] = ctx, np.log(gamma).astype(np.float32)
        lower, lower_keys = p, keys
    model["unseen"] = (model["logg"][1][0] - np.log(len(model["keys"][1]) + 1)).astype(np.float32) if k else np.zeros(0, np.float32)
    return model


def log_likelihoods(model: dict, s: np.ndarray) -> np.ndarray:
    """Log-probability of each symbol under each language (rows x languages)."""
    k = len(model["langs"])
    h = hashes(s)
    out = np.zeros((len(s), k), dtype=np.float32)
    rest = np.arange(len(s))
    for n in range(ORDER, 0, -1):
        at, hit = _find(model["keys"][n], h[n - 1][rest])
        out[rest[hit]] += model["logp"][n][at[hit]]
        rest = rest[~hit]
        if not len(rest):
            return out
        if n > 1:
            before = np.maximum(rest - 1, 0)
            at, hit = _find(model["ctx"][n], h[n - 2][before])
            out[rest[hit]] += model["logg"][n][at[hit]]
    out[rest] += model["unseen"]
    return out


def entropies(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per symbol under each language, and letters, per text."""
    k, m = len(model["langs"]), len(texts)
    total, letters, count = np.zeros((m, k)), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)

    def add(s: np.ndarray, owner: np.ndarray, skip: int = 0) -> None:
        real = s != PAD
        real[:skip] = False
        ll = log_likelihoods(model, s)
        for j in range(k):
            total[:, j] += np.bincount(owner[real], weights=ll[real, j], minlength=m)
        count[:] += np.bincount(owner[real], minlength=m)
        letters[:] += np.bincount(owner[real & (s != SPACE)], minlength=m)

    held, size = [], 0
    groups = []
    span = min(SPAN, max(LEAST_SPAN, CELLS // max(1, k)))
    for i, t in enumerate(texts):
        if len(t) > span:
            before = np.zeros(ORDER - 1, np.uint32)  # pads, then the last symbols of what stands before
            for s in cleaned(t, span):
                s = np.concatenate((before, s))
                add(s, np.full(len(s), i), ORDER - 1)
                before = s[1 - ORDER :]
            continue
        held.append(i)
        size += len(t)
        if size >= span:
            groups.append(held)
            held, size = [], 0
    for g in [*groups, held]:
        if g:
            s, owner = symbols([texts[i] for i in g])
            add(s, np.array(g)[owner])
    return -total / np.maximum(1, count)[:, None], letters


def _softmax(ce: np.ndarray, letters: np.ndarray, heat: float) -> np.ndarray:
    z = -ce * heat * np.sqrt(np.maximum(1, letters))[:, None]
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Models of the languages of rows with an id, a text and a lang that are
    not held out, from about ``SAMPLE`` documents each."""
    spark = common.configure(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~common.held_out("id", *HOLD_OUT))
    # one row per language, so texts stay where they are if these are few
    share = common.cut(known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.count("*")).alias("share"), (F.count("text") < FEW).alias("few")))
    rows, chars = share.agg(F.count("*"), F.coalesce(F.sum(F.length("lang")), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS:
        share = F.broadcast(share)
    part = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(F.col("text").isNotNull()).join(share, "lang").where(part < F.col("share"))
    sample = common.cut(sample.select("lang", "text", (~F.col("few") & (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(10)) == 0)).alias("later")))
    counts = sample.where("not later").mapInPandas(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = build(counts.orderBy("lang", "gram").toPandas())
    model |= {"heat": 1.0, "limit": float("inf")}
    if not model["langs"]:
        return model
    sent = spark.sparkContext.broadcast(model)
    k = len(model["langs"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ce, letters = entropies(sent.value, list(pdf["text"]))
            yield pd.DataFrame({"lang": pdf["lang"], "letters": letters, "ce": list(ce)})

    seen = sample.where("later").mapInPandas(score, "lang string, letters long, ce array<double>").where("letters > 0").toPandas()
    seen = seen[seen["lang"].isin(model["langs"])]
    if len(seen) >= 10:
        ce = np.array(seen["ce"].tolist()).reshape(len(seen), k)
        letters = seen["letters"].to_numpy()
        own = seen["lang"].map({x: i for i, x in enumerate(model["langs"])}).to_numpy()
        loss = {h: -np.log(np.maximum(1e-9, _softmax(ce, letters, h)[np.arange(len(own)), own])).mean() for h in (0.1, 0.2, 0.5, 1.0, 2.0, 5.0)}
        model["heat"] = min(loss, key=loss.get)
        best = ce.min(axis=1)
        model["limit"] = float(np.quantile(best, 0.99) + 2 * best.std() + 0.1)
    return model


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected), one row per input row.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if nothing was learnt.  ``rejected`` marks texts whose cross-entropy
    exceeds what calibration found.  Whole texts are read, repeated rows are
    judged alike, ties go to the first language in order, other columns are
    ignored, an empty table gives no rows."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        names = np.array([*m["langs"], "und"], dtype=object)
        for batch in texts:
            if not len(batch) or len(names) == 1:
                yield pd.DataFrame({"lang_pred": ["und"] * len(batch), "score": [0.0] * len(batch), "rejected": [True] * len(batch)})
                continue
            ce, letters = entropies(m, [t or "" for t in batch])
            at, p = ce.argmin(axis=1), _softmax(ce, letters, m["heat"])
            none = letters == 0
            score = np.where(none, 0.0, p[np.arange(len(at)), at])
            yield pd.DataFrame({"lang_pred": names[np.where(none, len(names) - 1, at)], "score": score, "rejected": none | (ce.min(axis=1) > m["limit"])})

    out = docs.select(id_col, common.held_out(id_col, *HOLD_OUT).alias("held_out"), judge(F.col(text_col)).alias("j"))
    return out.select(id_col, "held_out", "j.lang_pred", "j.score", "j.rejected")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
