"""URL filters: rules by host and path, and logistic regression on hashed
character n-grams of host and path where no rule fits.

The model is fitted on a small labelled URL table, a parameter; ``LABELLED``
is made by a rule from words that are common on either side of public block
lists.  It is independent of the urls to be judged: no host name of the given
tables is in it (a test holds that), so its figures there are of unseen hosts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (rule, verdict).  Fixed by the contract of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Hashed features, n-gram lengths, and the largest labelled table taken.
BUCKETS, GRAMS, MAX_LABELLED = 1 << 14, (3, 4, 5), 20_000

#: Topics of unwanted sites and the words that advertise them.
_TOPICS = "casino poker roulette jackpot betting bets sportsbook pills viagra pharmacy meds adult porn xxx sex cams spam linkfarm ads adserver adclick tracking tracker popunder payday replica warez keygen".split()
_BAITS = "bonus deals discount vip hot best club zone king today cheap free win online express mega".split()
#: Words that stand before names of either kind.
_FRONTS = "top super royal all my the world new our old".split()
#: Words that name ordinary sites.
_WORDS = (
    "library museum university school garden weather history science recipes kitchen travel railway hospital city council village theatre cinema orchestra "
    "nature forest river mountain bicycle chess football athletics physics biology chemistry geology language dictionary grammar poetry novel journal archive news "
    "radio gazette herald review notes atlas maps harbour bakery carpenter workshop software compiler database network robotics energy climate ocean planet star "
    "zeitung verein schule garten reise bibliothek musee ecole jardin voyage cuisine biblioteca escuela jardin viaje cocina noticias ciencia historia montana"
).split()
_SYLLABLES = [c + v for c in "b c d f g h j k l m n p r s t v w th st tr sh br".split() for v in "a e i o u".split()]
_TAILS = ("", "n", "r", "s", "l", "nd", "st", "ng", "ly")
_TOPS, _LANGS = ("example.com", "example.org", "example.net", "test", "invalid"), ("en", "de", "fr", "es")


def _labelled(names: int = 240, seed: int = 11) -> list[tuple[str, int]]:
    """A small labelled table.  Unwanted hosts pair a topic with a bait; good
    ones are ordinary words, alone or in pairs, and ``names`` invented names,
    since most hosts are no dictionary word.  Prefixes, domains and paths are
    alike on both sides, so that only the host's own part tells them apart."""
    import random

    rng = random.Random(seed)
    bad = [f"{t}{rng.choice(('-', ''))}{b}" for t in _TOPICS for b in rng.sample(_BAITS, 5)] + [f"{b}{t}" for t in _TOPICS for b in rng.sample(_FRONTS, 3)]
    good = _WORDS + [f"{a}{rng.choice(('-', ''))}{rng.choice(_WORDS)}" for a in _WORDS for _ in range(2)]
    good += [f"{f}{w}" for w in _WORDS for f in rng.sample(_FRONTS, 2)]
    good += ["".join(rng.choices(_SYLLABLES, k=rng.randint(2, 4))) + rng.choice(_TAILS) for _ in range(names)]
    out = []
    for label, hosts in ((1, bad), (0, good)):
        for h in dict.fromkeys(hosts):
            path = f"/{rng.choice(_LANGS)}/{rng.randrange(10_000)}{rng.choice(('', '.html', '/'))}"
            out.append((f"https://{rng.choice(('', 'www.', 'm.', 'blog.'))}{h}.{rng.choice(_TOPS)}{path}", label))
    return out


LABELLED = _labelled()


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _features(host: str, path: str) -> np.ndarray:
    found = set()
    for tag, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        b = s.encode("utf-8", "replace")
        for n in GRAMS:
            found.update(zlib.crc32(b[i : i + n], ord(tag)) % BUCKETS for i in range(len(b) - n + 1))
    return np.fromiter(found, dtype=np.int64)


def _split(url: str) -> tuple[str, str]:
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    return (m[1].lower(), m[2]) if m else ("", "")


def train(labelled: list[tuple[str, int]], epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression, by Adagrad on the driver;
    more than ``MAX_LABELLED`` rows are a ValueError.  Classes count as they
    come, so a host of unknown grams is what most rows are."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"a small labelled table has {MAX_LABELLED} rows at most, not {len(labelled)}")
    rows = [(_features(*_split(u)), y) for u, y in labelled]
    w, g, b, gb = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0, 1e-8
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            f, y = rows[k]
            if not len(f):
                continue
            p = 1 / (1 + np.exp(-np.clip(w[f].sum() / np.sqrt(len(f)) + b, -30, 30)))
            d = p - y
            step = d / np.sqrt(len(f)) + decay * w[f]
            g[f] += step * step
            w[f] -= rate * step / np.sqrt(g[f])
            gb += d * d
            b -= rate * d / np.sqrt(gb)
    return w, float(b)


def judge(
    pages: DataFrame, rules=RULES, labelled: list[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5,
) -> DataFrame:
    """(id, host, path, rule, verdict, score), one row per input row.

    A rule (host part, path part) fits its host and all subdomains if the path
    starts with the rule's; the longest decides, of two as long the one whose text
    is larger.
    Otherwise the model does: block at ``threshold`` or more.  A null url, or
    one without ``://``, has an empty host and path and is judged by the model.
    Urls of any length are read whole; other columns are ignored; repeated rows
    stay; an empty table gives no rows."""
    spark = pages.sparkSession
    common.configure(spark)
    sent = spark.sparkContext.broadcast(train(LABELLED if labelled is None else labelled))

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        w, b = sent.value
        z = [b + (w[f].sum() / np.sqrt(len(f)) if len(f := _features(h, p)) else 0.0) for h, p in zip(host, path)]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30))))

    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tested last, so outermost
        at, _, tail = text.partition("/")
        fits = ((F.col("host") == at) | F.endswith(F.col("host"), F.lit(f".{at}"))) & F.startswith(F.col("path"), F.lit(f"/{tail}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    rows = rows.withColumns({"rule": rule, "said": verdict}).withColumn("score", score("host", "path"))
    return rows.select(id_col, "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
