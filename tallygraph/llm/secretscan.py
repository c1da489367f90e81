"""Secret scans with multipart credential linking, in DataFrame functions only.

One pass finds base spans (assignments, access identifiers, long hex runs) and
weak parts, which mean little alone: bare long tokens, user names, endpoints.
Parts are interval-joined within scopes of ``SCOPE`` code points, by an
equi-join on (document, stretch of text) and a distance test; a weak part is
reported only when a complementary part lies in its scope.

Spans are found by splitting at a pattern and adding up lengths, since Spark's
regular expressions return matches without positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed by the contract of the scan.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts: kind and pattern.
ENDPOINT = r"https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"
USER = r"""(?i:\buser(?:name|_?id)?|\blogin|\bclient_?id|\baccount)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]+"""
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])"
#: Code points between complementary parts.
SCOPE = 256

BASE = ("assign", "access", "hex")
WEAK = ("token", "user", "endpoint")
#: What completes a weak part: a secret needs an identifier or an endpoint,
#: an identifier or an endpoint needs a secret.
COMPLEMENTS = {
    "token": ("access", "user", "endpoint"),
    "user": ("assign", "hex", "token"),
    "endpoint": ("assign", "access", "hex", "token"),
}
KINDS = BASE + WEAK
SPAN = "array<struct<start: int, end: int, rank: int>>"


#: Matches summed up at a time, so that long lists stay near linear.
RUN = 256


def _spans(rows: DataFrame, text: str, patterns: list[tuple[str, Column | None]]) -> DataFrame:
    """Adds ``parts``: (start, end, rank) of each pattern's leftmost
    non-overlapping matches, in code points.  A pattern comes with a condition
    on the element ``x`` of its matches, or None.

    Only texts that hold a match are split and extracted.  The steps are
    projections of their own, so that no search runs twice."""
    t, n = F.col(text), range(len(patterns))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"__hit{i}": F.when(F.regexp_like(t, F.lit(p)), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for i, (p, _) in enumerate(patterns)})
    rows = rows.withColumns({f"__gap{i}": F.when(F.size(f"__hit{i}") > 0, F.transform(F.split(t, patterns[i][0], -1), F.char_length)).otherwise(F.array().cast("array<int>")) for i in n})
    # A gap and the match after it; the last gap has none.

    def two(i: int) -> Column:
        keep = patterns[i][1] or (lambda h: F.lit(True))
        pair = lambda g, h: F.struct(g.alias("gap"), F.char_length(h).alias("len"), keep(h).alias("keep"))
        return F.zip_with(F.slice(f"__gap{i}", F.lit(1), F.size(f"__hit{i}")), f"__hit{i}", pair)

    rows = rows.withColumns({f"__two{i}": two(i) for i in n})

    def located(i: int) -> Column:
        two = F.col(f"__two{i}")

        def run(c: Column) -> Column:
            base = F.aggregate(F.slice(two, F.lit(1), c * RUN), F.lit(0), lambda acc, x: acc + x["gap"] + x["len"])
            zero = F.struct(base.alias("at"), F.array().cast(SPAN).alias("out"))

            def step(acc: Column, x: Column) -> Column:
                begin = acc["at"] + x["gap"]
                end = begin + x["len"]
                span = F.array(F.struct(begin.alias("start"), end.alias("end"), F.lit(i).alias("rank")))
                return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

            return F.aggregate(F.slice(two, c * RUN + 1, F.lit(RUN)), zero, step)["out"]

        runs = F.sequence(F.lit(0), F.floor((F.size(two) - 1) / RUN).cast("int"))
        return F.when(F.size(two) > 0, F.flatten(F.transform(runs, run))).otherwise(F.array().cast(SPAN))

    rows = rows.withColumn("parts", F.concat(*[located(i) for i in n]))
    return rows.drop(*[f"__{x}{i}" for i in n for x in ("hit", "gap", "two")])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k0, k1, id, parts): every base and weak part of each row's whole text.

    (k0, k1) stands for the id and the text, so rows that repeat have equal
    keys and equal results.  A null text is empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    long_enough = lambda hit: F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_MIN
    found = _spans(rows, "t", [(ASSIGN, long_enough), (ACCESS, None), (HEX, None), (TOKEN, None), (USER, None), (ENDPOINT, None)])
    return found.select(F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("k0"), F.xxhash64(F.col("id").isNull(), "t").alias("k1"), "id", "parts")


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(k0, k1, found): weak parts with a complementary part within ``scope``
    code points, one row per document that has any.

    A stretch of ``scope`` code points holds a bounded number of parts, however
    long the document, so no key of the join can grow hot with one document.
    A part inside a span of a base kind is that span and not a part of its own.
    """
    held = scanned.where(F.exists("parts", lambda p: p["rank"] >= len(BASE))).dropDuplicates(["k0", "k1"])
    held = held.where(F.size("parts") > 1)
    one = held.select("k0", "k1", F.explode("parts").alias("p")).select("k0", "k1", "p.*")
    # a weak part is laid in each stretch that it touches, the other part in each
    # that its scope touches
    part = ["k0", "k1", "start", "end", "rank"]
    laid = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)))
    weak = one.where(F.col("rank") >= len(BASE)).withColumn("cell", laid)
    reach = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    other = one.select("k0", "k1", F.col("start").alias("s"), F.col("end").alias("e"), F.col("rank").alias("r"), F.explode(reach).alias("cell"))
    pairs = F.lit(False)
    for kind, with_ in COMPLEMENTS.items():
        pairs = pairs | ((F.col("rank") == KINDS.index(kind)) & F.col("r").isin([KINDS.index(x) for x in with_]))
    apart = (F.col("s") - F.col("end") <= scope) & (F.col("start") - F.col("e") <= scope)
    outside = (F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start"))
    inside = (F.col("r") < len(BASE)) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e"))
    on = ["k0", "k1", "cell"]
    w, o = weak.alias("w"), other.alias("o")
    same = [F.col(f"w.{c}") == F.col(f"o.{c}") for c in on]
    both = same[0] & same[1] & same[2]
    good = w.join(o, both & pairs & apart & outside, "left_semi").select(part).distinct()
    held = good.withColumn("cell", laid).alias("w").join(o, both & inside, "left_semi").select(part).distinct()
    clean = good.join(held, part, "left_anti")
    return clean.groupBy("k0", "k1").agg(F.collect_set(F.struct("start", "end", "rank")).alias("found"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, k0, k1, base, spans): sorted spans of each row, as arrays of
    (start, end, rank), ``rank`` an index of ``KINDS``.

    Null texts are empty and have no spans; repeated rows give repeated rows; a
    null id keeps its row; other columns are ignored; an empty table gives no
    rows.  All of every text is read."""
    scanned = common.cut(scan(docs, id_col, text_col))
    more = linked(scanned, scope)
    base = F.filter("parts", lambda p: p["rank"] < len(BASE))
    order = lambda c: F.transform(F.array_sort(F.transform(c, lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["end"].alias("end")))), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["rank"].alias("rank")))
    found = F.coalesce("found", F.array().cast(SPAN))
    return scanned.join(more, ["k0", "k1"], "left").select("id", "k0", "k1", order(base).alias("base"), order(F.concat(base, found)).alias("spans"))


def _joined(arr: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(arr, lambda p: F.concat_ws(":", F.get(names, p["rank"]), p["start"].cast("string"), p["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the scan replaced by ``mark``; overlapping
    spans become one mark.  Rows, columns and clean texts stay as they are; a
    column n_chars, if there is one, follows the text."""
    n0, n1, at, fresh = common.fresh(docs, "k0", "k1", "spans", "new")
    k0 = F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias(n0)
    k1 = F.xxhash64(F.col(id_col).isNull(), F.coalesce(F.col(text_col), F.lit(""))).alias(n1)
    hits = spans(docs, id_col, text_col).where(F.size("spans") > 0).select(F.col("k0").alias(n0), F.col("k1").alias(n1), F.col("spans").alias(at)).dropDuplicates([n0, n1])
    t = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        gap = F.when(p["start"] >= acc["at"], F.concat(acc["out"], F.substring(t, acc["at"] + 1, p["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], p["end"]).alias("at"), gap.alias("out"))

    done = F.aggregate(at, start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.char_length(t))))
    out = docs.select("*", k0, k1).join(hits, [n0, n1], "left").withColumn(fresh, F.when(F.col(at).isNull(), t).otherwise(done))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col(fresh).alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col(at).isNull(), F.col(c)).otherwise(F.char_length(fresh)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(cols)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(common.table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda p: p["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
    )
