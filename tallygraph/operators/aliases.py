"""Which known repository an incoming id means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import repo_key, repo_name
from ..plans.workflow import REPO_IDS
from ..sources.adapters import spark_sql

#: Times that an id is renamed or loses its branch before it is taken as it is.
MOST_STEPS = 4


def seed_aliases(seen: DataFrame) -> DataFrame:
    """(ws, name, canonical): the id that each short name stands for, of the ids
    (ws, id, seq) in the order they were seen.

    The id with most segments wins.  If one came that had as many as the best
    before it, the name is ambiguous and canonical is null."""
    first = seen.where("id <> ''").groupBy("ws", "id").agg(F.min("seq").alias("seq"))
    ranked = first.withColumn("name", F.expr(repo_name("id"))).withColumn("rank", F.size(F.split("id", "/")))
    before = Window.partitionBy("ws", "name").orderBy("seq", "id").rowsBetween(Window.unboundedPreceding, -1)
    tied = ranked.withColumn("tie", F.coalesce(F.col("rank") == F.max("rank").over(before), F.lit(False)))
    best = tied.groupBy("ws", "name").agg(F.bool_or("tie").alias("tie"), F.max_by("id", "rank").alias("id"))
    return best.select("ws", "name", F.when(~F.col("tie"), F.col("id")).alias("canonical"))


def resolve_ids(ids: DataFrame, aliases: DataFrame, renames: DataFrame) -> DataFrame:
    """(ws, id, canonical) of distinct ids (ws, id).

    A rename (ws, id, new_id) comes first; an id with a branch is its base if
    the base's name is known; then the name decides, but never between two ids
    with an owner whose keys differ.  An unknown or ambiguous name is itself."""
    rename = renames.groupBy("ws", F.col("id").alias("at")).agg(F.min("new_id").alias("new_id"))
    known = aliases.where("canonical is not null").select("ws", F.col("name").alias("base_name"), F.lit(True).alias("known"))
    at = ids.select("ws", "id").distinct().withColumn("at", F.col("id"))
    for _ in range(MOST_STEPS):
        at = at.join(rename, ["ws", "at"], "left").withColumn("at", F.coalesce("new_id", "at")).drop("new_id")
        base = F.when(F.instr("at", "#") > 0, F.trim(F.substring_index("at", "#", 1)))
        at = at.withColumn("base", F.nullif(base, F.lit(""))).withColumn("base_name", F.expr(repo_name("base")))
        at = at.join(known, ["ws", "base_name"], "left").withColumn("at", F.when(F.col("known"), F.col("base")).otherwise(F.col("at")))
        at = at.select("ws", "id", "at")
    named = at.withColumn("name", F.expr(repo_name("at"))).join(aliases, ["ws", "name"], "left")
    apart = F.contains("at", F.lit("/")) & F.contains("canonical", F.lit("/")) & (F.expr(repo_key("at")) != F.expr(repo_key("canonical")))
    return named.select("ws", "id", F.when(F.col("canonical").isNull() | apart, F.col("at")).otherwise(F.col("canonical")).alias("canonical"))


def _resolved(s, d):
    seen = spark_sql(s, d, f"SELECT CAST(page_id % 3 AS STRING) AS ws, id, page_id AS seq FROM {REPO_IDS}")
    renames = seen.where("id like '/%'").selectExpr("ws", "id", "'local/App' AS new_id")
    return resolve_ids(seen, seed_aliases(seen), renames)


QUERIES = {"j24_resolved": _resolved}
ORACLE: dict[str, str] = {}
