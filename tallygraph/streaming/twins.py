"""Streaming twins of ledger roll-ups: a file source drained with
``availableNow``, event-time watermarks, and turn dedup within the watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import shared_folder


def _drained(stream: DataFrame, mode: str, at: str | None = None) -> DataFrame:
    """Runs ``stream`` over what there is and returns its output.  State and
    output are in the folder ``at``, by default one of its own in the shared
    folder."""
    spark = stream.sparkSession
    at = at or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    files = spark.readStream.schema(schema)
    rows = files.parquet(path) if not path.endswith(".parquet") else files.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def minute_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, current, last): events of each type in the newest minute of
    the stream and in the minute before it, none if that was skipped."""
    rows = _events(spark, sf_dir).withWatermark("ts", "1 hour")
    out = rows.groupBy(F.window("ts", "1 minute"), "event_type").agg(F.count("*").alias("n"))
    done = _drained(out.select((F.unix_timestamp("window.start") / 60).cast("long").alias("minute"), "event_type", "n"), "complete")
    newest = done.groupBy("event_type").agg(F.max("minute").alias("newest"))
    part = lambda m, name: F.coalesce(F.sum(F.when(F.col("minute") == m, F.col("n"))), F.lit(0)).alias(name)
    return done.join(newest, "event_type").groupBy("event_type").agg(part(F.col("newest"), "current"), part(F.col("newest") - 1, "last"))


def turns_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn once within 24 hours."""
    rows = _events(spark, sf_dir).withWatermark("ts", "24 hours").select("ts", F.floor(F.col("event_id") / 50).alias("turn"))
    return _drained(rows.dropDuplicatesWithinWatermark(["turn"]).select("turn"), "append")


QUERIES = {"st6_windows": minute_windows, "st10_turn_dedupe": turns_once}
ORACLE = {
    "st6_windows": """WITH m AS (SELECT event_type, epoch_us(ts) // 60000000 AS m FROM events), t AS (SELECT event_type, max(m) AS top FROM m GROUP BY event_type) SELECT t.event_type, count(*) FILTER (m.m = t.top) AS current, count(*) FILTER (m.m = t.top - 1) AS last FROM t JOIN m ON m.event_type = t.event_type GROUP BY t.event_type""",
    "st10_turn_dedupe": "SELECT DISTINCT event_id // 50 AS turn FROM events",
}
