"""Departure windows kept current from a stream of departures.

Each micro-batch adds to the distinct departures of the keys that it touches and
computes their windows anew. The store is partitioned by ``BUCKETS`` hashes of the
keys, so a batch reads only the buckets that it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfare.operators.schedule import departure_windows

BUCKETS = 256


def departures_of(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(day, user_id, weekday, minute, ts): distinct departures of an event stream, late ones up to the delay."""
    ts = F.col("ts").cast("timestamp")
    timed = events.withColumn("ts", ts).withWatermark("ts", delay)
    minute = F.round(F.hour("ts") * 60 + F.minute("ts") + F.second("ts") / 60, 2)
    return timed.select(F.to_date("ts").alias("day"), "user_id", F.weekday("ts").alias("weekday"), minute.alias("minute"), "ts").dropDuplicatesWithinWatermark(["day", "user_id", "minute"])


def start(departures: DataFrame, store: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to store/batch=N (a repeated batch replaces itself) and writes the windows of the touched keys to out/batch=N."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("user_id", "weekday"), F.lit(BUCKETS)).cast("int")
        batch.select("user_id", "weekday", "minute", bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")
        new = spark.read.schema("user_id long, weekday int, minute double, bucket int").parquet(f"{store}/batch={number}")
        touched = new.select("bucket", "user_id", "weekday").distinct()
        buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # BUCKETS at most
        every = spark.read.schema("user_id long, weekday int, minute double, batch long, bucket int").parquet(store).where((F.col("batch") <= number) & F.col("bucket").isin(buckets))
        own = every.join(touched, ["bucket", "user_id", "weekday"], "left_semi").select("user_id", "weekday", "minute")
        departure_windows(own, ["user_id", "weekday"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return departures.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, out: str, keys: tuple[str, ...] = ("user_id", "weekday")) -> DataFrame:  # noqa: ANN001
    """The windows of each key's last batch."""
    rows = spark.read.parquet(out)
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"])
