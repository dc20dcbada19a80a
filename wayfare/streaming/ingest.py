"""Streaming ingest: messages land in bronze keyed by day and micro-batch, and the days they touch
are merged in silver. The same expressions as in batch; no Python touches a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfare.functions import contract
from wayfare.operators import dedupe
from wayfare.plans.runner import SILVER
from wayfare.sources import lake

WATERMARK = "6 hours"


def start(stream: DataFrame, root: str, once: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """stream(value, ingested_at). A replayed micro-batch overwrites its own part and nothing else; a
    late message rewrites its own day in silver and is never dropped."""
    spark = stream.sparkSession

    def land(batch: DataFrame, epoch: int) -> None:
        lake.write_batch(batch, f"{root}/bronze", f"epoch-{epoch:012d}")
        own = lake.read_days(spark, f"{root}/bronze", lake.BRONZE).where(F.col("batch_id") == f"epoch-{epoch:012d}")
        valid, bad = contract.split_valid(contract.normalise(own))
        fresh = valid.withColumn("dt", F.date_format("event_ts", "yyyy-MM-dd")).select(*[c.split()[0] for c in SILVER.split(", ")])
        touched = [r[0] for r in own.select("dt").distinct().collect()]  # days of one micro-batch
        there = lake.read_days(spark, f"{root}/silver", SILVER, touched)
        merged = dedupe.latest(there.unionByName(fresh))
        merged.write.mode("overwrite").parquet(f"{root}/_merging")
        lake.replace_days(spark.read.schema(SILVER).parquet(f"{root}/_merging"), f"{root}/silver")
        rejected = bad.select("reason", "payload", F.lit(epoch).alias("epoch"))
        rejected.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{root}/quarantine_stream")

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{root}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def open_trip_counts(stream: DataFrame) -> DataFrame:
    """(window, store_id, events): events for each store and hour, on event time: the stateful branch alone has
    a watermark. Events more than WATERMARK behind the newest are not counted here; bronze keeps them."""
    valid = contract.normalise(stream).where("reason is null")
    timed = valid.withWatermark("event_ts", WATERMARK)
    return timed.groupBy(F.window("event_ts", "1 hour"), "store_id").agg(F.count("*").alias("events"))
