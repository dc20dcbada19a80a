"""One row for each fact (trip_id, event_type): the latest by ingestion, event time and message id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("trip_id", "event_type")
PRECEDENCE = ("ingested_at", "event_ts", "event_id")
#: A later copy that differs in one of these is a correction.
COMPARED = ("event_ts", "order_id", "driver_id", "store_id", "lat", "lon", "distance_m", "promised_minutes")


def latest(events: DataFrame, key=KEY, precedence=PRECEDENCE) -> DataFrame:
    """The row of highest precedence for each key; a function of the set of rows, not their order."""
    newest = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in precedence])
    return events.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")


def counters(events: DataFrame, key=KEY, precedence=PRECEDENCE, compared=COMPARED) -> DataFrame:
    """One row: rows, kept, duplicates_removed, corrected (copies that differ from the copy before
    them in ascending precedence)."""
    order = Window.partitionBy(*key).orderBy(*precedence)
    present = [c for c in compared if c in events.columns]
    before = [F.lag(c).over(order).alias(f"_{c}") for c in present]
    differs = F.lit(False)
    for c in present:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = events.select("*", *before, F.row_number().over(order).alias("_place"))
    return placed.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("_place") == 1).alias("kept"),
        F.count_if(F.col("_place") > 1).alias("duplicates_removed"),
        F.count_if((F.col("_place") > 1) & differs).alias("corrected"),
    )


def merge_late(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Late rows join what is there already; the same fact is kept once."""
    return latest(existing.unionByName(incoming, allowMissingColumns=True))
