"""Trips: one labelled fact for each trip_id, from deduplicated events and an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.contract import RANKS, TERMINAL

LAG_WINDOW = "INTERVAL 6 HOURS"
CARRIED = ("order_id", "driver_id", "store_id", "distance_m", "promised_minutes")
FACT_COLUMNS = (
    "trip_id", "order_id", "driver_id", "store_id", "assigned_at", "picked_up_at", "delivered_at", "terminal_event",
    "completeness", "tat_minutes", "pickup_minutes", "distance_m", "promised_minutes", "is_breach", "event_count", "issues",
)


def rank_of(event_type: Column) -> Column:
    """Lifecycle rank; null for types outside the sequence."""
    out = F.lit(None).cast("int")
    for name, rank in RANKS.items():
        out = F.when(event_type == name, rank).otherwise(out)
    return out


def with_violations(events: DataFrame) -> DataFrame:
    """events plus rank and violation: `<type>_before_<type>` where a ranked event precedes, in time,
    the ranked event that it should follow."""
    rank = rank_of(F.col("event_type"))
    order = Window.partitionBy("trip_id", F.col("rank").isNull()).orderBy("rank", "event_ts", "event_type")
    ranked = events.withColumn("rank", rank)
    early = F.col("event_ts") < F.lag("event_ts").over(order)
    return ranked.withColumn(
        "violation", F.when(F.col("rank").isNotNull() & early, F.concat("event_type", F.lit("_before_"), F.lag("event_type").over(order)))
    )


def minutes_between(start: Column, end: Column) -> Column:
    """Thousandths of a minute, halves up, by whole numbers."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start) + 30_000) / F.lit(60_000)) / F.lit(1000.0)


def build_facts(events: DataFrame, as_of: str, lag_window: str = LAG_WINDOW) -> DataFrame:
    """FACT_COLUMNS for each trip. A violation makes a trip broken, whatever else; a terminal event
    complete; else it is open while its last event is no older than the lag window, then stalled.
    Turnaround exists on complete, delivered trips alone. Every attribute is the first non-null one.

    Both steps deal by trip_id, so one exchange serves window and aggregation."""
    events = with_violations(events.repartition("trip_id"))
    first = F.struct("event_ts", F.coalesce("rank", F.lit(99)), "event_type")

    def at(kind: str) -> Column:
        return F.min(F.when(F.col("event_type") == kind, F.col("event_ts")))

    def carried(name: str) -> Column:
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), first)).alias(name)

    own_issues = F.col("issues") if "issues" in events.columns else F.array().cast("array<string>")
    terminal = F.col("event_type").isin(*TERMINAL)
    trips = events.groupBy("trip_id").agg(
        *map(carried, CARRIED),
        at("assigned").alias("assigned_at"),
        at("picked_up").alias("picked_up_at"),
        at("delivered").alias("delivered_at"),
        F.max_by("event_type", F.when(terminal, first)).alias("terminal_event"),
        F.max("event_ts").alias("last_ts"),
        F.count("*").alias("event_count"),
        F.count("violation").alias("violations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce(own_issues, F.array().cast("array<string>")), F.array_compact(F.array("violation"))))))).alias("issues"),
    )
    state = (
        F.when(F.col("violations") > 0, "broken")
        .when(F.col("terminal_event").isNotNull(), "complete")
        .when(F.col("last_ts") >= F.lit(as_of).cast("timestamp") - F.expr(lag_window), "open")
        .otherwise("stalled")
    )
    trips = trips.withColumn("completeness", state)
    done = F.when(F.col("completeness") == "complete", minutes_between(F.col("assigned_at"), F.col("delivered_at")))
    picked = F.when(F.col("picked_up_at") >= F.col("assigned_at"), minutes_between(F.col("assigned_at"), F.col("picked_up_at")))
    trips = trips.withColumns({"tat_minutes": done, "pickup_minutes": picked})
    return trips.withColumn("is_breach", F.col("tat_minutes") > F.col("promised_minutes")).select(*FACT_COLUMNS)


def measurable(facts: DataFrame) -> Column:
    return (F.col("completeness") == "complete") & F.col("tat_minutes").isNotNull()


def completeness_histogram(facts: DataFrame) -> DataFrame:
    return facts.groupBy("completeness").agg(F.count("*").alias("trips"))
