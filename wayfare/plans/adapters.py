"""The driver's tables as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How the event types of the events table stand for lifecycle events.
TYPES = {"signup": "assigned", "view": "reached_pickup", "click": "picked_up", "purchase": "delivered", "error": "cancelled"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conformed events: a user's day is a trip."""
    e = table(spark, sf_dir, "events")
    kind = F.lit(None).cast("string")
    for old, new in TYPES.items():
        kind = F.when(F.col("event_type") == old, new).otherwise(kind)
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format(ts, "yyyy-MM-dd")).alias("trip_id"),
        F.concat(F.lit("O-"), F.col("user_id").cast("string")).alias("order_id"),
        F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("D-"), (F.col("user_id") % 40).cast("string"))).alias("driver_id"),
        F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("store_id"),
        kind.alias("event_type"),
        ts.alias("event_ts"),
        ts.alias("ingested_at"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon"),
        F.floor(F.col("value") * 100).cast("bigint").alias("distance_m"),
        (240 + 60 * (F.col("user_id") % 5)).cast("bigint").alias("promised_minutes"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_no, value, ingested_at): JSON messages with the spellings and faults that producers have."""
    e = table(spark, sf_dir, "events")
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    micros = F.unix_micros(ts)

    def fmt(pattern: str):
        return F.date_format(ts, pattern)

    spelled = (
        F.when(n % 7 == 0, fmt("yyyy-MM-dd HH:mm:ss"))
        .when(n % 7 == 1, fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(n % 7 == 2, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(n % 7 == 3, F.concat(F.date_format(ts + F.expr("INTERVAL '05:30' HOUR TO MINUTE"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
        .when(n % 7 == 4, F.floor(micros / 1000000).cast("string"))
        .when(n % 7 == 5, F.floor(micros / 1000).cast("string"))
        .otherwise(fmt("yyyy-MM-dd'T'HH:mm:ss"))
    )
    spelled = F.when(n % 83 == 0, "around noon").when(n % 79 == 0, "2026").otherwise(spelled)

    def text(name: str, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":"'), value, F.lit('"')))

    def bare(name: str, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))

    parts = [
        text("event_id", F.when(n % 101 != 0, n.cast("string"))),
        text("trip_id", F.when(n % 89 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" T-"), F.col("user_id").cast("string")))),
        text("event_type", F.when(n % 97 == 0, F.lit("teleported")).when(n % 3 == 0, F.lit("DELIVERED")).otherwise(F.lit("picked_up"))),
        F.when(n % 7 == 4, bare("event_ts", F.when((n % 83 != 0) & (n % 79 != 0), spelled))).otherwise(text("event_ts", spelled)),
        text("driver_id", F.when(n % 11 != 0, F.concat(F.lit("D-"), (F.col("user_id") % 40).cast("string")))),
        text("store_id", F.when(n % 13 != 0, F.lit("S1"))),
        bare("lat", F.when(n % 17 == 0, F.lit("95.5")).otherwise(F.lit("12.5"))),
        F.when(n % 71 == 0, text("distance_m", F.lit("about a mile"))).when(n % 61 == 0, bare("distance_m", F.lit("-5"))).when(n % 59 == 0, text("distance_m", F.lit("12"))).otherwise(bare("distance_m", (n % 5000).cast("string"))),
        bare("promised_minutes", F.when(n % 67 == 0, F.lit("0")).otherwise(F.lit("45"))),
        text("schema_version", F.when(n % 2 == 0, F.lit("1.1.0")).when(n % 9 == 0, F.lit("9.9.9"))),
        text("vehicle_type", F.when(n % 6 == 0, F.lit("bike"))),
        bare("road_code", F.when(n % 53 == 0, F.lit("7"))),
        bare("_delay_hours", F.lit("1")),
    ]
    parts[3] = F.when((n % 7 == 4) & ((n % 83 == 0) | (n % 79 == 0)), text("event_ts", spelled)).otherwise(parts[3])
    value = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    value = F.when(n % 103 == 0, F.lit("not json")).otherwise(value)
    return e.select(n.alias("event_no"), value.alias("value"), ts.alias("ingested_at"))


def change_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change envelopes from orders: the key is the customer, the log position the order."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    op = F.when(n % 41 == 0, "x").when(F.col("o_orderstatus") == "F", "d").when(F.col("o_orderstatus") == "O", "u").when(n % 2 == 0, "c").otherwise("r")
    image = F.struct(F.when(n % 43 != 0, F.col("o_custkey")).alias("driver_id"), F.col("o_orderpriority").alias("vehicle"))
    source = F.struct(F.lit("drivers").alias("table"), n.alias("lsn"), F.when(op == "r", "true").otherwise("false").alias("snapshot"))
    body = F.struct(
        op.alias("op"), F.when(op == "d", image).alias("before"), F.when(op != "d", image).alias("after"), source.alias("source"), (n * 10).alias("ts_ms")
    )
    wrapped = F.when(n % 5 == 0, F.to_json(F.struct(body.alias("payload")))).otherwise(F.to_json(body))
    value = F.when(n % 37 == 0, F.lit("null")).when(n % 47 == 0, F.lit("{broken")).otherwise(wrapped)
    return o.select(n.alias("message_no"), value.alias("value"))
