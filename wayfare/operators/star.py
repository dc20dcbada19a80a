"""Star schema: dimensions and the fact table's stored shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators.trips import FACT_COLUMNS

UNKNOWN_DAY = "unknown"


class SchemaDrift(Exception):
    """The facts don't have the columns that the fact table stores."""


def date_key():
    return F.coalesce(F.date_format("assigned_at", "yyyy-MM-dd"), F.lit(UNKNOWN_DAY))


def fact_table(facts: DataFrame) -> DataFrame:
    """Facts as stored: breach as 0/1/null, issues as text, and the date_key they are partitioned by."""
    if (missing := set(FACT_COLUMNS) - set(facts.columns)) or (more := set(facts.columns) - set(FACT_COLUMNS)):
        raise SchemaDrift(f"missing {sorted(missing)}" if missing else f"unexpected {sorted(more)}")
    stored = {"is_breach": F.col("is_breach").cast("int"), "issues": F.nullif(F.array_join("issues", ","), F.lit(""))}
    return facts.select(*[stored.get(c, F.col(c)).alias(c) for c in FACT_COLUMNS], date_key().alias("date_key"))


def dim_driver(facts: DataFrame) -> DataFrame:
    return facts.where("driver_id is not null").groupBy("driver_id").agg(F.min("assigned_at").alias("first_seen_at"), F.count("*").alias("trips_total"))


#: Fixed value: the city of every store.
CITY = "Mirefield"


def dim_store(facts: DataFrame, city: str = CITY) -> DataFrame:
    names = facts.where("store_id is not null").select("store_id").distinct()
    return names.select("store_id", F.concat(F.initcap("store_id"), F.lit(" Depot")).alias("store_name"), F.lit(city).alias("city"))


def dim_date(facts: DataFrame) -> DataFrame:
    days = facts.select(date_key().alias("date_key")).where(F.col("date_key") != UNKNOWN_DAY).distinct()
    day = F.weekday(F.to_date("date_key"))
    return days.select("date_key", day.cast("int").alias("day_of_week"), (day >= 5).cast("int").alias("is_weekend"))
