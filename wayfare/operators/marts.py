"""Reporting marts over the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators import gates

MIN_PLAUSIBLE_TAT = 2.0


def staging(fact: DataFrame, min_tat: float = MIN_PLAUSIBLE_TAT) -> DataFrame:
    """The fact table with a Boolean breach, is_measurable and the signed promise error."""
    measurable = (F.col("completeness") == "complete") & F.col("tat_minutes").isNotNull() & (F.col("tat_minutes") >= min_tat)
    return fact.withColumns(
        {
            "is_breach": F.col("is_breach") == 1,
            "is_measurable": F.coalesce(measurable, F.lit(False)),
            "promise_error_minutes": F.col("tat_minutes") - F.col("promised_minutes"),
        }
    )


def _exact(name: str):
    """Minutes have three decimals, so sums and ties are exact as decimals, unlike as doubles."""
    return F.col(name).cast("decimal(18,3)")


def _mean(value, digits: int):
    return F.round(F.try_divide(F.sum(value), F.count(value)), digits).cast("double")


def _share(part, whole):
    return F.round(F.try_divide(part.cast("decimal(18,0)"), whole), 4).cast("double")


def store_daily(stg: DataFrame) -> DataFrame:
    """One row for each store and day; rates are null where nothing was measured. Halves round away from
    zero, exactly."""
    measured = F.col("is_measurable")

    def only(name: str, digits: int):
        return _mean(F.when(measured, _exact(name)), digits)

    n = F.count_if(measured)
    breaches = F.count_if(measured & F.col("is_breach"))
    return stg.groupBy("store_id", "date_key").agg(
        F.count("*").alias("trips_total"),
        n.alias("trips_measured"),
        *[F.count_if(F.col("completeness") == s).alias(f"trips_{s}") for s in ("open", "stalled", "broken")],
        only("tat_minutes", 2).alias("mean_tat_minutes"),
        only("pickup_minutes", 2).alias("mean_pickup_minutes"),
        only("distance_m", 0).alias("mean_distance_m"),
        breaches.alias("breaches"),
        _share(breaches, n).alias("breach_rate"),
        _share(n, F.count("*")).alias("measured_share"),
    ).withColumn("store_day_key", F.concat("store_id", F.lit("|"), "date_key"))


def _judged(stg: DataFrame) -> DataFrame:
    return stg.where("is_measurable and promise_error_minutes is not null").withColumn("error", _exact("promise_error_minutes"))


def promise_error(stg: DataFrame) -> DataFrame:
    """Signed and absolute promise error for each store, with its median and 90th percentile by rank
    (null where the rank is 0). Halves round away from zero, exactly.

    The rank is found by counting each value of a store's errors, so what is sorted for one store is
    its distinct errors (thousandths of minutes), not its trips."""
    counted = _judged(stg).groupBy("store_id", "error").agg(
        F.count("*").alias("own"), F.sum(_exact("tat_minutes")).alias("tat"), F.sum("promised_minutes").alias("promised")
    )
    by = Window.partitionBy("store_id")
    last = F.sum("own").over(by.orderBy("error").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.select("*", last.alias("last"), F.sum("own").over(by).alias("n"))

    def at(q: float):
        rank = F.floor(F.col("n") * q)
        return F.round(F.max(F.when((F.col("last") >= rank) & (F.col("last") - F.col("own") < rank), F.col("error"))), 2).cast("double")

    n = F.sum("own")
    late = F.coalesce(F.sum(F.when(F.col("error") > 0, F.col("own"))), F.lit(0))

    def mean(total):
        return F.round(F.try_divide(F.sum(total.cast("decimal(28,3)")), n), 2).cast("double")

    return ranked.groupBy("store_id").agg(
        n.alias("trips_measured"),
        mean(F.col("error") * F.col("own")).alias("mean_signed_error_minutes"),
        mean(F.abs("error") * F.col("own")).alias("mean_absolute_error_minutes"),
        at(0.5).alias("p50_error_minutes"),
        at(0.9).alias("p90_error_minutes"),
        mean(F.col("tat")).alias("mean_tat_minutes"),
        mean(F.col("promised")).alias("mean_promised_minutes"),
        late.alias("trips_late"),
        _share(late, n).alias("breach_rate"),
    )


def pooled_error(stg: DataFrame) -> DataFrame:
    return _judged(stg).agg(
        F.count("*").alias("trips_measured"),
        _mean(F.col("error"), 2).alias("mean_signed_error_minutes"),
        _mean(F.abs("error"), 2).alias("mean_absolute_error_minutes"),
    )


def gap_vs_pooled(stg: DataFrame) -> DataFrame:
    """Each store's mean error beside the pooled one, a single row."""
    pooled = pooled_error(stg).select(F.col("mean_signed_error_minutes").alias("pooled_error_minutes"))
    own = promise_error(stg).select("store_id", "mean_signed_error_minutes")
    return own.crossJoin(F.broadcast(pooled)).withColumn("gap_minutes", F.round(F.col("mean_signed_error_minutes") - F.col("pooled_error_minutes"), 2))


def shared_days(daily: DataFrame, least: int = 2) -> DataFrame:
    """Days that at least `least` stores report."""
    return daily.where("store_id is not null").groupBy("date_key").agg(F.count_distinct("store_id").alias("stores")).where(F.col("stores") >= least)


def worst_stores(errors: DataFrame, n: int = 2) -> DataFrame:
    return errors.orderBy(F.desc("mean_signed_error_minutes"), "store_id").limit(n)


def declared_tests(stg: DataFrame, stores: DataFrame, daily: DataFrame, errors: DataFrame) -> list[DataFrame]:
    """Verdicts of the tests that the tables declare, column by column, and of the three on whole tables."""
    def null(table, name, column):
        return gates.failing(table, f"{name}.{column}.not_null", F.col(column).isNull())

    def unique(table, name, column):
        twice = table.groupBy(column).agg(F.count("*").alias("n"))
        return gates.failing(twice, f"{name}.{column}.unique", F.col("n") > 1)

    orphans = stg.where("store_id is not null").select("store_id").distinct().join(stores.select("store_id"), "store_id", "left_anti")
    days = stg.groupBy("trip_id").agg(F.count_distinct("date_key").alias("days"))
    return [
        unique(stg, "stg_trip", "trip_id"),
        null(stg, "stg_trip", "trip_id"),
        null(stg, "stg_trip", "store_id"),
        gates.failing(orphans, "stg_trip.store_id.relationships", F.lit(True)),
        gates.failing(stg, "stg_trip.completeness.accepted_values", ~F.col("completeness").isin("complete", "open", "stalled", "broken")),
        null(stg, "stg_trip", "is_measurable"),
        unique(daily, "mart_store_daily", "store_day_key"),
        null(daily, "mart_store_daily", "store_day_key"),
        null(daily, "mart_store_daily", "trips_measured"),
        gates.failing(daily, "mart_store_daily.trips_measured.accepted_range", F.col("trips_measured") < 0),
        gates.failing(daily, "mart_store_daily.breach_rate.accepted_range", ~F.col("breach_rate").between(0, 1)),
        gates.failing(daily, "mart_store_daily.mean_tat_minutes.accepted_range", F.col("mean_tat_minutes") <= 0),
        unique(errors, "mart_promise_error", "store_id"),
        null(errors, "mart_promise_error", "store_id"),
        null(errors, "mart_promise_error", "trips_measured"),
        null(errors, "mart_promise_error", "mean_signed_error_minutes"),
        gates.failing(daily, "rate_has_its_denominator", F.col("breach_rate").isNotNull() & (F.coalesce("trips_measured", F.lit(0)) == 0)),
        gates.failing(stg, "measurable_is_complete", F.col("is_measurable") & ((F.col("completeness") != "complete") | F.col("tat_minutes").isNull())),
        gates.failing(days, "trip_in_one_day", F.col("days") > 1),
    ]
