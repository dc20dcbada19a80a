"""Batch stages: bronze, silver, gold and marts, each with its gates before anything is published, and the
load of driver changes.

    python -m wayfare.plans.runner all --source events.jsonl --root /lake --batch-id b1 --as-of 2026-09-09T00:00:00
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import contract
from wayfare.operators import cdc, dedupe, gates, marts, star, trips
from wayfare.plans import alerts
from wayfare.sources import lake
from wayfare.sources.warehouse import Load, Warehouse

MAX_SOURCE_LAG_HOURS = 72.0
#: Days on either side of a touched one in which events of its trips are looked for.
TRIP_DAYS = 7
SILVER = (
    "event_id string, trip_id string, order_id string, driver_id string, store_id string, event_type string, event_ts timestamp, ingested_at timestamp, "
    "lat double, lon double, distance_m bigint, promised_minutes bigint, producer_version string, schema_version string, extra string, issues array<string>, dt string"
)


@dataclass
class Run:
    """One batch. as_of is the only clock that results depend on."""

    spark: SparkSession
    root: str
    batch_id: str
    as_of: str
    min_measurable: float = 0.5

    @property
    def warehouse(self) -> Warehouse:
        return Warehouse(self.spark, f"{self.root}/warehouse")

    def _judge(self, stage: str, report: gates.GateReport) -> None:
        self.warehouse.record(self.batch_id, stage, report, self.as_of)
        if alert := alerts.from_report(stage, self.batch_id, report):
            alerts.send(alert)
        report.enforce()

    def bronze(self, source: str) -> list[str]:
        """Keep every message of the source; the days it touches."""
        raw = lake.read_lines(self.spark, source).withColumn("ingested_at", F.lit(self.as_of).cast("timestamp"))
        late = F.try_variant_get(F.try_parse_json("value"), "$._delay_hours", "double")
        stamped = F.try_variant_get(F.try_parse_json("value"), "$._ingested_at", "string")
        seen = F.coalesce(contract.parse_timestamp(stamped), F.col("ingested_at"))
        raw = raw.withColumn("ingested_at", F.timestamp_micros(F.unix_micros(seen) + F.coalesce(late, F.lit(0.0)).cast("bigint") * 3600000000))
        lake.write_batch(raw, f"{self.root}/bronze", self.batch_id)
        own = lake.read_days(self.spark, f"{self.root}/bronze", lake.BRONZE).where(F.col("batch_id") == self.batch_id)
        return [r[0] for r in own.select("dt").distinct().orderBy("dt").collect()]

    def _staged(self, rows: DataFrame, name: str) -> DataFrame:
        """rows computed once, for all that is asked of them."""
        path = f"{self.root}/_staged/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def silver(self, days: list[str] | None = None) -> list[str]:
        """Conform and deduplicate the days; rows with a reason go to quarantine. The days are replaced as
        they are now: one whose messages are all rejected is empty afterwards."""
        days = days or lake.days(self.spark, f"{self.root}/bronze", lake.BRONZE)
        raw = lake.read_days(self.spark, f"{self.root}/bronze", lake.BRONZE, days)
        valid, bad = contract.split_valid(self._staged(contract.normalise(raw), "normal"))
        kept = dedupe.latest(valid).withColumn("dt", F.date_format("event_ts", "yyyy-MM-dd"))
        kept = self._staged(kept.select(*[c.split()[0] for c in SILVER.split(", ")]), "kept")
        collapsed = dedupe.counters(valid).select("duplicates_removed")
        report = gates.GateReport().add(gates.reconciliation(raw, kept, bad, collapsed), gates.freshness(valid, "event_ts", self.as_of, MAX_SOURCE_LAG_HOURS))
        self.warehouse.quarantine(self.batch_id, bad, self.as_of)
        self._judge("silver", report)
        lake.replace_days(kept, f"{self.root}/silver", [d for d in days if d != star.UNKNOWN_DAY])
        return [d for d in days if d != star.UNKNOWN_DAY]

    def gold(self, days: list[str] | None = None) -> DataFrame:
        """Facts and dimensions over silver. The gates judge before any table is written, and all tables
        change at once.

        With days only they are rebuilt, and the days that their trips were assigned on: silver is read
        for TRIP_DAYS around them, as a trip is rebuilt from all of its days. The volume of the batch is held
        against the stored days that it does not rewrite."""
        w, silver = self.warehouse, f"{self.root}/silver"
        there = w.partitions("fct_trip") if w.exists("fct_trip") else []
        stored_facts = w.table("fct_trip") if there else None
        around = None if days is None else [r[0] for r in _days_around(self.spark, days, TRIP_DAYS).collect()]
        events = dedupe.latest(lake.read_days(self.spark, silver, SILVER, around).drop("dt"))
        facts = self._staged(star.fact_table(trips.build_facts(events, self.as_of)), "facts")
        values = there
        if days is not None:
            touched = lake.read_days(self.spark, silver, SILVER, days).select("trip_id")
            if there:
                touched = touched.union(w.table("fct_trip", days).select("trip_id"))
            touched = touched.distinct()
            named = facts.join(touched, "trip_id", "left_semi").select("date_key").distinct()
            values = sorted({*days, *(r[0] for r in named.collect())} - {star.UNKNOWN_DAY})  # days of one batch
            own = facts.where(F.col("date_key").isin(values) | (F.col("date_key") == star.UNKNOWN_DAY))
            if star.UNKNOWN_DAY in there:
                rest = w.table("fct_trip", [star.UNKNOWN_DAY])
                own = own.unionByName(rest.join(facts.select("trip_id"), "trip_id", "left_anti"))
            facts = self._staged(own, "batch")
            values.append(star.UNKNOWN_DAY)
        others = stored_facts.where(~F.col("date_key").isin(values)) if there else facts.limit(0)
        every = others.unionByName(facts)
        drivers, stores = self._staged(star.dim_driver(every), "dim_driver"), self._staged(star.dim_store(every), "dim_store")
        joined = facts.join(drivers.select("driver_id"), "driver_id", "left")
        per_day = facts.groupBy("date_key").agg(F.count("*").alias("n"))
        observed = per_day.agg(F.coalesce(gates.upper_median("n"), F.lit(0)).alias("n"))
        rewritten = per_day.select("date_key")
        baseline = (stored_facts if there else facts.limit(0)).join(F.broadcast(rewritten), "date_key", "left_anti")  # one row a day
        baseline = baseline.where(~F.col("date_key").isin(days or [])).groupBy("date_key").agg(F.count("*").alias("n")).select("n")
        report = gates.GateReport().add(
            gates.unique_key(facts, "trip_id"),
            gates.not_null(facts, "trip_id"),
            gates.row_conservation(facts, joined, "fct_trip_dim_driver"),
            gates.foreign_key(facts, "driver_id", drivers, "driver_id"),
            gates.foreign_key(facts, "store_id", stores, "store_id"),
            gates.volume_against(observed, baseline),
            gates.measurable_share(facts, trips.measurable(facts), self.min_measurable),
        )
        self._judge("gold", report)
        w.publish(
            dim_driver=Load(drivers), dim_store=Load(stores), dim_date=Load(star.dim_date(every)), fct_trip=Load(facts, "date_key", tuple(values))
        )
        return w.table("fct_trip")

    def build_marts(self) -> None:
        """Marts, published only if the declared tests hold."""
        w = self.warehouse
        stg = marts.staging(w.table("fct_trip"))
        daily, errors = self._staged(marts.store_daily(stg), "mart_store_daily"), self._staged(marts.promise_error(stg), "mart_promise_error")
        self._judge("marts", gates.GateReport().add(*marts.declared_tests(stg, w.table("dim_store"), daily, errors)))
        w.publish(mart_store_daily=Load(daily), mart_promise_error=Load(errors))

    def drivers(self, source: str) -> dict[str, int]:
        """Merge a file of change messages into dim_driver; what happened, in numbers. A driver that the
        changes don't name stays."""
        messages = self.spark.read.text(source).select("value")
        parsed = self._staged(cdc.parse(messages, ["driver_id"]), "changes")
        state = self._staged(cdc.collapse(parsed), "driver_state")
        image = F.from_json("image", "created_at string, trips_total bigint")
        changed = state.select(
            F.col("key")[0].alias("driver_id"), image["created_at"].cast("timestamp").alias("first_seen_at"), F.coalesce(image["trips_total"], F.lit(0)).alias("trips_total"), "deleted"
        )
        w = self.warehouse
        before = w.table("dim_driver") if w.exists("dim_driver") else self.spark.createDataFrame([], "driver_id string, first_seen_at timestamp, trips_total bigint")
        merged = before.join(changed.select("driver_id"), "driver_id", "left_anti").unionByName(changed.where("not deleted").drop("deleted"))
        w.replace("dim_driver", merged)
        counts = cdc.counters(parsed).crossJoin(cdc.out_of_order(parsed)).first()
        own = state.agg(F.count("*").alias("changes"), F.count_if(~F.col("deleted")).alias("upserted"), F.count_if("deleted").alias("removed")).first()
        return own.asDict() | {"tombstones_skipped": counts.tombstones, "out_of_order": counts.out_of_order, "errors": counts.errors, "rows_now": w.count("dim_driver")}

    def all(self, source: str) -> DataFrame:
        """Every stage, for the days that the source touches and the last few days before as_of."""
        touched = self.bronze(source)
        window = [r[0] for r in reprocess_days(touched, self.as_of[:10], self.spark).collect()]
        there = set(lake.days(self.spark, f"{self.root}/bronze", lake.BRONZE))
        fact = self.gold(self.silver(sorted(there.intersection(window))))
        self.build_marts()
        return fact


def _days_around(spark: SparkSession, days: list[str], reach: int) -> DataFrame:
    """(dt): the days and those up to reach before and after."""
    own = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("d"))
    return own.select(F.explode(F.sequence(F.date_sub("d", reach), F.date_add("d", reach))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("dt")).distinct()


def reprocess_days(touched: list[str], as_of_day: str, spark: SparkSession, trailing: int = 3) -> DataFrame:
    """(dt): the days a batch touched and the last `trailing` days."""
    window = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(as_of_day).cast("date"), trailing), F.lit(as_of_day).cast("date"))).alias("d"))
    return spark.createDataFrame([(d,) for d in touched], "dt string").union(window.select(F.date_format("d", "yyyy-MM-dd"))).distinct()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("stage", choices=["bronze", "silver", "gold", "marts", "all", "drivers"])
    parser.add_argument("--source")
    parser.add_argument("--root", required=True)
    parser.add_argument("--batch-id", required=True)
    parser.add_argument("--as-of", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("wayfare").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run = Run(spark, args.root, args.batch_id, args.as_of)
    steps = {"bronze": lambda: run.bronze(args.source), "silver": run.silver, "gold": run.gold, "marts": run.build_marts, "all": lambda: run.all(args.source), "drivers": lambda: print(json.dumps(run.drivers(args.source)))}
    try:
        steps[args.stage]()
    except gates.QualityGateFailed as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
