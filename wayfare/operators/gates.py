"""Quality gates: each gives one verdict row; a failing BLOCK verdict stops the load."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, WARN = "BLOCK", "WARN"


class QualityGateFailed(Exception):
    """A blocking gate did not pass."""


def _verdict(frame: DataFrame, gate: str, passed: Column, observed: Column, expected: Column, severity: str | Column = BLOCK) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return frame.select(
        F.lit(gate).alias("gate"), F.coalesce(passed, F.lit(False)).alias("passed"), severity.alias("severity"),
        observed.cast("string").alias("observed"), expected.cast("string").alias("expected"),
    )


def row_conservation(left: DataFrame, joined: DataFrame, join_name: str) -> DataFrame:
    """A left join keeps the number of rows: fewer, it is an inner join; more, it fans out."""
    counts = left.agg(F.count("*").alias("l")).crossJoin(joined.agg(F.count("*").alias("j")))
    return _verdict(counts, f"row_conservation:{join_name}", F.col("l") == F.col("j"), F.col("j"), F.col("l"))


def reconciliation(incoming: DataFrame, accepted: DataFrame, quarantined: DataFrame, collapsed: DataFrame | None = None) -> DataFrame:
    """accepted + collapsed + quarantined = incoming. collapsed has one number, the rows that deduplication removed:
    accounted for, not lost."""
    counts = incoming.agg(F.count("*").alias("i")).crossJoin(accepted.agg(F.count("*").alias("a"))).crossJoin(quarantined.agg(F.count("*").alias("q")))
    counts = counts.crossJoin(collapsed.toDF("c")) if collapsed is not None else counts.withColumn("c", F.lit(0))
    found = F.col("a") + F.col("c") + F.col("q")
    return _verdict(counts, "reconciliation", found == F.col("i"), found, F.col("i"))


def unique_key(rows: DataFrame, *key: str) -> DataFrame:
    """No key repeats; observed is the number of distinct keys that do."""
    twice = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("d"))
    return _verdict(twice, f"unique_key:{','.join(key)}", F.col("d") == 0, F.col("d"), F.lit(0))


def not_null(rows: DataFrame, column: str, severity: str = BLOCK) -> DataFrame:
    nulls = rows.agg(F.count_if(F.col(column).isNull()).alias("n"))
    return _verdict(nulls, f"not_null:{column}", F.col("n") == 0, F.col("n"), F.lit(0), severity)


def foreign_key(rows: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Every non-null value is in the parent; observed is the number of distinct orphans."""
    known = parent.select(F.col(parent_key).alias(column)).distinct()
    orphans = rows.where(F.col(column).isNotNull()).select(column).distinct().join(known, column, "left_anti").agg(F.count("*").alias("n"))
    return _verdict(orphans, f"fk:{column}", F.col("n") == 0, F.col("n"), F.lit(0))


def orphan_examples(rows: DataFrame, column: str, parent: DataFrame, parent_key: str, n: int = 3) -> DataFrame:
    """The first n orphans in text order."""
    known = parent.select(F.col(parent_key).alias(column)).distinct()
    missing = rows.where(F.col(column).isNotNull()).select(column).distinct().join(known, column, "left_anti")
    return missing.select(F.col(column).cast("string").alias("example")).orderBy("example").limit(n)


def freshness(rows: DataFrame, column: str, as_of: str, max_lag_hours: float, severity: str = BLOCK, warn_hours: float | None = None) -> DataFrame:
    """The newest row is no older than max_lag at as_of; no row at all fails. With warn_hours a lag
    beyond that alone fails as a WARN."""
    lag = rows.agg(((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.max(column).cast("timestamp"))) / F.lit(3.6e9)).alias("h"))
    limit = F.lit(float(max_lag_hours))
    if warn_hours is None:
        return _verdict(lag, f"freshness:{column}", F.col("h") <= limit, F.round("h", 3), limit, severity)
    only_late = F.col("h").between(warn_hours, max_lag_hours)
    return _verdict(lag, f"freshness:{column}", F.col("h") <= warn_hours, F.round("h", 3), F.when(only_late, F.lit(float(warn_hours))).otherwise(limit), F.when(only_late, WARN).otherwise(severity))


def upper_median(column: str) -> Column:
    ordered = F.sort_array(F.collect_list(column))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def volume_band(daily: DataFrame, day: str, tolerance: float = 0.5, least_days: int = 3) -> DataFrame:
    """daily(date_key, n): the day's count lies within median * (1 +- tolerance) of the other days; with
    fewer than least_days of them the gate passes as a WARN."""
    own = daily.where(F.col("date_key") == day).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return volume_against(own, daily.where(F.col("date_key") != day).select("n"), tolerance, least_days)


def volume_against(own: DataFrame, baseline: DataFrame, tolerance: float = 0.5, least_days: int = 3) -> DataFrame:
    """The same for one observed number own(n) and the daily counts baseline(n) that it is held against."""
    others = baseline.agg(upper_median("n").alias("m"), F.count("*").alias("days"))
    short = F.col("days") < least_days
    inside = F.col("n").between(F.col("m") * (1 - tolerance), F.col("m") * (1 + tolerance))
    return _verdict(others.crossJoin(own), "volume_band", short | inside, F.col("n"), F.coalesce("m", F.lit(0)), F.when(short, WARN).otherwise(BLOCK))


def measurable_share(facts: DataFrame, measurable: Column, least: float = 0.5) -> DataFrame:
    share = facts.agg(F.avg(measurable.cast("double")).alias("s"))
    return _verdict(share, "measurable_share", F.col("s") >= least, F.round("s", 4), F.lit(least))


def accepted_values(rows: DataFrame, column: str, values) -> DataFrame:
    """Values outside the list, with their counts: none is a pass."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def accepted_range(rows: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """One row: how many values lie outside."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return rows.agg(F.count_if(bad).alias("outside"))


def failing(rows: DataFrame, test: str, bad: Column) -> DataFrame:
    """A declared test: no row is bad; observed is how many are."""
    return _verdict(rows.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("n")), f"test:{test}", F.col("n") == 0, F.col("n"), F.lit(0))


@dataclass
class GateReport:
    """Verdicts of one stage, and what follows from them."""

    verdicts: list[dict] = field(default_factory=list)

    def add(self, *frames: DataFrame) -> GateReport:
        """Judge all frames in one job; each is one row."""
        every = [frame.withColumn("_no", F.lit(i)) for i, frame in enumerate(frames)]
        judged = reduce(DataFrame.unionByName, every).collect() if every else []
        self.verdicts += [{k: v for k, v in r.asDict().items() if k != "_no"} for r in sorted(judged, key=lambda r: r["_no"])]
        return self

    @property
    def blocking_failures(self) -> list[dict]:
        return [v for v in self.verdicts if not v["passed"] and v["severity"] == BLOCK]

    @property
    def ok(self) -> bool:
        return not self.blocking_failures

    def enforce(self) -> None:
        if not self.ok:
            raise QualityGateFailed(self.summary())

    def summary(self) -> str:
        return "; ".join(f"{'PASS' if v['passed'] else 'FAIL'} [{v['severity']}] {v['gate']} observed={v['observed']} expected={v['expected']}" for v in self.verdicts)
