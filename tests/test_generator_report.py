import pytest
from pyspark.sql import functions as F

from wayfare.functions import contract
from wayfare.operators import cdc, dedupe, marts, star, trips
from wayfare.plans import report, runner
from wayfare.sources import generator


def test_generated_trips_run_end_to_end_and_keep_their_finding(spark, tmp_path):
    lines = generator.events(150, 3, 11, faults=generator.Faults(late=0.0))
    assert lines == generator.events(150, 3, 11, faults=generator.Faults(late=0.0)) != generator.events(150, 3, 12)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    run = runner.Run(spark, str(tmp_path / "lake"), "b", "2026-09-05 00:00:00")
    with pytest.raises(FileNotFoundError):
        report.build(run.warehouse)
    run.all(str(tmp_path / "in"))
    errors = {r.store_id: r.mean_signed_error_minutes for r in run.warehouse.table("mart_promise_error").collect()}
    assert errors["HARBOUR"] > errors["ORCHARD"]
    page = report.build(run.warehouse)
    assert page.index("<td>HARBOUR") < page.index("<td>ORCHARD") and "complete" in page and page.count("<polyline") == 2
    landed, kept = len(lines), run.warehouse.spark.read.parquet(f"{run.root}/silver").count()
    assert f"{landed:,} messages landed, {kept:,} rows kept, {landed - kept:,} collapsed" in page
    with pytest.raises(KeyError):
        report.render("{missing}", {})


@pytest.mark.parametrize("seed", [5, 19, 88, 2026])
def test_the_finding_does_not_hang_on_a_seed(spark, seed):
    """The slower store is worse whatever the seed, clearly so, and the pooled error lies between the two."""
    raw = spark.createDataFrame([(m,) for m in generator.events(1_200, 10, seed)], "value string").withColumn("ingested_at", F.lit("2026-09-16").cast("timestamp"))
    valid, _ = contract.split_valid(contract.normalise(raw))
    stg = marts.staging(star.fact_table(trips.build_facts(dedupe.latest(valid), "2026-09-16 00:00:00")))
    errors = {r.store_id: r.mean_signed_error_minutes for r in marts.promise_error(stg).collect()}
    pooled = marts.pooled_error(stg).first().mean_signed_error_minutes
    assert errors["HARBOUR"] > 1.8 * errors["ORCHARD"] > 0 and errors["ORCHARD"] < pooled < errors["HARBOUR"]


def test_geometry():
    assert [report.axis_top(x) for x in (0, 0.07, 1, 2.2, 2.6, 38, 1000)] == [1, 0.1, 1, 2.5, 5, 50, 1000]
    line = report.number_line({"a": 4.0, "b": -1.0})
    assert 'cx="540.0"' in line and 'cx="240.0"' in line
    assert "150.0,60.0" in report.day_chart({"s": [0.5, None]}, 1.0)


def test_change_stream_collapses_to_one_state_a_driver(spark):
    messages = generator.driver_changes(40, 3)
    parsed = cdc.parse(spark.createDataFrame([(m,) for m in messages], "value string"), ["driver_id"])
    state = cdc.collapse(parsed)
    assert state.count() == 40 and cdc.live(state).count() + cdc.deleted(state).count() == 40
    assert state.where(F.col("snapshot")).count() == 0
    assert cdc.counters(parsed).first().tombstones == messages.count(None)
