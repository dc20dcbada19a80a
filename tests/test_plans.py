import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayfare.operators.gates import GateReport, QualityGateFailed
from wayfare.plans import alerts, runner
from wayfare.sources import lake
from wayfare.sources.warehouse import Load, Warehouse
from wayfare.streaming import ingest

AS_OF = "2026-09-09 00:00:00"


def messages(trips=30, broken=False):
    out, base = [], datetime(2026, 9, 7, 9)
    for t in range(trips):
        start = base + timedelta(hours=t % 20, minutes=t)
        for k, (kind, minute) in enumerate([("assigned", 0), ("picked_up", 8), ("delivered", 30 + t % 40)][: 1 if broken and t % 4 else 3]):
            body = {"event_id": f"e{t}-{k}", "trip_id": f"T-{t}", "event_type": kind, "event_ts": (start + timedelta(minutes=minute)).isoformat(), "driver_id": f"D-{t % 3}", "store_id": f"S{t % 2}", "distance_m": 100 * t, "promised_minutes": 45}
            out.append(json.dumps(body))
    return out + ["not json", ""]


def write(path, lines):
    path.mkdir(exist_ok=True, parents=True)
    (path / f"{len(list(path.iterdir()))}.jsonl").write_text("\n".join(lines))
    return str(path)


def fingerprint(df):
    return sorted(map(str, df.collect()))


def test_end_to_end_replay_and_audit(spark, tmp_path):
    source = write(tmp_path / "in", messages())
    run = runner.Run(spark, str(tmp_path / "lake"), "b1", AS_OF)
    first = fingerprint(run.all(source))
    assert len(first) == 30
    assert run.warehouse.table("run_audit").count() == 28 and run.warehouse.count("run_audit", "passed = 0") == 0
    assert run.warehouse.count("quarantine") == 1
    assert fingerprint(run.all(source)) == first
    assert lake.days(spark, f"{run.root}/bronze", lake.BRONZE)[-1] == "unknown"
    assert run.warehouse.latest_audit().count() == 56
    assert run.warehouse.query("select count(*) as n from fct_trip where store_id = :s", "fct_trip", s="S1").first().n == 15


def test_a_failed_gate_leaves_the_warehouse_untouched(spark, tmp_path, capsys):
    run = runner.Run(spark, str(tmp_path / "lake"), "b1", AS_OF)
    with pytest.raises(QualityGateFailed):
        run.all(write(tmp_path / "in", messages(broken=True)))
    assert not run.warehouse.exists("fct_trip") and not run.warehouse.exists("dim_driver")
    assert "measurable_share" in capsys.readouterr().out


def day(name, trips=20, of=20):
    """Messages of whole trips on one day."""
    lines = [m for t, m in ((json.loads(m)["trip_id"], m) for m in messages(of)[:-2]) if int(t[2:]) < trips]
    return [m.replace("2026-09-08", "2026-09-07").replace("2026-09-07", name).replace('": "e', f'": "{name}e').replace('"T-', f'"{name}T-') for m in lines]


def test_a_partial_day_is_not_published(spark, tmp_path, capsys):
    root = str(tmp_path / "lake")
    run = runner.Run(spark, root, "b1", AS_OF)
    before = fingerprint(run.all(write(tmp_path / "in", [m for d in ("2026-09-04", "2026-09-05", "2026-09-06") for m in day(d)])))
    assert len(before) == 60 and "volume_band" not in capsys.readouterr().out
    late = runner.Run(spark, root, "b2", AS_OF)
    late.bronze(write(tmp_path / "more", day("2026-09-08", 6)))
    with pytest.raises(QualityGateFailed):
        late.gold(late.silver(["2026-09-08"]))
    assert "- volume_band: observed 6, expected 20" in capsys.readouterr().out
    assert fingerprint(run.warehouse.table("fct_trip")) == before and run.warehouse.count("dim_driver") == 3
    late.bronze(write(tmp_path / "whole", day("2026-09-08")))
    late.gold(late.silver(["2026-09-08"]))
    late.build_marts()
    assert len(fingerprint(run.warehouse.table("fct_trip"))) == 80 and run.warehouse.partitions("fct_trip") == ["2026-09-04", "2026-09-05", "2026-09-06", "2026-09-08"]
    assert run.warehouse.table("fct_trip", ["2026-09-08"]).count() == 20 and run.warehouse.count("mart_store_daily") == 8


def test_a_day_that_loses_its_rows_is_empty_afterwards(spark, tmp_path):
    run = runner.Run(spark, str(tmp_path / "lake"), "b1", AS_OF)
    run.all(write(tmp_path / "in", day("2026-09-07") + day("2026-09-08")))
    broken = [m.replace("trip_id", "trap_id") for m in day("2026-09-07")] + day("2026-09-08")
    fact = run.all(write(tmp_path / "again", broken))
    assert lake.days(spark, f"{run.root}/silver", runner.SILVER) == ["2026-09-08"]
    assert fact.count() == 20 and run.warehouse.partitions("fct_trip") == ["2026-09-08"] and run.warehouse.count("quarantine") == 60
    run.silver(["2026-09-08"])
    assert run.warehouse.count("quarantine") == 0


def test_a_trip_over_midnight_and_a_late_event_are_one_fact(spark, tmp_path):
    def message(n, kind, ts):
        return json.dumps({"event_id": f"m{n}", "trip_id": "T-night", "event_type": kind, "event_ts": ts, "driver_id": "D-0", "store_id": "S0", "distance_m": 1, "promised_minutes": 45})

    root = str(tmp_path / "lake")
    run = runner.Run(spark, root, "b1", AS_OF)
    run.all(write(tmp_path / "in", [*day("2026-09-06"), message(1, "assigned", "2026-09-06T23:50:00"), message(2, "picked_up", "2026-09-06T23:58:00")]))
    late = runner.Run(spark, root, "b2", AS_OF)
    late.bronze(write(tmp_path / "late", [*day("2026-09-07"), message(3, "delivered", "2026-09-07T00:30:00")]))
    fact = late.gold(late.silver(["2026-09-07"]))
    (night,) = fact.where("trip_id = 'T-night'").collect()
    assert (night.date_key, night.completeness, night.tat_minutes) == ("2026-09-06", "complete", 40.0) and fact.count() == 41


def test_a_load_that_dies_changes_no_table(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    w.publish(one=Load(rows), two=Load(rows, "k"))
    with pytest.raises(Exception, match="boom"):
        w.publish(one=Load(rows.limit(0)), two=Load(rows.withColumn("n", F.raise_error(F.lit("boom")).cast("long")), "k"))
    assert w.count("one") == 2 and w.count("two") == 2
    w.replace("two", rows.where("k = 'a'").withColumn("n", F.lit(7).cast("long")), "k", ("a", "b"))
    assert w.table("two").collect() == [("a", 7)] and w.partitions("two") == ["a"]
    w.replace("two", w.table("two").withColumn("n", F.col("n") + 1), "k")
    w.replace("two", rows.limit(0), "k", ("a",))
    assert w.count("two") == 0 and w.table("two").columns == ["k", "n"]


def test_driver_changes_are_merged(spark, tmp_path):
    def change(op, driver, lsn, trips=0, snapshot="false"):
        image = {"driver_id": driver, "created_at": "2026-01-05 07:00:00", "trips_total": trips}
        return json.dumps({"op": op, "before" if op == "d" else "after": image, "source": {"table": "drivers", "lsn": lsn, "snapshot": snapshot}, "ts_ms": lsn})

    run = runner.Run(spark, str(tmp_path / "lake"), "b1", AS_OF)
    run.warehouse.replace("dim_driver", spark.createDataFrame([("quiet", None, 3), ("gone", None, 1)], "driver_id string, first_seen_at timestamp, trips_total long"))
    lines = [change("c", "new", 1), change("u", "new", 5, 9), change("u", "new", 3, 4), change("d", "gone", 6), "null", change("r", "new", 0, 0, "true"), "{bad"]
    source = write(tmp_path / "changes", lines)
    want = {"changes": 2, "upserted": 1, "removed": 1, "tombstones_skipped": 1, "out_of_order": 2, "errors": 1, "rows_now": 2}
    assert run.drivers(source) == want
    assert {r.driver_id: r.trips_total for r in run.warehouse.table("dim_driver").collect()} == {"quiet": 3, "new": 9}
    assert run.drivers(source) == want and run.drivers(write(tmp_path / "none", [""])) == dict.fromkeys(want, 0) | {"rows_now": 2}


def test_declared_tests_stop_the_marts(spark, tmp_path):
    run = runner.Run(spark, str(tmp_path / "lake"), "b1", AS_OF)
    fact = run.all(write(tmp_path / "in", messages()))
    marts_before = fingerprint(run.warehouse.table("mart_store_daily"))
    run.warehouse.replace("fct_trip", fact.withColumn("store_id", F.when(F.col("trip_id") != "T-1", F.col("store_id"))).union(fact.where("trip_id = 'T-2'").withColumn("store_id", F.lit("S-none"))))
    with pytest.raises(QualityGateFailed) as failed:
        run.build_marts()
    for test in ("stg_trip.trip_id.unique", "stg_trip.store_id.not_null", "stg_trip.store_id.relationships"):
        assert f"FAIL [BLOCK] test:{test}" in str(failed.value)
    assert fingerprint(run.warehouse.table("mart_store_daily")) == marts_before


def test_hourly_counts_of_a_stream(spark, tmp_path):
    source = write(tmp_path / "in", messages(8))
    query = ingest.open_trip_counts(lake.read_stream(spark, source)).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("hourly").collect()
    assert sum(r.events for r in rows) == 24 and {r.store_id for r in rows} == {"S0", "S1"}


def test_bronze_parts_and_silver_days(spark, tmp_path):
    root = str(tmp_path / "bronze")
    raw = spark.createDataFrame([(m,) for m in messages(3)], "value string").withColumn("ingested_at", F.lit(AS_OF).cast("timestamp"))
    assert lake.read_days(spark, root, lake.BRONZE).count() == 0
    for batch in ("a", "b", "a"):
        lake.write_batch(raw, root, batch)
    assert lake.read_days(spark, root, lake.BRONZE).count() == 2 * raw.count()
    assert lake.read_days(spark, root, lake.BRONZE, ["2026-09-01"]).count() == 0
    with pytest.raises(ValueError, match="bucket"):
        lake.check_uri("gs://")


def test_stream_keeps_both_micro_batches_of_a_day(spark, tmp_path):
    root, source = str(tmp_path / "lake"), tmp_path / "in"
    lines = messages(6)
    for part in (lines[:9], lines[9:] + lines[:3]):
        write(source, part)
        ingest.start(lake.read_stream(spark, str(source)), root).awaitTermination()
    assert lake.read_days(spark, f"{root}/silver", runner.SILVER).count() == 18
    assert lake.read_days(spark, f"{root}/bronze", lake.BRONZE).select("batch_id").distinct().count() == 2
    ingest.start(lake.read_stream(spark, str(source)), root).awaitTermination()
    assert lake.read_days(spark, f"{root}/silver", runner.SILVER).count() == 18


def test_alerts_never_raise():
    report = GateReport([{"gate": "g", "passed": False, "severity": "BLOCK", "observed": "1", "expected": "0"}])
    alert = alerts.from_report("gold", "b", report)
    assert "g: observed 1" in alert.to_text() and "Nothing was loaded" in alert.to_text()
    assert alerts.from_report("gold", "b", GateReport()) is None
    assert alerts.send(alert) is False
    assert alerts.send(alert, "http://127.0.0.1:9/x", timeout=0.2) is False
    assert alerts.send(alert, "not a url") is False
    assert alerts.failure_callback(None) is False
