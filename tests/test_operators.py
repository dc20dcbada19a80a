import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayfare.operators import cdc, dedupe, gates, marts, star, trips

BASE = datetime(2026, 10, 1, 9)
SCHEMA = "event_id string, trip_id string, event_type string, event_ts timestamp, ingested_at timestamp, order_id string, driver_id string, store_id string, lat double, lon double, distance_m long, promised_minutes long"


def event(trip, kind, minute, n=None, ingest=None, driver="D-1", store="S1", distance=4200, promise=45):
    ts = BASE + timedelta(minutes=minute)
    return (n or f"{trip}-{kind}-{minute}", trip, kind, ts, BASE + timedelta(minutes=ingest if ingest is not None else minute), "O-1", driver, store, None, None, distance, promise)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def facts(spark, rows, as_of=BASE + timedelta(hours=2)):
    return {r.trip_id: r for r in trips.build_facts(dedupe.latest(frame(spark, rows)), str(as_of)).collect()}


def trip(name, tat=30, **more):
    return [event(name, "assigned", 0, **more), event(name, "picked_up", 8, **more), event(name, "delivered", tat, **more)]


def test_replay_correction_and_order_independence(spark):
    rows = trip("T") + [event("T", "delivered", 30, n="fix", ingest=120, distance=5100)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        kept = dedupe.latest(frame(spark, rows + rows).repartition(seed + 1)).collect()
        assert sorted(r.event_id for r in kept) == ["T-assigned-0", "T-picked_up-8", "fix"]
    counts = dedupe.counters(frame(spark, rows)).first()
    assert (counts.n_rows, counts.kept, counts.duplicates_removed, counts.corrected) == (4, 3, 1, 1)
    late = dedupe.merge_late(frame(spark, rows[:2]), frame(spark, rows)).count()
    assert late == 3
    assert dedupe.latest(frame(spark, [])).count() == 0


def test_completeness_labels_and_turnaround(spark):
    rows = trip("done", 60) + [event("open", "assigned", 0)] + [event("late", "delivered", 4), *trip("late", 30)[:2]]
    rows += [event("gone", "assigned", 0), event("gone", "cancelled", 5)]
    f = facts(spark, rows)
    assert {k: v.completeness for k, v in f.items()} == {"done": "complete", "open": "open", "late": "broken", "gone": "complete"}
    assert f["done"].tat_minutes == 60 and f["done"].is_breach is True and f["done"].pickup_minutes == 8
    assert f["late"].tat_minutes is None and f["late"].issues == ["delivered_before_picked_up"]
    assert f["gone"].tat_minutes is None and f["gone"].terminal_event == "cancelled"
    later = facts(spark, rows, BASE + timedelta(days=9))
    assert later["open"].completeness == "stalled" and later["done"].tat_minutes == 60


def test_attributes_are_the_first_non_null(spark):
    rows = [event("T", "assigned", 0, driver=None), event("T", "picked_up", 5, driver="A"), event("T", "delivered", 9, driver="B")]
    assert facts(spark, rows)["T"].driver_id == "A"


def test_one_exchange_serves_dedupe_and_trips(spark):
    plan = trips.build_facts(frame(spark, trip("T")), "2026-10-02 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_star_and_marts(spark):
    rows = trip("a", 60) + trip("b", 30, store="S2") + [event("c", "delivered", 5, store="S2", driver=None)]
    f = trips.build_facts(frame(spark, rows), "2026-10-02 00:00:00")
    fact = star.fact_table(f)
    with pytest.raises(star.SchemaDrift):
        star.fact_table(f.withColumn("extra", F.lit(1)))
    assert {r.trip_id: (r.date_key, r.is_breach) for r in fact.collect()} == {"a": ("2026-10-01", 1), "b": ("2026-10-01", 0), "c": ("unknown", None)}
    assert star.dim_driver(f).first().trips_total == 2
    day = star.dim_date(f).collect()
    assert [(d.date_key, d.day_of_week, d.is_weekend) for d in day] == [("2026-10-01", 3, 0)]
    daily = {r.store_day_key: r for r in marts.store_daily(marts.staging(fact)).collect()}
    assert daily["S1|2026-10-01"].breach_rate == 1.0 and daily["S2|unknown"].breach_rate is None
    errors = {r.store_id: r for r in marts.promise_error(marts.staging(fact)).collect()}
    assert errors["S1"].mean_signed_error_minutes == 15.0 and errors["S1"].p50_error_minutes is None


def envelope(op, key, lsn, before=None, after=None, snapshot="false", **more):
    image = {"driver_id": key, "name": f"n{lsn}"}
    body = {"op": op, "before": image if op == "d" else before, "after": image if op in "cur" else after, "source": {"table": "d", "lsn": lsn, "snapshot": snapshot}, "ts_ms": lsn}
    return json.dumps(body | more)


def changes(spark, *messages):
    return cdc.parse(spark.createDataFrame([(m,) for m in messages], "value string"), ["driver_id"])


def test_cdc_errors_and_tombstones(spark):
    no_before = json.dumps({"op": "d", "before": None, "source": {"lsn": 1}})
    rows = changes(spark, None, "", "null", '{"key": 1, "value": null}', "{oops", "[1]", envelope("x", "1", 1), no_before, envelope("c", None, 2), json.dumps({"payload": json.loads(envelope("c", "1", 3))})).collect()
    assert [r.kind for r in rows] == ["tombstone"] * 4 + ["error"] * 5 + ["record"]
    assert [r.reason for r in rows[4:9]] == ["not_json", "not_an_object", "unknown_op", "delete_without_before", "null_key"]


def test_cdc_collapse_is_order_independent(spark):
    messages = [envelope("c", "1", 1), envelope("u", "1", 5), envelope("u", "1", 3), envelope("r", "1", 9, snapshot="true"), envelope("r", "2", 4), envelope("c", "3", 1), envelope("d", "3", 2), envelope("d", "4", 1), envelope("c", "4", 2)]
    want = {"1": (5, False), "2": (4, False), "3": (2, True), "4": (2, False)}
    for seed in range(3):
        random.Random(seed).shuffle(messages)
        state = cdc.collapse(changes(spark, *messages)).collect()
        assert {r.key[0]: (r.lsn, r.deleted) for r in state} == want
    truncate = json.dumps({"op": "t", "source": {"table": "d", "lsn": 4}})
    state = {r.key[0]: r.deleted for r in cdc.collapse(changes(spark, truncate, *messages)).collect()}
    assert state == {"1": False, "2": False, "3": True, "4": True}


def test_cdc_merge_leaves_the_quiet_and_is_replay_safe(spark):
    dim = spark.createDataFrame([("1", "a", 1), ("2", "b", 1), ("3", "c", 9)], "id string, name string, _lsn long")
    batch = spark.createDataFrame([("1", "new", False, 2), ("2", None, True, 3), ("3", "old", False, 5), ("4", "x", False, 1)], "id string, name string, deleted boolean, lsn long")
    once = cdc.merge(dim, batch, "id", ["name"])
    assert sorted(map(tuple, once.collect())) == [("1", "new", 2), ("3", "c", 9), ("4", "x", 1)]
    assert sorted(map(tuple, cdc.merge(once, batch, "id", ["name"]).collect())) == sorted(map(tuple, once.collect()))
    assert cdc.merge(dim, batch.limit(0), "id", ["name"]).count() == 3


def test_flatten_is_bounded_and_keeps_lists(spark):
    df = spark.sql("select named_struct('a', named_struct('b', named_struct('c', 1)), 'tags', array('x','y')) as p")
    assert cdc.flatten(df, max_depth=2).first().asDict() == {"p_a": '{"b":{"c":1}}', "p_tags": '["x","y"]'}
    assert cdc.flatten(df).columns == ["p_a_b_c", "p_tags"]


def verdict(frame):
    return frame.first().passed


def test_gates(spark):
    one, two = spark.range(10).toDF("k"), spark.range(8).toDF("k")
    assert verdict(gates.row_conservation(one, one, "j")) and not verdict(gates.row_conservation(one, two, "j"))
    assert verdict(gates.reconciliation(one, two, spark.range(2).toDF("k"))) and not verdict(gates.reconciliation(one, two, two))
    assert verdict(gates.unique_key(one, "k")) and not verdict(gates.unique_key(one.union(two), "k"))
    assert not verdict(gates.foreign_key(one, "k", two, "k"))
    assert verdict(gates.foreign_key(spark.createDataFrame([(None,), (1,)], "k long"), "k", two, "k"))
    assert [r.example for r in gates.orphan_examples(one, "k", two, "k").collect()] == ["8", "9"]
    events = frame(spark, trip("T"))
    assert verdict(gates.freshness(events, "event_ts", "2026-10-01 11:00:00", 2)) and not verdict(gates.freshness(events, "event_ts", "2026-10-01 18:00:00", 2))
    assert not verdict(gates.freshness(events.limit(0), "event_ts", "2026-10-01 18:00:00", 2))
    daily = spark.createDataFrame([("1", 640), ("2", 655), ("3", 610), ("4", 702), ("5", 240)], "date_key string, n long")
    assert not verdict(gates.volume_band(daily, "5"))
    short = gates.volume_band(daily.where("date_key in ('1', '5')"), "5").first()
    assert short.passed and short.severity == "WARN"
    report = gates.GateReport().add(gates.not_null(frame(spark, [event("T", "assigned", 0, driver=None)]), "driver_id", gates.WARN))
    report.enforce()
    report.add(gates.unique_key(one.union(one), "k"))
    with pytest.raises(gates.QualityGateFailed):
        report.enforce()
