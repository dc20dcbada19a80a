import json

import pytest
from pyspark.sql import functions as F

from wayfare.functions import contract, registry


def normal(spark, *messages):
    rows = [(m if isinstance(m, str) or m is None else json.dumps(m),) for m in messages]
    df = spark.createDataFrame(rows, "value string").withColumn("ingested_at", F.lit("2026-10-01 10:00:00").cast("timestamp"))
    return contract.normalise(df).collect()


GOOD = {"event_id": "e1", "trip_id": "T-1", "event_type": "Delivered", "event_ts": "2026-10-01 09:00:00", "driver_id": "D", "store_id": "S", "distance_m": 5, "promised_minutes": 45}


@pytest.mark.parametrize(
    ("text", "micros"),
    [
        ("2025-11-03 06:45:19", 1762152319000000),
        ("2025-11-03T06:45:19.250000", 1762152319250000),
        ("2025-11-03T06:45:19", 1762152319000000),
        ("2025-11-03T06:45:19Z", 1762152319000000),
        ("2025-11-03T02:45:19-04:00", 1762152319000000),
        ("2025-11-03T15:45:19+0900", 1762152319000000),
        ("20251103T064519", 1762152319000000),
        ("2025/11/03 06:45:19", 1762152319000000),
        ("03/11/2025 06:45:19", 1762152319000000),
        ("1762152319", 1762152319000000),
        ("1762152319.5", 1762152319500000),
        ("1762152319000", 1762152319000000),
        ("around noon", None),
        ("", None),
        (None, None),
        ("2026", None),
        ("12:30:00", None),
        ("2026-13-45 00:00:00", None),
    ],
)
def test_timestamp_spellings(spark, text, micros):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.unix_micros(contract.parse_timestamp(F.col("t")))).first()[0] == micros


def test_fatal_reasons_come_in_order_and_nothing_is_lost(spark):
    bad = [None, "", "no json", "[1]", {}, GOOD | {"event_id": " "}, GOOD | {"trip_id": None}, GOOD | {"event_type": "x"}, GOOD | {"event_ts": "soon"}, GOOD]
    assert [r.reason for r in normal(spark, *bad)] == [
        *["not_an_object"] * 4, "missing_event_id", "missing_event_id", "missing_trip_id", "unknown_event_type", "bad_event_ts", None,
    ]


def test_issues_null_the_value_and_keep_the_row(spark):
    (row,) = normal(spark, GOOD | {"driver_id": "", "store_id": None, "lat": 91, "lon": -181, "distance_m": -1, "promised_minutes": 0})
    assert row.reason is None and row.event_type == "delivered"
    assert (row.lat, row.lon, row.distance_m, row.promised_minutes, row.driver_id) == (None,) * 5
    assert row.issues == ["null_driver_id", "null_store_id", "lat_out_of_range", "lon_out_of_range", "negative_distance", "non_positive_promise"]


def test_a_mistyped_field_is_flagged_and_still_read_if_it_can_be(spark):
    a, b, c = normal(spark, GOOD | {"distance_m": "about a mile"}, GOOD | {"distance_m": "12"}, GOOD | {"distance_m": "inf"})
    assert [r.distance_m for r in (a, b, c)] == [None, 12, None]
    assert all("mistyped:distance_m" in r.issues for r in (a, b, c))


def test_undeclared_fields_and_defaults_land_in_extra(spark):
    old, new, odd = normal(spark, GOOD | {"road_code": 7, "_delay": 1}, GOOD | {"schema_version": "1.1.0"}, GOOD | {"schema_version": "9.9.9", "vehicle_type": "bike"})
    assert json.loads(old.extra) == {"road_code": 7} and "undeclared_fields" in old.issues
    assert json.loads(new.extra) == {"vehicle_type": "unknown"} and new.issues == []
    assert odd.schema_version == "9.9.9" and json.loads(odd.extra) == {"vehicle_type": "bike"} and "undeclared_fields" in odd.issues


def test_column_order_is_the_contract(spark):
    df = spark.createDataFrame([("{}",)], "value string").withColumn("ingested_at", F.current_timestamp())
    assert tuple(contract.normalise(df).columns) == (*contract.SILVER_COLUMNS, "issues", "reason", "payload")


def test_registry_verdicts():
    old = registry.VERSIONS["1.0.0"]
    assert registry.check_compatibility(old, registry.VERSIONS["1.1.0"]).verdict == "FULL"
    assert registry.check_compatibility(old, old[:-1]).verdict == "BACKWARD"
    retyped = (*old[:-1], registry.Field("producer_version", "int"))
    with pytest.raises(registry.IncompatibleSchema):
        registry.check_compatibility(old, retyped).raise_if_breaking()
    required = (*old, registry.Field("zone", "str", required=True))
    assert registry.check_compatibility(old, required).newly_required == ("zone",)
    assert registry.fields("nonsense") == old
