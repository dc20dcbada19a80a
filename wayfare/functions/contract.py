"""The event contract as Catalyst expressions: text, numbers and timestamps as producers spell them,
fatal reasons, issue flags, and the fields nobody declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import registry

#: Lifecycle order, terminal types, and the columns of a conformed event in order.
RANKS = {"assigned": 0, "reached_pickup": 1, "picked_up": 2, "out_for_delivery": 3, "reached_delivery": 4, "delivered": 5}
TERMINAL = ("delivered", "cancelled", "returned")
VOCABULARY = (*RANKS, "cancelled", "returned")
SILVER_COLUMNS = (
    "event_id", "trip_id", "order_id", "driver_id", "store_id", "event_type", "event_ts", "ingested_at",
    "lat", "lon", "distance_m", "promised_minutes", "producer_version", "schema_version", "extra",
)
_ISO = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?( ?(Z|z|[+-]\d{2}:?\d{2}))?$"
_COMPACT = r"^\d{8}T\d{6}$"


def as_text(value: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(""))


def as_float(value: Column) -> Column:
    """Null where it doesn't parse and where it is not a number; infinities stay."""
    return F.nanvl(F.trim(value).try_cast("double"), F.lit(None).cast("double"))


def as_int(value: Column) -> Column:
    """Truncated toward zero; infinities and anything beyond a long are null."""
    return as_float(value).try_cast("bigint")


def parse_timestamp(value: Column) -> Column:
    """UTC instant of a text: epoch seconds (10 digits, perhaps a fraction) or milliseconds (13), ISO
    date and time with Z, an offset or neither, a plain or day-first or slashed date and time.
    Anything else is null: a bare year or time of day is not an instant."""
    # the lambda's variable is made once, where a column would be copied into each of the spellings
    return F.get(F.transform(F.array(as_text(value)), _instant), F.lit(0))


def _instant(t: Column) -> Column:
    zoned = F.regexp_replace(F.regexp_replace(t, r" ?[Zz]$", "+00:00"), r" ?([+-]\d{2}):?(\d{2})$", "$1:$2")

    def spelled(pattern: str, fmt: str) -> Column:
        return F.when(t.rlike(pattern), F.try_to_timestamp(t, F.lit(fmt)))

    return F.coalesce(
        F.when(t.rlike(r"^\d{13}$"), F.timestamp_millis(t.try_cast("bigint"))),
        F.when(t.rlike(r"^\d{10}(\.\d+)?$"), F.timestamp_micros((t.try_cast("decimal(30,6)") * 1000000).cast("bigint"))),
        F.when(t.rlike(_ISO), zoned.try_cast("timestamp")),
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("timestamp")),
        spelled(_COMPACT, "yyyyMMdd'T'HHmmss"),
        spelled(r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss"),
        spelled(r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$", "dd/MM/yyyy HH:mm:ss"),
    )


def _typed(kind: str, shape: Column, instant: Column) -> Column:
    """Whether a variant of this shape is acceptable for the kind; absent and null always are here."""
    whole = shape == "BIGINT"
    number = whole | shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT")
    ok = {"str": shape == "STRING", "int": whole, "float": number, "timestamp": instant.isNotNull()}[kind]
    return shape.isNull() | (shape == "VOID") | ok


def normalise(raw: DataFrame, value: str = "value", ingested_at: str = "ingested_at") -> DataFrame:
    """Conformed events: SILVER_COLUMNS, then issues (array) and reason (null for a valid row), payload
    (the text as it came). No row is lost: a row with a reason goes to quarantine.

    Fatal, in this order: text that is no JSON object, no event_id, no trip_id, a type outside the
    vocabulary, an unreadable event_ts. Everything else is flagged and kept."""
    v = F.try_parse_json(F.col(value))
    names = (*registry.all_fields(), registry.RESERVED)
    # one projection for each step, so that no step's expressions are copied into the next
    step = raw.select(F.col(value).alias("payload"), F.col(ingested_at).alias("ingested_at"), v.alias("v"))
    step = step.withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))
    texts = {f"t_{n}": F.regexp_replace(F.try_variant_get("v", f"$.{n}", "string"), r"^\s+|\s+$", "") for n in names}
    shapes = {f"s_{n}": F.schema_of_variant(F.try_variant_get("v", f"$.{n}", "variant")) for n in registry.all_fields()}
    step = step.withColumns(texts | shapes)
    step = step.withColumns({t: F.nullif(F.col(t), F.lit("")) for t in texts} | {"instant": _instant(F.nullif(F.col("t_event_ts"), F.lit("")))})
    numbers = {f"x_{n}": as_float(F.col(f"t_{n}")) for n in ("lat", "lon")} | {f"x_{n}": as_int(F.col(f"t_{n}")) for n in ("distance_m", "promised_minutes")}
    step = step.withColumns(numbers | {"kind": F.lower("t_event_type"), "version": F.coalesce(f"t_{registry.RESERVED}", F.lit(registry.OLDEST))})

    # a filter on the reason would else be pushed down, and all of the parsing copied into it
    step = step.withColumn("drawn", F.rand(0))

    def text(name: str) -> Column:
        return F.col(f"t_{name}")

    version, event_type, instant = F.col("version"), F.col("kind"), F.col("instant")
    known_version = F.when(version.isin(*registry.VERSIONS), version).otherwise(registry.OLDEST)
    lat, lon, distance, promise = (F.col(f"x_{n}") for n in ("lat", "lon", "distance_m", "promised_minutes"))
    lat_ok, lon_ok = lat.between(-90, 90), lon.between(-180, 180)
    reason = F.coalesce(
        F.when(F.col("v").isNull(), F.lit("not_an_object")),
        F.when(text("event_id").isNull(), F.lit("missing_event_id")),
        F.when(text("trip_id").isNull(), F.lit("missing_trip_id")),
        F.when(F.coalesce(~event_type.isin(*VOCABULARY), F.lit(True)), F.lit("unknown_event_type")),
        F.when(instant.isNull(), F.lit("bad_event_ts")),
    )
    fields = F.map_filter(F.col("v").cast("map<string,variant>"), lambda k, _: ~k.startswith("_") & (k != registry.RESERVED))
    by_version = {ver: F.array(*[F.lit(f.name) for f in registry.fields(ver)]) for ver in registry.VERSIONS}
    step = step.withColumns({"fields": fields, "declared": F.coalesce(*[F.when(known_version == ver, own) for ver, own in by_version.items()]), "given": _defaults(known_version)})
    fields, declared = F.col("fields"), F.col("declared")
    columns = F.array(*map(F.lit, SILVER_COLUMNS))
    undeclared = F.exists(F.map_keys(fields), lambda k: ~F.array_contains(declared, k))
    mistyped = [
        F.when(F.array_contains(declared, name) & ~_typed(f.kind, F.col(f"s_{name}"), instant), F.lit(f"mistyped:{name}"))
        for name, f in sorted(registry.all_fields().items())
    ]
    issues = F.array_compact(
        F.array(
            *mistyped,
            F.when(undeclared, F.lit("undeclared_fields")),
            F.when(text("driver_id").isNull(), F.lit("null_driver_id")),
            F.when(text("store_id").isNull(), F.lit("null_store_id")),
            F.when(~lat_ok, F.lit("lat_out_of_range")),
            F.when(~lon_ok, F.lit("lon_out_of_range")),
            F.when(distance < 0, F.lit("negative_distance")),
            F.when(promise <= 0, F.lit("non_positive_promise")),
        )
    )
    own = F.map_filter(fields, lambda k, _: ~F.array_contains(columns, k))
    absent = F.map_filter(F.col("given"), lambda k, _: ~F.array_contains(F.map_keys(fields), k) & ~F.array_contains(columns, k))
    step = step.withColumns({"extra_map": F.map_concat(absent, own), "issues": issues, "reason": F.when(F.col("drawn") >= 0, reason)})
    return step.select(
        text("event_id").alias("event_id"),
        text("trip_id").alias("trip_id"),
        text("order_id").alias("order_id"),
        text("driver_id").alias("driver_id"),
        text("store_id").alias("store_id"),
        event_type.alias("event_type"),
        instant.alias("event_ts"),
        "ingested_at",
        F.when(lat_ok, lat).alias("lat"),
        F.when(lon_ok, lon).alias("lon"),
        F.when(distance >= 0, distance).alias("distance_m"),
        F.when(promise > 0, promise).alias("promised_minutes"),
        F.coalesce(text("producer_version"), F.lit("unknown")).alias("producer_version"),
        version.alias("schema_version"),
        F.when(F.size("extra_map") > 0, F.to_json("extra_map")).alias("extra"),
        "issues",
        "reason",
        "payload",
    )


def _defaults(known_version: Column) -> Column:
    out = None
    for ver in registry.VERSIONS:
        pairs = [x for k, d in registry.defaults(ver).items() for x in (F.lit(k), F.parse_json(F.lit(f'"{d}"')))]
        own = F.create_map(*pairs)
        out = F.when(known_version == ver, own) if out is None else out.when(known_version == ver, own)
    return out


def split_valid(normalised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined)."""
    return normalised.where("reason is null").drop("reason", "payload"), normalised.where("reason is not null")


def get_field(name: str, default=None) -> Column:
    """A column of the contract, or else a field kept in extra."""
    found = F.col(name) if name in SILVER_COLUMNS else F.try_variant_get(F.try_parse_json("extra"), f"$.{name}", "string")
    return F.coalesce(found, F.lit(default)) if default is not None else found
