"""Change data capture: parse change envelopes, collapse them to the latest state of each key, and
merge that state into a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_columns(schema: T.StructType, sep: str = "_", max_depth: int = 4) -> list[Column]:
    """Nested structs become a_b_c; what lies deeper than max_depth, arrays and maps become JSON text."""

    def walk(struct: T.StructType, path: tuple[str, ...]):
        for field in struct.fields:
            own = (*path, field.name)
            column = F.col(".".join(f"`{p}`" for p in own)).alias(sep.join(own))
            if isinstance(field.dataType, T.StructType) and len(own) < max_depth:
                yield from walk(field.dataType, own)
            elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
                yield F.to_json(column).alias(sep.join(own))
            else:
                yield column

    return list(walk(schema, ()))


def flatten(df: DataFrame, sep: str = "_", max_depth: int = 4) -> DataFrame:
    return df.select(*flatten_columns(df.schema, sep, max_depth))


def parse(messages: DataFrame, key_columns: list[str], value: str = "value") -> DataFrame:
    """Every message with kind record, tombstone or error, and for an error the reason.

    Columns: kind, reason, op, table, key (array of text), lsn, ts_ms, snapshot, image (JSON text).
    A delete is known by its before image, everything else by its after image; a truncate has no key.
    Null, blank and "null" messages, and those without an op, are tombstones. arrival grows with the
    place of the message in its file."""
    # one projection for each step, so that no step's expressions are copied into the next; the row number
    # keeps filters on the result from being pushed down, and all of the parsing copied into them
    step = messages.select(F.col(value).alias("message"), F.trim(F.col(value)).alias("text"))
    step = step.withColumns({"v": F.try_parse_json("text"), "blank": F.col("text").isNull() | F.col("text").isin("", "null")})
    step = step.withColumns({"object": F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "b": F.coalesce(F.try_variant_get("v", "$.payload", "variant"), F.col("v"))})

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get("b", f"$.{path}", kind)

    numbers = {"lsn": ("source.lsn", "source.scn"), "ts_ms": ("ts_ms", "source.ts_ms")}
    read = {n: F.coalesce(*[F.nullif(get(p, "bigint"), F.lit(0)) for p in paths], F.lit(0)) for n, paths in numbers.items()}
    step = step.withColumns(read | {"op": F.lower(F.trim(get("op", "string"))), "table": F.coalesce(get("source.table", "string"), F.lit("")), "taken": F.lower(get("source.snapshot", "string"))})
    op = F.col("op")
    step = step.withColumn("i", F.when(op == "d", get("before", "variant")).when(op.isin("c", "u", "r"), get("after", "variant")))
    parts = [F.try_variant_get("i", f"$.{'.'.join(k.split('__'))}", "string") for k in key_columns]
    step = step.withColumns({"no_image": F.coalesce(~F.schema_of_variant("i").startswith("OBJECT"), F.lit(True)), "parts": F.array(*parts), "row_no": F.monotonically_increasing_id()})
    reason = F.coalesce(
        F.when(F.col("v").isNull(), F.lit("not_json")),
        F.when(~F.col("object"), F.lit("not_an_object")),
        F.when(~op.isin("c", "u", "d", "r", "t"), F.lit("unknown_op")),
        F.when((op == "d") & F.col("no_image"), F.lit("delete_without_before")),
        F.when(op.isin("c", "u", "r") & F.col("no_image"), F.lit("missing_after")),
        F.when((op != "t") & F.exists("parts", lambda k: k.isNull()), F.lit("null_key")),
    )
    tombstone = F.col("blank") | (F.col("object") & op.isNull())
    step = step.withColumns({"reason": F.when(F.col("row_no") >= 0, F.when(~tombstone, reason)), "empty": tombstone})
    return step.select(
        F.when(F.col("empty"), "tombstone").when(F.col("reason").isNotNull(), "error").otherwise("record").alias("kind"),
        "reason",
        "op",
        "table",
        F.when(op != "t", F.col("parts")).alias("key"),
        "lsn",
        "ts_ms",
        F.coalesce(F.col("taken").isin("true", "first", "last") | (op == "r"), F.lit(False)).alias("snapshot"),
        F.to_json("i").alias("image"),
        "message",
        F.col("row_no").alias("arrival"),
    )


def collapse(parsed: DataFrame) -> DataFrame:
    """(table, key, image, deleted, lsn, snapshot, changes): the state of each key after its change of
    highest precedence. Any streamed change beats any snapshot read, then the log position decides. A
    key is deleted by a delete or by a later truncate of its table; its last image stays to name it.
    A function of the set of messages: arrival order doesn't matter."""
    records = parsed.where("kind = 'record'")
    order = F.struct(~F.col("snapshot"), "lsn", "ts_ms", "op", "image")
    state = records.where("op <> 't'").groupBy("table", "key").agg(
        F.max_by(F.struct("op", "image", "lsn", "ts_ms", "snapshot"), order).alias("s"), F.count("*").alias("changes")
    )
    cleared = records.where("op = 't'").groupBy("table").agg(F.max("lsn").alias("cleared"))
    deleted = (F.col("s.op") == "d") | F.coalesce(F.col("s.lsn") < F.col("cleared"), F.lit(False))
    joined = state.join(F.broadcast(cleared), "table", "left")  # one row for each table
    return joined.select("table", "key", "s.image", deleted.alias("deleted"), "s.lsn", "s.ts_ms", "s.snapshot", "changes")


def live(state: DataFrame) -> DataFrame:
    return state.where("not deleted")


def deleted(state: DataFrame) -> DataFrame:
    return state.where("deleted")


def counters(parsed: DataFrame) -> DataFrame:
    """One row: messages, records, tombstones, errors, truncates, superseded."""
    r = F.col("kind") == "record"
    keyed = parsed.where("kind = 'record' and op <> 't'")
    winners = keyed.select("table", "key").distinct().agg(F.count("*").alias("keys"))
    return (
        parsed.agg(
            F.count("*").alias("messages"),
            F.count_if(r).alias("records"),
            F.count_if(F.col("kind") == "tombstone").alias("tombstones"),
            F.count_if(F.col("kind") == "error").alias("errors"),
            F.count_if(r & (F.col("op") == "t")).alias("truncates"),
        )
        .crossJoin(winners)
        .withColumn("superseded", F.col("records") - F.col("truncates") - F.col("keys"))
        .drop("keys")
    )


def out_of_order(parsed: DataFrame) -> DataFrame:
    """One number: the changes that arrived after one of their key with the same or a later position."""
    position = F.struct(~F.col("snapshot"), "lsn", "ts_ms")
    before = Window.partitionBy("table", "key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    keyed = parsed.where("kind = 'record' and op <> 't'").withColumn("position", position)
    late = keyed.withColumn("reached", F.max("position").over(before)).where("position <= reached")
    return late.agg(F.count("*").alias("out_of_order"))


def merge(dimension: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """dimension(key, *columns, _lsn) after changes(key, *columns, deleted, lsn): upserts and deletes.
    A key that the batch doesn't name stays as it is, and an older batch never undoes a newer one."""
    c = changes.select(F.col(key), *[F.col(x).alias(f"_new_{x}") for x in columns], F.col("deleted").alias("_deleted"), F.col("lsn").alias("_new_lsn"))
    joined = dimension.withColumn("_there", F.lit(True)).join(c, key, "full_outer")
    newer = F.col("_new_lsn").isNotNull() & (F.col("_there").isNull() | (F.col("_new_lsn") >= F.coalesce("_lsn", F.lit(-1))))
    kept = joined.where(~(newer & F.col("_deleted")))
    return kept.select(
        key, *[F.when(newer, F.col(f"_new_{x}")).otherwise(F.col(x)).alias(x) for x in columns], F.when(newer, F.col("_new_lsn")).otherwise(F.col("_lsn")).alias("_lsn")
    )
