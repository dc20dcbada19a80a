"""Shared parts of the training-data operators: scratch tables, components, text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOTS: dict[str, str] = {}
_SCOPES: list[list[DataFrame]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _OWN_ROOTS:
        _OWN_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="wayfare-")
    return _OWN_ROOTS[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared scratch folder and read it back: cuts lineage and
    survives the loss of any executor, which a cache would not. The table stays until forget() or the
    settled() around it removes it."""
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def forget(*tables: DataFrame) -> None:
    """Remove the files of tables that stored() gave and nothing will read again."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, "scratch_path", None)
        if path:
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """stored(make()), after which all other tables that were stored on the way are removed."""
    _SCOPES.append([])
    try:
        out = stored(make(), name)
    finally:
        tables = _SCOPES.pop()
    forget(*[t for t in tables if t is not out])
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names derived from `names` that clash with no column of df, whatever its spelling."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component_id) for every id in links(u long, v long); component_id is the smallest
    reachable id. Alternating large-star and small-star steps: each is an aggregation with
    map-side combine and one join, so no component is ever gathered in one place, and the number
    of rounds grows with the logarithm of the longest path.

    Nulls and self-links are ignored; an empty table gives an empty result."""
    edges = links.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = stored(edges.distinct(), "cc")
    state = _digest(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_lowest(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _with_lowest(large, 2 * state[0])
        small = small.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        before, edges = edges, stored(
            small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
        )
        forget(before)
        now = _digest(edges)
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "id")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return stars.union(roots)


HUBS = 2_000


def join_hot(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with found, which has a key once and says by weight how many of the total rows have it.
    At most HUBS keys have a share of more than 1 / HUBS: those are broadcast, so that the rows of
    no such key meet in one task. weight is dropped."""
    limit = total // HUBS
    hot = F.broadcast(found.where(F.col(weight) > limit).drop(weight))
    rest = found.where(F.col(weight) <= limit).drop(weight)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(rest, keys, how))


def _with_lowest(edges: DataFrame, total: int) -> DataFrame:
    """edges with m, the smallest v of the same u."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    return join_hot(edges, low, ["u"], "degree", total)


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("long"))
    ).first()
    return tuple(row)


BROADCAST_IDS = 1_000_000


def with_ids(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """rows whose `on` is among ids(on), one long a row. Up to BROADCAST_IDS ids (8 MB) are broadcast, so that the
    rows stay where they are; more are joined by exchange."""
    ids = stored(ids.distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, on, "left_semi")


def short_batches(spark: SparkSession, rows: int = 1_000, size: int = 16 << 20) -> None:
    """Smaller Arrow batches than Spark's default, for tables with very long texts."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def ship(spark: SparkSession) -> None:
    """Lets Python workers that see this checkout import the package; a cluster that doesn't share
    the path takes it by --py-files instead."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
