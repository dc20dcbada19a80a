"""Lake tables partitioned by day: bronze keeps what arrived, one part for each batch; silver holds
each day once. All through Spark's own readers and writers, so any store that Spark knows will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import contract

DAY = r"^(\d{4}-\d{2}-\d{2}|unknown)$"
BRONZE = "value string, ingested_at timestamp, dt string, batch_id string"


def check_uri(uri: str) -> str:
    """A lake's root. An object store's URI must name a bucket."""
    scheme, found, rest = uri.partition("://")
    if found and scheme != "file" and not rest.strip("/").split("/")[0]:
        raise ValueError(f"no bucket in {uri!r}")
    return uri.rstrip("/")


def read_lines(spark: SparkSession, source: str) -> DataFrame:
    """One message to a line; blank lines are skipped. A missing source raises."""
    return spark.read.text(source).where(F.trim("value") != "")


def with_day(raw: DataFrame) -> DataFrame:
    """raw plus dt: the UTC day of the message's event_ts, or unknown."""
    stamp = F.try_variant_get(F.try_parse_json("value"), "$.event_ts", "string")
    return raw.withColumn("dt", F.coalesce(F.date_format(contract.parse_timestamp(stamp), "yyyy-MM-dd"), F.lit("unknown")))


def write_batch(raw: DataFrame, root: str, batch_id: str) -> None:
    """raw(value, ingested_at) into (dt, batch_id) parts; the same batch written again replaces itself
    and nothing else."""
    out = with_day(raw).withColumn("batch_id", F.lit(batch_id)).select("value", "ingested_at", "dt", "batch_id")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch_id").parquet(check_uri(root))


def replace_days(rows: DataFrame, root: str, days: list[str] | None = None, day: str = "dt") -> None:
    """Replace the days that rows hold, whole, and those listed: a listed day of which no row is left is
    empty afterwards. Other days stay."""
    root, spark = check_uri(root), rows.sparkSession
    out = rows.repartition(day).sortWithinPartitions("trip_id", "event_ts", "event_type")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(root)
    for gone in set(days or []) - {r[0] for r in rows.select(day).distinct().collect()}:  # days of one batch
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{day}={gone}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_days(spark: SparkSession, root: str, schema: str, days: list[str] | None = None) -> DataFrame:
    """The days asked for (all if None); days and lakes never written read as empty."""
    try:
        table = spark.read.schema(schema).parquet(check_uri(root))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = spark.createDataFrame([], schema)
    table = table.where(F.col("dt").rlike(DAY))
    return table if days is None else table.where(F.col("dt").isin(days))


def days(spark: SparkSession, root: str, schema: str) -> list[str]:
    """Days there are, in order; folders of other names don't count."""
    return [r[0] for r in read_days(spark, root, schema).select("dt").distinct().orderBy("dt").collect()]


def object_count(spark: SparkSession, root: str, schema: str, day: str) -> int:
    return read_days(spark, root, schema, [day]).select(F.input_file_name()).distinct().count()


def write_lines(df: DataFrame, path: str) -> None:
    """All columns as JSON, one object to a line."""
    df.select(F.to_json(F.struct("*"))).write.mode("overwrite").text(path)


def read_stream(spark: SparkSession, source: str, max_files: int = 100, kafka: dict | None = None) -> DataFrame:
    """(value, ingested_at) as a stream: text files in a folder, or a Kafka topic where its connector is
    on the classpath (kafka: bootstrap.servers, subscribe and so on)."""
    if kafka:
        stream = spark.readStream.format("kafka").options(**{"startingOffsets": "earliest", "maxOffsetsPerTrigger": "200000"} | kafka).load()
        return stream.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingested_at"))
    stream = spark.readStream.option("maxFilesPerTrigger", max_files).text(source)
    return stream.select("value", F.col("_metadata.file_modification_time").alias("ingested_at"))


def write_kafka(df: DataFrame, servers: str, topic: str, options: dict | None = None) -> None:
    """Messages keyed by trip_id, so that a trip's events stay in order. A message counts as sent when all
    replicas have it; retries neither double nor reorder; a task whose sends fail fails."""
    delivery = {"kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.linger.ms": "50", "kafka.delivery.timeout.ms": "120000", "kafka.compression.type": "snappy"}
    out = df.select(F.col("trip_id").alias("key"), F.to_json(F.struct("*")).alias("value"))
    out.write.format("kafka").options(**delivery | (options or {})).option("kafka.bootstrap.servers", servers).option("topic", topic).save()
