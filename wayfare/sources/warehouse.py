"""Warehouse tables: partition-wise replacement, counts, queries and the audit trail.

A table's files are never changed once written: one small manifest names, for every table, its schema and
the folders that make it up, by partition. A load writes new folders first and then replaces the manifest, so
several tables change at once, and a load that dies leaves all of them as they were. One writer at a
time; what a load replaces is removed by the load after it, so that readers may finish."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.operators.gates import GateReport

AUDIT = "batch_id string, stage string, check_name string, passed int, severity string, observed string, expected string, recorded_at timestamp"
QUARANTINE = "batch_id string, stage string, reason string, payload string, quarantined_at timestamp"
PAYLOAD_CHARS = 4000
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Load:
    """rows for a table. Without a partition column they are the whole of it; with one they replace the
    partitions that they hold and those listed in values, which are empty afterwards if no row is theirs."""

    rows: DataFrame
    partition: str | None = None
    values: tuple[str, ...] = field(default=())
    add: bool = False


class Warehouse:
    """Parquet tables under a root, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _manifest(self) -> dict:
        fs, path = self._fs(f"{self.root}/_manifest.json")
        if not fs.exists(path):
            return {"tables": {}, "replaced": []}
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        fs, staged = self._fs(f"{self.root}/_manifest.{uuid.uuid4().hex}")
        stream = fs.create(staged, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        jvm = self.spark._jvm
        rename = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        rename[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(staged, self._fs(f"{self.root}/_manifest.json")[1], rename)

    def publish(self, **loads: Load) -> None:
        """All loads at once: either every table is replaced or none is. Rows may come from the tables
        that they replace."""
        manifest = self._manifest()
        for stale in manifest["replaced"]:
            fs, path = self._fs(stale)
            fs.delete(path, True)
        replaced, tables = [], dict(manifest["tables"])
        for name, load in loads.items():
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            old = tables.get(name, {"parts": {}})["parts"]
            if load.partition:
                own = load.rows.withColumn("_part", F.col(load.partition).cast("string"))
                own.repartition("_part").write.partitionBy("_part").parquet(path)
                fs, folder = self._fs(path)
                found = {}
                for status in fs.listStatus(folder):
                    at = status.getPath()
                    if at.getName().startswith("_part="):
                        found[self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(at.getName()[6:])] = [f"{path}/{at.getName()}"]
                gone = {*found, *load.values}
                parts = {k: v for k, v in old.items() if k not in gone} | found
                replaced += [x for k, v in old.items() if k in gone for x in v]
            else:
                load.rows.write.parquet(path)
                parts = {"": [*old.get("", []), path]} if load.add else {"": [path]}
                replaced += [] if load.add else [x for v in old.values() for x in v]
            tables[name] = {"schema": load.rows.schema.json(), "parts": parts}
        self._swap({"tables": tables, "replaced": replaced})

    def replace(self, table: str, rows: DataFrame, partition: str | None = None, values: tuple[str, ...] = ()) -> None:
        """Replace the partitions that rows hold and those listed, or the whole table without a partition."""
        self.publish(**{table: Load(rows, partition, tuple(values))})

    def append(self, table: str, rows: DataFrame) -> None:
        self.publish(**{table: Load(rows, add=True)})

    def table(self, name: str, values: list[str] | None = None) -> DataFrame:
        """The table, or of a partitioned one the partitions listed: no other is listed or read."""
        own = self._manifest()["tables"].get(name)
        if own is None:
            raise FileNotFoundError(f"{name} has not been built")
        schema = T.StructType.fromJson(json.loads(own["schema"]))
        paths = [x for k, v in own["parts"].items() if values is None or k in values for x in v]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def partitions(self, name: str) -> list[str]:
        return sorted(self._manifest()["tables"].get(name, {"parts": {}})["parts"])

    def exists(self, name: str) -> bool:
        return name in self._manifest()["tables"]

    def count(self, name: str, where: str = "true") -> int:
        return self.table(name).where(where).count()

    def query(self, sql: str, *tables: str, **args) -> DataFrame:
        """SQL over the named tables, with named parameters."""
        for name in tables:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=args or None)

    def copy_to_jdbc(self, url: str, *tables: str, **options: str) -> None:
        """Tables into a database that has its JDBC driver on the classpath: each is created if it isn't
        there, emptied and filled."""
        for name in tables:
            self.table(name).write.mode("overwrite").option("truncate", "true").options(**options).jdbc(url, name)

    def record(self, batch_id: str, stage: str, report: GateReport, recorded_at: str) -> None:
        """Every verdict, passed or not."""
        rows = [(batch_id, stage, v["gate"], int(v["passed"]), v["severity"], v["observed"], v["expected"]) for v in report.verdicts]
        schema = AUDIT.rsplit(",", 1)[0]
        self.append("run_audit", self.spark.createDataFrame(rows, schema).withColumn("recorded_at", F.lit(recorded_at).cast("timestamp")))

    def quarantine(self, batch_id: str, bad: DataFrame, at: str) -> None:
        """Rejected rows of a batch; the same batch again replaces its own, also if nothing is rejected now."""
        rows = bad.select(
            F.lit("silver").alias("stage"), "reason", F.left("payload", F.lit(PAYLOAD_CHARS)).alias("payload"), F.lit(at).cast("timestamp").alias("quarantined_at"), F.lit(batch_id).alias("batch_id")
        )
        self.replace("quarantine", rows, "batch_id", (batch_id,))

    def latest_audit(self) -> DataFrame:
        """The verdicts of the batch recorded last."""
        audit = self.table("run_audit")
        last = audit.agg(F.max_by("batch_id", F.struct("recorded_at", "batch_id")).alias("batch_id"))
        return audit.join(F.broadcast(last), "batch_id").orderBy("stage", "check_name")
