"""Answers and prompts as keyed tables on files: writing again replaces, a broken write changes nothing.

A sink is a folder of data files and manifests. Rows are dealt to ``parts`` parts by a hash of the replaced key
(``query_id``). A write makes new files for the parts that it touches, holding the old rows of other keys and the new rows,
and then publishes them by one new manifest, a small JSON file that lists the folder of every part. Readers take the
newest manifest, so that they see a write whole or not at all; a job that dies before the manifest is renamed into place leaves
files that nothing lists. Of two writers at a time one fails and can be run again.

Formats: ``parquet`` for answers, ``json`` (one object a line) for prompts that another program reads.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


@dataclass(frozen=True)
class KeyedSink:
    """``path``: folder on a file system that Spark reads; ``key``: whose rows a write replaces; ``unique``: with the key, what no two rows share."""

    path: str
    key: str = "query_id"
    unique: tuple[str, ...] = ("rank",)
    parts: int = 16
    format: str = "parquet"

    # ---- manifests

    def _fs(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests")
        return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _newest(self, spark: SparkSession) -> tuple[int, dict | None]:
        """(number, content) of the newest manifest; (0, None) of an empty sink."""
        jvm, fs, folder = self._fs(spark)
        if not fs.exists(folder):
            return 0, None
        numbers = [int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith(".")]
        if not numbers:
            return 0, None
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests/{max(numbers):012d}.json"))
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)

    def _publish(self, spark: SparkSession, number: int, content: dict) -> None:
        jvm, fs, folder = self._fs(spark)
        fs.mkdirs(folder)
        hidden = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests/{number:012d}.json")
        if fs.exists(final) or not fs.rename(hidden, final):
            fs.delete(hidden, False)
            raise RuntimeError(f"another write has published number {number}: run this one again")

    # ---- rows

    def _load(self, spark: SparkSession, schema: str, folders: list[str]) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not folders:
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).format(self.format).load(folders)

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows that are in force."""
        number, now = self._newest(spark)
        if now is None:
            raise FileNotFoundError(f"nothing has been written to {self.path}")
        return self._load(spark, now["schema"], [f"{self.path}/{f}" for f in sorted(now["parts"].values())])

    def write(self, rows: DataFrame) -> int:
        """Rows replace all earlier rows of their keys; the number of the write. Rows that share key and ``unique`` fail it before anything
        changes, NULL keys too."""
        spark = rows.sparkSession
        number, now = self._newest(spark)
        if now is not None and StructType.fromJson(json.loads(now["schema"])).simpleString() != rows.schema.simpleString():
            raise ValueError(f"the sink holds {StructType.fromJson(json.loads(now['schema'])).simpleString()}")
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        checked = rows.withColumn("_part", F.when(F.col(self.key).isNull(), F.raise_error(F.lit("a row without a key")).cast("int")).otherwise(part))
        folder = f"data/{number + 1:012d}-{uuid.uuid4().hex[:8]}"
        # the new rows are written first: they are read twice below, and must not be computed again
        fresh = f"{self.path}/{folder}/new"
        checked.write.partitionBy("_part").parquet(fresh)
        new = spark.read.schema(StructType([*rows.schema.fields, StructField("_part", IntegerType())])).parquet(fresh)
        twice = new.groupBy(self.key, *self.unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"rows share a key: {twice[0].asDict()}")
        touched = sorted(r["_part"] for r in new.select("_part").distinct().collect())  # at most ``parts`` numbers
        if not touched and now is not None:
            return number
        keep = {} if now is None else dict(now["parts"])
        old = [f"{self.path}/{keep[str(p)]}" for p in touched if str(p) in keep]
        if old:
            before = self._load(spark, now["schema"], old).join(new.select(self.key).distinct(), self.key, "left_anti")
            new = new.unionByName(before.select(*rows.columns).withColumn("_part", part))
        new.repartition(max(1, len(touched)), "_part").sortWithinPartitions("_part", self.key, *self.unique) \
            .write.partitionBy("_part").format(self.format).save(f"{self.path}/{folder}/rows")
        keep.update({str(p): f"{folder}/rows/_part={p}" for p in touched})
        self._publish(spark, number + 1, {"schema": rows.schema.json(), "parts": keep})
        return number + 1
