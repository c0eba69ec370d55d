"""SparkSession construction and the shared scratch folder."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_spark(app: str = "shoprank", cpus: int | str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests/bench. On a cluster, use the session the platform gives."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    parts = shuffle_partitions or int(cpus) * 2
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


#: Bytes of one Arrow batch that a Python stage gets, unless the session sets its own: 10,000 rows of long texts are too many to hold
#: in the JVM and in a worker at once.
ARROW_BATCH = "8m"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session ready for this package: shared checkpoint folder, code on the workers, Arrow batches of bounded bytes."""
    ensure_checkpoint_dir(spark)
    if spark.conf.get(_ARROW_BYTES) == "67108864b":  # Spark's default
        spark.conf.set(_ARROW_BYTES, ARROW_BATCH)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The setting is read from the session; only when it is unset (tests, a bare local
    session with a local master) a fresh folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        conf_dir = tempfile.mkdtemp(prefix="shoprank-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unique folder path under the shared checkpoint folder (not created)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/shoprank-{label}-{uuid.uuid4().hex[:12]}"
    _HANDED_OUT.append(path)
    return path


def scratch_table(spark: SparkSession, df, label: str):
    """``df`` written once as Parquet in the shared scratch folder and read back, for later jobs to share."""
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders that this process has handed out (call once their results are no longer read)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _HANDED_OUT:
        path = jvm.org.apache.hadoop.fs.Path(_HANDED_OUT.pop())
        path.getFileSystem(conf).delete(path, True)


_HANDED_OUT: list[str] = []
_SHIPPED: set[str] = set()


def _package_zip() -> bytes:
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(root)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, base))
    return buf.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Put this package on the Python workers' path (what ``--py-files`` does).

    Python stages (tile packing and scoring) import ``shoprank`` on the executors, which
    otherwise only works when every worker happens to start in the repository folder.
    The zip is written once per content hash into the shared checkpoint folder and
    registered with ``addPyFile``; Spark fetches it to every executor.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    data = _package_zip()
    name = f"shoprank-{hashlib.sha1(data).hexdigest()[:12]}.zip"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pyfiles/{name}"
    jvm = sc._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        out = fs.create(jpath, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
