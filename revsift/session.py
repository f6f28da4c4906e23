"""Session helpers for tests, the bench and the driver entry points.

Library code never builds a session; it only reads settings from the one it is
given (for example ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins with measured sizes (so a
# side is broadcast only after its real size is known to be small), coalesces
# small shuffle partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE sizes reducers from measured shuffle output: start with many shuffle
    # partitions on a cluster and let it coalesce towards this size.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    # text-heavy rows (whole documents, prompts): smaller scan splits keep a task's
    # Python batches and line arrays well inside executor memory
    "spark.sql.files.maxPartitionBytes": "64MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "16MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",  # full-text prompts: keep Arrow batches small
    # JSON objects with a repeated key keep the last value, as Python's json.loads does
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "revsift", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SCALE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("REVSIFT_DRIVER_MEMORY", "12g"))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers (pandas UDFs, mapInPandas).

    The package is zipped in memory once per application, written to the shared
    checkpoint folder through Spark's file systems and added with ``addPyFile``."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(pkg_dir):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(pkg_dir)))
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/revsift-pkg-{app}/revsift.zip")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target.toString())
    _SHIPPED.add(app)


def configure_semantics(spark: SparkSession) -> None:
    """Session settings the parsing semantics depend on (safe to call repeatedly).

    A session that refuses them gets the refusal: answers with a repeated JSON
    key would otherwise turn into NULL without notice."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment has to set it, to shared storage; a local
    master, as in tests, gets a temporary folder where it is unset.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a checkpoint folder on shared storage")
        current = tempfile.mkdtemp(prefix="revsift-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: what it holds is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
