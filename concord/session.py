"""Session settings and shared scratch space."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("concord")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_scratch: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The session names it in ``spark.checkpoint.dir``. A machine-local folder is used only when
    that is unset and the session itself is local; a cluster session without it is an error.
    """
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="concord-")
    return _local_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never reused."""
    return f"{scratch_root(spark)}/concord/{name}-{uuid.uuid4().hex}"


#: How Spark is told to delete the shuffle files of a write when it ends, not when the driver next collects its garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Writer options for large tables of numbers: integers as bit-packed differences, then zstd.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2"}


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage with a table in shared storage, so a lost executor never makes Spark repeat
    what came before, and the re-read has real sizes for adaptive planning. Shuffle files of the write go
    when it ends, as nothing reads them again. ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def release(*stored: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more; other frames are left alone."""
    for df in stored:
        if path := df.__dict__.pop("_stored_at", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters where it is not installed; once per session."""
    if getattr(spark.sparkContext, "_concord_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="concord-package-"))  # the driver serves it until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(package, folder / "root" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "root"))
    spark.sparkContext._concord_shipped = True
