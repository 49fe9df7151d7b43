"""Session helpers: local sessions for tests, package shipping, and the shared work folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows on its way to Python, which the memory of both sides goes with.
BATCH_BYTES = 4 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"
_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_folders: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vetloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run, and send them rows in batches of BATCH_BYTES unless set otherwise."""
    if spark.conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="vetloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "vetloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, str(Path("vetloom") / path.relative_to(_PACKAGE)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one where it is unset and the master is local.

    A temporary folder of one machine is of no use to other executors, so elsewhere it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _folders.get(sc.applicationId)
        if base is None:
            base = _folders[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="vetloom-work-")
            atexit.register(shutil.rmtree, base[len("file://") :], ignore_errors=True)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a write go as soon as it ends; stages that are tried again make them anew."""
    own = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, own)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage.

    Files survive the loss of any executor, unlike a cache or a local checkpoint.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_dropped(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables that materialise() made and nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
