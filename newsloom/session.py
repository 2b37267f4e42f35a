"""Session helpers shared by every job: shipping the package, shared scratch tables."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []
#: Most bytes of one Arrow batch sent to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application, and bound Arrow batches by bytes.

    Executors need not have the package installed: Spark's own file server hands out the archive. A
    batch of 10,000 rows, Spark's default, can be gigabytes of texts; a smaller bound set by the session
    stays.
    """
    sc = spark.sparkContext
    if sc.getConf().get(_BATCH_SETTING) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="newsloom-")) / "newsloom_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, str(f.relative_to(_PACKAGE.parent)))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session's `spark.checkpoint.dir`; a local one only if unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="newsloom-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. Files are removed when
    the driver process ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared scratch folder, removed when the driver process ends."""
    path = f"{scratch_root(spark)}/newsloom-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def unstaged(*frames: DataFrame) -> None:
    """Remove staged tables that nothing will read any more (call it only once what reads them is staged itself)."""
    for df in frames:
        for item in list(_written):
            if any(item[1] in f for f in df.inputFiles()):
                _written.remove(item)
                remove_path(*item)


def freed(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that are over.

    Spark deletes a shuffle's files once nothing in the driver refers to it, which it learns from the driver's garbage
    collector; a driver with much free memory may not collect for half an hour. To be called where a job of many
    stages has written the tables that it goes on from.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for item in _written:
        try:
            remove_path(*item)
        except Exception:  # the session may be gone by now; the shared folder is then the cluster's to clear
            continue


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
