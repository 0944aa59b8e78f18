"""Folders for intermediate files: under the one that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests) is a local folder made; it goes with the process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="rangeloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def own_folder(spark: SparkSession) -> str:
    """Where this application's intermediate files stand."""
    return f"{shared_root(spark)}/rangeloom/{spark.sparkContext.applicationId}"


def path(spark: SparkSession, name: str) -> str:
    """A path there that nothing has used yet."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes an execution's shuffle files as soon as it ends.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed(spark: SparkSession):
    """What is written inside leaves no shuffle files: they would stay until the driver collects its garbage."""
    old = spark.conf.get(FREES, None)
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREES) if old is None else spark.conf.set(FREES, old)


def kept(df: DataFrame, name: str = "frame") -> DataFrame:
    """``df`` computed once, into Parquet in the shared folder, and read from there: for what a plan reads several times.

    Each of those readings would otherwise compute it anew, and plans stacked on plans would double with every step.
    """
    place = path(df.sparkSession, name)
    with freed(df.sparkSession):
        df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def forget(spark: SparkSession) -> bool:
    """Remove the intermediate files of this application, when no result that reads them is needed any more.

    (Checkpoints go by themselves under ``spark.cleaner.referenceTracking.cleanCheckpoints``.)
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
