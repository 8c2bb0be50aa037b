"""Session settings and run folders."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are tuned for; everything else stays with the cluster's defaults.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_FALLBACK: dict[str, str] = {}


def local_session(cores: int = 8, memory: str = "8g", app: str = "casedesk",
                  shared: str | None = None) -> SparkSession:
    """Session for tests and benchmarks on one machine.

    ``shared`` is the folder for stored stages; without it Spark's own defaults decide.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = SETTINGS | ({"spark.checkpoint.dir": shared} if shared else {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """Folder all executors can reach: the argument, else ``spark.checkpoint.dir``.

    A session on one machine without that setting gets a folder of its own, as its tasks
    run where it does. On a cluster the setting is required.
    """
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _FALLBACK:
        _FALLBACK[context.applicationId] = tempfile.mkdtemp(prefix="casedesk-")
    return _FALLBACK[context.applicationId]


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The table written once below the shared folder and read back.

    Steps that read a costly plan several times start from files, which also survive
    the loss of executors.
    """
    path = run_folder(df.sparkSession, name, folder)
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when a write ends, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def briefly(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """As ``materialize``, for the time of a block: what is read later has to be stored inside it."""
    path = run_folder(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove(df.sparkSession, path)


def run_folder(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """Path of a new folder for one table of this run below the shared folder."""
    path = f"{application_folder(spark, folder)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def application_folder(spark: SparkSession, folder: str | None = None) -> str:
    """Folder of this application below the shared folder; it goes when the program ends."""
    root = f"{shared_folder(spark, folder)}/casedesk-{spark.sparkContext.applicationId}"
    if root not in _USED:
        _USED[root] = spark
        atexit.register(_clear, root)
    return root


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Stored stages made inside go at the end, for work that repeats without end."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.remove(made)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this run with all it holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_USED: dict[str, SparkSession] = {}
_SCRATCH: list[list[str]] = []


def _clear(root: str) -> None:
    """At the end of the program the stored stages of its session go."""
    spark = _USED.pop(root)
    if spark.sparkContext._jsc is not None:
        remove(spark, root)
