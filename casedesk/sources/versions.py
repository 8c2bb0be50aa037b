"""Stored tables, indexes and models with a catalogue of their versions.

A version is named by what it was made of: the fingerprint of its sources and its parameters. It
is written to a folder of its own and entered in the catalogue when it is whole, so a reader finds
either all of it or nothing, and one that broke off is made again elsewhere.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from casedesk.session import remove, tidy
from casedesk.sources.files import read_optional

CATALOGUE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("published_at", T.TimestampType())])


def fingerprint(spark: SparkSession, paths: list[str], *parameters) -> str:
    """Stands for the files below some paths as they are now, and for parameters.

    Bytes, number of files and time of the last change are asked of the store, one request a
    path; no file is read.
    """
    parts = [repr(p) for p in parameters]
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        size, status = store.getContentSummary(path), store.getFileStatus(path)
        parts += [store.makeQualified(path).toString(), str(size.getLength()),
                  str(size.getFileCount()), str(status.getModificationTime())]
    return hashlib.md5("\n".join(parts).encode()).hexdigest()


class Versions:
    """Versions below one folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def catalogue(self) -> DataFrame:
        return read_optional(self.spark, f"{self.root}/catalogue", CATALOGUE)

    def find(self, name: str, made_of: str) -> str | None:
        """Folder of the latest whole version, if there is one."""
        found = (self.catalogue().filter((F.col("name") == name) & (F.col("fingerprint") == made_of))
                 .orderBy(F.desc("published_at"), "path").select("path").first())
        return found.path if found else None

    def stored(self, name: str, made_of: str, make: Callable[[str], None]) -> str:
        """Folder of the version, made and entered first if there is none."""
        key = (self.root, name, made_of)
        path = _KNOWN.get(key) or self.find(name, made_of)
        if path is None:
            path = f"{self.root}/{name}/{made_of}-{uuid.uuid4().hex[:8]}"
            make(path)
            (self.spark.range(1).select(
                F.lit(name).alias("name"), F.lit(made_of).alias("fingerprint"),
                F.lit(path).alias("path"), F.current_timestamp().alias("published_at"))
             .write.mode("append").parquet(f"{self.root}/catalogue"))
        _KNOWN[key] = path
        return path


# Versions that this program has looked up: they never change, so the catalogue is read once for each.
_KNOWN: dict[tuple[str, str, str], str] = {}


def write_bucketed(df: DataFrame, path: str, buckets: int, *keys: str) -> DataFrame:
    """The table in files by hash of the keys, sorted by them; joins on them need no shuffle of it."""
    with tidy(df.sparkSession):
        (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
         .option("path", path).option("compression", "zstd").mode("overwrite").format("parquet")
         .saveAsTable(_table_name(path)))
    return df.sparkSession.table(_table_name(path))


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType, buckets: int,
                  *keys: str) -> DataFrame:
    """A bucketed table of this or an earlier session; its files are entered, not moved."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        by = ", ".join(keys)
        spark.sql(f"create table {name} ({columns}) using parquet "
                  f"clustered by ({by}) sorted by ({by}) into {buckets} buckets "
                  f"location '{path}'")
    return spark.table(name)


def remove_bucketed(spark: SparkSession, path: str) -> None:
    """Deletes a bucketed table of this run: its files and its entry."""
    spark.sql(f"drop table if exists {_table_name(path)}")
    remove(spark, path)


def _table_name(path: str) -> str:
    return f"casedesk_{hashlib.md5(path.encode()).hexdigest()}"
