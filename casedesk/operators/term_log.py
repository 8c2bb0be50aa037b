"""Term statistics that grow by segments instead of being counted anew.

A segment holds the document and corpus frequencies of the documents it added, their number and
their ids. Reading sums the segments, so it is what a count over all documents would give; compaction
writes the sums as one segment and leaves the rest behind. A segment counts once its mark is written,
which is last; one that broke off is written again under the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casedesk.operators import tfidf
from casedesk.sources.files import read_optional

STATS = "term string, df long, cf long, segment long"
IDS = "id long, segment long"
MARKS = "n_docs long, segment long"


class TermLog:
    """Segments of term statistics below one folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, stop_words=()):
        self.spark, self.folder, self.stop_words = spark, folder.rstrip("/"), stop_words

    def _all(self, name: str, schema: str) -> DataFrame:
        kind = self.spark.createDataFrame([], schema).schema
        return read_optional(self.spark, f"{self.folder}/{name}", kind)

    def marks(self) -> DataFrame:
        """Number of documents per whole segment, of those since the last compaction."""
        marks = self._all("marks", MARKS)
        starts = self._all("starts", "segment long").join(marks.select("segment"), "segment", "left_semi")
        start = starts.agg(F.coalesce(F.max("segment"), F.lit(0)))
        return marks.filter(F.col("segment") >= start.scalar())

    def _whole(self, name: str, schema: str) -> DataFrame:
        return self._all(name, schema).join(self.marks().select("segment"), "segment", "left_semi")

    def _next(self) -> int:
        last = self._all("marks", MARKS).agg(F.max("segment")).first()[0]
        return 0 if last is None else last + 1

    def _write(self, df: DataFrame, name: str, segment: int) -> None:
        (df.write.mode("overwrite").option("compression", "zstd")
         .parquet(f"{self.folder}/{name}/segment={segment}"))

    def add(self, docs: DataFrame, text: Column, id_column: str = "customer_tweet_id") -> int:
        """Counts the documents whose id was not counted yet; returns the segment's number."""
        segment = self._next()
        known = self._whole("ids", IDS).select("id")
        new = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text")).join(
            known, "id", "left_anti").dropDuplicates(["id"])
        counted = tfidf.with_term_counts(new, F.col("text"), self.stop_words)
        self._write(tfidf.term_stats(counted), "stats", segment)
        self._write(new.select("id"), "ids", segment)
        written = self.spark.read.schema("id long").parquet(f"{self.folder}/ids/segment={segment}")
        self._write(written.agg(F.count("*").alias("n_docs")), "marks", segment)
        return segment

    def compact(self) -> int:
        """Sums all segments into one, from which on segments count."""
        segment = self._next()
        self._write(self.stats(), "stats", segment)
        self._write(self._whole("ids", IDS).select("id"), "ids", segment)
        total = self.n_docs()
        self._write(self.spark.range(1).select(F.lit(True).alias("compact")), "starts", segment)
        self._write(total, "marks", segment)
        return segment

    def stats(self) -> DataFrame:
        """(term, df, cf) over all segments."""
        return self._whole("stats", STATS).groupBy("term").agg(
            F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def n_docs(self) -> DataFrame:
        """One row: the number of documents."""
        return self.marks().agg(F.coalesce(F.sum("n_docs"), F.lit(0)).cast("long").alias("n_docs"))

    def vocabulary(self, **options) -> DataFrame:
        return tfidf.vocabulary(self.stats(), self.n_docs(), **options)
