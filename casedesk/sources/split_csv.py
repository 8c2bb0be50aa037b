"""CSV files whose quoted fields hold line breaks, read in splits by many tasks.

A split can't tell by itself whether it begins inside a quoted field. So the lines of every split are
read twice. The first time the quotes of each split are counted: whether their number before a split
is odd, a running sum over one row per split, tells how the split begins. The second time each split
puts its lines together into records. What continues a record of an earlier split, and the record
that is still open at a split's end, are set aside as pieces; pieces of one record are joined, at most
two for every split. Records are then read as CSV one by one.

The files must quote as RFC 4180 has it: a field with a separator, quote or line break is quoted
whole, a quote in it is doubled. Records end with a line feed, with or without a carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from casedesk.session import materialize
from casedesk.sources import files

# Splits whose starting states are broadcast: about 100 bytes each, 128 MB of CSV apiece.
MOST_BROADCAST = 200_000

PIECE = "file string, block long, kind int, at long, text string"
WHOLE, OPEN, REST = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines in the order of their split, each with its file, split and number of quotes."""
    line = F.col("value")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))).alias("quotes"),
        line.alias("line"))


def split_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a split begins inside a quoted field."""
    sums = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    # One row per split of a file.
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return sums.select(
        "file", "block",
        (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order, as records that lie in one split and pieces of others.

    Columns: file, block, inside, quotes, line.
    """
    key, held, inside, kind, at = None, [], False, REST, 0
    out: list[tuple] = []

    def close(last: bool) -> None:
        """Ends what is held; at a split's end the record may go on in the next one."""
        nonlocal held, at
        if held:
            open_ = OPEN if kind == WHOLE and last and inside else kind
            out.append((*key, open_, at, "\n".join(held)))
            at += 1
        held = []

    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(5)]
        for file, block, begins, quotes, line in zip(*columns, strict=True):
            if (file, block) != key:
                close(True)
                key, inside, at = (file, block), begins, 0
                kind = REST if inside else WHOLE
            held.append(line)
            inside ^= quotes % 2 == 1
            if not inside:
                close(False)
                kind = WHOLE
        if len(out) > 1_000:
            yield _batch(out)
            out = []
    close(True)
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
        names=["file", "block", "kind", "at", "text"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(text, first): the records of the files as text; ``first`` marks each file's first one."""
    lines = _lines(spark, path)
    states = materialize(split_states(lines), "csv-splits")
    if states.count() <= MOST_BROADCAST:
        placed = lines.join(F.broadcast(states), ["file", "block"])
    else:
        placed = lines.withColumn("at", F.monotonically_increasing_id()).join(
            states, ["file", "block"]).repartition("file", "block").sortWithinPartitions(
            "file", "block", "at")
    pieces = materialize(placed.select("file", "block", "inside", "quotes", "line").mapInArrow(
        _records, PIECE), "csv-pieces")
    first = (F.col("block") == 0) & (F.col("at") == 0)
    whole = pieces.filter(F.col("kind") == WHOLE).select(F.col("text"), first.alias("first"))

    # An open record goes on with the rests of the splits up to the next open one.
    broken = pieces.filter(F.col("kind") != WHOLE)
    order = W.partitionBy("file").orderBy("block", "kind_order")
    chains = broken.select(
        "file", "block", "kind", (F.col("kind") == OPEN).cast("int").alias("kind_order")).withColumn(
        "chain", F.sum("kind_order").over(order)).drop("kind_order")
    piece = F.struct("block", "kind", "text", first.alias("first"))
    joined = broken.join(chains, ["file", "block", "kind"]).groupBy("file", "chain").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"))
    stitched = joined.select(
        F.array_join(F.transform("pieces", lambda p: p["text"]), "\n").alias("text"),
        F.get("pieces", F.lit(0))["first"].alias("first"))
    return whole.unionByName(stitched)


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Like ``files.read_csv_strings``, but a large file is read by many tasks."""
    names = files.read_csv_strings(spark, path).columns
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    text = F.regexp_replace("text", "\r$", "")
    parsed = records(spark, path).filter(~F.col("first") & (text != "")).select(
        F.from_csv(text, schema.simpleString()[7:-1].replace(":", " "),
                   {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1",
                    "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
