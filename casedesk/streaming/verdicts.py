"""Judging as checkpointed streams: messages in, verdicts kept, one current verdict per message.

Both streams write one segment per micro-batch, in overwrite mode under the batch's number, so a
batch that is run again after a failure replaces what it wrote and adds nothing. The table of
verdicts is what the segments hold, of each message the entry of the latest run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from casedesk import schemas
from casedesk.operators import judging
from casedesk.session import scratch
from casedesk.sources.files import read_optional

ID = judging.ID


def _schema(run: str, kind: T.DataType) -> T.StructType:
    schema = T.StructType([
        T.StructField(ID, T.LongType()),
        T.StructField(run, kind),
        T.StructField("parse_ok", T.BooleanType())])
    for field in schemas.JUDGE_VERDICT.fields:
        schema = schema.add(field)
    return schema


def segments(spark: SparkSession, out: str, run: str = "run", kind: T.DataType = T.LongType()) -> DataFrame:
    """All entries that the micro-batches wrote, with the number of their segment."""
    return read_optional(spark, out, _schema(run, kind).add("segment", "long"))


def current(spark: SparkSession, out: str, run: str = "run", kind: T.DataType = T.LongType()) -> DataFrame:
    """The verdict of the latest run of each message, however often and late entries came.

    Entries of one id and run differ only if a judge answered twice; the later segment counts.
    """
    entries = segments(spark, out, run, kind)
    rest = [c for c in entries.columns if c not in (ID, "segment")]
    last = F.max_by(F.struct(*rest), F.struct(run, "segment"))
    return entries.groupBy(ID).agg(last.alias("entry")).select(ID, "entry.*")


def _write(df: DataFrame, out: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/segment={batch_id}")


def start_verdicts(
    responses: DataFrame, out: str, checkpoint: str, run: str = "run", **trigger,
) -> StreamingQuery:
    """Reads streamed responses (customer_tweet_id, run, raw) into the table of verdicts.

    State keyed by message holds its latest verdict so far. A repeated response leaves the state as
    it is, a late one of an earlier run too, whenever it comes: no watermark drops it. Only
    messages whose responses a micro-batch brought are written by it.
    """
    # Of several responses of one run the choice must not depend on their order.
    marked = responses.withColumn("_mark", F.md5(F.coalesce("raw", F.lit(""))))
    verdicts = judging.parse_verdicts(marked)
    rest = [c for c in verdicts.columns if c not in (ID, "_mark")]
    latest = verdicts.groupBy(ID).agg(
        F.max_by(F.struct(*rest), F.struct(run, "_mark")).alias("entry")).select(ID, "entry.*")
    kind = responses.schema[run].dataType

    def write(batch: DataFrame, batch_id: int) -> None:
        _write(batch.select(_schema(run, kind).names), out, batch_id)

    return (
        latest.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def start_judging(
    messages: DataFrame, judge: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    run: int = 1, **trigger,
) -> StreamingQuery:
    """Has streamed messages judged and keeps every verdict as soon as its micro-batch is done.

    ``judge`` turns messages into (customer_tweet_id, raw). A message with a readable verdict in
    an earlier segment is not judged again, nor is one that a micro-batch holds twice. A batch that
    is run again judges anew what it wrote itself, as that may not be whole.
    """
    spark = messages.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            done = segments(spark, out).filter(
                (F.col("segment") != batch_id) & F.col("parse_ok"))
            todo = judging.pending(batch.dropDuplicates([ID]), done)
            verdicts = judging.parse_verdicts(judge(todo)).withColumn(
                "run", F.lit(run).cast("long"))
            _write(verdicts.select(_schema("run", T.LongType()).names), out, batch_id)

    return (
        messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def compact(spark: SparkSession, out: str, into: str, run: str = "run", kind: T.DataType = T.LongType()) -> None:
    """Writes the current verdicts as one segment of a new table, for a stream started anew."""
    _write(current(spark, out, run, kind), into, -1)
