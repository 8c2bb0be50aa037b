"""Messages of a stream with what they answer, where both arrive on that stream.

A stream-stream left join brings a message together with the tweet it answers, whichever comes
first and however many micro-batches lie between. Watermarks bound the state: tweets may come
``late_by`` behind the latest one, and a message answers a tweet at most ``reply_within`` older than
itself. A message whose tweet never came leaves the state, without context, once the watermark says
that it can't come any more; ``heartbeat`` rows move the watermark on where a stream has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from casedesk import schemas
from casedesk.streaming.triage import labelled

# Long after any tweet: a row of this time in both inputs ends all waiting.
END_OF_TIME = "9999-01-01 00:00:00"


def heartbeat(spark: SparkSession) -> DataFrame:
    """A row of the tweet table that moves the watermark and is no tweet."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.TWEETS.fields]
    return spark.range(1).select(*empty).withColumn(
        "created_at", F.lit(END_OF_TIME).cast("timestamp")).select(schemas.TWEETS.names)


def tweet_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Tweets of the Parquet files that arrive in a folder, oldest file first."""
    reader = spark.readStream.schema(schemas.TWEETS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def with_context(
    tweets: DataFrame, late_by: str = "1 day", reply_within: str = "30 days",
) -> DataFrame:
    """Inbound messages of the stream with the text of the tweet they answer.

    Messages that answer nothing are joined by their own id, which is no message's answer, so
    they wait for nobody and share no key.
    """
    marked = tweets.withWatermark("created_at", late_by)
    # Conditions that read the event time stay behind the watermark: all rows move it.
    here = F.col("created_at").isNotNull()
    parents = marked.filter(F.when(here, F.col("tweet_id").isNotNull())).select(
        F.col("tweet_id").alias("said_id"), F.col("text").alias("previous_context"),
        F.col("created_at").alias("said_at"))
    messages = marked.filter(
        F.when(here, F.col("inbound") & F.col("text").isNotNull())).select(
        "tweet_id", "in_response_to_tweet_id", "text", "created_at")
    match = F.expr(
        "coalesce(in_response_to_tweet_id, tweet_id) = said_id and said_at <= created_at "
        f"and said_at >= created_at - interval {reply_within}")
    # A message that answers nothing meets itself, and its own text is no context.
    context = F.when(F.col("in_response_to_tweet_id").isNotNull(), F.col("previous_context"))
    return messages.join(parents, match, "left").select(
        F.col("tweet_id").alias("customer_tweet_id"), context.alias("previous_context"),
        F.col("text").alias("customer_message"))


def start_triage(
    tweets: DataFrame, out: str, checkpoint: str, late_by: str = "1 day",
    reply_within: str = "30 days", **trigger,
) -> StreamingQuery:
    """Scores messages into a Parquet table as soon as they and what they answer are there."""
    return (
        labelled(with_context(tweets, late_by, reply_within))
        .writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", out)
        .trigger(**(trigger or {"availableNow": True})).start())
