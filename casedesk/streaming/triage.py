"""Streams of customer messages: triage, replies, incremental judging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from casedesk import schemas
from casedesk.functions.escalation import with_escalation
from casedesk.functions.rules import with_silver_prediction
from casedesk.operators import agent, judging, retrieval
from casedesk.session import scratch
from casedesk.sources.files import read_optional
from casedesk.sources.tables import tweets_from_conversations


def triage(tweets: DataFrame, said_before: DataFrame) -> DataFrame:
    """Rule intent and escalation of inbound tweets, for batch and stream alike.

    ``said_before`` is a table of tweets that holds what the messages answer; a stream is
    joined with it as it stands when a micro-batch starts.
    """
    context = said_before.select(
        F.col("tweet_id").alias("_context_id"), F.col("text").alias("previous_context"))
    # Messages that answer nothing are spread by their own id and kept unmatched.
    answers = F.col("in_response_to_tweet_id")
    match = (F.coalesce(answers, "tweet_id") == F.col("_context_id")) & answers.isNotNull()
    messages = tweets.filter("inbound and text is not null").join(context, match, "left").select(
        F.col("tweet_id").alias("customer_tweet_id"), "previous_context",
        F.col("text").alias("customer_message"))
    return labelled(messages)


def labelled(messages: DataFrame) -> DataFrame:
    """Rule intent and escalation of messages with their context."""
    return with_escalation(with_silver_prediction(messages, "intent", "confidence")).select(
        "customer_tweet_id", "intent", F.round("confidence", 6).alias("confidence"),
        "escalate", "escalation_rule")


def conversation_stream(spark: SparkSession, folder: str, pattern: str = "conversations.parquet") -> DataFrame:
    """Tweets of the conversation files that arrive in a folder; a match may be a folder of part files.

    A stream takes no path of a single file, but what a pattern finds; braces make one of any name.
    """
    files = spark.readStream.schema(schemas.CONVERSATIONS).parquet(f"{folder}/{{{pattern}}}")
    return tweets_from_conversations(files)


def start_triage(
    tweets: DataFrame, said_before: DataFrame, out: str, checkpoint: str,
) -> StreamingQuery:
    """Scores all tweets at hand into a Parquet table, then stops; a restart goes on."""
    return (
        triage(tweets, said_before).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", out)
        .trigger(availableNow=True).start()
    )


def rule_predictions(messages: DataFrame) -> DataFrame:
    return with_silver_prediction(messages, "predicted_intent", "confidence").select(
        "customer_tweet_id", "predicted_intent", "confidence")


def start_replies(
    messages: DataFrame, index: retrieval.CaseIndex, out: str, checkpoint: str, k: int = 3,
    predict: Callable[[DataFrame], DataFrame] = rule_predictions,
) -> StreamingQuery:
    """Intent, reply and escalation for every streamed message against a fixed index.

    Each micro-batch is written to its own folder in overwrite mode, so a batch that is
    run again after a failure leaves no doubles, and its stored stages go with it.
    """
    spark = messages.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            answered = agent.answer(batch, predict(batch), index, k)
            agent.agent_decisions(answered).drop("evidence").write.mode("overwrite").parquet(
                f"{out}/batch={batch_id}")

    return (
        messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def judge_pending_rows(
    spark: SparkSession, golden: DataFrame, out: str, judge: Callable[[DataFrame], DataFrame],
) -> int:
    """Judges rows that have no verdict yet and appends the verdicts; returns their number.

    ``judge`` turns pending rows into (customer_tweet_id, raw) responses. Verdicts carry the
    number of their run, so the last one of an id is known.
    """
    schema = schemas.all_strings([]).add("customer_tweet_id", "long").add("parse_ok", "boolean")
    for field in schemas.JUDGE_VERDICT.fields:
        schema = schema.add(field)
    done = read_optional(spark, out, schema.add("run", "long"))
    run = (done.agg(F.max("run")).first()[0] or 0) + 1
    todo = judging.pending(golden, done.filter("parse_ok"))
    written = Observation()
    (judging.parse_verdicts(judge(todo)).withColumn("run", F.lit(run).cast("long"))
     .observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(out))
    return written.get["n"]
