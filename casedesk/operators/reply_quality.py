"""Automatic measures of drafted replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casedesk.functions import lexicons as lex
from casedesk.functions import text as tx
from casedesk.functions.rules import flags
from casedesk.functions.staging import staged
from casedesk.operators.text_similarity import pair_cosine

# Weights of the grounding score.
ACTION_WEIGHTS = {
    "reply_has_dm_request": 0.25, "reply_asks_device": 0.15, "reply_asks_os": 0.15,
    "reply_contains_troubleshooting": 0.20,
}
ACTION_TOTAL = 0.75
SIMILARITY_SHARE, ACTION_SHARE = 0.65, 0.35

FLAG_COLUMNS = [name for name, _ in lex.REPLY_PATTERNS]
QUALITY_COLUMNS = [
    "grounding_score", "historical_reply_similarity", *FLAG_COLUMNS, "reply_length_score"]
JUDGE_QUEUE_COLUMNS = [
    "customer_tweet_id", "customer_message", "previous_context", "expected_intent",
    "predicted_intent", "generated_reply", "human_label_status", "retrieved_case_count",
    "grounding_score", "historical_reply_similarity"]


def length_score(words: Column) -> Column:
    return (
        F.when(words == 0, 0.0).when(words.between(8, 80), 1.0)
        .when(words.between(5, 120), 0.75).otherwise(0.5))


def with_reply_flags(replies: DataFrame, column: str = "generated_reply") -> DataFrame:
    """Adds five yes/no properties and the length score of a reply."""
    return (
        staged(replies, _reply=F.lower(tx.strip(F.col(column))))
        .select("*", *flags(F.col("_reply"), lex.REPLY_PATTERNS),
                length_score(tx.word_count(F.col("_reply"))).alias("reply_length_score"))
        .drop("_reply")
    )


def reply_similarity(drafts: DataFrame) -> DataFrame:
    """Per drafted reply and case: cosine with the historical reply."""
    pairs = drafts.select(
        "customer_tweet_id", "generated_reply", F.explode("evidence").alias("case"))
    flat = pairs.select(
        "customer_tweet_id", "generated_reply",
        F.col("case.customer_tweet_id").alias("case_id"), F.col("case.brand_reply").alias("brand_reply"))
    return pair_cosine(flat, ["customer_tweet_id", "case_id"], "generated_reply", "brand_reply")


def grounding_score(similarity: Column) -> Column:
    action = sum(
        (F.when(F.col(name), weight).otherwise(0.0) for name, weight in ACTION_WEIGHTS.items()),
        F.lit(0.0))
    score = SIMILARITY_SHARE * similarity + ACTION_SHARE * F.least(
        action / ACTION_TOTAL, F.lit(1.0))
    return F.round(F.least(score, F.lit(1.0)), 4)


def grounding_scores(drafts: DataFrame) -> DataFrame:
    """Drafts with flags, best similarity to a historical reply, and grounding score."""
    best = reply_similarity(drafts).groupBy("customer_tweet_id").agg(
        F.max("similarity").alias("best"))
    supported = F.exists("evidence", lambda e: F.coalesce(e["brand_reply"], F.lit("")) != "")
    grounded = F.coalesce(supported, F.lit(False)) & (tx.strip(F.col("generated_reply")) != "")
    return (
        with_reply_flags(drafts).join(best, "customer_tweet_id", "left")
        .withColumn("historical_reply_similarity", F.coalesce("best", F.lit(0.0)))
        .withColumn("grounding_score", F.when(
            grounded, grounding_score(F.col("historical_reply_similarity"))).otherwise(0.0))
        .drop("best")
    )


def judge_queue(scored: DataFrame) -> DataFrame:
    return scored.select(*JUDGE_QUEUE_COLUMNS)


def _means(condition: Column | None = None) -> list[Column]:
    def value(name):
        number = F.col(name).cast("double")
        return number if condition is None else F.when(condition, number)

    count = F.count("*") if condition is None else F.count_if(condition)
    return [count.alias("n"), *[F.round(F.avg(value(c)), 6).alias(c) for c in QUALITY_COLUMNS]]


def quality_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(*_means())


def quality_by_status(scored: DataFrame) -> DataFrame:
    return scored.groupBy("human_label_status").agg(*_means())
