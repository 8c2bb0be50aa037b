"""Judge responses and review decisions derived from the messages.

The given tables hold neither, so both are made from the length of each message:
readable and broken responses, accepted, changed and skipped labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casedesk.schemas import JUDGE_SCORES

JUDGED_FIELDS = JUDGE_SCORES


def judge_responses(messages: DataFrame) -> DataFrame:
    """Two batches of raw responses per message: clean, fenced, in prose, or cut off."""
    n, batch = F.col("n"), F.col("batch")
    def score(i):
        """A whole number, one with a decimal, a quoted one, or a half."""
        value, form = (1 + (n + i + batch) % 5).cast("string"), (n + i) % 4
        return (F.when(form == 0, value).when(form == 1, F.concat(value, F.lit(".0")))
                .when(form == 2, F.concat(F.lit('"'), value, F.lit('"')))
                .otherwise(F.concat(value, F.lit(".5"))))

    scores = F.concat_ws(", ", *[
        F.concat(F.lit(f'"{name}": '), score(i)) for i, name in enumerate(JUDGED_FIELDS)])
    body = F.concat(
        F.lit("{"), scores, F.lit(', "unsupported_claims": '),
        F.when(n % 3 == 0, "true").otherwise("false"),
        F.lit(', "major_issue": "", "reasoning": "message of '), n.cast("string"),
        F.lit(' characters"}'))
    raw = (
        F.when((n + batch) % 4 == 0, F.col("body"))
        .when((n + batch) % 4 == 1, F.concat(F.lit("```json\n"), F.col("body"), F.lit("\n```")))
        .when((n + batch) % 4 == 2, F.concat(
            F.lit("My verdict is "), F.col("body"), F.lit(" and that is all.")))
        .otherwise(F.left("body", F.lit(40))))
    return (
        messages.select(
            "customer_tweet_id", F.length("customer_message").alias("n"),
            F.explode(F.array(F.lit(0), F.lit(1))).alias("batch"))
        .withColumn("body", body).select("customer_tweet_id", "batch", raw.alias("raw"))
    )


def review_decisions(messages: DataFrame) -> DataFrame:
    n = F.length("customer_message")
    return messages.select(
        "customer_tweet_id",
        F.when(n % 3 == 0, "y").when(n % 3 == 1, "N").otherwise("s").alias("action"),
        (1 + n % 12).alias("intent_number"),
        F.when(n % 2 == 0, "yes").otherwise("n").alias("escalate"),
        F.when(n % 5 == 0, "checked by hand").alias("reason"))
