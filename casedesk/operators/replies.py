"""Template replies drawn from the replies of similar cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casedesk.functions import lexicons as lex
from casedesk.functions.rules import flags
from casedesk.functions.staging import staged


def reply_patterns(evidence: DataFrame) -> DataFrame:
    """Support habits seen in the replies of the cases, read as one joined text."""
    joined = F.lower(F.concat_ws(" ", F.filter(
        F.transform("evidence", lambda e: e["brand_reply"]), lambda r: r != "")))
    return (
        staged(evidence, _replies=joined)
        .select("*", *flags(F.col("_replies"), lex.EVIDENCE_PATTERNS)).drop("_replies")
    )


def draft_replies(messages: DataFrame, evidence: DataFrame) -> DataFrame:
    """Messages with ``generated_reply``, their evidence and its size."""
    device, system = F.col("asks_for_device"), F.col("asks_for_os")
    question = (
        F.when(device & system, lex.REPLY_ASK_BOTH)
        .when(device, lex.REPLY_ASK_DEVICE).when(system, lex.REPLY_ASK_OS))
    closing = (
        F.when(F.col("asks_for_dm"), lex.REPLY_DM)
        .when(F.col("provides_steps"), lex.REPLY_STEPS).otherwise(lex.REPLY_GENERIC))
    reply = F.when(F.col("evidence").isNull(), lex.REPLY_NO_EVIDENCE).otherwise(
        F.concat_ws(" ", F.lit(lex.REPLY_GREETING), question, closing))
    return (
        messages.join(reply_patterns(evidence), "customer_tweet_id", "left")
        .withColumn("generated_reply", reply)
        .withColumn("retrieved_case_count", F.coalesce(F.array_size("evidence"), F.lit(0)))
        .drop(*[name for name, _ in lex.EVIDENCE_PATTERNS])
    )
