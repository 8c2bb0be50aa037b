"""Human review as a merge of a decision table into the proposed labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casedesk.functions import lexicons as lex
from casedesk.functions import text as tx
from casedesk.functions.rules import intent_of_number
from casedesk.operators.evaluation import HUMAN, normal_status

ID = "customer_tweet_id"


def apply_reviews(proposed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Accepted and changed labels; skipped, undecided and finished rows stay as they are.

    ``decisions`` holds one row per id: action y, n or s, an intent number for n, the
    escalation and a reason. Applying the same decisions twice changes nothing.
    """
    intent = F.when(F.col("auto_intent").isin(*lex.INTENTS), F.col("auto_intent")).otherwise(
        F.lit(lex.OTHER))
    changed = intent_of_number(F.col("intent_number"))
    final = F.when(F.col("action") == "y", intent).when(F.col("action") == "n", changed)
    escalate = (
        F.when(F.col("decided_escalate").isin("y", "yes"), "yes")
        .when(F.col("decided_escalate").isin("n", "no"), "no"))
    open_row = normal_status(F.col("review_status")) != HUMAN
    decided = F.coalesce(open_row & final.isNotNull() & escalate.isNotNull(), F.lit(False))
    note = tx.strip(F.col("reason"))
    reason = F.when(note != "", note).otherwise(F.concat(F.lit("Human-reviewed as "), final))

    def value(new, old):
        return F.when(F.col("_decided"), new).otherwise(F.col(old))

    given = decisions.select(
        ID, F.lower(tx.strip(F.col("action"))).alias("action"), "intent_number",
        F.lower(tx.strip(F.col("escalate"))).alias("decided_escalate"), "reason")
    joined = proposed.join(given, ID, "left").withColumn("_decided", decided)
    return joined.withColumns({
        "_intent": value(final, "intent"), "_escalate": value(escalate, "escalate"),
        "_label_reason": value(reason, "label_reason"),
        "_review_status": value(F.lit("reviewed"), "review_status"),
    }).select(*[
        F.col(f"_{c}").alias(c) if c in ("intent", "escalate", "label_reason", "review_status")
        else c for c in proposed.columns])


def review_progress(reviewed: DataFrame) -> DataFrame:
    return reviewed.agg(
        F.count_if(normal_status(F.col("review_status")) == HUMAN).alias("n_reviewed"),
        F.count("*").alias("n_total"))
