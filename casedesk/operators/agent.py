"""The support agent over a whole table: intent, evidence, reply, decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casedesk.functions.escalation import with_escalation
from casedesk.operators import replies, retrieval

TOP_CASES = 3


def answer(
    messages: DataFrame, predictions: DataFrame, index: retrieval.CaseIndex, k: int = TOP_CASES,
) -> DataFrame:
    """Messages with prediction, drafted reply, evidence and escalation decision.

    ``predictions`` holds ``customer_tweet_id, predicted_intent, confidence``.
    """
    found = retrieval.with_case_text(retrieval.similar_cases(messages, index, k), index)
    drafts = replies.draft_replies(messages, retrieval.evidence_lists(found))
    return with_escalation(
        drafts.join(predictions, "customer_tweet_id"), "predicted_intent", "confidence")


def agent_decisions(answered: DataFrame) -> DataFrame:
    return answered.select(
        "customer_tweet_id", F.col("predicted_intent").alias("intent"),
        F.round("confidence", 4).alias("confidence"), F.col("generated_reply").alias("reply"),
        F.col("escalate").alias("escalate_to_human"), "escalation_reason", "evidence")


def reply_evaluation(answered: DataFrame, golden: DataFrame) -> DataFrame:
    """Answered messages with the labels they are compared with."""
    labels = golden.select(
        "customer_tweet_id", F.col("review_status").alias("human_label_status"),
        F.col("intent").alias("expected_intent"), F.col("escalate").alias("expected_escalation"))
    return (
        answered.withColumnRenamed("confidence", "intent_confidence")
        .withColumnRenamed("escalate", "predicted_escalation")
        .join(labels, "customer_tweet_id", "left")
    )


def score_with(messages: DataFrame, scorer, text_column: str = "customer_message") -> DataFrame:
    """Predictions of a scorer of the user's own, fed with Arrow batches.

    ``scorer`` gets a pandas Series of texts and returns (labels, confidences).
    """
    def run(batches):
        for batch in batches:
            labels, scores = scorer(batch[text_column].fillna(""))
            yield batch[["customer_tweet_id"]].assign(
                predicted_intent=list(labels), confidence=list(scores))

    return messages.select("customer_tweet_id", text_column).mapInPandas(
        run, "customer_tweet_id long, predicted_intent string, confidence double")
