"""Evaluation of predicted intents, confidence and escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casedesk.functions import lexicons as lex
from casedesk.functions import text as tx
from casedesk.functions.escalation import is_yes, with_escalation
from casedesk.functions.rules import with_baseline_intent

# Confidence levels of the coverage curve.
COVERAGE_LEVELS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)

HUMAN, PROPOSED = "HUMAN_REVIEWED", "PROPOSED"


def normal_status(status: Column) -> Column:
    """Review status in one spelling."""
    plain = F.upper(tx.strip(status))
    return F.when(plain == "REVIEWED", HUMAN).when(plain == "REVIEW", PROPOSED).otherwise(plain)


def true_label(intent: Column) -> Column:
    return tx.strip(F.coalesce(intent, F.lit(lex.OTHER)))


def label_status(golden: DataFrame) -> DataFrame:
    status = normal_status(F.col("review_status"))
    return golden.agg(
        F.count("*").alias("n_total"),
        F.count_if(status == HUMAN).alias("n_human"),
        F.count_if(status == PROPOSED).alias("n_proposed"))


def majority_class(golden: DataFrame) -> DataFrame:
    """Most frequent label, the first by name among equals, with its share."""
    counts = golden.groupBy(true_label(F.col("intent")).alias("majority_class")).agg(
        F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return counts.select(
        "majority_class", "n", F.round(F.col("n") / total, 6).alias("accuracy"),
    ).orderBy(F.desc("n"), "majority_class").limit(1)


def evaluation_results(golden: DataFrame) -> DataFrame:
    """Evaluation rows with keyword, majority and escalation predictions attached.

    ``golden`` carries the labels and the model's ``predicted_intent`` and
    ``prediction_confidence``; a failed prediction counts as unclear with confidence 0.
    """
    filled = golden.withColumns({
        "predicted_intent": F.coalesce("predicted_intent", F.lit(lex.OTHER)),
        "prediction_confidence": F.coalesce("prediction_confidence", F.lit(0.0)),
        "majority_prediction": majority_class(golden).select("majority_class").scalar(),
    })
    return with_baseline_intent(with_both_escalations(filled))


def with_both_escalations(predicted: DataFrame) -> DataFrame:
    """Labelled and predicted escalation, the latter with its reason."""
    actual = predicted.withColumn("actual_escalation", is_yes(F.col("escalate")))
    return with_escalation(
        actual.drop("escalate"), "predicted_intent", "prediction_confidence",
    ).withColumnRenamed("escalate", "predicted_escalation")


def accuracy_comparison(results: DataFrame) -> DataFrame:
    """The three accuracies and the gains of the model, from one count per label."""
    label = true_label(F.col("intent"))
    per_label = results.groupBy(label.alias("label")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("keyword_prediction") == label).alias("keyword_hits"),
        F.count_if(F.col("predicted_intent") == label).alias("model_hits"))
    shares = per_label.agg(
        (F.max("n") / F.sum("n")).alias("majority"),
        (F.sum("keyword_hits") / F.sum("n")).alias("keyword"),
        (F.sum("model_hits") / F.sum("n")).alias("model"))
    return shares.select(
        F.round("majority", 6).alias("majority_accuracy"),
        F.round("keyword", 6).alias("keyword_accuracy"),
        F.round("model", 6).alias("model_accuracy"),
        F.round((F.col("model") - F.col("majority")) * 100, 4).alias("gain_vs_majority"),
        F.round((F.col("model") - F.col("keyword")) * 100, 4).alias("gain_vs_keyword"))


def confusion_matrix(results: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    return results.groupBy(actual.alias("actual"), predicted.alias("predicted")).agg(
        F.count("*").alias("n"))


def classification_report(
    results: DataFrame, actual: Column, predicted: Column, labels=(),
) -> DataFrame:
    """Precision, recall, F1 and support per label, with accuracy and both averages.

    The rows are counted once into the confusion matrix; all else works on its few
    cells. Labels are those of either side, plus ``labels`` even without rows.
    """
    cells = confusion_matrix(results, actual, predicted)
    zero = F.lit(0).cast("long")

    def part(label, hits, support, guessed):
        return F.struct(label.alias("label"), hits.alias("hits"), support.alias("support"),
                        guessed.alias("guessed"))

    parts = cells.select(F.inline(F.array(
        part(F.col("actual"), F.when(F.col("actual") == F.col("predicted"), F.col("n"))
             .otherwise(zero), F.col("n"), zero),
        part(F.col("predicted"), zero, zero, F.col("n")))))
    if labels:
        parts = parts.unionByName(results.sparkSession.createDataFrame(
            [(name, 0, 0, 0) for name in labels],
            "label string, hits long, support long, guessed long"))
    totals = parts.groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("hits", "support", "guessed")])

    def ratio(top, bottom):
        return F.when(bottom == 0, 0.0).otherwise(top / bottom)

    scores = totals.withColumns({
        "precision": ratio(F.col("hits"), F.col("guessed")),
        "recall": ratio(F.col("hits"), F.col("support")),
        "f1_score": ratio(2 * F.col("hits"), F.col("guessed") + F.col("support")),
    })
    support = F.sum("support")

    def weighted(name):
        return ratio(F.sum(F.col(name) * F.col("support")), support)

    names = ("precision", "recall", "f1_score")
    accuracy = ratio(F.sum("hits"), support)
    summary = scores.agg(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), accuracy.alias("f1_score"),
                 support.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.avg(n).alias(n) for n in names],
                 support.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), *[weighted(n).alias(n) for n in names],
                 support.alias("support")),
    ).alias("rows")).select(F.inline("rows"))
    return scores.select("label", *names, "support").unionByName(summary).select(
        "label", *[F.round(n, 6).alias(n) for n in names], "support")


def intent_report(results: DataFrame) -> DataFrame:
    return classification_report(
        results, true_label(F.col("intent")), F.col("predicted_intent"))


def escalation_report(results: DataFrame) -> DataFrame:
    """Report over ``no`` and ``yes``; both rows are always there."""
    def word(flag):
        return F.when(F.col(flag), "yes").otherwise("no")

    return classification_report(
        results, word("actual_escalation"), word("predicted_escalation"), ("no", "yes"))


def mistakes(results: DataFrame) -> DataFrame:
    return results.filter(true_label(F.col("intent")) != F.col("predicted_intent")).select(
        "customer_tweet_id", "customer_message", "previous_context", "intent",
        "predicted_intent", "prediction_confidence")


def confidence_stats(results: DataFrame, column: str = "prediction_confidence") -> DataFrame:
    """Mean, median, least and greatest confidence.

    Six decimals leave at most a million different values, so the exact median needs
    counters of bounded size, however many rows there are.
    """
    rounded = results.select(F.round(F.col(column), 6).alias("c"))
    return rounded.agg(
        F.count("c").alias("n"), F.round(F.avg("c"), 6).alias("mean"),
        F.round(F.percentile("c", F.lit(0.5)), 6).alias("median"),
        F.min("c").alias("min"), F.max("c").alias("max"))


def confidence_coverage(results: DataFrame, column: str = "prediction_confidence") -> DataFrame:
    """Share of rows at or above each confidence level, in one pass."""
    shares = results.agg(*[
        F.avg((F.col(column) >= t).cast("double")).alias(str(i))
        for i, t in enumerate(COVERAGE_LEVELS)])
    rows = [F.struct(F.lit(t).alias("threshold"), F.round(F.col(f"`{i}`"), 6).alias("coverage"))
            for i, t in enumerate(COVERAGE_LEVELS)]
    return shares.select(F.inline(F.array(*rows)))
