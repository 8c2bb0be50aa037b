import pytest
from pyspark.sql import functions as F

from casedesk.functions.lexicons import INTENTS
from casedesk.operators import classifier, evaluation, profile, review
from casedesk.plans.workspace import Workspace


def report(spark, rows, labels=()):
    df = spark.createDataFrame(rows, "y string, p string")
    found = evaluation.classification_report(df, F.col("y"), F.col("p"), labels).collect()
    return {r.label: r for r in found}


def test_report_with_classes_never_true_or_never_predicted(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "a")] + [("c", "a")] + [("a", "d")]
    found = report(spark, rows)
    assert found["a"].precision == 0.6 and found["a"].recall == 0.6 and found["a"].support == 5
    assert (found["c"].precision, found["c"].recall, found["c"].f1_score) == (0, 0, 0)
    assert found["d"].support == 0
    assert found["accuracy"].f1_score == found["weighted avg"].recall == pytest.approx(3 / 7, abs=1e-6)
    assert sum(r.support for n, r in found.items() if n in "abcd") == 7


def test_report_keeps_fixed_labels(spark):
    found = report(spark, [("no", "no")], ("no", "yes"))
    assert found["yes"].support == 0 and found["yes"].f1_score == 0 and found["no"].f1_score == 1


def test_results_invariants(spark, small_dir):
    w = Workspace(spark, small_dir)
    results = evaluation.evaluation_results(w.predicted).persist()
    n = results.count()
    assert evaluation.confusion_matrix(results, F.col("intent"), F.col("predicted_intent")).agg(
        F.sum("n")).first()[0] == n
    coverage = [r.coverage for r in evaluation.confidence_coverage(results).orderBy("threshold").collect()]
    assert coverage == sorted(coverage, reverse=True) and len(coverage) == 6
    share = evaluation.accuracy_comparison(results).first()
    wrong = evaluation.mistakes(results).count()
    assert share.model_accuracy == pytest.approx(1 - wrong / n, abs=1e-6)
    weights = classifier.class_weights(results.select("intent")).collect()
    assert sum(r.n * r.weight for r in weights) == pytest.approx(n, rel=1e-4)
    results.unpersist()


def test_null_label_counts_as_unclear(spark):
    df = spark.createDataFrame([(None,), (" other_unclear ",), ("a",)], "intent string")
    row = evaluation.majority_class(df).first()
    assert (row.majority_class, row.n) == ("other_unclear", 2)


def test_intent_distribution_lists_every_intent(spark):
    df = spark.createDataFrame([("battery_power",)], "intent string")
    found = {r.intent: r.n for r in profile.intent_distribution(df).collect()}
    assert set(found) == set(INTENTS) and sum(found.values()) == 1


def test_reviews(spark):
    proposed = spark.createDataFrame(
        [(i, "battery_power" if i != 4 else "bogus", "", "", "", "REVIEW" if i != 3 else "reviewed")
         for i in range(1, 7)],
        "customer_tweet_id long, auto_intent string, intent string, escalate string, "
        "label_reason string, review_status string")
    decisions = spark.createDataFrame(
        [(1, "y", None, "Y", "  "), (2, "n", 1, "no", "odd"), (3, "y", None, "y", None),
         (4, "Y", None, "n", None), (5, "s", None, "y", None), (6, "n", 13, "y", None)],
        "customer_tweet_id long, action string, intent_number int, escalate string, reason string")
    once = review.apply_reviews(proposed, decisions)
    rows = {r.customer_tweet_id: r for r in once.collect()}
    assert (rows[1].intent, rows[1].escalate, rows[1].label_reason, rows[1].review_status) == (
        "battery_power", "yes", "Human-reviewed as battery_power", "reviewed")
    assert (rows[2].intent, rows[2].escalate, rows[2].label_reason) == ("software_update", "no", "odd")
    assert rows[3].intent == "" and rows[5].review_status == rows[6].review_status == "REVIEW"
    assert rows[4].intent == "other_unclear"
    again = review.apply_reviews(once, decisions)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))
    progress = review.review_progress(once).first()
    assert (progress.n_reviewed, progress.n_total) == (4, 6)
