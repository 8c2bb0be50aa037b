from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from casedesk.functions import lexicons as lex
from casedesk.operators import agent, classifier, replies, tfidf
from casedesk.plans.workspace import Workspace
from casedesk.session import run_folder
from casedesk.streaming import triage


@pytest.fixture(scope="module")
def workspace(spark, small_dir):
    return Workspace(spark, small_dir)


def evidence(spark, lists):
    return spark.createDataFrame(
        [(i, [(n, t) for n, t in enumerate(texts)]) for i, texts in enumerate(lists)],
        "customer_tweet_id long, evidence array<struct<rank:int,brand_reply:string>>")


def test_reply_templates(spark):
    found = evidence(spark, [
        ["Please DM us your iOS version and which device you use."], ["Which model is it?"],
        ["What is your OS version?"], ["try this article"], ["We look."]])
    messages = spark.createDataFrame([(i,) for i in range(6)], "customer_tweet_id long")
    rows = {r.customer_tweet_id: r for r in replies.draft_replies(messages, found).collect()}
    hello = lex.REPLY_GREETING
    assert [rows[i].generated_reply for i in range(6)] == [
        f"{hello} {lex.REPLY_ASK_BOTH} {lex.REPLY_DM}",
        f"{hello} {lex.REPLY_ASK_DEVICE} {lex.REPLY_GENERIC}",
        f"{hello} {lex.REPLY_ASK_OS} {lex.REPLY_GENERIC}",
        f"{hello} {lex.REPLY_STEPS}", f"{hello} {lex.REPLY_GENERIC}", lex.REPLY_NO_EVIDENCE]
    assert [rows[i].retrieved_case_count for i in range(6)] == [1] * 5 + [0]


def test_model_learns_saves_and_loads(spark, workspace, tmp_path):
    train = classifier.silver_train(workspace.stored_pairs)
    model = classifier.train_classifier(train, str(tmp_path / "vocabulary"))
    found = model.predict(train).persist()
    assert found.filter("abs(aggregate(probabilities, 0D, (a, x) -> a + x) - 1) > 1e-6").count() == 0
    hits = found.filter("intent = predicted_intent").count() / found.count()
    assert hits > 0.8
    model.save(str(tmp_path / "model"))
    again = classifier.IntentModel.load(spark, str(tmp_path / "model")).predict(train)
    key = lambda r: (r.customer_tweet_id, r.predicted_intent, round(r.prediction_confidence, 9))
    assert sorted(map(key, again.collect())) == sorted(map(key, found.collect()))
    found.unpersist()


def test_training_without_rows_says_so(spark, workspace, tmp_path):
    with pytest.raises(ValueError):
        classifier.train_classifier(
            classifier.silver_train(workspace.stored_pairs).filter("false"), str(tmp_path / "v"))


def test_own_scorer(spark, workspace):
    scorer = lambda texts: (["battery_power"] * len(texts), texts.str.len() * 0.0 + 0.5)
    rows = agent.score_with(workspace.stored_open, scorer).collect()
    assert len(rows) == workspace.stored_open.count()
    assert {(r.predicted_intent, r.confidence) for r in rows} == {("battery_power", 0.5)}


def test_golden_rows_stay_out_of_the_index(workspace):
    golden = workspace.stored_golden
    assert golden.count() > 0
    assert workspace.index.cases.join(
        golden, workspace.index.cases["case_id"] == golden["customer_tweet_id"]).count() == 0


def test_agent_answers_every_evaluation_message(workspace):
    rows = workspace.answered.collect()
    assert len(rows) == workspace.stored_golden.count()
    assert all(r.generated_reply and r.escalation_reason for r in rows)
    scores = workspace.scored.select("grounding_score").collect()
    assert all(0 <= r[0] <= 1 for r in scores)


def test_stream_equals_batch_and_restart_adds_nothing(spark, workspace, small_dir, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        triage.start_triage(
            triage.conversation_stream(spark, small_dir), workspace.tweets, out, state).awaitTermination()
    streamed = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert streamed == sorted(map(tuple, triage.triage(workspace.tweets, workspace.tweets).collect()))


def test_stream_replies_equal_batch(spark, workspace, tmp_path):
    messages = tmp_path / "messages"
    workspace.stored_golden.write.parquet(str(messages))
    stream = spark.readStream.schema(workspace.stored_golden.schema).parquet(str(messages))
    index = workspace.index
    columns = ["customer_tweet_id", "intent", "confidence", "reply", "escalate_to_human"]
    batch = agent.agent_decisions(workspace.answered).select(columns).collect()
    root = tmp_path_of(spark)
    before = set(root.iterdir())
    triage.start_replies(stream, index, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert set(root.iterdir()) == before
    streamed = spark.read.parquet(str(tmp_path / "out")).select(columns).collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch))


def tmp_path_of(spark):
    return Path(run_folder(spark, "x")).parent


def test_scoring_by_join_equals_spark_ml_at_the_optimum(spark, workspace, tmp_path):
    train = classifier.silver_train(workspace.stored_pairs)
    model = classifier.train_classifier(train, str(tmp_path / "vocabulary"), tol=1e-9)
    labelled = classifier.known_labels(train)
    vectors = tfidf.unit_vectors(
        classifier.counted_terms(labelled), model.vocab, classifier.ID, sublinear=True, key="position")
    weights = {r.intent: r.weight for r in classifier.class_weights(labelled).collect()}
    rows = labelled.join(vectors, classifier.ID, "left").select(
        classifier.ID, "intent", "vector").collect()
    found = {r.customer_tweet_id: r.probabilities for r in model.predict(labelled).collect()}
    coefficients, shift = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    n_classes, n = len(shift), len(rows)
    slope = coefficients / n
    total = sum(weights[r.intent] for r in rows)
    for r in rows:
        x = np.zeros(coefficients.shape[1])
        for entry in r.vector or []:
            x[entry.position] = entry.weight
        margins = coefficients @ x + shift
        p = np.exp(margins - margins.max())
        p /= p.sum()
        assert np.allclose(p, found[r.customer_tweet_id], atol=1e-9)
        target = np.eye(n_classes)[lex.INTENTS.index(r.intent)]
        slope = slope + weights[r.intent] * np.outer(p - target, x) / total
    assert abs(slope).max() < 1e-4


def test_rows_of_the_fit_are_bounded(workspace):
    train = classifier.known_labels(classifier.silver_train(workspace.stored_pairs))
    few = classifier.bounded_rows(train, 7).collect()
    assert len(few) == 7 and few == classifier.bounded_rows(train, 7).collect()
    assert classifier.bounded_rows(train, 10_000).count() == train.count()


def test_judging_resumes(spark, workspace, tmp_path):
    golden, out = workspace.stored_open.select("customer_tweet_id"), str(tmp_path / "judged")
    half = lambda todo: todo.select("customer_tweet_id", F.when(
        F.col("customer_tweet_id") % 8 == 0, F.lit('{"overall": 4}')).otherwise("broken").alias("raw"))
    whole = lambda todo: todo.select("customer_tweet_id", F.lit('{"overall": 5}').alias("raw"))
    n = golden.count()
    assert triage.judge_pending_rows(spark, golden, out, half) == n
    ok = spark.read.parquet(out).filter("parse_ok").count()
    assert triage.judge_pending_rows(spark, golden, out, whole) == n - ok
    assert triage.judge_pending_rows(spark, golden, out, whole) == 0
