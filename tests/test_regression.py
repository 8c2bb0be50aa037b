"""The classifier with its coefficients in tables, as it is fitted when the driver can't hold them."""

import random

import numpy as np
import pytest

from casedesk.functions import lexicons as lex
from casedesk.operators import classifier, regression

SCHEMA = "customer_tweet_id long, previous_context string, customer_message string, intent string"


@pytest.fixture(scope="module")
def train(spark):
    """Four of twelve classes, null ids, texts without a word that is known."""
    r = random.Random(3)
    rows = []
    for i in range(120):
        c = r.choice((0, 1, 1, 4, 6))
        words = [f"{lex.INTENTS[c]}{r.randrange(6)}" if r.random() < 0.4 else f"w{r.randrange(40)}"
                 for _ in range(r.randrange(1, 25))]
        rows.append((i, r.choice((None, "", "hello there")), " ".join(words), lex.INTENTS[c]))
    rows += [(None, None, "w3 w4", lex.INTENTS[0]),
             (None, "x", "w5", lex.INTENTS[1]), (900, None, "", lex.INTENTS[6]), (901, None, "w1", "no intent")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def answers(model, messages):
    rows = model.predict(messages).collect()
    return sorted((r.customer_tweet_id or -1, r.customer_message, r.probabilities) for r in rows)


def test_coefficients_too_many_for_the_driver_are_fitted_in_tables(spark, train, tmp_path, monkeypatch):
    whole = classifier.train_classifier(train, str(tmp_path / "whole"), tol=1e-9)
    want = answers(whole, train)

    def never(*args, **kw):
        raise AssertionError("coefficients on the driver")

    monkeypatch.setattr(classifier, "LogisticRegression", never)
    monkeypatch.setattr(classifier, "DRIVER_COEFFICIENTS", 10)
    model = classifier.train_classifier(train, str(tmp_path / "tables"), tol=1e-5)
    found = answers(model, train)
    assert [row[:2] for row in found] == [row[:2] for row in want]
    assert np.allclose([row[2] for row in found], [row[2] for row in want], atol=2e-4)
    coefficients = whole.regression.coefficientMatrix.toArray()
    rows = model.regression.margins.collect()
    assert sorted(r.position for r in rows) == list(range(coefficients.shape[1]))
    assert np.allclose([r.coefficients for r in sorted(rows)], coefficients.T, atol=2e-3)

    model.save(str(tmp_path / "model"))
    again = classifier.IntentModel.load(spark, str(tmp_path / "model"))
    assert answers(again, train) == found
    assert again.regression.numClasses == 7


def test_all_labelled_rows_are_fitted_to_one_block_of_rows_at_a_time(spark, train, tmp_path, monkeypatch):
    """No row is left out, and no task of a product takes the numbers of all rows at once."""
    def never(*args, **kw):
        raise AssertionError("rows were picked")

    monkeypatch.setattr(classifier, "bounded_rows", never)
    whole = classifier.train_classifier(train, str(tmp_path / "whole"), tol=1e-9)
    want = answers(whole, train)
    monkeypatch.setattr(classifier, "DRIVER_COEFFICIENTS", 10)
    monkeypatch.setattr(regression, "ROWS_PER_BLOCK", 7)
    monkeypatch.setattr(regression, "ENTRIES_AT_ONCE", 10)
    plans, product = [], regression._product

    def watched(*args):
        found = product(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(regression, "_product", watched)
    model = classifier.train_classifier(train, str(tmp_path / "tables"), tol=1e-4)
    found = answers(model, train)
    assert np.allclose([row[2] for row in found], [row[2] for row in want], atol=2e-3)
    assert "CoGroup" not in plans[0] and "SortMergeJoin" in plans[0] and "Bucketed: true" in plans[0]
