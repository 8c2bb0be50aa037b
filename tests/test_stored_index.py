"""Stored index and models: versions, loading, joins without a shuffle of the index."""

import pytest
from pyspark.sql import functions as F

from casedesk.operators import classifier, retrieval
from casedesk.plans.workspace import Workspace
from casedesk.sources import versions


@pytest.fixture(scope="module")
def workspace(spark, small_dir):
    return Workspace(spark, small_dir)


@pytest.fixture(scope="module")
def saved(spark, workspace, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    retrieval.save_index(workspace.stored_pairs, path, exclude=workspace.stored_golden)
    return path


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_loaded_index_answers_like_the_built_one(spark, workspace, saved):
    built = retrieval.build_index(workspace.stored_pairs, exclude=workspace.stored_golden)
    want = rows(retrieval.similar_cases(workspace.inquiries, built))
    assert rows(retrieval.similar_cases(workspace.inquiries, retrieval.load_index(spark, saved))) == want
    assert rows(retrieval.index_postings(built).selectExpr("case_id", "term", "round(weight, 9)")) == rows(
        retrieval.index_postings(retrieval.load_index(spark, saved))
        .selectExpr("case_id", "term", "round(weight, 9)"))
    # As another session finds it: files without entries in the catalogue of tables.
    for name in ("vectors", "postings"):
        spark.sql(f"drop table {versions._table_name(f'{saved}/{name}')}")
    assert rows(retrieval.similar_cases(workspace.inquiries, retrieval.load_index(spark, saved))) == want


def exchanges(df):
    """Numbers of exchanges above each scan of a bucketed table, and of all exchanges."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Bucketed: true"), plan.count("Exchange hashpartitioning(term")


def test_joins_on_terms_do_not_shuffle_the_index(spark, workspace, saved, monkeypatch):
    index = retrieval.load_index(spark, saved)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = retrieval.with_search_text(workspace.inquiries)
        texts = retrieval._distinct_texts(asked, "customer_tweet_id").withColumnRenamed("rep_id", "query_rep")
        terms = retrieval.materialize(
            retrieval._query_terms(texts, index, retrieval.tx.STOP_WORDS), "terms")
        joined = retrieval._partial_scores(terms, retrieval._case_postings(index))
        assert exchanges(joined) == (1, 1)
        without = retrieval.build_index(workspace.stored_pairs, store=True)
        assert exchanges(retrieval._partial_scores(terms, retrieval._case_postings(without)))[1] > 1
        plan = joined.join(index.vectors, "rep_id")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") == 2 and plan.count("Exchange hashpartitioning(rep_id") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_frequent_terms_lie_in_several_buckets(spark, workspace, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "POSTINGS_PER_PART", 5)
    retrieval.save_index(workspace.stored_pairs, str(tmp_path / "parts"))
    index = retrieval.load_index(spark, str(tmp_path / "parts"))
    parts = index.postings.groupBy("term").agg(F.countDistinct("part").alias("n"), F.count("*").alias("rows"))
    assert parts.agg(F.max("n")).first()[0] > 1
    assert parts.where("rows > 5 and n = 1").count() == 0
    plain = retrieval.build_index(workspace.stored_pairs)
    assert rows(retrieval.similar_cases(workspace.inquiries, index)) == rows(
        retrieval.similar_cases(workspace.inquiries, plain))


def test_versions_are_made_once_and_only_whole_ones_count(spark, tmp_path):
    source = tmp_path / "source.parquet"
    spark.range(5).write.parquet(str(source))
    book = versions.Versions(spark, str(tmp_path / "store"))
    made = []

    def make(path):
        made.append(path)
        if len(made) == 1:
            raise OSError("broken off")
        spark.range(len(made)).write.parquet(path)

    key = versions.fingerprint(spark, [str(source)], 1)
    with pytest.raises(OSError):
        book.stored("numbers", key, make)
    assert book.find("numbers", key) is None
    path = book.stored("numbers", key, make)
    assert book.stored("numbers", key, make) == path == made[1] and len(made) == 2
    assert versions.fingerprint(spark, [str(source)], 2) != key
    spark.range(5).write.mode("append").parquet(str(source))
    changed = versions.fingerprint(spark, [str(source)], 1)
    assert changed != key
    assert book.stored("numbers", changed, make) == made[2]
    assert book.catalogue().count() == 2


def test_a_workspace_loads_what_another_one_stored(spark, small_dir, tmp_path, monkeypatch):
    first = Workspace(spark, small_dir, str(tmp_path / "store"))
    want = rows(first.similar)
    labels = rows(first.model.predict(first.stored_open).select("customer_tweet_id", "predicted_intent"))

    def never(*args, **kw):
        raise AssertionError("built again")

    monkeypatch.setattr(retrieval, "build_index", never)
    monkeypatch.setattr(classifier, "train_classifier", never)
    second = Workspace(spark, small_dir, str(tmp_path / "store"))
    assert rows(second.similar) == want
    assert labels == rows(second.model.predict(second.stored_open).select(
        "customer_tweet_id", "predicted_intent"))
