"""Rules from tables against chains of ``contains``; samples by counted hashes; cubes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casedesk.functions import lexicons as lex, rules
from casedesk.operators import classifier, profile, rule_tables, sampling
from casedesk.plans.workspace import Workspace


@pytest.fixture(scope="module")
def workspace(spark, small_dir):
    return Workspace(spark, small_dir)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


LEXICONS = {"silver": lex.SILVER_RULES, "proposal": lex.PROPOSAL_RULES,
            "baseline": lex.BASELINE_RULES}


def test_tables_equal_chains_on_all_lexicons(spark):
    r = random.Random(6)
    terms = sorted({t for lexicon in (*LEXICONS.values(), lex.THEMES) for _, ts in lexicon for t in ts})
    texts = [(i, " ".join(r.choice((r.choice(terms), "xx", "é😀", r.choice(terms)[:4], ""))
                          for _ in range(r.randrange(0, 6)))) for i in range(400)]
    texts += [(900, None), (901, ""), (902, "a"), (903, "battery " * 20_000)]
    texts += [(1_000 + i, "my battery drains, refund please") for i in range(200)]
    df = spark.createDataFrame(texts, "customer_tweet_id long, text string").repartition(4)
    table = rule_tables.rule_table(spark, LEXICONS)
    found = rule_tables.with_rule_labels(df, table, {name: F.col("text") for name in LEXICONS})
    chains = df.select("customer_tweet_id", "text", *[
        rules.first_label(F.coalesce("text", F.lit("")), lexicon).alias(name)
        for name, lexicon in LEXICONS.items()])
    assert rows(found) == rows(chains)
    themes = rule_tables.rule_table(spark, {"themes": lex.THEMES})
    counts = rule_tables.label_counts(df, themes, F.col("text"), "themes")
    want = profile.theme_counts(df.withColumnRenamed("text", "customer_message"))
    assert rows(counts) == rows(want)


def test_short_terms_and_terms_in_terms(spark):
    table = spark.createDataFrame([
        ("a", 0, "one", "q"), ("a", 1, "two", "zz"), ("a", 2, "three", "abcd"), ("a", 3, "four", "abc"),
        ("a", 4, "five", "é😀"), ("a", 5, "none", "")], rule_tables.RULES)
    df = spark.createDataFrame(
        [(1, "xq abcd"), (2, "abcd"), (3, "abc"), (4, "azz"), (5, "z z"), (6, "né😀n"), (7, "")],
        "customer_tweet_id long, text string")
    found = rule_tables.with_rule_labels(df, table, {"a": F.col("text")}, default="-")
    assert {r.customer_tweet_id: r.a for r in found.collect()} == {
        1: "one", 2: "three", 3: "four", 4: "two", 5: "-", 6: "five", 7: "-"}
    empty = table.limit(0)
    assert {r.a for r in rule_tables.with_rule_labels(df, empty, {"a": F.col("text")}).collect()} == {lex.OTHER}


def test_a_hundred_thousand_terms(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(5, 10)))
    terms = [word() + " " + word() for _ in range(100_000)]
    table = spark.createDataFrame(
        [("big", i % 50, f"label {i % 50}", t) for i, t in enumerate(terms)], rule_tables.RULES)
    hits = [r.randrange(100_000) for _ in range(300)]
    texts = [(i, f"some {terms[h]} words {word()}") for i, h in enumerate(hits)]
    texts += [(1_000 + i, " ".join(word() for _ in range(8))) for i in range(300)]
    df = spark.createDataFrame(texts, "customer_tweet_id long, text string")
    found = rule_tables.with_rule_labels(df, table, {"big": F.col("text")}, default="-").collect()
    labels = {f.customer_tweet_id: f.big for f in found}
    for i, h in enumerate(hits):
        assert int(labels[i].split()[1]) <= h % 50
    assert sum(labels[i] == f"label {h % 50}" for i, h in enumerate(hits)) > 290
    assert {labels[1_000 + i] for i in range(300)} == {"-"}


def test_grams_are_counted_before_they_are_shuffled(spark):
    texts = ["", None, "a", "é😀", "né😀n\nné", "aaaa", "ab\r\nab", "a"] + ["my battery drains"] * 50
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = rule_tables.gram_counts(df, "text", [1, 3])
    want = Counter(g for t in texts for g in {
        (t or "")[i:i + n] for n in (1, 3) for i in range(len(t or "") - n + 1)})
    assert {r.gram: r.n for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert "partial_count" in plan and "Join" not in plan


@pytest.mark.parametrize("n", [0, 1, 5, 700, 999, 1_000, 1_001, 2_999, 3_000, 5_000])
def test_samples_by_counts_equal_samples_by_order(spark, n, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_ORDERED", 3)
    df = spark.range(3_000).withColumnRenamed("id", "customer_tweet_id")
    key = sampling.shuffle_key("customer_tweet_id")
    want = rows(df.orderBy(key, "customer_tweet_id").limit(n))
    assert rows(sampling.exact_sample(df, n)) == want


def test_equal_keys_are_cut_by_the_ties(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_ORDERED", 3)
    df = spark.range(50)
    assert rows(sampling.first_by_hash(df, 20, F.md5(F.lit("x")), "id")) == [(i,) for i in sorted(range(20), key=lambda i: str((i,)))]


def test_training_rows_are_those_of_least_hash(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_ORDERED", 3)
    df = spark.range(500).withColumnRenamed("id", "customer_tweet_id")
    mark = F.xxhash64(F.lit(17), F.col("customer_tweet_id"))
    assert rows(classifier.bounded_rows(df, 123)) == rows(df.orderBy(mark, "customer_tweet_id").limit(123))


def test_cube_totals(workspace):
    labelled = rules.with_proposed_labels(workspace.pairs).select(
        "brand", F.col("auto_intent").alias("intent"), F.col("auto_escalate").alias("escalate"))
    cube = profile.label_cube(labelled, "brand", "intent").collect()
    n = labelled.count()
    assert [r.n for r in cube if r.grouping == 3] == [n]
    for grouping in (0, 1):
        assert sum(r.n for r in cube if r.grouping == grouping) == n
