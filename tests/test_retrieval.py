import math
import random
import re
from collections import Counter

import pytest

from casedesk.functions.text import STOP_WORDS
from casedesk.operators import retrieval, tfidf
from casedesk.operators.text_similarity import pair_cosine

WORDS = "battery update wifi phone screen charge music photo call slow the of account".split()


def terms_of(text, stop=STOP_WORDS):
    words = [w for w in re.findall(r"\w{2,}", text.lower()) if w not in stop]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def unit(text, idf):
    weights = {t: n * idf[t] for t, n in Counter(terms_of(text)).items() if t in idf}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {t: w / norm for t, w in weights.items()} if norm else {}


def brute_force(queries, cases, k, max_features):
    texts = {c: f" {t}" for c, t in cases}
    df, cf = Counter(), Counter()
    for text in texts.values():
        counts = Counter(terms_of(text))
        cf.update(counts)
        df.update(counts.keys())
    kept = sorted((t for t in df if df[t] >= 2), key=lambda t: (-cf[t], t))[:max_features]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in kept}
    vectors = {c: unit(t, idf) for c, t in texts.items()}
    found = set()
    for q, text in queries:
        asked = unit(f" {text}", idf)
        scores = [(round(sum(w * v.get(t, 0) for t, w in asked.items()), 6), c)
                  for c, v in vectors.items()]
        ranked = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1]))[:k]
        found |= {(q, c, s, place) for place, (s, c) in enumerate(ranked, 1)}
    return found


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6)))
    cases = [(i, text()) for i in range(100)] + [(1000 + i, "same hot text battery") for i in range(80)]
    queries = [(5000 + i, text()) for i in range(30)] + [(6000, "same hot text"), (6001, "zzz"), (6002, "same hot text")]
    return queries, cases


def frames(spark, queries, cases):
    schema = "customer_tweet_id long, previous_context string, customer_message string"
    asked = spark.createDataFrame([(q, None, t) for q, t in queries], schema)
    answered = spark.createDataFrame(
        [(c, None, t, "reply", c + 1) for c, t in cases],
        schema + ", brand_reply string, brand_tweet_id long")
    return asked, answered


def rows(df):
    return {(r.query_id, r.case_id, r.similarity, r.rank) for r in df.collect()}


@pytest.mark.parametrize("part,features", [(100_000, None), (7, 40), (100_000, 5)])
def test_top_k_equals_brute_force(spark, corpus, monkeypatch, part, features):
    monkeypatch.setattr(retrieval, "POSTINGS_PER_PART", part)
    asked, answered = frames(spark, *corpus)
    index = retrieval.build_index(answered, max_features=features)
    found = rows(retrieval.similar_cases(asked, index, 3))
    assert found == brute_force(*corpus, 3, features)


def test_no_python_stage(spark, corpus):
    asked, answered = frames(spark, *corpus)
    index = retrieval.build_index(answered)
    terms = retrieval._query_terms(retrieval._distinct_texts(
        retrieval.with_search_text(asked), "customer_tweet_id").withColumnRenamed(
        "rep_id", "query_rep"), index, STOP_WORDS)
    plan = retrieval._best_texts(terms, index, 3)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_excluded_ids_stay_out(spark, corpus):
    asked, answered = frames(spark, *corpus)
    index = retrieval.build_index(answered, exclude=answered.filter("customer_tweet_id >= 1000"))
    assert index.cases.filter("case_id >= 1000").count() == 0
    assert index.cases.count() == 100


def test_index_rows_are_unit_vectors_and_copies_share_them(spark, corpus):
    _, answered = frames(spark, *corpus)
    index = retrieval.build_index(answered, store=True)
    norms = retrieval.index_postings(index).groupBy("case_id").agg({"weight": "count"}).count()
    assert index.vectors.count() <= norms
    squares = tfidf.postings(index.vectors, "rep_id").selectExpr("rep_id", "weight * weight as s")
    assert all(abs(r["sum(s)"] - 1) < 1e-9 for r in squares.groupBy("rep_id").sum("s").collect())


def pair_value(a, b):
    ta, tb = Counter(terms_of(a, ())), Counter(terms_of(b, ()))
    idf = lambda t: 1.0 if t in ta and t in tb else math.log(1.5) + 1
    na, nb = (math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items())) for c in (ta, tb))
    return sum(n * tb[t] for t, n in ta.items()) / (na * nb) if na and nb else 0.0


def test_pair_cosine(spark):
    texts = [("a b", ""), ("same words here", "same words here"), ("one two two", "two three"),
             ("x", "y"), ("Hello WORLD again", "hello world"), (None, "abc")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "id int, a string, b string")
    got = {r.id: r.similarity for r in pair_cosine(df, ["id"], "a", "b").collect()}
    assert len(got) == len(texts)
    for i, (a, b) in enumerate(texts):
        assert got[i] == pytest.approx(pair_value(a or "", b or ""))
