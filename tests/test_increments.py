"""Summaries that merge, term statistics in segments, verdicts with unknown fields."""

import json

import pytest
from pyspark.sql import functions as F

from casedesk.operators import judging, sketches, term_log, tfidf


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merged_summaries_are_as_close_as_they_say(spark):
    df = spark.range(200_000).select(
        (F.col("id") % 9).alias("day"), (F.col("id") % 2).alias("brand"),
        (F.pmod(F.xxhash64("id"), F.lit(50_000))).alias("x"), (F.col("id") % 30_000).alias("author"))
    df = df.unionByName(spark.range(60_000).select(  # a third of one day has one value
        F.lit(3).alias("day"), F.lit(1).alias("brand"), F.lit(7).alias("x"), F.lit(1).alias("author")))
    daily = sketches.summaries(df, ["day", "brand"], {"x": F.col("x")}, {"authors": F.col("author")})
    late = spark.range(10).select(F.lit(99).alias("day"), F.lit(0).alias("brand"),
                                  F.col("id").alias("x"), F.col("id").alias("author"))
    parts = daily.unionByName(sketches.summaries(
        late, ["day", "brand"], {"x": F.col("x")}, {"authors": F.col("author")}))
    everything = df.unionByName(late)
    for keys in (["brand"], ["day"]):
        table = sketches.merged(parts, keys)
        errors = sketches.rank_errors(
            everything, table, keys, "x", F.col("x"), [0.01, 0.25, 0.5, 0.75, 0.99]).collect()
        assert errors and all(r.rank_error <= 2 * sketches.rank_error() for r in errors)
        exact = everything.groupBy(*keys).agg(F.countDistinct("author").alias("k"), F.count("*").alias("m"))
        for r in table.withColumn("e", sketches.estimated("authors")).join(exact, keys).collect():
            assert r.n == r.m and abs(r.e - r.k) <= 4 * sketches.distinct_error() * r.k + 1


@pytest.fixture
def docs(spark):
    words = "battery update wifi phone charge music photo call slow".split()
    return spark.createDataFrame(
        [(i, " ".join(words[(i * k) % 9] for k in range(1, 2 + i % 5))) for i in range(60)]
        + [(100, None), (101, ""), (102, "the of")], "customer_tweet_id long, text string")


def test_segments_equal_a_rebuild(spark, docs, tmp_path):
    text = F.coalesce("text", F.lit(""))
    log = term_log.TermLog(spark, str(tmp_path))
    assert log.add(docs.where("customer_tweet_id < 20"), text) == 0
    assert log.add(docs.where("customer_tweet_id < 40"), text) == 1  # twenty of them again
    log.compact()
    log.add(docs.unionByName(docs), text)
    log.add(docs, text)
    want = tfidf.term_stats(tfidf.with_term_counts(docs, text))
    assert rows(log.stats()) == rows(want) and log.n_docs().first()[0] == docs.count()
    counted = tfidf.vocabulary(want, tfidf.count_docs(docs)).selectExpr("term", "df", "cf", "round(idf, 9)")
    assert rows(log.vocabulary().selectExpr("term", "df", "cf", "round(idf, 9)")) == rows(counted)
    log.compact()
    assert log.marks().count() == 1 and rows(log.stats()) == rows(want)


@pytest.mark.parametrize("lost", ["stats", "ids", "marks", "starts"])
def test_a_segment_that_broke_off_does_not_count(spark, docs, tmp_path, lost):
    text = F.coalesce("text", F.lit(""))
    log = term_log.TermLog(spark, str(tmp_path))
    log.add(docs.where("customer_tweet_id < 20"), text)
    before, written = rows(log.stats()), log._write

    def breaking(df, name, segment):
        if name == lost:
            raise OSError("gone")
        written(df, name, segment)

    log._write = breaking
    with pytest.raises(OSError):
        log.compact() if lost == "starts" else log.add(docs, text)
    assert rows(log.stats()) == before
    log._write = written
    log.add(docs, text)
    assert rows(log.stats()) == rows(tfidf.term_stats(tfidf.with_term_counts(docs, text)))


def test_unknown_fields_of_verdicts_are_kept(spark):
    full = {"relevance": 4, "overall": "4.5", "unsupported_claims": True, "reasoning": 'a "b"\n{c}',
            "notes": {"tone": ["calm", 2]}, "extra": 7}
    raws = [json.dumps(full), f"```json\n{json.dumps(full)}\n```", "no", None, '{"overall": 4,, }',
            '{"overall": 4.0}', "{}", '{"overall": "good"}', '{"overall": null, "safety": 3}']
    df = spark.createDataFrame(list(enumerate(raws)), "customer_tweet_id long, raw string")
    found = judging.variant_verdicts(df)
    assert rows(found.drop("verdict")) == rows(judging.parse_verdicts(df))
    kept = found.select("customer_tweet_id", F.try_variant_get("verdict", "$.notes.tone[1]", "int").alias("n"),
                        F.try_variant_get("verdict", "$.extra", "int").alias("x"))
    assert [tuple(r) for r in kept.orderBy("customer_tweet_id").limit(2).collect()] == [(0, 2, 7), (1, 2, 7)]
