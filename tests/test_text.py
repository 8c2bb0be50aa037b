import pytest
from pyspark.sql import functions as F

from casedesk.functions import text as tx
from casedesk.operators.reply_quality import length_score


def one(spark, value, build):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(build(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value,expected", [
    (None, ""), ("", ""), ("@Someone", ""), ("https://t.co/a1", ""),
    ("  Hello\t@you\n www.x.y  World ", "hello world"), ("É @é_1 😀", "é 😀"),
    ("a b", "a b")])
def test_clean(spark, value, expected):
    assert one(spark, value, tx.clean) == expected


def test_contexts(spark):
    df = spark.createDataFrame([(" a ", " b "), (None, "b"), ("a", None), (None, None)],
                               "c string, m string")
    both = F.col("c"), F.col("m")
    assert [r[0] for r in df.select(tx.merged_context(*both)).collect()] == ["a b", "b", "a", ""]
    assert [r[0] for r in df.select(tx.raw_context(*both)).collect()] == [" a   b ", " b", "a ", " "]


def test_tokens_and_bigrams(spark):
    build = lambda x: tx.with_bigrams(tx.tokens(x, ("the",)))
    assert one(spark, "The quick, x brown_1 the FOX", build) == [
        "quick", "brown_1", "fox", "quick brown_1", "brown_1 fox"]
    assert one(spark, "a", build) == [] and one(spark, None, build) == []
    assert one(spark, "word", build) == ["word"]


@pytest.mark.parametrize("n,score", [
    (0, 0.0), (4, 0.5), (5, 0.75), (7, 0.75), (8, 1.0), (80, 1.0), (81, 0.75), (120, 0.75),
    (121, 0.5)])
def test_length_score(spark, n, score):
    assert one(spark, " ".join(["w"] * n), lambda x: length_score(tx.word_count(x))) == score
