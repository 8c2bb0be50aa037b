"""Cosine of two texts under a TF-IDF fitted on just these two."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from casedesk.functions import text as tx
from casedesk.functions.staging import spread, staged

# With two documents a shared term has idf 1 and any other ln(3/2) + 1.
SINGLE_IDF = math.log(1.5) + 1


def _entries(words: str, left: float, right: float) -> Column:
    return F.transform(tx.with_bigrams(F.col(words)), lambda t: F.struct(
        t.alias("term"), F.lit(left).alias("a"), F.lit(right).alias("b")))


def pair_cosine(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """``similarity`` of two text columns over words and word pairs, per row.

    ``keys`` name the row. Only the texts are shuffled, once and by key; a row's terms
    are then counted and summed in the task that holds it. Rows without words score 0.
    """
    rows = spread(pairs.select(*keys, left, right), *keys)
    words = staged(rows, _left=tx.tokens(F.col(left)), _right=tx.tokens(F.col(right)))
    both = staged(words, _terms=F.concat(_entries("_left", 1.0, 0.0), _entries("_right", 0.0, 1.0)))
    counts = both.select(*keys, F.inline_outer("_terms")).groupBy(*keys, "term").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    idf = F.when((a > 0) & (b > 0), 1.0).otherwise(SINGLE_IDF)
    sums = counts.select(*keys, a.alias("a"), b.alias("b"), idf.alias("idf")).groupBy(*keys).agg(
        F.sum(F.col("a") * F.col("b")).alias("dot"),
        F.sum(F.pow(F.col("a") * F.col("idf"), F.lit(2))).alias("na"),
        F.sum(F.pow(F.col("b") * F.col("idf"), F.lit(2))).alias("nb"))
    cosine = F.when(
        (F.col("na") > 0) & (F.col("nb") > 0),
        F.col("dot") / F.sqrt(F.col("na") * F.col("nb"))).otherwise(0.0)
    return sums.select(*keys, cosine.alias("similarity"))
