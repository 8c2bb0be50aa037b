"""Reproducible samples and the split they protect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEED = 42
# Rows that one task may order, and hex digits that rows are counted by at a time.
MOST_ORDERED = 100_000
DIGITS = 3


def shuffle_key(id_column: str, seed: int = SEED) -> Column:
    """Order of a seeded shuffle: the same rows everywhere, whatever the partitioning."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))


def exact_sample(df: DataFrame, n: int, id_column: str = "customer_tweet_id", seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows (all if fewer): those that come first in the seeded shuffle.

    Up to ``MOST_ORDERED`` rows, each task keeps only its own first ``n`` and one merges them.
    """
    key = shuffle_key(id_column, seed)
    if n <= MOST_ORDERED:
        return df.orderBy(key, id_column).limit(n)
    return first_by_hash(df, n, key, id_column)


def first_by_hash(df: DataFrame, n: int, key: Column, *ties: str) -> DataFrame:
    """The ``n`` rows of least ``key``, a hash in hex digits; no task orders more than a few.

    Rows are counted by the first digits of their key. All before the digits at which the count
    reaches ``n`` are taken; those with these digits are counted by the next ones, until so few
    are left that they can be ordered.
    """
    marked = df.withColumn("_key", key)
    digits, left = "", n
    while True:
        part = F.substring("_key", len(digits) + 1, DIGITS)
        counts = (marked.filter(F.col("_key").startswith(digits)).groupBy(part.alias("part"))
                  .count().orderBy("part").collect())  # at most 16 ** DIGITS rows
        for row in counts:
            if row["count"] >= left:
                break
            left -= row["count"]
        else:
            return df  # fewer rows than asked for
        digits += row.part
        if row["count"] == left:  # all of them
            return marked.filter((F.col("_key") < digits) | F.col("_key").startswith(digits)).drop("_key")
        if left <= MOST_ORDERED or not row.part:  # or keys that are equal throughout
            break
    before = marked.filter(F.col("_key") < digits)
    edge = marked.filter(F.col("_key").startswith(digits)).orderBy("_key", *ties).limit(left)
    return before.unionByName(edge).drop("_key")


def golden_set(pairs: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """Evaluation sample with empty label columns to be filled in."""
    return exact_sample(pairs, n, seed=seed).select(
        "customer_tweet_id",
        F.coalesce("previous_context", F.lit("")).alias("previous_context"),
        F.coalesce("customer_message", F.lit("")).alias("customer_message"),
        "brand_reply",
        *[F.lit("").alias(name) for name in ("intent", "escalate", "label_reason")])


def without(df: DataFrame, excluded: DataFrame, id_column: str = "customer_tweet_id") -> DataFrame:
    """Rows whose id is not in the other table (leak guard of training and index)."""
    return df.join(excluded.select(id_column), id_column, "left_anti")
