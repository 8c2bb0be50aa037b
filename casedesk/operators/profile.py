"""Counts and distributions of tweets and messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from casedesk.functions import lexicons as lex
from casedesk.functions import text as tx
from casedesk.functions.rules import any_term
from casedesk.functions.staging import staged


def _unpivot(row: DataFrame, names, key: str, value: str) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names]
    rest = [c for c in row.columns if c not in names]
    return row.select(*rest, F.inline(F.array(*pairs)))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Per column: rows and rows with a value, in one pass."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(c) for c in df.columns])
    return _unpivot(counts, df.columns, "column_name", "n_non_null").select(
        "column_name", "n_rows", "n_non_null")


def null_counts(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _unpivot(counts, df.columns, "column_name", "n_null")


def brand_counts(tweets: DataFrame) -> DataFrame:
    return (
        tweets.filter(~F.col("inbound") & F.col("author_id").isNotNull())
        .groupBy(F.col("author_id").alias("brand_id"))
        .agg(F.count("*").alias("support_tweets"))
    )


def top_brands(tweets: DataFrame, n: int = 30) -> DataFrame:
    return brand_counts(tweets).orderBy(F.desc("support_tweets"), "brand_id").limit(n)


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows left after each stage."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        for name, df in stages.items()])


def label_cube(labelled: DataFrame, *columns: str) -> DataFrame:
    """Counts of all labels together, by the first column, by each other one within it, and in total.

    One pass over the rows: every grouping set is counted on the map side. ``grouping`` has a bit
    for each column, the first one the highest, that is set where the column is left out.
    """
    first, *others = columns
    sets = [list(columns), *[[first, c] for c in others], [first], []]
    distinct = list({tuple(s): s for s in sets}.values())
    return labelled.groupingSets(distinct, *columns).agg(
        F.count("*").alias("n"),
        F.sum((F.col("escalate") == "yes").cast("long")).alias("n_escalated"),
        F.grouping_id().cast("long").alias("grouping"))


def label_distribution(df: DataFrame, columns) -> DataFrame:
    """Counts of several label columns at once."""
    labels = F.array(*[
        F.struct(F.lit(c).alias("label_column"), F.col(c).cast("string").alias("label"))
        for c in columns])
    return (
        df.select(F.inline(labels)).groupBy("label_column", "label")
        .agg(F.count("*").alias("n"))
    )


def intent_distribution(labelled: DataFrame) -> DataFrame:
    """One row per known intent, zero where no message has it."""
    counts = labelled.groupBy("intent").agg(F.count("*").alias("hits"))
    domain = labelled.sparkSession.createDataFrame([(i,) for i in lex.INTENTS], "intent string")
    return domain.join(counts, "intent", "left").select(
        "intent", F.coalesce("hits", F.lit(0)).cast("long").alias("n"))


def message_length_stats(messages: DataFrame, column: str = "customer_message") -> DataFrame:
    """Describes message lengths; exact quartiles need only one counter per length."""
    length = F.length(tx.or_empty(F.col(column)))
    return messages.select(length.alias("x")).agg(
        F.count("x").alias("n"),
        F.round(F.avg("x"), 6).alias("mean"),
        F.round(F.stddev_samp("x"), 6).alias("std"),
        F.min("x").cast("long").alias("min"),
        F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.max("x").cast("long").alias("max"),
    ).select(
        "n", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"), "max")


def top_keywords(messages: DataFrame, column: str = "customer_message", n: int = 100) -> DataFrame:
    words = messages.select(F.explode(tx.keyword_words(F.col(column))).alias("word"))
    return (
        words.filter((F.length("word") > 2) & ~F.col("word").isin(*lex.KEYWORD_STOPWORDS))
        .groupBy("word").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "word").limit(n)
    )


def _lowered(messages: DataFrame, column: str) -> DataFrame:
    return staged(messages, _text=F.lower(tx.or_empty(F.col(column))))


def theme_counts(messages: DataFrame, column: str = "customer_message") -> DataFrame:
    """Messages per theme; a message counts once for each of its themes."""
    names = [name for name, _ in lex.THEMES]
    counts = _lowered(messages, column).agg(*[
        F.count_if(any_term(F.col("_text"), terms)).alias(name) for name, terms in lex.THEMES])
    return _unpivot(counts, names, "theme", "n")


def theme_examples(messages: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` messages per theme; tasks drop all others before the shuffle."""
    matched = F.array(*[
        F.when(any_term(F.col("_text"), terms), F.lit(name)) for name, terms in lex.THEMES])
    themed = _lowered(messages, "customer_message").select(
        "customer_tweet_id", "customer_message", "brand_reply",
        F.explode(F.array_compact(matched)).alias("theme"))
    first = W.partitionBy("theme").orderBy("customer_tweet_id")
    return (
        themed.withColumn("example", F.row_number().over(first)).filter(F.col("example") <= n)
        .select("theme", "example", "customer_tweet_id", "customer_message", "brand_reply")
    )
