"""Keyword rules read from a table instead of code, for any number of terms.

A rule table has the columns lexicon, rule_rank, label, term. A term occurs in a text only if all of
its grams (runs of three characters, or the whole of a shorter term) do, so each term is indexed by
the one of its grams that the texts hold least often. Texts look up their grams, and only the terms
found there are searched for. The work grows with the texts and with how often rare grams meet, not
with the number of terms, and no expression holds a term.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casedesk.functions import lexicons as lex
from casedesk.functions.staging import staged
from casedesk.session import materialize

GRAM = 3
RULES = "lexicon string, rule_rank int, label string, term string"


def rule_table(spark: SparkSession, lexicons: dict[str, Iterable]) -> DataFrame:
    """Ordered rules as they stand in code, as a table."""
    return spark.createDataFrame(
        [(name, rank, label, term) for name, rules in lexicons.items()
         for rank, (label, terms) in enumerate(rules) for term in terms], RULES)


def grams(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters of a text.

    One expression finds them all: it looks ahead and goes on by one character.
    """
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))
    return F.array_distinct(runs)


def _with_grams(df: DataFrame, text: str, sizes: Iterable[int], own_size: bool = False) -> DataFrame:
    """One row per row and gram: of all the sizes, or of the size that fits a term's length."""
    fits = [F.when(F.least(F.length(text), F.lit(GRAM)) == n, grams(F.col(text), n))
            if own_size else grams(F.col(text), n) for n in sizes]
    found = F.coalesce(*fits) if own_size else F.flatten(F.array(*fits))
    return df.withColumn("gram", F.explode(found))


def gram_counts(texts: DataFrame, text: str, sizes: Iterable[int]) -> DataFrame:
    """(gram, n): how many texts hold a gram.

    Counted in the tasks, before any shuffle: different grams are few, those of all texts are not.
    """
    return _with_grams(texts.select(text), text, sizes).groupBy("gram").agg(
        F.count("*").alias("n"))


def term_index(rules: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """(gram, lexicon, rule_rank, label, term): every term under its rarest gram in the texts."""
    rules = rules.filter(F.length("term") > 0)
    sizes = _sizes(rules)
    if not sizes:
        return rules.withColumn("gram", F.lit(""))
    terms = _with_grams(rules.select("term").distinct(), "term", sizes, own_size=True)
    counts = gram_counts(texts, text, sizes)
    rarest = (terms.join(counts, "gram", "left").groupBy("term")
              .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))
    return materialize(rules.join(rarest, "term").select(
        "gram", "lexicon", "rule_rank", "label", "term"), "rule-index")


def _sizes(rules: DataFrame) -> list[int]:
    size = F.least(F.length("term"), F.lit(GRAM))
    return sorted(r[0] for r in rules.select(size).distinct().collect())


def matched_rules(texts: DataFrame, index: DataFrame, id_column: str) -> DataFrame:
    """(id, lexicon, rule_rank, label) of every rule with a term in the text.

    ``texts`` holds id, lexicon and text: every lexicon reads a text of its own.
    """
    sizes = sorted(r[0] for r in index.select(F.length("gram")).distinct().collect())
    if not sizes:
        return texts.limit(0).select(
            id_column, "lexicon", F.lit(0).alias("rule_rank"), F.lit("").alias("label"))
    looked_up = _with_grams(texts, "text", sizes).join(index, ["gram", "lexicon"])
    return (looked_up.filter(F.contains("text", "term"))
            .select(id_column, "lexicon", "rule_rank", "label").distinct())


def texts_of(messages: DataFrame, id_column: str, texts: dict[str, Column]) -> DataFrame:
    """The text that each lexicon reads, one row per message and lexicon."""
    pairs = F.array(*[F.struct(F.lit(name).alias("lexicon"), text.alias("text"))
                      for name, text in texts.items()])
    return messages.select(id_column, F.inline(pairs))


def with_rule_labels(
    messages: DataFrame, rules: DataFrame, texts: dict[str, Column],
    id_column: str = "customer_tweet_id", default: str = lex.OTHER,
) -> DataFrame:
    """Messages with one column per lexicon: the label of its first rule that matches."""
    read = materialize(texts_of(messages, id_column, texts), "rule-texts")
    first = F.min(F.struct("rule_rank", "label"))
    labels = (matched_rules(read, term_index(rules, read), id_column)
              .groupBy(id_column, "lexicon").agg(first.alias("rule"))
              .groupBy(id_column).pivot("lexicon", list(texts)).agg(F.first("rule.label")))
    named = [F.coalesce(name, F.lit(default)).alias(name) for name in texts]
    return messages.join(labels, id_column, "left").select(*messages.columns, *named)


def label_counts(
    messages: DataFrame, rules: DataFrame, text: Column, lexicon: str,
    id_column: str = "customer_tweet_id",
) -> DataFrame:
    """Messages per label of a lexicon; a message counts once for each label it matches."""
    read = materialize(texts_of(messages, id_column, {lexicon: text}), "rule-texts")
    counts = (matched_rules(read, term_index(rules, read), id_column)
              .select(id_column, "label").distinct()
              .groupBy("label").agg(F.count("*").alias("n")))
    labels = rules.filter(F.col("lexicon") == lexicon).select("label").distinct()
    return labels.join(counts, "label", "left").select(
        "label", F.coalesce("n", F.lit(0)).alias("n"))
