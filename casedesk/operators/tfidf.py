"""TF-IDF as relational steps: term counts, term statistics, unit vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casedesk.functions import text as tx
from casedesk.functions.staging import staged


def with_term_counts(docs: DataFrame, text: Column, stop_words=()) -> DataFrame:
    """Adds ``terms``: an array of (term, tf) over words and word pairs.

    Each row counts its own terms by sorting them and measuring the runs, so nothing
    is shuffled. The staged columns keep the sort out of the inner expressions.
    """
    ordered = F.col("_ordered")
    n = F.size(ordered)
    starts = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))
    ends = F.concat(F.slice(F.col("_starts"), F.lit(2), n), F.array(n + 1))
    terms = F.zip_with(F.col("_starts"), ends, lambda a, b: F.struct(
        F.get(ordered, a - 1).alias("term"), (b - a).cast("long").alias("tf")))
    words = staged(docs, _words=tx.tokens(text, stop_words)).filter(F.size("_words") > 0)
    sorted_terms = staged(words, _ordered=F.sort_array(tx.with_bigrams(F.col("_words"))))
    return staged(staged(sorted_terms, _starts=starts), terms=terms).drop(
        "_words", "_ordered", "_starts")


def term_stats(counted: DataFrame, copies: Column | None = None) -> DataFrame:
    """Per term: documents holding it (df) and occurrences (cf)."""
    weight = F.lit(1) if copies is None else copies
    return (
        counted.select(weight.cast("long").alias("copies"), F.inline("terms"))
        .groupBy("term")
        .agg(F.sum("copies").alias("df"), F.sum(F.col("tf") * F.col("copies")).alias("cf"))
    )


def vocabulary(
    stats: DataFrame, n_docs: DataFrame, min_df: int = 2, max_df: float = 1.0,
    max_features: int | None = None,
) -> DataFrame:
    """Kept terms with their idf; ``n_docs`` is a one-value table.

    ``max_features`` keeps the terms with the highest cf, ties by term.
    """
    kept = stats.withColumn("n_docs", n_docs.scalar()).filter(
        (F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_docs")))
    if max_features:
        kept = _most_frequent(kept, max_features)
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    return kept.select("term", "df", "cf", idf.alias("idf"))


def _most_frequent(stats: DataFrame, n: int) -> DataFrame:
    """The ``n`` terms of highest cf: all above a count, and the first ones of that count.

    How many terms have which count is a small table, so no task orders the terms.
    """
    above, last = 0, None
    for r in stats.groupBy("cf").count().orderBy(F.desc("cf")).toLocalIterator():
        last = r["cf"]
        if above + r["count"] >= n:
            break
        above += r["count"]
    if last is None:
        return stats
    ties = stats.filter(F.col("cf") == last).orderBy("term").limit(n - above)
    return stats.filter(F.col("cf") > last).unionByName(ties)


def unit_vectors(
    counted: DataFrame, vocab: DataFrame, id_column: str, sublinear: bool = False,
    key: str = "term",
) -> DataFrame:
    """One row per document: ``vector``, an array of (term, weight) of length one.

    ``key`` names the vocabulary column that stands for the term in the vector.

    The vocabulary is as small as its parameters make it, so Spark decides by size
    whether it is broadcast; a document is put together again in one task.
    """
    tf = F.log("tf") + 1 if sublinear else F.col("tf").cast("double")
    weighted = counted.select(id_column, F.inline("terms")).join(
        vocab.select("term", "idf", F.col(key).alias("_key")), "term").select(
        id_column, F.col("_key").alias(key), (tf * F.col("idf")).alias("weight"))
    packed = weighted.groupBy(id_column).agg(
        F.collect_list(F.struct(key, "weight")).alias("raw"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return packed.select(id_column, F.transform("raw", lambda x: F.struct(
        x[key].alias(key), (x["weight"] / F.col("norm")).alias("weight"))).alias("vector"))


def postings(vectors: DataFrame, id_column: str) -> DataFrame:
    """One row per document and term."""
    return vectors.select(id_column, F.inline("vector"))


def count_docs(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*"))


def classifier_vocabulary(counted: DataFrame) -> DataFrame:
    """Words and word pairs in at least two and at most 95% of the documents."""
    return vocabulary(term_stats(counted), count_docs(counted), min_df=2, max_df=0.95)
