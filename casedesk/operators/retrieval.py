"""Similar cases: exact cosine top-k between messages and an index of answered cases."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from casedesk.functions import text as tx
from casedesk.functions.staging import spread, staged
from casedesk.operators import tfidf
from casedesk.session import materialize, tidy
from casedesk.sources.versions import read_bucketed, write_bucketed

# The rarest terms of a query set the bar that other cases have to reach: so many at least, and
# more as long as they have no more postings than this in all.
SEED_TERMS = 3
SEED_POSTINGS = 200
# Cases of these terms that are scored in full.
SEED_CASES = 10
# Postings of a term beyond which it is cut into parts.
POSTINGS_PER_PART = 100_000
# Similarities are rounded to six decimals: this much below the bar may still tie with it.
ROUNDING = 2e-6
# Rows of a stored index that a bucket should hold.
ROWS_PER_BUCKET = 1_000_000

VECTORS = T.StructType([
    T.StructField("rep_id", T.LongType()),
    T.StructField("vector", T.ArrayType(T.StructType([
        T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])))])
POSTINGS = T.StructType([
    T.StructField("term", T.StringType()), T.StructField("part", T.IntegerType()),
    T.StructField("rep_id", T.LongType()), T.StructField("case_weight", T.DoubleType())])
LAYOUT = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("buckets", T.IntegerType())])


@dataclass
class CaseIndex:
    """The parts of a fitted index. Cases with the same text share one vector."""

    cases: DataFrame     # case_id, text_key, search_text, ...
    vocab: DataFrame     # term, df, cf, idf
    vectors: DataFrame   # rep_id, vector
    postings: DataFrame | None = None  # term, part, rep_id, case_weight, where they are stored


def with_search_text(messages: DataFrame) -> DataFrame:
    """Adds the text that is compared, and a short key that stands for it in joins."""
    text = tx.raw_context(F.col("previous_context"), F.col("customer_message"))
    return messages.withColumn("search_text", text).withColumn("text_key", F.md5("search_text"))


def _distinct_texts(docs: DataFrame, id_column: str) -> DataFrame:
    """One row per text: its smallest id and its copies.

    A text repeated very often is counted on the map side, so its copies are
    tokenised, weighted and compared once.
    """
    return docs.groupBy("text_key", "search_text").agg(
        F.min(id_column).alias("rep_id"), F.count("*").alias("copies"))


def build_index(
    pairs: DataFrame, exclude: DataFrame | None = None, stop_words=tx.STOP_WORDS,
    max_features: int | None = None,
    store: bool | Callable[[DataFrame, str], DataFrame] = False,
) -> CaseIndex:
    """Index over answered cases; ids in ``exclude`` stay out of it.

    The vocabulary is whole unless ``max_features`` asks for the most frequent terms.

    With ``store`` every part is written as it is built and read back, by a function of the
    caller's if it is one, so that later parts and all retrievals start from files. Term counts are made anew for the
    vectors: counting again is cheaper than keeping all postings twice.
    """
    def part(df: DataFrame, name: str) -> DataFrame:
        if callable(store):
            return store(df, name)
        return materialize(df, f"index-{name}") if store else df

    if exclude is not None:
        pairs = pairs.join(exclude.select("customer_tweet_id"), "customer_tweet_id", "left_anti")
    cases = part(with_search_text(pairs).withColumnRenamed("customer_tweet_id", "case_id"), "cases")
    counted = tfidf.with_term_counts(
        _distinct_texts(cases, "case_id"), F.col("search_text"), stop_words)
    vocab = part(tfidf.vocabulary(
        tfidf.term_stats(counted, F.col("copies")), tfidf.count_docs(cases),
        max_features=max_features), "vocabulary")
    vectors = tfidf.unit_vectors(counted, vocab, "rep_id")
    if not callable(store):
        vectors = spread(vectors, "rep_id")
    return CaseIndex(cases, vocab, part(vectors, "vectors"))


def save_index(pairs: DataFrame, path: str, **options) -> None:
    """Builds an index into a folder: vectors bucketed by text, postings by term and part.

    A frequent term's parts are keys of their own, so no bucket holds more than its share.
    """
    spark = pairs.sparkSession
    layout: list[tuple[str, int]] = []

    def bucketed(df: DataFrame, name: str, rows: int, *keys: str) -> DataFrame:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                      math.ceil(rows / ROWS_PER_BUCKET))
        layout.append((name, buckets))
        return write_bucketed(df, f"{path}/{name}", buckets, *keys)

    def keep(df: DataFrame, name: str) -> DataFrame:
        if name == "vectors":
            return bucketed(df, name, kept["cases"].count(), "rep_id")
        with tidy(spark):
            df.write.option("compression", "zstd").parquet(f"{path}/{name}")
        kept[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        return kept[name]

    kept: dict[str, DataFrame] = {}
    index = build_index(pairs, store=keep, **options)
    entries = index.vocab.agg(F.sum("df")).first()[0] or 0
    bucketed(_case_postings(index), "postings", entries, "term", "part")
    spark.createDataFrame(layout, LAYOUT).coalesce(1).write.parquet(f"{path}/layout")


def load_index(spark: SparkSession, path: str) -> CaseIndex:
    """The index of a folder, also one that another session saved."""
    layout = {r.table: r.buckets for r in spark.read.schema(LAYOUT).parquet(f"{path}/layout").collect()}
    return CaseIndex(
        spark.read.parquet(f"{path}/cases"), spark.read.parquet(f"{path}/vocabulary"),
        read_bucketed(spark, f"{path}/vectors", VECTORS, layout["vectors"], "rep_id"),
        read_bucketed(spark, f"{path}/postings", POSTINGS, layout["postings"], "term", "part"))


def index_postings(index: CaseIndex) -> DataFrame:
    """The index as a table: every case with its terms and weights."""
    reps = index.cases.groupBy("text_key").agg(F.min("case_id").alias("rep_id"))
    return (
        index.cases.select("case_id", "text_key").join(reps, "text_key")
        .join(index.vectors, "rep_id")
        .select("case_id", F.inline("vector"))
    )


def _query_terms(texts: DataFrame, index: CaseIndex, stop_words) -> DataFrame:
    """One row per query text and term, rarest first: place, weight, squared weight before it."""
    counted = tfidf.with_term_counts(texts, F.col("search_text"), stop_words)
    weights = tfidf.postings(tfidf.unit_vectors(counted, index.vocab, "query_rep"), "query_rep")
    rare = W.partitionBy("query_rep").orderBy("df", "term")
    square = F.col("weight") * F.col("weight")
    return (
        weights.join(index.vocab.select("term", "df"), "term")
        .withColumn("place", F.row_number().over(rare))
        .withColumn("before", F.sum(square).over(
            rare.rowsBetween(W.unboundedPreceding, 0)) - square)
        .withColumn("postings", F.sum("df").over(rare.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("tail", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("before")))))


def _parts() -> Column:
    """Parts that the postings of a term are cut into, so that a frequent term is no hot key."""
    return F.ceil(F.col("df") / POSTINGS_PER_PART).cast("int")


def _case_postings(index: CaseIndex) -> DataFrame:
    if index.postings is not None:
        return index.postings
    part = F.pmod(F.xxhash64("rep_id"), _parts()).cast("int")
    return (
        tfidf.postings(index.vectors, "rep_id").withColumnRenamed("weight", "case_weight")
        .join(index.vocab.select("term", "df"), "term")
        .select("term", part.alias("part"), "rep_id", "case_weight"))


def _partial_scores(terms: DataFrame, cases: DataFrame) -> DataFrame:
    """Scores over the given query terms of all cases that hold one of them."""
    spread_terms = terms.withColumn("part", F.explode(F.sequence(F.lit(0), _parts() - 1)))
    return (
        spread_terms.join(cases, ["term", "part"]).groupBy("query_rep", "rep_id")
        .agg(F.sum(F.col("weight") * F.col("case_weight")).alias("partial")))


def _best_texts(terms: DataFrame, index: CaseIndex, k: int) -> DataFrame:
    """``query_rep, rep_id, similarity`` of the k best case texts per query text, exactly.

    The best cases by the rarest terms, scored in full, give k scores that the true k best
    can't fall below: the bar. A case that shares only the terms behind some place scores at most the length of that
    tail of the query, as case vectors have length one. So only the terms up to the place
    where the tail falls below the bar bring candidates, and of these only the ones that
    could still reach it are scored over the rest of the terms.
    """
    cases = _case_postings(index)
    best = W.partitionBy("query_rep").orderBy(F.desc("partial"), "rep_id")
    rarest = (F.col("place") <= SEED_TERMS) | (F.col("postings") <= SEED_POSTINGS)
    seeds = (
        _partial_scores(terms.filter(rarest), cases)
        .withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= max(k, SEED_CASES)))
    whole = (
        seeds.select("query_rep", "rep_id").join(index.vectors, "rep_id")
        .select("query_rep", "rep_id", F.inline("vector")).withColumnRenamed("weight", "case_weight")
        .join(terms.select("query_rep", "term", "weight"), ["query_rep", "term"])
        .groupBy("query_rep", "rep_id")
        .agg(F.sum(F.col("weight") * F.col("case_weight")).alias("partial"))
        .withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k))
    bars = whole.groupBy("query_rep").agg(
        F.when(F.count("*") >= k, F.min("partial")).alias("bar"))
    barred = terms.join(bars, "query_rep", "left").withColumn(
        "bar", F.coalesce("bar", F.lit(0.0)) - ROUNDING)
    barred = materialize(barred, "query-terms")
    leading = F.col("tail") >= F.col("bar")
    rest = barred.groupBy("query_rep").agg(
        F.collect_list(F.when(~leading, F.struct("term", "weight"))).alias("rest"),
        F.coalesce(F.max(F.when(~leading, F.col("tail"))), F.lit(0.0)).alias("reach"),
        F.first("bar").alias("bar"))
    candidates = (
        _partial_scores(barred.filter(leading), cases).join(rest, "query_rep")
        .filter(F.col("partial") + F.col("reach") >= F.col("bar")))
    behind = F.aggregate(
        "rest", F.lit(0.0), lambda total, t: total + t["weight"] * F.coalesce(
            F.try_element_at("_weights", t["term"]), F.lit(0.0)))
    similarity = F.round(F.col("partial") + behind, 6)
    ranked = W.partitionBy("query_rep").orderBy(F.desc("similarity"), "rep_id")
    return (
        staged(candidates.join(index.vectors, "rep_id"), _weights=F.map_from_entries("vector"))
        .select("query_rep", "rep_id", similarity.alias("similarity"))
        .filter(F.col("similarity") > 0)
        .withColumn("nth", F.row_number().over(ranked)).filter(F.col("nth") <= k).drop("nth"))


def _copies(cases: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest case ids with the text of each found case; no other can be in a top k.

    The rank is cut in every task before the shuffle, so a text of very many copies sends
    k rows per task.
    """
    same = W.partitionBy("text_key").orderBy("case_id")
    least = (
        cases.select("text_key", "case_id")
        .withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k))
    own = least.filter("copy = 1").select("text_key", F.col("case_id").alias("rep_id"))
    wanted = own.join(found.select("rep_id").distinct(), "rep_id")
    return least.join(wanted, "text_key").select("rep_id", "case_id")


def similar_cases(
    queries: DataFrame, index: CaseIndex, k: int = 3, stop_words=tx.STOP_WORDS,
) -> DataFrame:
    """``query_id, case_id, similarity, rank`` of the ``k`` most similar cases per query.

    Similarities are rounded before ranking and ties go to the smaller case id. Only
    cases that share a term are returned. Equal query texts are answered once. The
    ranked table is returned as files.
    """
    asked = with_search_text(queries).select(
        F.col("customer_tweet_id").alias("query_id"), "text_key", "search_text")
    texts = _distinct_texts(asked, "query_id").withColumnRenamed("rep_id", "query_rep")
    terms = materialize(_query_terms(texts, index, stop_words), "query-postings")
    found = materialize(_best_texts(terms, index, k), "best-texts")

    reps = texts.select("text_key", "query_rep")
    members = asked.select("query_id", "text_key").join(reps, "text_key")
    expanded = (
        found.join(_copies(index.cases, found, k), "rep_id")
        .select("query_rep", "case_id", "similarity")
        .withColumn("rank", F.row_number().over(
            W.partitionBy("query_rep").orderBy(F.desc("similarity"), "case_id")))
        .filter(F.col("rank") <= k)
    )
    ranked = members.join(expanded, "query_rep").select(
        "query_id", "case_id", "similarity", "rank")
    return materialize(ranked, "similar-cases")


def with_case_text(found: DataFrame, index: CaseIndex) -> DataFrame:
    """The ranked table with message, context and reply of each case."""
    texts = index.cases.select(
        "case_id", "customer_message", "previous_context", "brand_reply", "brand_tweet_id")
    return texts.join(found, "case_id")


def evidence_lists(found: DataFrame) -> DataFrame:
    """One row per query with its ranked cases; a list holds at most k entries."""
    case = F.struct(
        "rank", "similarity", "customer_message", "previous_context", "brand_reply",
        F.col("case_id").alias("customer_tweet_id"), "brand_tweet_id")
    return found.groupBy(F.col("query_id").alias("customer_tweet_id")).agg(
        F.array_sort(F.collect_list(case)).alias("evidence"))
