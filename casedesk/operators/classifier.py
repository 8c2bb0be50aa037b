"""Intent classifier: TF-IDF features and multinomial logistic regression."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from casedesk.functions import lexicons as lex
from casedesk.functions import text as tx
from casedesk.functions.rules import with_silver_intent
from casedesk.functions.staging import staged
from casedesk.operators import tfidf
from casedesk.operators.regression import TableRegression, fit
from casedesk.operators.sampling import first_by_hash, without
from casedesk.session import materialize, run_folder

ID = "customer_tweet_id"
# Every partition returns a gradient as large as the coefficients in each iteration, so
# it should hold at least this many rows.
ROWS_PER_GRADIENT = 10_000
TERMS_PER_BUCKET = 50_000
# Coefficients up to which Spark ML keeps them, and some twenty vectors as long, on the driver.
DRIVER_COEFFICIENTS = 500_000


def known_labels(df: DataFrame) -> DataFrame:
    return df.filter(F.col("intent").isin(*lex.INTENTS))


def silver_train(pairs: DataFrame, golden: DataFrame | None = None, match: str = "substring") -> DataFrame:
    """Rule-labelled training rows: no golden ids, no messages under five characters."""
    kept = pairs if golden is None else without(pairs, golden)
    long_enough = F.length(tx.strip(F.col("customer_message"))) >= 5
    return with_silver_intent(kept.filter(long_enough), match=match).select(
        ID, F.coalesce("previous_context", F.lit("")).alias("previous_context"),
        "customer_message", "brand_reply", "created_at", "intent")


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced weights n / (classes * n of the class); the window runs over the labels only."""
    counts = known_labels(train).groupBy("intent").agg(F.count("*").alias("n"))
    every = W.partitionBy()
    weight = F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))
    return counts.select("intent", "n", F.round(weight, 6).alias("weight"))


def model_text(context_mode: str = "template"):
    """Text the classifier reads: labelled parts, or both texts merged into one."""
    context, message = F.col("previous_context"), F.col("customer_message")
    if context_mode == "merged":
        return tx.template_context(F.lit(""), tx.merged_context(context, message))
    return tx.template_context(context, message)


def counted_terms(messages: DataFrame, context_mode: str = "template") -> DataFrame:
    """Id and term counts of the text the classifier reads."""
    return tfidf.with_term_counts(
        messages.select(ID, model_text(context_mode).alias("_text")), F.col("_text")).drop("_text")


def training_vectors(train: DataFrame) -> DataFrame:
    """Unit vectors of the training messages: damped term frequency times idf."""
    counted = counted_terms(train)
    return tfidf.unit_vectors(counted, tfidf.classifier_vocabulary(counted), ID, sublinear=True)


def _placed(vocab: DataFrame) -> DataFrame:
    """The vocabulary with positions 0..n-1: counted per bucket, then numbered inside it."""
    spark = vocab.sparkSession
    n = vocab.count()
    buckets = max(1, math.ceil(n / TERMS_PER_BUCKET))
    vocab = vocab.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    sizes = sorted(vocab.groupBy("bucket").count().collect())
    starts, total = [], 0
    for bucket, size in sizes:
        starts.append((bucket, total))
        total += size
    starts = spark.createDataFrame(starts, "bucket long, start int")
    nth = F.row_number().over(W.partitionBy("bucket").orderBy("term")) - 1
    return vocab.withColumn("nth", nth).join(F.broadcast(starts), "bucket").select(
        "term", "df", "cf", "idf", (F.col("start") + F.col("nth")).cast("int").alias("position"))


def _with_entries(rows: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """Label, weight and the parts of a sparse vector of each row; without known terms it has no entries."""
    entries = F.coalesce(
        F.sort_array("vector"), F.array().cast("array<struct<position:int,weight:double>>"))
    parts = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.transform("_entries", lambda e: e["position"]).alias("indices"),
        F.transform("_entries", lambda e: e["weight"]).alias("values"))
    joined = staged(rows.join(vectors, ID, "left"), _entries=entries)
    return joined.select("label", "weight", parts.alias("features"))


def _as_features(rows: DataFrame) -> DataFrame:
    """The rows with ``features`` for Spark ML: parts of vectors are written and read back as such."""
    folder = run_folder(rows.sparkSession, "features")
    rows.write.parquet(folder)
    schema = T.StructType([
        T.StructField("label", T.DoubleType()), T.StructField("weight", T.DoubleType()),
        T.StructField("features", VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(folder)


def _margins(regression: LogisticRegressionModel | TableRegression, spark: SparkSession) -> DataFrame:
    """(position, coefficients of all classes)."""
    if isinstance(regression, TableRegression):
        return regression.margins
    by_position = regression.coefficientMatrix.toArray().T
    return spark.createDataFrame(pd.DataFrame({
        "position": range(len(by_position)), "coefficients": [r.tolist() for r in by_position]}),
        "position int, coefficients array<double>")


@dataclass
class IntentModel:
    """A fitted classifier: the regression and the vocabulary table it reads."""

    regression: LogisticRegressionModel | TableRegression
    vocab: DataFrame

    def predict(self, messages: DataFrame, context_mode: str = "template") -> DataFrame:
        """Messages with ``predicted_intent``, ``prediction_confidence`` and all probabilities.

        Terms meet their coefficients in a join and are summed per message and class.
        """
        counted = counted_terms(messages, context_mode)
        entries = tfidf.postings(
            tfidf.unit_vectors(counted, self.vocab, ID, sublinear=True, key="position"), ID)
        n = self.regression.numClasses
        sums = entries.join(_margins(self.regression, messages.sparkSession), "position").groupBy(
            ID).agg(*[F.sum(F.col("weight") * F.get("coefficients", F.lit(i))).alias(f"m{i}")
                      for i in range(n)])
        shifts = self.regression.interceptVector.toArray().tolist()
        margins = F.array(*[F.coalesce(F.col(f"m{i}"), F.lit(0.0)) + F.lit(shifts[i])
                            for i in range(n)])
        scored = staged(messages.join(sums, ID, "left"), _margins=margins)
        powers = staged(scored, _powers=F.transform(
            "_margins", lambda m: F.exp(m - F.array_max("_margins"))))
        total = F.aggregate("_powers", F.lit(0.0), lambda a, p: a + p)
        names = F.array(*[F.lit(i) for i in lex.INTENTS])
        best = F.array_position("probabilities", F.array_max("probabilities")) - 1
        return (
            powers.withColumn("probabilities", F.transform("_powers", lambda p: p / total))
            .withColumn("predicted_intent", F.get(names, best.cast("int")))
            .withColumn("prediction_confidence", F.array_max("probabilities"))
            .select(*messages.columns, "predicted_intent", "probabilities",
                    "prediction_confidence"))

    def save(self, path: str) -> None:
        if isinstance(self.regression, TableRegression):
            self.regression.save(f"{path}/regression")
        else:
            self.regression.write().overwrite().save(f"{path}/regression")
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IntentModel":
        regression = TableRegression.load(spark, f"{path}/regression")
        return IntentModel(
            regression or LogisticRegressionModel.load(f"{path}/regression"),
            spark.read.parquet(f"{path}/vocabulary"))


def _weight_of_classes(weights: DataFrame) -> list[float]:
    """Weight of all rows of each class, up to the last one that occurs."""
    held = {r.intent: r.n * r.weight for r in weights.collect()}
    last = max(lex.INTENTS.index(i) for i in held)
    return [held.get(i, 0.0) for i in lex.INTENTS[:last + 1]]


def train_classifier(
    train: DataFrame, folder: str, max_iter: int = 2000, tol: float = 1e-4,
) -> IntentModel:
    """Fits the classifier on all labelled messages.

    Their vocabulary is whole. It is written to ``folder`` once: its rows get
    fixed positions that training, scoring and later runs share. The penalty equals C = 1
    over the summed loss. Coefficients too many for the driver are fitted in tables.
    """
    spark = train.sparkSession
    labelled = materialize(known_labels(train), "labelled")
    n = labelled.count()
    if n == 0:
        raise ValueError("no labelled rows to train on")
    counted = materialize(counted_terms(labelled), "training-terms")
    stored = materialize(tfidf.classifier_vocabulary(counted), "vocabulary")
    _placed(stored).write.mode("overwrite").parquet(folder)
    vocab = spark.read.parquet(folder)
    size = vocab.count()

    label = F.array_position(F.array(*[F.lit(i) for i in lex.INTENTS]), F.col("intent")) - 1
    weights = class_weights(labelled)
    weighted = labelled.select(ID, "intent").join(
        F.broadcast(weights.select("intent", "weight")), "intent").withColumn(
        "label", label.cast("double"))
    vectors = tfidf.unit_vectors(counted, vocab, ID, sublinear=True, key="position")
    rows = _with_entries(weighted, vectors, size)
    histogram = _weight_of_classes(weights)
    if size * len(histogram) > DRIVER_COEFFICIENTS and sum(w > 0 for w in histogram) > 1:
        entries = vocab.agg(F.sum("df")).first()[0]
        return IntentModel(fit(
            rows, size, entries, histogram, 1.0 / n, f"{folder}-coefficients", max_iter, tol), vocab)
    regression = LogisticRegression(
        family="multinomial", weightCol="weight", maxIter=max_iter, tol=tol, elasticNetParam=0.0,
        regParam=1.0 / n, standardization=False)
    parts = math.ceil(n / ROWS_PER_GRADIENT)
    return IntentModel(regression.fit(_as_features(rows).coalesce(parts)), vocab)


def bounded_rows(labelled: DataFrame, most: int, seed: int = 17) -> DataFrame:
    """At most ``most`` rows, for callers that want no more: those with the smallest hash of their id.

    Where the table has no more, it is left as it is; else the bound is found by counts.
    """
    if labelled.count() <= most:
        return labelled
    # In hex digits, the sign bit turned round, the hash sorts as the number does.
    mark = F.xxhash64(F.lit(seed), F.col(ID)).bitwiseXOR(F.lit(-(1 << 63)))
    return first_by_hash(labelled, most, F.lpad(F.hex(mark), 16, "0"), ID)
