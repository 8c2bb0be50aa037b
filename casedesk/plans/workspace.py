"""The tables of one data folder, built on each other as lazy plans."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from casedesk.functions import rules
from casedesk.operators import (
    agent, classifier, evaluation, pairs, reply_quality, retrieval, sampling)
from casedesk.session import application_folder, materialize, run_folder, scratch, tidy
from casedesk.sources import tables
from casedesk.sources.versions import Versions, fingerprint

# Sizes of the working sample and of the evaluation sample drawn by the registered queries.
PAIR_SAMPLE = 10_000
GOLDEN_SIZE = 60
# Brands and pairs of the queries whose cut takes effect on small tables too.
LEADING_BRANDS = 2
POOL_SIZE = 20
MESSAGE = ("customer_tweet_id", "previous_context", "customer_message")


class Workspace:
    """Names for the steps from tweets to scored replies; nothing runs until asked for.

    Index, models and the tables that many steps read are versions in ``store``: made once for the
    conversations as they are, then loaded. Without a folder they last as long as the application.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, store: str | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.versions = Versions(spark, store or f"{application_folder(spark)}/versions")

    @cached_property
    def source(self) -> str:
        """Stands for the conversations and the sizes of the samples drawn from them."""
        return fingerprint(
            self.spark, [f"{self.sf_dir}/conversations.parquet"], GOLDEN_SIZE, PAIR_SAMPLE)

    def _table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        def write(path: str) -> None:
            df = build()
            with tidy(self.spark):
                df.write.option("compression", "zstd").parquet(path)

        path = self.versions.stored(name, self.source, write)
        return self.spark.read.parquet(path)

    @cached_property
    def tweets(self) -> DataFrame:
        return tables.tweets(self.spark, self.sf_dir)

    @cached_property
    def pairs(self) -> DataFrame:
        return pairs.reply_pairs(self.tweets)

    @cached_property
    def open_messages(self) -> DataFrame:
        """Messages without a usable answer: what the agent works on."""
        return pairs.open_messages(self.tweets, self.pairs)

    @cached_property
    def stored_pairs(self) -> DataFrame:
        """The pairs as files, for work that reads them several times."""
        return self._table("pairs", lambda: self.pairs)

    @cached_property
    def stored_open(self) -> DataFrame:
        return self._table(
            "open-messages", lambda: pairs.open_messages(self.tweets, self.stored_pairs))

    @cached_property
    def stored_golden(self) -> DataFrame:
        """The evaluation messages as files, without the replies they got."""
        return self._table("golden", lambda: sampling.golden_set(
            self.stored_pairs, GOLDEN_SIZE).select(*MESSAGE))

    @cached_property
    def inquiries(self) -> DataFrame:
        """All messages to be answered: the open ones and those of the evaluation set."""
        return self.stored_open.select(*MESSAGE).unionByName(self.stored_golden)

    @cached_property
    def golden(self) -> DataFrame:
        return sampling.golden_set(self.pairs, GOLDEN_SIZE)

    @cached_property
    def train(self) -> DataFrame:
        return sampling.without(self.pairs, self.golden)

    @staticmethod
    def labelled(messages: DataFrame) -> DataFrame:
        """Proposed labels taken as the labels to compare with."""
        return rules.with_proposed_labels(messages).select(
            "customer_tweet_id", "previous_context", "customer_message",
            F.col("auto_intent").alias("intent"), F.col("auto_escalate").alias("escalate"),
            F.col("auto_label_reason").alias("label_reason"),
            F.when(F.col("confidence") == "high", evaluation.HUMAN)
            .otherwise(evaluation.PROPOSED).alias("review_status"))

    @cached_property
    def labelled_pairs(self) -> DataFrame:
        return self.labelled(self.pairs)

    @cached_property
    def labelled_golden(self) -> DataFrame:
        return self.labelled(self.stored_golden)

    @staticmethod
    def rule_predictions(messages: DataFrame) -> DataFrame:
        """Rule intent and score in the place of model predictions."""
        return rules.with_silver_prediction(
            messages, "predicted_intent", "prediction_confidence")

    @cached_property
    def predicted(self) -> DataFrame:
        """Labelled pairs with the predictions of the silver rules.

        Reports read this and not the full evaluation table, so that each computes only
        what it shows.
        """
        return self.rule_predictions(self.labelled_pairs)

    @cached_property
    def index(self) -> retrieval.CaseIndex:
        """Index of the answered cases outside the evaluation set, loaded from its files."""
        path = self.versions.stored("case-index", self.source, lambda p: retrieval.save_index(
            self.stored_pairs, p, exclude=self.stored_golden))
        return retrieval.load_index(self.spark, path)

    @cached_property
    def similar(self) -> DataFrame:
        return retrieval.similar_cases(self.inquiries, self.index)

    @cached_property
    def answered(self) -> DataFrame:
        """Evaluation messages answered by the agent with rule predictions."""
        predictions = self.rule_predictions(self.stored_golden).select(
            "customer_tweet_id", "predicted_intent",
            F.col("prediction_confidence").alias("confidence"))
        return materialize(agent.answer(self.stored_golden, predictions, self.index), "answered")

    @cached_property
    def scored(self) -> DataFrame:
        """Reply evaluation of the evaluation set."""
        return reply_quality.grounding_scores(
            agent.reply_evaluation(self.answered, self.labelled_golden))

    def _trained(self, name: str, golden: Callable[[], DataFrame | None]) -> classifier.IntentModel:
        def train(path: str) -> None:
            with scratch(self.spark):
                rows = materialize(classifier.silver_train(self.stored_pairs, golden()).select(
                    *MESSAGE, "intent"), "silver-train")
                folder = f"{run_folder(self.spark, 'training')}/vocabulary"
                classifier.train_classifier(rows, folder).save(path)

        return classifier.IntentModel.load(
            self.spark, self.versions.stored(name, self.source, train))

    @cached_property
    def model(self) -> classifier.IntentModel:
        """Model for open messages, trained on the rule labels of all pairs."""
        return self._trained("intent-model", lambda: None)

    @cached_property
    def evaluated_model(self) -> classifier.IntentModel:
        """Model trained on the pairs outside the evaluation sample."""
        return self._trained("evaluated-model", lambda: self.stored_golden)

    @cached_property
    def model_predicted(self) -> DataFrame:
        """The labelled evaluation set with the predictions of a model that has not seen it."""
        return materialize(self.evaluated_model.predict(
            self.labelled(self.stored_golden), "merged").drop("probabilities"), "model-predicted")
