"""The registered queries: each takes a session and a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from casedesk import schemas
from casedesk.functions import lexicons as lex
from casedesk.functions import rules
from casedesk.functions import text as tx
from casedesk.functions.escalation import with_escalation
from casedesk.operators import (
    agent, classifier, evaluation, judging, pairs, profile, replies, reply_quality, retrieval,
    review, rule_tables, sampling, sketches, term_log, tfidf)
from casedesk.plans import fixtures
from casedesk.plans.workspace import GOLDEN_SIZE, LEADING_BRANDS, PAIR_SAMPLE, POOL_SIZE, Workspace
from casedesk.session import materialize, run_folder
from casedesk.sources import split_csv
from casedesk.sources.files import ensure_string_columns, typed_columns, write_csv
from casedesk.streaming import context, triage, verdicts

ID = "customer_tweet_id"
# The brand of the one-brand queries.
BRAND = "AcmeHelp"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _rule_table_labels(w: Workspace) -> DataFrame:
    """The three rule sets, read from a table."""
    context, message = F.col("previous_context"), F.col("customer_message")
    lexicons = {"silver": lex.SILVER_RULES, "proposal": lex.PROPOSAL_RULES,
                "baseline": lex.BASELINE_RULES}
    texts = {"silver": tx.cleaned_context(context, message),
             "proposal": F.lower(tx.raw_context(context, message)),
             "baseline": F.lower(tx.merged_context(context, message))}
    return rule_tables.with_rule_labels(
        w.stored_pairs, rule_tables.rule_table(w.spark, lexicons), texts).select(ID, *texts)


def _rule_table_themes(w: Workspace) -> DataFrame:
    themes = rule_tables.rule_table(w.spark, {"themes": lex.THEMES})
    text = F.lower(tx.or_empty(F.col("customer_message")))
    return rule_tables.label_counts(w.stored_pairs, themes, text, "themes").withColumnRenamed(
        "label", "theme")


def _label_cube(w: Workspace) -> DataFrame:
    labelled = rules.with_proposed_labels(w.pairs).select(
        "brand", F.col("auto_intent").alias("intent"), "confidence",
        F.col("auto_escalate").alias("escalate"))
    return profile.label_cube(labelled, "brand", "intent", "confidence")


def _sketch_errors(w: Workspace) -> DataFrame:
    """Per brand: whether merged daily summaries are as close to the exact figures as they claim.

    Twice the bound is allowed to quantiles, and four standard errors to distinct counts.
    """
    length, author = F.length("text"), F.col("author_id")
    tweets = materialize(w.tweets.filter("text is not null").select(
        "inbound", F.to_date("created_at").alias("day"), "text", "author_id"), "tweets")
    daily = materialize(sketches.summaries(
        tweets, ["inbound", "day"], {"length": length}, {"authors": author}), "daily")
    whole = sketches.merged(daily, ["inbound"])
    errors = sketches.rank_errors(tweets, whole, ["inbound"], "length", length, [0.1, 0.25, 0.5, 0.75, 0.9])
    exact = tweets.groupBy("inbound").agg(F.countDistinct("author_id").alias("authors"))
    off = F.abs(sketches.estimated("authors") - F.col("authors")) / F.col("authors")
    return whole.join(errors, "inbound").join(exact, "inbound").select(
        "inbound", "n", (F.col("rank_error") <= 2 * sketches.rank_error()).alias("lengths_close"),
        (off <= 4 * sketches.distinct_error()).alias("authors_close"))


def _segment_term_stats(w: Workspace) -> DataFrame:
    """Statistics of the case index, from segments that were added, given again and compacted."""
    log = term_log.TermLog(w.spark, run_folder(w.spark, "term-log"), tx.STOP_WORDS)
    cases = retrieval.with_search_text(sampling.without(w.stored_pairs, w.stored_golden))
    middle = cases.agg(F.percentile_approx(ID, 0.5)).scalar()
    log.add(cases.filter(F.col(ID) <= middle), F.col("search_text"))
    log.compact()
    log.add(cases, F.col("search_text"))
    return _rounded(log.vocabulary(), "idf")


def _judge_variants(w: Workspace) -> DataFrame:
    responses = fixtures.judge_responses(w.golden)
    return judging.variant_verdicts(responses).drop("verdict")


def _csv_tweets(w: Workspace) -> DataFrame:
    """Tweets with line breaks in their texts, through a CSV file read in splits."""
    folder = run_folder(w.spark, "csv")
    text = F.concat("text", F.lit('\n"as written", once more\n'))
    write_csv(w.tweets.withColumn("text", text), folder)
    return typed_columns(split_csv.read_csv_strings(w.spark, folder), schemas.TWEETS)


def _stage_counts(w: Workspace) -> DataFrame:
    stored = w.stored_pairs
    golden = sampling.golden_set(stored, GOLDEN_SIZE)
    return profile.stage_counts({
        "tweets": w.tweets,
        "brand_tweets": pairs.brand_tweets(w.tweets),
        "interactions": pairs.interactions(w.tweets),
        "pairs": stored,
        "golden": golden,
        "train": sampling.without(stored, golden),
        "silver_train": classifier.silver_train(stored, golden),
    })


def _clean_messages(w: Workspace) -> DataFrame:
    return w.pairs.select(
        ID, tx.clean(F.col("previous_context")).alias("clean_context"),
        tx.clean(F.col("customer_message")).alias("clean_message"))


def _evaluation_text(w: Workspace) -> DataFrame:
    both = F.col("previous_context"), F.col("customer_message")
    return w.pairs.select(
        ID, tx.cleaned_context(*both).alias("cleaned"), tx.raw_context(*both).alias("raw"),
        tx.template_context(*both).alias("template"), tx.merged_context(*both).alias("merged"))


def _auto_label(w: Workspace) -> DataFrame:
    return rules.with_proposed_labels(w.pairs.drop("brand", "brand_tweet_id"))


def _escalation_decisions(w: Workspace) -> DataFrame:
    messages = w.rule_predictions(w.pairs.select(ID, "previous_context", "customer_message"))
    return with_escalation(messages, "predicted_intent", "prediction_confidence").select(
        ID, F.col("predicted_intent").alias("intent"),
        F.round("prediction_confidence", 6).alias("confidence"), "escalation_rule", "escalate",
        "escalation_reason")


def _silver_train(w: Workspace) -> DataFrame:
    return classifier.silver_train(w.stored_pairs, w.stored_golden)


def _tfidf_features(w: Workspace) -> DataFrame:
    train = _silver_train(w)
    return _rounded(tfidf.postings(classifier.training_vectors(train), ID), "weight")


def _evidence(w: Workspace) -> DataFrame:
    return retrieval.evidence_lists(retrieval.with_case_text(w.similar, w.index))


def _reply_patterns(w: Workspace) -> DataFrame:
    return replies.reply_patterns(_evidence(w)).drop("evidence")


def _evaluation_results(w: Workspace) -> DataFrame:
    return _rounded(
        evaluation.evaluation_results(w.predicted), "prediction_confidence").select(
        ID, "previous_context", "customer_message", "intent", "label_reason", "review_status",
        "predicted_intent", "prediction_confidence", "keyword_prediction",
        "majority_prediction", "actual_escalation", "predicted_escalation", "escalation_reason")


def _verdicts(w: Workspace) -> DataFrame:
    return judging.parse_verdicts(fixtures.judge_responses(w.golden))


def _first_verdicts(w: Workspace) -> DataFrame:
    return _verdicts(w).filter("batch = 0 and parse_ok")


def _judge_merged(w: Workspace) -> DataFrame:
    new = _verdicts(w).filter("batch = 1 and parse_ok").drop("batch", "parse_ok")
    return judging.merged(_first_verdicts(w).drop("batch", "parse_ok"), new)


def _judge_results(w: Workspace) -> DataFrame:
    return _rounded(
        judging.judge_results(w.answered, _first_verdicts(w), w.labelled_golden), "confidence")


def _reviewed(w: Workspace) -> DataFrame:
    proposed = ensure_string_columns(
        rules.with_proposed_labels(w.pairs), ["intent", "escalate", "label_reason"])
    return review.apply_reviews(proposed, fixtures.review_decisions(w.pairs)).select(
        ID, "auto_intent", "auto_escalate", "intent", "escalate", "label_reason",
        "review_status")


def _stream_triage(w: Workspace) -> DataFrame:
    """Runs the stream over the conversation files to its end and reads what it wrote."""
    folder = run_folder(w.spark, "triage")
    query = triage.start_triage(
        triage.conversation_stream(w.spark, w.sf_dir), w.tweets, f"{folder}/out",
        f"{folder}/state")
    query.awaitTermination()
    return w.spark.read.parquet(f"{folder}/out")


def _stream_session(w: Workspace) -> SparkSession:
    """A session whose streams keep their state in as many parts as there are cores.

    A part is a store of its own with files of its own in every micro-batch, and their number
    can't be changed later: Spark's default for shuffles is far too many here.
    """
    session = w.spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", w.spark.sparkContext.defaultParallelism)
    return session


def _land(df: DataFrame, folder: str) -> None:
    """Adds the rows to the files that a stream reads."""
    df.write.mode("append").parquet(folder)


def _stream_verdicts(w: Workspace) -> DataFrame:
    """Responses to all pairs, second ones first and some twice, read by a stream that restarts."""
    folder = run_folder(w.spark, "verdicts")
    responses = fixtures.judge_responses(w.stored_pairs)
    second = F.col("batch") == 1
    early = F.pmod("customer_tweet_id", F.lit(8)) == 0
    for parts in ([responses.filter(second & early), responses.filter(~second)],
                  [responses.filter(second)]):
        for part in parts:
            _land(part, f"{folder}/in")
        stream = _stream_session(w).readStream.schema(responses.schema).parquet(f"{folder}/in")
        verdicts.start_verdicts(
            stream, f"{folder}/out", f"{folder}/state", run="batch").awaitTermination()
    return verdicts.current(
        w.spark, f"{folder}/out", "batch", responses.schema["batch"].dataType)


def _stream_context(w: Workspace) -> DataFrame:
    """Triage of a stream that brings answers before what they answer, a restart in between."""
    folder = run_folder(w.spark, "context")
    tweets = materialize(w.tweets, "tweets")
    first, last = tweets.agg(
        F.unix_timestamp(F.min("created_at")), F.unix_timestamp(F.max("created_at"))).first()
    # As late as the table is long: no row of it may be dropped.
    late_by = f"{(last or 0) - (first or 0) + 1} seconds"
    for part in (tweets.filter("inbound"), tweets.filter("not inbound"), context.heartbeat(w.spark)):
        _land(part, f"{folder}/in")
        context.start_triage(
            context.tweet_stream(_stream_session(w), f"{folder}/in"), f"{folder}/out", f"{folder}/state",
            late_by).awaitTermination()
    return w.spark.read.parquet(f"{folder}/out")


def _intent_predictions(w: Workspace) -> DataFrame:
    return w.model.predict(w.stored_open).select(
        ID, "predicted_intent", F.round("prediction_confidence", 4).alias("confidence"))


def _intent_model_eval(w: Workspace) -> DataFrame:
    """Report of the trained model on the evaluation sample, which it has not seen."""
    return evaluation.intent_report(w.model_predicted)


def _agent_decisions(w: Workspace) -> DataFrame:
    predictions = w.model.predict(w.stored_open).select(
        ID, "predicted_intent", F.col("prediction_confidence").alias("confidence"))
    decisions = agent.agent_decisions(agent.answer(w.stored_open, predictions, w.index))
    return decisions.withColumn("evidence", F.to_json("evidence"))


QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {
    # tweets and pairs
    "brand_tweets": lambda w: pairs.brand_tweets(w.tweets),
    "brand_counts": lambda w: profile.brand_counts(w.tweets),
    "top_brands": lambda w: profile.top_brands(w.tweets),
    "dataset_profile": lambda w: profile.dataset_profile(w.tweets),
    "null_counts": lambda w: profile.null_counts(w.pairs),
    "stage_counts": _stage_counts,
    "reply_pairs": lambda w: w.pairs,
    "conversation_pairs": lambda w: pairs.conversation_pairs(w.tweets),
    "answered_customers": lambda w: pairs.answered_customers(w.tweets),
    "brand_pairs": lambda w: pairs.reply_pairs(w.tweets, brand=BRAND),
    "brand_customers": lambda w: pairs.answered_customers(w.tweets, brand=BRAND),
    "answered_flags": lambda w: pairs.with_answered_flag(w.tweets).select(
        "tweet_id", "has_brand_response"),
    "open_messages": lambda w: w.open_messages,
    "pair_sample": lambda w: sampling.exact_sample(w.pairs, PAIR_SAMPLE),
    "golden_set": lambda w: w.golden,
    "train_split": lambda w: w.train,
    # messages and labels
    "clean_messages": _clean_messages,
    "evaluation_text": _evaluation_text,
    "silver_intent": lambda w: rules.with_silver_intent(w.pairs).select(ID, "intent"),
    "silver_train": lambda w: _silver_train(w),
    "auto_label": _auto_label,
    "keyword_baseline": lambda w: rules.with_baseline_intent(w.pairs).select(
        ID, "keyword_prediction"),
    "escalation_decisions": _escalation_decisions,
    "intent_distribution": lambda w: profile.intent_distribution(
        _silver_train(w)),
    "label_distribution": lambda w: profile.label_distribution(
        _auto_label(w), ["auto_intent", "auto_escalate", "confidence"]),
    "message_length_stats": lambda w: profile.message_length_stats(w.pairs),
    "top_keywords": lambda w: profile.top_keywords(w.pairs),
    "theme_counts": lambda w: profile.theme_counts(w.pairs),
    "theme_examples": lambda w: profile.theme_examples(w.pairs),
    # retrieval and replies
    "term_stats": lambda w: _rounded(
        retrieval.build_index(w.stored_pairs, exclude=w.stored_golden).vocab, "idf"),
    "tfidf_features": _tfidf_features,
    "case_index": lambda w: _rounded(retrieval.index_postings(w.index), "weight"),
    "similar_cases": lambda w: w.similar,
    "reply_patterns": _reply_patterns,
    "draft_replies": lambda w: replies.draft_replies(w.inquiries, _evidence(w)).select(
        ID, "generated_reply", "retrieved_case_count"),
    "reply_flags": lambda w: reply_quality.with_reply_flags(w.answered).select(
        ID, *reply_quality.FLAG_COLUMNS, "reply_length_score"),
    "reply_similarity": lambda w: _rounded(
        reply_quality.reply_similarity(w.answered), "similarity"),
    "grounding_scores": lambda w: _rounded(w.scored, "historical_reply_similarity").select(
        ID, "grounding_score", "historical_reply_similarity"),
    "judge_queue": lambda w: _rounded(
        reply_quality.judge_queue(w.scored), "historical_reply_similarity"),
    "reply_quality_summary": lambda w: reply_quality.quality_summary(w.scored),
    "reply_quality_by_status": lambda w: reply_quality.quality_by_status(w.scored),
    # evaluation
    "evaluation_results": _evaluation_results,
    "label_status": lambda w: evaluation.label_status(w.labelled_pairs),
    "majority_baseline": lambda w: evaluation.majority_class(w.labelled_pairs),
    "accuracy_comparison": lambda w: evaluation.accuracy_comparison(
        rules.with_baseline_intent(w.predicted)),
    "classification_report": lambda w: evaluation.intent_report(w.predicted),
    "confusion_matrix": lambda w: evaluation.confusion_matrix(
        w.predicted, F.col("intent"), F.col("predicted_intent")),
    "escalation_report": lambda w: evaluation.escalation_report(
        evaluation.with_both_escalations(w.predicted)),
    "mistakes": lambda w: _rounded(evaluation.mistakes(w.predicted), "prediction_confidence"),
    "confidence_stats": lambda w: evaluation.confidence_stats(w.predicted),
    "confidence_coverage": lambda w: evaluation.confidence_coverage(w.predicted),
    # classifier and agent
    "class_weights": lambda w: classifier.class_weights(
        _silver_train(w)),
    "intent_predictions": _intent_predictions,
    "intent_model_eval": _intent_model_eval,
    "model_accuracy": lambda w: evaluation.accuracy_comparison(
        rules.with_baseline_intent(w.model_predicted)),
    "model_results": lambda w: _rounded(
        evaluation.evaluation_results(w.model_predicted), "prediction_confidence"),
    "model_mistakes": lambda w: _rounded(
        evaluation.mistakes(w.model_predicted), "prediction_confidence"),
    "model_confidence_stats": lambda w: evaluation.confidence_stats(w.model_predicted),
    "model_confidence_coverage": lambda w: evaluation.confidence_coverage(w.model_predicted),
    "agent_decisions": _agent_decisions,
    # judge and review
    "judge_requests": lambda w: judging.judge_requests(w.answered),
    "judge_parsed": _verdicts,
    "judge_pending": lambda w: judging.pending(w.labelled_golden, _first_verdicts(w)).select(
        ID, "customer_message", "intent"),
    "judge_latest": lambda w: judging.latest(_verdicts(w), "batch"),
    "judge_merged": _judge_merged,
    "judge_results": _judge_results,
    "judge_summary": lambda w: judging.judge_summary(_first_verdicts(w)),
    "apply_reviews": _reviewed,
    # rules from tables, cubes, samples and files at size
    "rule_table_labels": _rule_table_labels,
    "rule_table_themes": _rule_table_themes,
    "label_cube": _label_cube,
    "leading_brands": lambda w: profile.top_brands(w.tweets, LEADING_BRANDS),
    "evaluation_pool": lambda w: sampling.first_by_hash(
        w.stored_pairs, POOL_SIZE, sampling.shuffle_key(ID), ID),
    "csv_tweets": _csv_tweets,
    "sketch_errors": _sketch_errors,
    "segment_term_stats": _segment_term_stats,
    "judge_variants": _judge_variants,
    "review_progress": lambda w: review.review_progress(_reviewed(w)),
    # streaming
    "stream_triage": _stream_triage,
    "stream_context": _stream_context,
    "stream_verdicts": _stream_verdicts,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: build(Workspace(spark, sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}
