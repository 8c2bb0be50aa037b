"""Ordered keyword rules as Spark expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from casedesk.functions import lexicons as lex
from casedesk.functions import text as tx
from casedesk.functions.staging import staged


def needed_terms(terms) -> list[str]:
    """Terms that do not hold another term of the list: the others can never matter."""
    return [t for t in terms if not any(o != t and o in t for o in terms)]


def any_term(text: Column, terms, match: str = "substring") -> Column:
    """True where a term occurs in the text.

    Substring search runs as a chain of ``contains``; it is several times faster in
    generated code than one regular expression with alternatives. ``match="word"``
    asks for whole words; the substring test then spares most rows the expression.
    """
    if match == "word":
        pattern = "|".join(re.escape(t) for t in terms)
        edge = r"[^\p{L}\p{N}_]"
        return any_term(text, terms) & text.rlike(f"(^|{edge})({pattern})({edge}|$)")
    return reduce(lambda a, b: a | b, [text.contains(t) for t in needed_terms(terms)])


def first_label(text: Column, rules, match: str = "substring") -> Column:
    """Label of the first rule with a term in the text, else ``other_unclear``."""
    chain = F
    for label, terms in rules:
        chain = chain.when(any_term(text, terms, match), F.lit(label))
    return chain.otherwise(F.lit(lex.OTHER))


def rule_score(text: Column, label: Column, rules) -> Column:
    """Evidence for a label in [0, 1): hits / (hits + 2) over the terms of its rule."""
    chain = F
    for name, terms in rules:
        hits = reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in terms])
        chain = chain.when(label == name, hits)
    hits = chain.otherwise(F.lit(0))
    return hits / (hits + 2)


def flags(text: Column, patterns) -> list[Column]:
    return [any_term(text, terms).alias(name) for name, terms in patterns]


def with_label(df: DataFrame, out: str, text: Column, rules, match: str = "substring") -> DataFrame:
    """The table with the rule label of a text.

    Text and label are staged: the text is cleaned once per row, not once per term,
    and a filter on the label does not run the rules again.
    """
    prepared = staged(df, _rule_text=text)
    return staged(prepared, **{out: first_label(F.col("_rule_text"), rules, match)}).drop(
        "_rule_text")


def with_silver_intent(df: DataFrame, out: str = "intent", match: str = "substring") -> DataFrame:
    text = tx.cleaned_context(F.col("previous_context"), F.col("customer_message"))
    return with_label(df, out, text, lex.SILVER_RULES, match)


def with_baseline_intent(df: DataFrame, out: str = "keyword_prediction") -> DataFrame:
    text = F.lower(tx.merged_context(F.col("previous_context"), F.col("customer_message")))
    return with_label(df, out, text, lex.BASELINE_RULES)


def with_silver_prediction(df: DataFrame, intent: str, score: str) -> DataFrame:
    """Silver label and its score of evidence, for use where no model is trained."""
    cleaned = tx.cleaned_context(F.col("previous_context"), F.col("customer_message"))
    text = F.col("_rule_text")
    labelled = staged(
        staged(df, _rule_text=cleaned), **{intent: first_label(text, lex.SILVER_RULES)})
    return labelled.withColumn(
        score, rule_score(text, F.col(intent), lex.SILVER_RULES)).drop("_rule_text")


def intent_number(intent: Column) -> Column:
    """Place of the intent in the list, from 1."""
    return F.array_position(F.array(*[F.lit(i) for i in lex.INTENTS]), intent).cast("int")


def intent_of_number(number: Column) -> Column:
    """Intent at the place, null outside the list."""
    return F.get(F.array(*[F.lit(i) for i in lex.INTENTS]), number - 1)


def proposed_escalation(full_text: Column, intent: Column) -> Column:
    risky = (
        any_term(full_text, lex.PROPOSAL_RISK_TERMS)
        | intent.isin(*lex.PROPOSAL_RISK_INTENTS)
        | ((intent == "device_performance")
           & any_term(full_text, lex.PROPOSAL_PERFORMANCE_TERMS))
    )
    return F.when(risky, F.lit("yes")).otherwise(F.lit("no"))


# What a proposed label says about the message.
LABEL_REASONS = (
    ("software_update", "The message is about a software update or a version."),
    ("battery_power", "The message is about battery, charging or power."),
    ("device_performance", "The message is about a slow or unstable device."),
    ("connectivity_network", "The message is about Wi-Fi, Bluetooth, mobile network or SIM."),
    ("messaging_calls", "The message is about calls or messages."),
    ("apps_media", "The message is about apps, media or the camera."),
    ("account_icloud", "The message is about an account, sign-in or cloud storage."),
    ("hardware_repair", "The message is about hardware, repair or warranty."),
    ("payments_billing", "The message is about a payment, a charge or a refund."),
    ("settings_features", "The message is about a setting or a feature."),
    ("feedback_request", "The message is feedback or asks for a feature."),
    ("other_unclear", "The message and its context leave the intent open."),
)
ESCALATED_REASON = " A person should take over: it may need service, account or money action."


def label_reason(intent: Column, escalate: Column) -> Column:
    chain = F
    for label, sentence in LABEL_REASONS:
        chain = chain.when(intent == label, F.lit(sentence))
    return F.concat(
        chain, F.when(escalate == "yes", F.lit(ESCALATED_REASON)).otherwise(F.lit("")))


def proposal_confidence(full_text: Column, intent: Column) -> Column:
    strong = reduce(lambda a, b: a | b, [
        (intent == label) & any_term(full_text, terms) for label, terms in lex.STRONG_TERMS])
    return F.when(strong, F.lit("high")).otherwise(F.lit("medium"))


def with_proposed_labels(df: DataFrame) -> DataFrame:
    """Proposed intent, escalation, reason and confidence band, ready for review."""
    text, intent = F.col("_full_text"), F.col("auto_intent")
    full_text = F.lower(tx.raw_context(F.col("previous_context"), F.col("customer_message")))
    labelled = staged(
        staged(df, _full_text=full_text), auto_intent=first_label(text, lex.PROPOSAL_RULES))
    return (
        labelled.withColumns({
            "auto_intent_number": intent_number(intent),
            "auto_escalate": proposed_escalation(text, intent),
            "confidence": proposal_confidence(text, intent),
            "review_status": F.lit("REVIEW"),
        })
        .withColumn("auto_label_reason", label_reason(intent, F.col("auto_escalate")))
        .drop("_full_text")
    )
