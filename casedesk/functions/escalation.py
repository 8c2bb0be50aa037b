"""Escalation policy: one ordered chain of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casedesk.functions import lexicons as lex
from casedesk.functions.rules import any_term
from casedesk.functions.staging import staged
from casedesk.functions.text import normalize

# Fixed value: an unclear message below this confidence goes to a person.
UNCLEAR_CONFIDENCE = 0.30

REASONS = {
    "human_request": "The customer asks for a person.",
    "finance_risk": "A money matter that may need a look into the account.",
    "finance_routine": "An everyday billing question that needs no person at first.",
    "account_risk": "An access or security matter that may need an identity check.",
    "account_routine": "An everyday account question that needs no person at first.",
    "hardware_risk": "A hardware fault that may need inspection, repair or replacement.",
    "hardware_routine": "A hardware question without clear need of a person.",
    "device_failure": "The device seems unusable and may need guided troubleshooting.",
    "restart_loop": "The device restarts again and again, a sign of a serious fault.",
    "widespread_failure": "Several parts of the system fail at once.",
    "call_failure": "Calling does not work at all and may need guided troubleshooting.",
    "data_loss": "Data may be lost, which needs care by a person.",
    "unclear": "The issue is too unclear to be handled automatically.",
    "first_line": "The issue suits automated first-line support.",
}


def escalation_rule(topic: Column, score: Column, text: Column) -> Column:
    """Name of the policy rule that decides the case, from normalised inputs.

    Billing, account and hardware messages are settled by their own rules and never
    reach the later ones.
    """

    def settled(label, terms, hit, miss):
        return topic == label, F.when(any_term(text, terms), hit).otherwise(miss)

    stages = [
        (any_term(text, lex.ESCALATION_HUMAN, "word"), F.lit("human_request")),
        settled("payments_billing", lex.ESCALATION_FINANCE, "finance_risk", "finance_routine"),
        settled("account_icloud", lex.ESCALATION_ACCOUNT, "account_risk", "account_routine"),
        settled("hardware_repair", lex.ESCALATION_HARDWARE, "hardware_risk", "hardware_routine"),
        (any_term(text, lex.ESCALATION_DEVICE), F.lit("device_failure")),
        (any_term(text, lex.ESCALATION_RESTART), F.lit("restart_loop")),
        ((topic == "device_performance") & any_term(text, lex.ESCALATION_WIDESPREAD),
         F.lit("widespread_failure")),
        ((topic == "messaging_calls") & any_term(text, lex.ESCALATION_CALLS),
         F.lit("call_failure")),
        (any_term(text, lex.ESCALATION_DATA_LOSS), F.lit("data_loss")),
        ((topic == lex.OTHER) & (score < UNCLEAR_CONFIDENCE), F.lit("unclear")),
    ]
    chain = F
    for condition, result in stages:
        chain = chain.when(condition, result)
    return chain.otherwise(F.lit("first_line"))


def escalates(rule: Column) -> Column:
    return ~rule.isin("finance_routine", "account_routine", "hardware_routine", "first_line")


def reason(rule: Column) -> Column:
    chain = F
    for name, sentence in REASONS.items():
        chain = chain.when(rule == name, F.lit(sentence))
    return chain


def with_escalation(
    df: DataFrame, intent="intent", confidence="confidence", message="customer_message",
    normalize_quotes: bool = False,
) -> DataFrame:
    """The table with ``escalation_rule``, ``escalate`` and ``escalation_reason``."""
    inputs = staged(
        df, _text=normalize(F.col(message), normalize_quotes), _topic=normalize(F.col(intent)),
        _score=F.coalesce(F.col(confidence).try_cast("double"), F.lit(0.0)))
    ruled = staged(
        inputs,
        escalation_rule=escalation_rule(F.col("_topic"), F.col("_score"), F.col("_text")))
    return ruled.withColumns({
        "escalate": escalates(F.col("escalation_rule")),
        "escalation_reason": reason(F.col("escalation_rule")),
    }).drop("_text", "_topic", "_score")


def is_yes(flag: Column) -> Column:
    """Escalation flag as a boolean: yes, true and 1 count, anything else does not."""
    return normalize(flag.cast("string")).isin("yes", "true", "1")
