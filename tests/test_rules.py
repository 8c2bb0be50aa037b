import pytest
from pyspark.sql import functions as F

from casedesk.functions import escalation, lexicons as lex, rules


def silver(spark, texts, **options):
    df = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)],
                               "id long, previous_context string, customer_message string")
    rows = rules.with_silver_intent(df, **options).orderBy("id").collect()
    return [r.intent for r in rows]


def test_first_rule_wins_and_shadowed_terms_stay_dead(spark):
    assert silver(spark, [
        "my charge is gone",            # payments before battery
        "closing apps all day",         # apps before performance
        "a feature request",            # settings before feedback
        "i wish apple would listen",    # "app" inside "apple"
        "nothing to see", "", None,
    ]) == ["payments_billing", "apps_media", "settings_features", "apps_media",
           "other_unclear", "other_unclear", "other_unclear"]


def test_links_and_mentions_do_not_label(spark):
    assert silver(spark, ["@battery hi", "http://battery.example", "www.refund.example x"]) == [
        "other_unclear"] * 3


def test_substrings_match_unless_words_are_asked_for(spark):
    assert silver(spark, ["a simple thing"]) == ["connectivity_network"]
    assert silver(spark, ["a simple thing", "my sim"], match="word") == [
        "other_unclear", "connectivity_network"]


def test_reduced_terms_match_the_same_texts():
    for _, terms in lex.SILVER_RULES:
        kept = rules.needed_terms(terms)
        assert all(any(k in t for k in kept) for t in terms)


def test_the_three_lexicons_disagree_where_expected(spark):
    df = spark.createDataFrame([("", "charge the screen")], "previous_context string, customer_message string")
    row = rules.with_baseline_intent(rules.with_proposed_labels(df)).first()
    assert (row.auto_intent, row.keyword_prediction) == ("hardware_repair", "battery_power")
    assert (row.auto_intent_number, row.auto_escalate, row.confidence) == (8, "yes", "medium")


# Cases of the escalation policy with the outcome its rules give.
CASES = [
    ("battery_power", 0.91, "since monday the charge is gone by noon", "first_line", False),
    ("device_performance", 0.5, "every few minutes it keeps restarting by itself", "restart_loop", True),
    ("connectivity_network", 0.85, "at home the signal drops in the kitchen", "first_line", False),
    ("account_icloud", 0.3, "the backup in the cloud is a week old", "account_routine", False),
    ("payments_billing", 0.75, "the bill lists one song and i was charged twice", "finance_risk", True),
    ("messaging_calls", 0.5, "since lunch i cannot make calls to anybody", "call_failure", True),
    ("settings_features", 0.25, "where do i change the ring tone", "first_line", False),
    ("device_performance", 0.35, "on the train it keeps rebooting", "restart_loop", True),
    ("account_icloud", 0.7, "how do i change the name on the account", "account_routine", False),
    ("other_unclear", 0.25, "well, hm", "unclear", True),
    ("other_unclear", 0.25, "let a real person answer this", "human_request", True),
    ("payments_billing", 0.9, "i lost my photos", "finance_routine", False),
    ("battery_power", 0.9, "i lost my photos", "data_loss", True),
    ("other_unclear", None, None, "unclear", True),
    ("battery_power", 0.9, "the managers are kind", "first_line", False),
]


def test_escalation_policy(spark):
    df = spark.createDataFrame(
        [(i, *case[:3]) for i, case in enumerate(CASES)],
        "id int, intent string, confidence double, customer_message string")
    rows = escalation.with_escalation(df).orderBy("id").collect()
    assert [(r.escalation_rule, r.escalate) for r in rows] == [case[3:] for case in CASES]
    assert all(r.escalation_reason == escalation.REASONS[r.escalation_rule] for r in rows)


def test_curly_apostrophe_matches_only_on_request(spark):
    df = spark.createDataFrame([("battery_power", 0.9, "it won’t turn on")],
                               "intent string, confidence double, customer_message string")
    assert not escalation.with_escalation(df).first().escalate
    assert escalation.with_escalation(df, normalize_quotes=True).first().escalate


@pytest.mark.parametrize("flag,expected", [
    ("yes", True), (" Yes ", True), ("true", True), ("1", True), ("no", False), (None, False)])
def test_yes_flags(spark, flag, expected):
    df = spark.createDataFrame([(flag,)], "flag string")
    assert df.select(escalation.is_yes(F.col("flag"))).first()[0] is expected
