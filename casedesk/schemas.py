"""Table schemas."""

from pyspark.sql import types as T

_S, _L, _D, _I, _B, _TS = (
    T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType(),
    T.TimestampType(),
)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


CONVERSATIONS = _schema(conv_id=_L, turn=_L, role=_S, text=_S)

TWEETS = _schema(
    tweet_id=_L, author_id=_S, inbound=_B, created_at=_TS, text=_S, in_response_to_tweet_id=_L)

REPLY_PAIRS = _schema(
    brand=_S, customer_tweet_id=_L, previous_context=_S, customer_message=_S, brand_tweet_id=_L,
    brand_reply=_S, created_at=_TS)

GOLDEN = _schema(
    customer_tweet_id=_L, previous_context=_S, customer_message=_S, brand_reply=_S, intent=_S,
    escalate=_S, label_reason=_S, review_status=_S)

# Columns an evaluation table must have.
EVALUATION_COLUMNS = (
    "customer_tweet_id", "previous_context", "customer_message", "intent", "escalate",
    "label_reason", "review_status",
)

# Fields of one judge verdict.
JUDGE_SCORES = (
    "relevance", "groundedness", "helpfulness", "brand_consistency", "safety", "overall")
JUDGE_VERDICT = _schema(
    **{name: _D for name in JUDGE_SCORES}, unsupported_claims=_B, major_issue=_S, reasoning=_S)

# One judged reply as kept in a CSV file.
JUDGE_RESULTS = _schema(
    customer_tweet_id=_L, customer_message=_S, intent=_S, confidence=_D, generated_reply=_S,
    escalate=_B, escalation_reason=_S, **{name: _D for name in JUDGE_SCORES},
    unsupported_claims=_B, major_issue=_S, reasoning=_S, human_reviewed=_S, human_intent=_S,
    human_escalate=_S)


def all_strings(columns) -> T.StructType:
    return T.StructType([T.StructField(name, _S, True) for name in columns])
