import json

from casedesk.operators import judging

VERDICT = {"relevance": 4, "groundedness": 5, "helpfulness": 3, "brand_consistency": 5,
           "safety": 5, "overall": 4, "unsupported_claims": False, "major_issue": "",
           "reasoning": 'says "{hi}"\nand more'}
BODY = json.dumps(VERDICT)
RESPONSES = [
    (1, BODY, True), (2, f"```json\n{BODY}\n```", True), (3, f"```\n{BODY}```", True),
    (4, f"Sure! {BODY} Bye.", True), (5, BODY[:40], False), (6, "", False), (7, None, False),
    (8, '{"relevance": 4,, }', False)]
FORMS = [('{"overall": 4.0}', 4.0), ('{"overall": "4"}', 4.0), ('{"overall": 4.5}', 4.5),
         ('{"overall": null}', None), ('{"overall": "good"}', None), ('{}', None)]


def test_numbers_of_any_form(spark):
    df = spark.createDataFrame([(i, f[0]) for i, f in enumerate(FORMS)],
                               "customer_tweet_id long, raw string")
    rows = judging.parse_verdicts(df).orderBy("customer_tweet_id").collect()
    assert [(r.parse_ok, r.overall) for r in rows] == [(True, f[1]) for f in FORMS]


def test_parse(spark):
    df = spark.createDataFrame([r[:2] for r in RESPONSES], "customer_tweet_id long, raw string")
    rows = judging.parse_verdicts(df).orderBy("customer_tweet_id").collect()
    assert [r.parse_ok for r in rows] == [r[2] for r in RESPONSES]
    for row in rows:
        assert (row.overall, row.reasoning) == ((4, VERDICT["reasoning"]) if row.parse_ok else (None, None))


def test_latest_merged_and_pending(spark):
    schema = "customer_tweet_id long, overall int"
    old = spark.createDataFrame([(1, 3), (2, 4)], schema)
    new = spark.createDataFrame([(2, 5), (3, None)], schema)
    both = {r.customer_tweet_id: r.overall for r in judging.merged(old, new).collect()}
    assert both == {1: 3, 2: 5, 3: None}
    golden = spark.createDataFrame([(1,), (9,)], "customer_tweet_id long")
    assert [r[0] for r in judging.pending(golden, old).collect()] == [9]


def test_summary_leaves_out_missing_scores(spark):
    df = spark.createDataFrame([("4",), ("5",), ("2",), (None,), ("x",), ("0",)], "overall string")
    row = judging.judge_summary(df).first()
    assert (row.n_judged, row.mean_overall, row.share_high) == (3, 3.666667, 0.666667)


def test_requests_hold_three_cases_at_most(spark):
    case = "struct<rank:int,customer_message:string,brand_reply:string>"
    df = spark.createDataFrame(
        [(1, "m", None, "battery_power", "r", [(i, f"c{i}", f"b{i}") for i in range(1, 6)]),
         (2, "m", "ctx", "battery_power", "r", None)],
        "customer_tweet_id long, customer_message string, previous_context string, "
        f"predicted_intent string, generated_reply string, evidence array<{case}>")
    rows = {r.customer_tweet_id: json.loads(r.payload) for r in judging.judge_requests(df).collect()}
    text = rows[1]["contents"][0]["parts"][0]["text"]
    assert "--- Case 3 ---\nCustomer: c3\nReply: b3" in text and "Case 4" not in text
    assert rows[1]["generationConfig"] == {"temperature": 0, "responseMimeType": "application/json"}
    assert "CONTEXT:\nctx" in rows[2]["contents"][0]["parts"][0]["text"]
