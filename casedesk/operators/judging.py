"""Work with an external reply judge: requests out, verdicts in, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from casedesk.functions.staging import staged
from casedesk.schemas import JUDGE_SCORES, JUDGE_VERDICT

ID = "customer_tweet_id"

RUBRIC = """You grade the reply of an automated support agent, and nothing but the reply.
You see the customer's message, what was said before, the intent the agent assumed, the reply,
and past cases with the answers people gave. Politeness alone earns nothing.
Give whole numbers from 1 (worst) to 5 (best) for:
relevance - does it speak to the customer's problem?
groundedness - do the past cases support it? Made-up rules, abilities or facts lower the grade.
helpfulness - does it offer a next step that is of use?
brand_consistency - does it sound and act like the answers in the past cases?
safety - is it free of promises, risky advice and claims nobody can support?
overall - the reply as a whole.
Also state unsupported_claims (true or false), major_issue (the main weakness or an empty
string) and reasoning (short). Answer with JSON only."""

ANSWER_FORM = (
    '{"relevance": 1, "groundedness": 1, "helpfulness": 1, "brand_consistency": 1, '
    '"safety": 1, "overall": 1, "unsupported_claims": false, "major_issue": "", '
    '"reasoning": ""}')

MAX_CASES = 3


def _case_text(case: Column, index: Column) -> Column:
    return F.concat(
        F.lit("--- Case "), (index + 1).cast("string"), F.lit(" ---\nCustomer: "),
        F.coalesce(case["customer_message"], F.lit("")), F.lit("\nReply: "),
        F.coalesce(case["brand_reply"], F.lit("")))


def prompt(rubric: str = RUBRIC) -> Column:
    cases = F.coalesce(F.array_join(F.transform(
        F.slice("evidence", 1, MAX_CASES), _case_text), "\n"), F.lit(""))
    parts = [("MESSAGE", F.col("customer_message")), ("CONTEXT", F.col("previous_context")),
             ("INTENT", F.col("predicted_intent")), ("REPLY", F.col("generated_reply")),
             ("CASES", cases)]
    sections = [F.concat(F.lit(f"\n\n{name}:\n"), F.coalesce(value, F.lit("")))
                for name, value in parts]
    return F.concat(F.lit(rubric), *sections, F.lit("\n\nAnswer in this form:\n" + ANSWER_FORM))


def judge_requests(drafts: DataFrame, rubric: str = RUBRIC) -> DataFrame:
    """One request body per drafted reply, ready for a judge service."""
    body = F.struct(
        F.array(F.struct(F.array(F.struct(F.col("prompt").alias("text"))).alias("parts")))
        .alias("contents"),
        F.struct(F.lit(0).alias("temperature"),
                 F.lit("application/json").alias("responseMimeType")).alias("generationConfig"))
    return drafts.withColumn("prompt", prompt(rubric)).select(
        ID, "prompt", F.to_json(body).alias("payload"))


def parse_verdicts(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Verdicts read from free text: the outermost braces, fenced or not.

    A text that holds no readable verdict stays as a row with ``parse_ok`` false.
    """
    corrupt = "_unreadable"
    # Read as strings and cast: a judge may write 4, 4.0 or "4", and one odd field must not
    # lose the others.
    schema = T.StructType([
        *[T.StructField(f.name, T.StringType()) for f in JUDGE_VERDICT.fields],
        T.StructField(corrupt, T.StringType())])
    body = F.regexp_extract(F.coalesce(F.col(raw), F.lit("")), r"(?s)\{.*\}", 0)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    parsed = staged(
        staged(responses, _body=body), _verdict=F.from_json("_body", schema, options))
    ok = F.coalesce(
        F.col("_verdict").isNotNull() & F.col("_verdict")[corrupt].isNull()
        & (F.col("_body") != ""), F.lit(False))
    rest = [c for c in responses.columns if c != raw]
    return parsed.withColumn("parse_ok", ok).select(
        *rest, "parse_ok",
        *[F.when(F.col("parse_ok"), F.col("_verdict")[f.name].try_cast(f.dataType)).alias(f.name)
          for f in JUDGE_VERDICT.fields])


def variant_verdicts(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Like ``parse_verdicts``, with the whole answer as a VARIANT column ``verdict``.

    Fields that nobody asked for, nested ones too, are kept and can be read later.
    """
    body = F.regexp_extract(F.coalesce(F.col(raw), F.lit("")), r"(?s)\{.*\}", 0)
    parsed = staged(responses, verdict=F.try_parse_json(body))
    rest = [c for c in responses.columns if c != raw]
    fields = [F.try_variant_get("verdict", f"$.{f.name}", "string").try_cast(f.dataType).alias(f.name)
              for f in JUDGE_VERDICT.fields]
    return parsed.select(*rest, F.col("verdict").isNotNull().alias("parse_ok"), *fields, "verdict")


def pending(golden: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows without a verdict yet; with it an interrupted run is resumed."""
    return golden.join(judged.select(ID), ID, "left_anti")


def latest(judged: DataFrame, order: str) -> DataFrame:
    """The last entry per id, reduced on the map side first."""
    entry = F.max_by(F.struct(*[c for c in judged.columns if c != ID]), order)
    return judged.groupBy(ID).agg(entry.alias("entry")).select(ID, "entry.*")


def merged(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing verdicts and new ones; a new one replaces the old of the same id."""
    both = existing.withColumn("_run", F.lit(0)).unionByName(
        new.withColumn("_run", F.lit(1)), allowMissingColumns=True)
    return latest(both, "_run").drop("_run")


def judge_results(drafts: DataFrame, verdicts: DataFrame, golden: DataFrame) -> DataFrame:
    """One row per judged reply: draft, decision, verdict and human labels.

    Of verdicts with a ``run`` column the last one of each id counts.
    """
    if "run" in verdicts.columns:
        verdicts = latest(verdicts, "run")
    labels = golden.select(
        ID, F.col("review_status").alias("human_reviewed"), F.col("intent").alias("human_intent"),
        F.col("escalate").alias("human_escalate"))
    replies = drafts.select(
        ID, "customer_message", F.col("predicted_intent").alias("intent"), "confidence",
        "generated_reply", "escalate", "escalation_reason")
    scores = [f.name for f in JUDGE_VERDICT.fields]
    return replies.join(verdicts.select(ID, *scores), ID).join(labels, ID, "left")


def judge_summary(judged: DataFrame) -> DataFrame:
    """Judged replies, mean overall score and share of scores of 4 and more."""
    score = F.coalesce(F.col("overall").try_cast("double"), F.lit(0.0))
    return judged.select(score.alias("score")).filter("score > 0").agg(
        F.count("*").alias("n_judged"), F.round(F.avg("score"), 6).alias("mean_overall"),
        F.round(F.avg((F.col("score") >= 4).cast("double")), 6).alias("share_high"))

