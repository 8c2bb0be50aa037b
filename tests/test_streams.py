"""Streams with state: verdicts that come late and twice, context that comes on the stream."""

import pytest
from pyspark.sql import functions as F

from casedesk.operators import judging
from casedesk.plans import catalog, fixtures
from casedesk.plans.workspace import Workspace
from casedesk.streaming import context, triage, verdicts


@pytest.fixture(scope="module")
def workspace(spark, small_dir):
    return Workspace(spark, small_dir)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def land(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_late_and_repeated_verdicts(spark, workspace, tmp_path):
    responses = fixtures.judge_responses(workspace.pairs)
    want = rows(judging.latest(judging.parse_verdicts(responses), "batch"))
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    odd = F.col("customer_tweet_id") % 8 == 0
    # Second answers first, then late first answers, then all of them once more.
    for part in (responses.where((F.col("batch") == 1) & odd), responses.where("batch = 0"),
                 responses.where(F.col("batch") == 1), responses):
        land(part, folder)

    def run():
        stream = (spark.readStream.schema(responses.schema).option("maxFilesPerTrigger", 1)
                  .parquet(folder))
        verdicts.start_verdicts(stream, out, state, run="batch").awaitTermination()
        found = verdicts.current(spark, out, "batch", responses.schema["batch"].dataType)
        return rows(found.select(judging.ID, "batch", *[
            c for c in found.columns if c not in (judging.ID, "batch")]))

    assert run() == want
    land(responses.where("batch = 0"), folder)
    assert run() == want
    verdicts.compact(spark, out, str(tmp_path / "compact"), "batch", responses.schema["batch"].dataType)
    again = verdicts.current(spark, str(tmp_path / "compact"), "batch", responses.schema["batch"].dataType)
    assert again.count() == len(want)


def test_judging_stops_in_mid_run_and_goes_on(spark, workspace, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    messages = workspace.pairs.select("customer_tweet_id")
    for k in range(3):
        land(messages.where(F.pmod("customer_tweet_id", F.lit(3)) == k), folder)
    land(messages, folder)  # all of them again
    asked, broken = [], []

    def judge(todo):
        asked.append(sorted(r[0] for r in todo.collect()))
        if len(asked) == 2 and not broken:
            broken.append(True)
            raise OSError("the service is gone")
        return todo.withColumn("raw", F.lit('{"overall": 4}'))

    def run():
        stream = (spark.readStream.schema("customer_tweet_id long")
                  .option("maxFilesPerTrigger", 1).parquet(folder))
        verdicts.start_judging(stream, judge, out, state).awaitTermination()

    with pytest.raises(Exception, match="gone"):
        run()
    assert verdicts.current(spark, out).count() == len(asked[0])
    run()
    everyone = sorted(r[0] for r in messages.collect())
    assert asked[1] == asked[2] and asked[-1] == []
    assert sorted(asked[0] + asked[2] + asked[3]) == everyone
    kept = verdicts.current(spark, out)
    assert sorted(r.customer_tweet_id for r in kept.collect()) == everyone
    assert verdicts.segments(spark, out).count() == len(everyone)


def test_a_segment_written_before_the_crash_is_not_lost(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    land(spark.range(5).withColumnRenamed("id", "customer_tweet_id"), folder)
    judge = lambda todo: todo.withColumn("raw", F.lit('{"overall": 4}'))
    stream = spark.readStream.schema("customer_tweet_id long").parquet(folder)
    verdicts.start_judging(stream, judge, out, state).awaitTermination()
    # The crash came after the write, before the batch was committed.
    commits = tmp_path / "state" / "commits"
    for path in (commits / "0", commits / ".0.crc"):
        path.rename(tmp_path / path.name.strip("."))
    verdicts.start_judging(stream, judge, out, state).awaitTermination()
    assert verdicts.current(spark, out).count() == 5


def test_broken_verdicts_are_asked_again(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    ids = spark.range(4).withColumnRenamed("id", "customer_tweet_id")
    land(ids, folder)
    land(ids, folder)
    calls = []

    def judge(todo):
        calls.append(todo.count())
        raw = F.when((F.col("customer_tweet_id") % 2 == 0) | F.lit(len(calls) > 1), '{"overall": 4}')
        return todo.withColumn("raw", raw.otherwise("no answer"))

    stream = (spark.readStream.schema("customer_tweet_id long").option("maxFilesPerTrigger", 1)
              .parquet(folder))
    verdicts.start_judging(stream, judge, out, state).awaitTermination()
    assert calls == [4, 2]
    assert verdicts.current(spark, out).where("parse_ok").count() == 4


ORDERS = {"together": [["parents", "answers"]], "parents first": [["parents"], ["answers"]],
          "answers first": [["answers"], ["parents"]]}


@pytest.mark.parametrize("order", ORDERS)
def test_context_from_the_stream(spark, workspace, tmp_path, order):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    tweets = workspace.tweets
    # Parents that never come leave their answers without context.
    missing = (F.col("tweet_id") / 4_000_000_000) % 7 < 1
    tweets = tweets.where(~(missing & ~F.col("inbound")))
    sides = {"parents": tweets.where("not inbound"), "answers": tweets.where("inbound")}
    want = rows(triage.triage(tweets, tweets))

    def run():
        stream = context.tweet_stream(spark, folder, files_per_batch=1)
        context.start_triage(stream, out, state, "400 days").awaitTermination()
        return rows(spark.read.parquet(out))

    for n, step in enumerate(ORDERS[order]):
        part = sides[step[0]]
        for name in step[1:]:
            part = part.unionByName(sides[name])
        land(part, folder)
        found = run()  # a restart between the files
        assert len(found) <= len(want) and set(found) <= set(want)
    land(context.heartbeat(spark), folder)
    assert run() == want


@pytest.mark.parametrize("parts", [1, 3])
def test_conversations_in_part_files_are_triaged(spark, tmp_path, parts):
    table = spark.createDataFrame(
        [(c, t, r, f"my battery drains {c}") for c in range(6)
         for t, r in enumerate(("user", "assistant", "user"))] + [(None, 0, "user", None)],
        "conv_id long, turn long, role string, text string")
    table.repartition(parts).write.parquet(str(tmp_path / "conversations.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "other.parquet"))
    found = catalog.queries()["stream_triage"](spark, str(tmp_path))
    tweets = Workspace(spark, str(tmp_path)).tweets
    assert rows(found) == rows(triage.triage(tweets, tweets)) and found.count() == 12
