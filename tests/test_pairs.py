from datetime import datetime

from casedesk import schemas
from casedesk.operators import pairs, sampling
from casedesk.plans.workspace import Workspace

T0 = datetime(2024, 1, 1)


def tweets(spark):
    rows = [
        (1, "u1", True, T0, "first", None), (2, "A", False, T0, "reply one", 1),
        (3, "A", False, T0, "reply two", 1), (4, "u1", True, T0, "second", 2),
        (5, "B", False, T0, None, 4), (6, "B", False, T0, "late", 4),
        (7, "u2", True, T0, None, None), (8, "A", False, T0, "to nothing", 7),
        (9, "A", False, T0, "to a brand", 2), (10, "A", False, T0, "dangling", 99),
        (11, "A", False, T0, "open", None), (12, "u3", True, T0, "waiting", 99)]
    rows += [(100 + i, "A", False, T0, f"again {i}", 1) for i in range(500)]
    return spark.createDataFrame(rows, schemas.TWEETS)


def test_first_reply_then_null_drop(spark):
    found = pairs.reply_pairs(tweets(spark)).collect()
    assert [(r.brand, r.customer_tweet_id, r.brand_tweet_id, r.previous_context) for r in found] == [
        ("A", 1, 2, None)]


def test_last_reply_keeps_nulls(spark):
    found = pairs.conversation_pairs(tweets(spark)).orderBy("customer_tweet_id").collect()
    assert [(r.customer_tweet_id, r.brand_tweet_id) for r in found] == [(1, 599), (4, 6), (7, 8)]


def test_answered_and_open(spark):
    t = tweets(spark)
    assert sorted(r.tweet_id for r in pairs.answered_customers(t).collect()) == [1, 4, 7]
    assert sorted(r.tweet_id for r in pairs.answered_customers(t, "B").collect()) == [4]
    flags = {r.tweet_id: r.has_brand_response for r in pairs.with_answered_flag(t).collect()}
    assert flags == {1: True, 4: True, 7: True, 12: False}
    inbox = pairs.open_messages(t, pairs.reply_pairs(t)).collect()
    assert {(r.customer_tweet_id, r.previous_context) for r in inbox} == {(4, "reply one"), (12, None)}
    assert pairs.interactions(t).count() == 502 + 3


def test_sample_is_exact_and_split_disjoint(spark, small_dir):
    found = Workspace(spark, small_dir).pairs
    ids = lambda df: {r.customer_tweet_id for r in df.collect()}
    golden = sampling.golden_set(found, 10)
    assert len(ids(golden)) == 10
    assert ids(golden) == ids(sampling.golden_set(found.repartition(7), 10))
    assert ids(golden) != ids(sampling.golden_set(found, 10, seed=7))
    rest = ids(sampling.without(found, golden))
    assert not rest & ids(golden) and rest | ids(golden) == ids(found)
