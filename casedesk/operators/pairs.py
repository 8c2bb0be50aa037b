"""Reply pairs: which brand tweet answers which customer tweet."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def brand_tweets(tweets: DataFrame, brand: str | None = None) -> DataFrame:
    """Tweets of one brand, or all outbound tweets."""
    return tweets.filter(F.col("author_id") == brand if brand else ~F.col("inbound"))


def _one_reply_each(tweets: DataFrame, brand: str | None, pick) -> DataFrame:
    """One brand reply per answered tweet.

    Replies are reduced before the join: the map side combines them, so a tweet with
    very many replies never meets in one task, and the join gets one row per key.
    """
    reply = F.struct(
        F.col("author_id").alias("brand"), F.col("tweet_id").alias("brand_tweet_id"),
        F.col("text").alias("brand_reply"))
    return (
        brand_tweets(tweets, brand)
        .filter(F.col("in_response_to_tweet_id").isNotNull())
        .groupBy(F.col("in_response_to_tweet_id").alias("customer_tweet_id"))
        .agg(pick(reply, "tweet_id").alias("reply"))
        .select("customer_tweet_id", "reply.*")
    )


def _customers(tweets: DataFrame) -> DataFrame:
    return tweets.filter("inbound").select(
        F.col("tweet_id").alias("customer_tweet_id"),
        F.col("text").alias("customer_message"),
        "created_at",
        F.col("in_response_to_tweet_id").alias("previous_tweet_id"))


def _with_context(messages: DataFrame, tweets: DataFrame) -> DataFrame:
    """Adds the text of the tweet a message answers, if there is one.

    Messages that answer nothing are many; they are spread by their own id instead of
    meeting in the one partition of the null key, and the condition keeps them unmatched.
    """
    context = tweets.select(
        F.col("tweet_id").alias("_context_id"), F.col("text").alias("previous_context"))
    key = F.coalesce("previous_tweet_id", "customer_tweet_id")
    match = (key == F.col("_context_id")) & F.col("previous_tweet_id").isNotNull()
    return messages.join(context, match, "left")


def reply_pairs(tweets: DataFrame, brand: str | None = None) -> DataFrame:
    """Customer message, its context and the first brand reply.

    The first reply is chosen before null texts are dropped: a customer tweet whose
    first reply has no text disappears, even when a later reply has one.
    """
    replies = _one_reply_each(tweets, brand, F.min_by).filter("brand_reply is not null")
    answered = _customers(tweets).filter("customer_message is not null").join(
        replies, "customer_tweet_id")
    return _with_context(answered, tweets).select(
        "brand", "customer_tweet_id", "previous_context", "customer_message",
        "brand_tweet_id", "brand_reply", "created_at")


def conversation_pairs(tweets: DataFrame, brand: str | None = None) -> DataFrame:
    """Customer message and the last brand reply; null texts are kept."""
    replies = _one_reply_each(tweets, brand, F.max_by)
    return _customers(tweets).join(replies, "customer_tweet_id").select(
        "brand", "customer_tweet_id", "customer_message", "brand_tweet_id", "brand_reply",
        "created_at")


def _answered_ids(tweets: DataFrame, brand: str | None) -> DataFrame:
    return (
        brand_tweets(tweets, brand)
        .select(F.col("in_response_to_tweet_id").alias("tweet_id"))
        .filter("tweet_id is not null").distinct()
    )


def answered_customers(tweets: DataFrame, brand: str | None = None) -> DataFrame:
    """Inbound tweets with at least one brand reply."""
    return tweets.filter("inbound").join(_answered_ids(tweets, brand), "tweet_id", "left_semi")


def with_answered_flag(tweets: DataFrame, brand: str | None = None) -> DataFrame:
    """Inbound tweets with ``has_brand_response``."""
    answered = _answered_ids(tweets, brand).withColumn("_hit", F.lit(True))
    return (
        tweets.filter("inbound").join(answered, "tweet_id", "left")
        .withColumn("has_brand_response", F.col("_hit").isNotNull()).drop("_hit")
    )


def open_messages(tweets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Customer messages without a usable pair, with their context: the agent's inbox."""
    waiting = (
        _customers(tweets).filter("customer_message is not null")
        .join(pairs.select("customer_tweet_id"), "customer_tweet_id", "left_anti")
    )
    return _with_context(waiting, tweets).select(
        "customer_tweet_id", "previous_context", "customer_message", "created_at")


def interactions(tweets: DataFrame, brand: str | None = None) -> DataFrame:
    """Brand replies whose parent is an inbound tweet, doubles included."""
    parents = tweets.filter("inbound").select(
        F.col("tweet_id").alias("in_response_to_tweet_id"))
    return (
        brand_tweets(tweets, brand).select("tweet_id", "in_response_to_tweet_id")
        .join(parents, "in_response_to_tweet_id")
    )
