"""The given tables, and the tweet table derived from the conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Support phrases put in front of the invented prose, which has none of its own.
CUSTOMER_OPENINGS = (
    "@AcmeHelp my battery drains so fast after the update https://t.co/a1 ",
    "@AcmeHelp wifi keeps dropping, no service on my sim card ",
    "@AcmeHelp i was charged twice, want a refund ",
    "@AcmeHelp locked out of my icloud account, forgot password ",
    "@AcmeHelp cracked glass, need a repair under warranty ",
    "@AcmeHelp phone keeps restarting and is slow ",
    "@AcmeHelp cannot make calls or send sms ",
    "@AcmeHelp music will not play on this thing ",
    "@AcmeHelp how do i update to the newest version? ",
    "@AcmeHelp keyboard shows odd symbols ",
    "@AcmeHelp i have a suggestion for you ",
    "@AcmeHelp let me speak to a human now ",
    "@AcmeHelp lost my photos, data is gone ",
    "ok",
    "@AcmeHelp connect me with support, everything disappeared ",
    "@AcmeHelp thanks that is all ",
)
SHORT_MESSAGE = "ok"
BRAND_OPENINGS = (
    "Please DM us your iOS version and which device you use. ",
    "Try these steps: this page should help. ",
    "Which model is it? Let us know. ",
    "We are looking into it. ",
)
FOLLOW_UP = "Following up. "
# Brand by last digit of the conversation number.
BRANDS = ("AcmeHelp",) * 4 + ("BoltCare",) * 3 + ("CirrusHelp",) * 2 + ("DeltaDesk",)

# Turns of one conversation share a block of ids this wide.
ID_BLOCK = 4_000_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def tweets_from_conversations(conversations: DataFrame) -> DataFrame:
    """Tweets made of the spoken turns: a plain projection, so it also runs on a stream.

    A turn answers the turn before it. User turns become inbound tweets, assistant
    turns brand replies; some replies come twice, some without text.
    """
    turn_id = F.col("conv_id") * ID_BLOCK + F.col("turn") * 2
    inbound = F.col("role") == "user"
    opening = _pick((F.col("conv_id") * 7 + F.col("turn") * 3) % 16, CUSTOMER_OPENINGS)
    customer_text = F.when(opening == SHORT_MESSAGE, opening).otherwise(
        F.concat(opening, F.col("text")))
    brand_text = F.when(F.col("conv_id") % 17 != 3, F.concat(
        _pick((F.col("conv_id") + F.col("turn")) % 4, BRAND_OPENINGS), F.col("text")))
    copies = F.when(~inbound & (F.col("turn") % 5 == 1), F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))
    turns = conversations.filter(F.col("role").isin("user", "assistant")).select(
        turn_id.alias("turn_id"),
        F.when(inbound, (F.col("conv_id") + 100000).cast("string"))
        .otherwise(_pick(F.col("conv_id") % 10, BRANDS)).alias("author_id"),
        inbound.alias("inbound"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("conv_id") * 60 + F.col("turn")) * 60)
        .alias("created_at"),
        F.when(inbound, customer_text).otherwise(brand_text).alias("body"),
        F.when(F.col("turn") > 0, turn_id - 2).alias("in_response_to_tweet_id"),
        F.explode(copies).alias("copy"),
    )
    return turns.select(
        (F.col("turn_id") + F.col("copy")).alias("tweet_id"),
        "author_id",
        "inbound",
        "created_at",
        F.when(F.col("copy") == 0, F.col("body"))
        .otherwise(F.concat(F.lit(FOLLOW_UP), F.coalesce("body", F.lit("")))).alias("text"),
        "in_response_to_tweet_id",
    )


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tweets_from_conversations(read_table(spark, sf_dir, "conversations"))
