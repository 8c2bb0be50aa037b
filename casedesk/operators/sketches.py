"""Mergeable summaries of values too many to be counted exactly: quantiles and distinct values.

A summary is kept per day and key; longer times, fewer keys and data that come later are merges of
what is stored, no row is read again. Quantiles (KLL) have a rank error of at most
``rank_error(k)`` with 99% probability, numbers of distinct values (HyperLogLog) a relative standard
error of ``distinct_error(lg)``, both whatever the number of rows or merges. The exact forms in
``profile`` and ``evaluation`` stay the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

K = 400  # size of a quantile summary
LG = 12  # binary logarithm of the registers of a distinct count


def rank_error(k: int = K) -> float:
    """Bound of the normalised rank error of one quantile, at 99% confidence."""
    return 2.296 / k ** 0.9021


def distinct_error(lg: int = LG) -> float:
    return 1.04 / 2 ** (lg / 2)


def summaries(
    rows: DataFrame, keys: list[str], values: dict[str, Column], distinct: dict[str, Column],
    k: int = K, lg: int = LG,
) -> DataFrame:
    """One row per combination of keys: n, a ``q_`` sketch per value, a ``d_`` sketch per distinct."""
    value_aggs = [F.kll_sketch_agg_double(v.cast("double"), F.lit(k)).alias(f"q_{name}")
                  for name, v in values.items()]
    distinct_aggs = [F.hll_sketch_agg(v, F.lit(lg)).alias(f"d_{name}")
                     for name, v in distinct.items()]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *value_aggs, *distinct_aggs)


def merged(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries put together over all other keys, from as many tables as were stored."""
    aggs = [F.sum("n").alias("n")]
    for name in stored.columns:
        if name.startswith("q_"):
            aggs.append(F.kll_merge_agg_double(name).alias(name))
        elif name.startswith("d_"):
            aggs.append(F.hll_union_agg(name).alias(name))
    return stored.groupBy(*keys).agg(*aggs)


def quantiles(table: DataFrame, name: str, ranks: list[float]) -> Column:
    """The values at some ranks, as an array."""
    return F.array(*[F.kll_sketch_get_quantile_double(f"q_{name}", F.lit(r)) for r in ranks])


def estimated(name: str) -> Column:
    """The number of distinct values."""
    return F.hll_sketch_estimate(f"d_{name}")


def rank_errors(rows: DataFrame, table: DataFrame, keys: list[str], name: str, value: Column,
                ranks: list[float]) -> DataFrame:
    """Per key the largest distance of an estimate's true rank range from the rank asked for."""
    asked = table.select(*keys, F.posexplode(quantiles(table, name, ranks)).alias("i", "estimate"))
    wanted = F.get(F.array(*[F.lit(r) for r in ranks]), F.col("i"))
    below = F.avg((F.col("value") < F.col("estimate")).cast("double"))
    upto = F.avg((F.col("value") <= F.col("estimate")).cast("double"))
    placed = (rows.select(*keys, value.cast("double").alias("value")).join(asked, keys)
              .groupBy(*keys, "i").agg(below.alias("below"), upto.alias("upto")))
    off = F.greatest(F.col("below") - wanted, wanted - F.col("upto"), F.lit(0.0))
    return placed.groupBy(*keys).agg(F.max(off).alias("rank_error"))
