"""Evaluate-once columns and work-heavy partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows hash-partitioned by key over all shuffle partitions.

    Meant in front of steps whose work far exceeds their input: adaptive execution
    would merge such partitions by their bytes and leave most cores idle.
    """
    session = df.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")),
            session.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns so that each is computed once per row.

    A plain projection may be merged into later steps and pushed into filters, which
    repeats a long rule chain or a sort inside every expression that reads it. A
    generator over one struct keeps the work in the row and cannot be merged.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))
