"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources in code-point order (null last) weigh ``WEIGHTS`` in turn and share as many words as the
table has. A target above ``MAX_REPEATS`` times its source's words stops there; what is over is
shared anew by weight. Words are dealt out in blocks of ``BLOCK`` words: first to the sources, by
the highest quotients target / (2 k + 1), then by the same rule to a source's shards. What whole
blocks leave of a source's target is settled in words, so sources of a few words meet theirs too. A shard is a
hash bucket of its source's documents, read as one stream of words in seeded order. It gives whole
passes over its stream first and the rest as blocks picked by a seeded permutation, so a document
is taken as often as the blocks it lies in, and never more than ``MAX_REPEATS`` times.

A word is a run outside ``[\\x20\\x09-\\x0D]``. Null and empty texts have no words and are taken not
at all. Null ids and repeated rows are documents like others. A table without rows gives none.
Reruns agree, however the rows are dealt to tasks. The number of sources is a matter of
configuration: up to ``MAX_SOURCES`` are apportioned on the driver, more are an error.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from casedesk.llm.frames import fresh, named
from casedesk.session import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 32
SHARD_WORDS = 32_768
MAX_SHARDS = 1 << 20  # of one source, as many as one task apportions; beyond that shards grow
MAX_SOURCES = 1_000_000
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS,
            repeats: int = MAX_REPEATS) -> list[Fraction]:
    """Words each source shall give; ``sizes`` in the order of the sources."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[Fraction] = [Fraction(0)] * len(sizes)
    free, left = set(range(len(sizes))), Fraction(sum(sizes))
    while free and left:
        whole = sum(weight[i] for i in free)
        full = [i for i in free if left * weight[i] > repeats * sizes[i] * whole]
        if not full:
            for i in free:
                out[i] = left * weight[i] / whole
            break
        for i in full:
            out[i] = Fraction(repeats * sizes[i])
            free.remove(i)
        left -= sum(out[i] for i in full)
    return out


def sainte_lague(shares: list[Fraction] | np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients share / (2 k + 1); ties go to the earlier one.

    All seats above a divisor are dealt at once, the divisor being the least, found by halving, that
    deals no more than there are; the seats that are left lie on it and go by their quotients.
    """
    shares = np.asarray([float(s) for s in shares])
    got = np.zeros(len(shares), np.int64)
    if not seats or not shares.sum() > 0:
        return got
    low, high = 0.0, 2.1 * float(shares.max())
    for _ in range(80):
        middle = (low + high) / 2
        if np.floor(shares / middle + 0.5).sum() > seats:
            low = middle
        else:
            high = middle
    # A little above it, so that no quotient on the divisor is dealt by rounding.
    got = np.floor(shares / (high * (1 + 1e-12)) + 0.5).astype(np.int64)
    heap = [(-share / (2 * k + 1), i) for i, (share, k) in enumerate(
        zip(shares.tolist(), got.tolist(), strict=True)) if share > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-shares[i] / (2 * got[i] + 1), i))
    return got


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(sized: DataFrame, source: str, size: str, block: int) -> DataFrame:
    """(source, source_no, source_size, target, seats, n_shards) of every source."""
    spark = sized.sparkSession
    found = (sized.groupBy(named(source).alias("source")).agg(F.sum(size).alias("words"))
             .limit(MAX_SOURCES + 1).collect())
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.words for r in found]
    target = targets(sizes)
    seats = sainte_lague(target, round(sum(sizes) / block))
    rows = [(r.source, i, r.words, float(target[i]), int(seats[i]),
             max(1, min(MAX_SHARDS, -(-r.words // SHARD_WORDS)))) for i, r in enumerate(found)]
    plan = spark.createDataFrame(
        rows, "source string, source_no int, source_size long, target double, seats long, "
              "n_shards int")
    return F.broadcast(plan) if len(rows) <= BROADCAST_SOURCES else plan


def _quotas(block: int, seed: int):
    def apportion(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard").reset_index(drop=True)
        words = shards.words.to_numpy(np.int64)
        most = MAX_REPEATS * words // block
        seats = int(min(shards.seats.iloc[0], most.sum()))
        got = np.minimum(sainte_lague(words, seats), most)
        while got.sum() < seats:  # what full shards can't take goes to the others
            free = np.where(got < most, words, 0)
            got = np.minimum(got + sainte_lague(free, seats - int(got.sum())), most)
        take = got * block
        # The source's remainder in words: what whole blocks can't give, or gave too much.
        short = min(round(shards.target.iloc[0]), MAX_REPEATS * int(words.sum())) - int(take.sum())
        room = MAX_REPEATS * words - take if short > 0 else take
        before = np.cumsum(room) - room
        take = take + np.sign(short) * np.clip(abs(short) - before, 0, room)
        full = np.maximum(words // block, 1)
        rest = np.where(words > 0, take % np.maximum(words, 1), 0)
        step, shift = zip(*[_permutation(int(n), seed + i) for i, n in enumerate(full)])
        return pd.DataFrame({
            "source_no": shards.source_no, "shard": shards.shard,
            "passes": np.where(words > 0, take // np.maximum(words, 1), 0),
            "picked": rest // block, "piece": rest % block, "n_blocks": words // block,
            "step": step, "shift": shift})
    return apportion


def _permutation(n: int, seed: int) -> tuple[int, int]:
    """Step and shift of j -> (step * j + shift) mod n, a permutation of 0..n-1."""
    step = max(1, int(n * 0.6180339887498949)) % n or 1
    while gcd(step, n) != 1:
        step += 1
    return step, (seed * 2_654_435_761) % n


QUOTA = ("source_no int, shard int, passes long, picked long, piece long, n_blocks long, "
         "step long, shift long")


def placed(docs: DataFrame, source_col: str, id_col: str, seed: int, block: int, size: str,
           keep: list[Column]) -> DataFrame:
    """Rows with their place in the shard's stream and the shard's quota."""
    plan = source_plan(docs, source_col, size, block)
    src = named(source_col)
    mark = F.xxhash64(F.lit(seed), named(id_col), F.col(size))
    rows = (docs.withColumn("mix_mark", mark)
            .join(plan, src.cast("string").eqNullSafe(plan["source"]))
            .withColumn("shard", F.pmod("mix_mark", "n_shards").cast("int")))
    shards = (rows.groupBy("source_no", "shard")
              .agg(F.sum(size).alias("words"), F.first("seats").alias("seats"),
                   F.first("target").alias("target")))
    quotas = shards.groupBy("source_no").applyInPandas(_quotas(block, seed), QUOTA)
    order = Window.partitionBy("source_no", "shard").orderBy(
        F.xxhash64(F.lit(seed + 1), named(id_col)), named(id_col), F.col(size), *keep)
    at = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return rows.withColumn("mix_at", at).join(quotas, ["source_no", "shard"])


def _order(j: Column) -> Column:
    """Place of a block in the seeded order; the short block at the end comes last."""
    return F.when(j < F.col("n_blocks"),
                  (F.col("step") * j + F.col("shift")) % F.col("n_blocks")).otherwise(j)


def _picked_words(size: str, block: int) -> Column:
    """Words of the document in the picked blocks, beyond whole passes."""
    at, end = F.col("mix_at"), F.col("mix_at") + F.col(size)
    blocks = F.sequence(F.floor(at / block), F.floor((end - 1) / block))

    def more(total: Column, j: Column) -> Column:
        length = F.when(_order(j) < F.col("picked"), F.lit(block)).when(
            _order(j) == F.col("picked"), F.col("piece")).otherwise(F.lit(0)).cast("long")
        return total + F.greatest(
            F.lit(0), F.least(j * block + length, end) - F.greatest(j * block, at))

    return F.when(F.col(size) > 0, F.aggregate(blocks, F.lit(0).cast("long"), more)) \
        .otherwise(F.lit(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", seed: int = 7, block: int = BLOCK) -> DataFrame:
    """Per document: id, size, source_size, target, taken (words, repeats counted)."""
    sized = materialize(
        docs.select(named(id_col).alias("mix_id"),
                    named(source_col).cast("string").alias("mix_source"),
                    word_count(named(text_col).cast("string")).alias("mix_size")), "mix-sizes")
    rows = placed(sized, "mix_source", "mix_id", seed, block, "mix_size", [])
    taken = F.col("passes") * F.col("mix_size") + _picked_words("mix_size", block)
    return rows.select(F.col("mix_id").alias(id_col), F.col("mix_size").alias("size"),
                       "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", chars_col: str = "n_chars", seed: int = 7,
                    block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of ``docs``.

    A document comes once per whole pass, as it is, and once more with the words of its picked
    blocks joined by single spaces (as it is where all of them are picked). ``chars_col``, where
    there is such a column, is counted anew for shortened texts.
    """
    row, size = fresh(docs, "row", "size")
    src, ident = fresh(docs, "src", "ident")
    text = named(text_col).cast("string")
    sized = docs.select(F.struct(*[named(c) for c in docs.columns]).alias(row),
                        named(id_col).alias(ident), named(source_col).cast("string").alias(src),
                        word_count(text).alias(size))
    rows = placed(sized, src, ident, seed, block, size,
                  [F.xxhash64(F.col(row)[text_col])])
    part = _picked_words(size, block)
    whole = F.col("passes") + F.when(part == F.col(size), 1).otherwise(0)
    whole = F.when(F.col(size) > 0, whole).otherwise(F.lit(0)).cast("int")
    rows = rows.select(row, size, "mix_at", "n_blocks", "step", "shift", "picked", "piece",
                       whole.alias("mix_whole"),
                       F.when(part < F.col(size), part).otherwise(0).alias("mix_part"))
    full = (rows.where("mix_whole > 0")
            .select(row, F.explode(F.sequence(F.lit(1), F.col("mix_whole"))).alias("mix_copy"))
            .select(f"{row}.*"))
    words = F.regexp_extract_all(F.col(row)[text_col].cast("string"), F.lit(f"({WORD})"), 1)

    def chosen(word: Column, i: Column) -> Column:
        j = F.floor((F.col("mix_at") + i) / block)
        place = (F.col("mix_at") + i) - j * block
        return (_order(j) < F.col("picked")) | (
            (_order(j) == F.col("picked")) & (place < F.col("piece")))

    cut = F.array_join(F.filter(words, chosen), " ")
    short = rows.where("mix_part > 0").withColumn("mix_text", cut).select(*[
        F.col("mix_text").alias(c) if c == text_col
        else F.char_length("mix_text").cast(docs.schema[c].dataType).alias(c) if c == chars_col
        else F.col(row)[c].alias(c) for c in docs.columns])
    return full.unionByName(short)
