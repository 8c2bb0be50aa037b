"""Packing of token sequences by length patterns fitted with non-negative least squares.

Every document becomes its token ids and one end id. Documents longer than a sequence are cut into
full pieces, with the shorter one first. The lengths of all pieces make a histogram of at most
``capacity`` counts, which is all that the planner sees, so it runs on the driver at any scale:

1. patterns of one to three lengths that fill a sequence are enumerated;
2. non-negative least squares fits how often each is repeated to the histogram;
3. the repeats are rounded down, and what they take is subtracted;
4. the residual counts are packed best-fit: the longest left first, then whatever fills the rest
   exactly with one or two pieces, else the longest that fits.

The plan is a list of patterns with repeats. Pieces get a rank among those of their length (counted
per length and salt, so a length shared by a third of all pieces is spread), and the plan maps
ranks to sequence and offset. Its size depends on ``capacity`` only.

A null text is an empty one: its piece is the end id alone. Nulls as ids and repeated rows are
packed like all others; ties of rank are between equal rows or broken by their ids' checksum. A
table without rows gives none.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from casedesk.llm.frames import batch, named, sliced
from casedesk.session import materialize

CAPACITY = 2048
END = 0
SALT_ROWS = 200_000  # pieces of one salt over all lengths, at most a few of one rank window
MOST_PATTERNS = 24_000
STEPS = 400

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())])


# --- tokens -----------------------------------------------------------------------------------

# What the faster of the two encoders is not trusted with: scripts whose character classes may
# differ between regular-expression engines, the special token, and very long blanks.
UNUSUAL = re.compile(r"[^\x00-ɏ]|<\|endoftext\|>|\s{500}")


@lru_cache(maxsize=4)
def encoder(json_path: str, ranks_path: str | None):
    """A function from text to token ids.

    ``json_path`` defines the ids. ``ranks_path`` names the same vocabulary as plain ranks; with
    it, ordinary texts take an encoder that gives the same ids in a fifth of the time.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)

    def by_json(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    if not ranks_path:
        return by_json
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})

    def by_ranks(text: str) -> list[int]:
        return by_json(text) if UNUSUAL.search(text) else fast.encode_ordinary(text)

    return by_ranks


def public_vocabulary() -> tuple[str, str]:
    """Both files of the public byte-level vocabulary."""
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.path("byte_bpe_50k.tiktoken"))


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first one may be shorter."""
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None,
           capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           ) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all pieces."""

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        for b in sliced(batches, 1, 1 << 22):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                    strict=True):
                ids = np.array(encode(text or "") + [END], "<u4")
                for n, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start: start + length].tobytes())
                    rows.append((doc_id, n, start, length, crc))
            yield batch(PIECES, *zip(*rows, strict=True))

    return docs.select(named(id_col).cast("long").alias("doc_id"),
                       named(text_col).cast("string").alias("text")).mapInArrow(
        cut_all, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- plan -------------------------------------------------------------------------------------

@dataclass
class Pattern:
    """Lengths that share a sequence, longest first, and how many sequences do so."""

    lengths: tuple[int, ...]
    repeats: int


def enumerated(counts: np.ndarray, most: int = MOST_PATTERNS) -> np.ndarray:
    """Patterns of up to three present lengths that fill a sequence; unused places are 0.

    ``counts`` has the number of pieces at every length from 0 to the capacity. Of the triples,
    whose number is quadratic, every n-th in their order is listed.
    """
    capacity = len(counts) - 1
    present = np.flatnonzero(counts[:capacity])
    has = counts > 0
    pairs = present[(present <= capacity - present) & has[capacity - present]]
    found = [np.stack([capacity - pairs, pairs, np.zeros_like(pairs)], 1)]
    a, b = np.triu_indices(len(present))
    long, short = present[b], present[a]
    third = capacity - long - short
    fits = (third > 0) & (third <= short)
    long, short, third = long[fits], short[fits], third[fits]
    good = has[third]
    triples = np.stack([long[good], short[good], third[good]], 1)
    found.append(triples[:: max(1, -(-len(triples) // most))])
    return np.concatenate(found)


def fitted(patterns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 that minimise the weighted squared misfit of patterns to counts.

    Accelerated projected gradients. Misfit of long pieces weighs more: short ones fill gaps.
    """
    capacity = len(counts) - 1
    weight = np.arange(capacity + 1) / capacity
    weight[0] = 0

    def used(x):
        return np.bincount(patterns.ravel(), np.repeat(x, patterns.shape[1]), capacity + 1)

    def back(misfit):
        return (weight * misfit)[patterns].sum(1)

    probe = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = back(used(probe))
        norm = np.linalg.norm(probe)
        if not norm:
            return np.zeros(len(patterns))
        probe /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        nearer = np.maximum(0, y - step * back(used(y) - counts))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nearer + (t - 1) / t_next * (nearer - x)
        x, t = nearer, t_next
    return x


def rounded(patterns: np.ndarray, x: np.ndarray, left: np.ndarray) -> Iterator[Pattern]:
    """Whole repeats, never more than the pieces there are; ``left`` goes down by them."""
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 1:
            return
        lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        repeats = min(int(x[i] + 1e-9), int((left[lengths] // times).min()))
        if repeats:
            left[lengths] -= repeats * times
            yield Pattern(tuple(int(n) for n in sorted(patterns[i], reverse=True) if n), repeats)


def best_fit(left: np.ndarray) -> Iterator[Pattern]:
    """Packs all counts: longest first, then what fills the sequence best.

    Every pattern repeats until one of its lengths runs out, so the number of steps depends on
    the number of lengths, not of pieces.
    """
    capacity = len(left) - 1
    while (present := np.flatnonzero(left)).size:
        lengths = [int(present[-1])]
        left[lengths[0]] -= 1
        room = capacity - lengths[0]
        while room:
            n = _next(left, room)
            if not n:
                break
            lengths.append(n)
            left[n] -= 1
            room -= n
        distinct, times = np.unique(lengths, return_counts=True)
        more = int((left[distinct] // times).min())
        left[distinct] -= more * times
        yield Pattern(tuple(sorted(lengths, reverse=True)), 1 + more)


def _next(left: np.ndarray, room: int) -> int:
    """One piece that fills the room, else the longer of two that do, else the longest fitting."""
    if left[room]:
        return room
    low = np.arange(1, room // 2 + 1)
    both = low[(left[low] > 0) & (left[room - low] > 0)]
    both = both[(both * 2 != room) | (left[both] > 1)]
    if both.size:
        return int(room - both[-1])
    fits = np.flatnonzero(left[1: room + 1])
    return int(fits[-1]) + 1 if fits.size else 0


def plan(counts: np.ndarray) -> list[Pattern]:
    """Patterns that use up ``counts`` (pieces at every length from 0 to the capacity)."""
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    out = [Pattern((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    if left.any():
        patterns = enumerated(left)
        if len(patterns):
            out += rounded(patterns, fitted(patterns, left), left)
        out += best_fit(left)
    return out


@dataclass
class Slots:
    """The plan as ranges of ranks per length."""

    first: dict[int, np.ndarray]  # first rank of each range
    base: dict[int, np.ndarray]  # its first sequence
    times: dict[int, np.ndarray]  # pieces of this length in a sequence
    offset: dict[int, np.ndarray]  # of the first of them

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.first[length], ranks, "right") - 1
        k = ranks - self.first[length][i]
        times = self.times[length][i]
        return self.base[length][i] + k // times, self.offset[length][i] + k % times * length


def slots(patterns: list[Pattern]) -> Slots:
    ranges: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for length in sorted(set(p.lengths), reverse=True):
            times = p.lengths.count(length)
            start = used.get(length, 0)
            ranges.setdefault(length, []).append((start, sequence, times, offset))
            used[length] = start + times * p.repeats
            offset += times * length
        sequence += p.repeats
    tables = {n: np.array(rows, np.int64).T for n, rows in ranges.items()}
    return Slots(*[{n: t[i] for n, t in tables.items()} for i in range(4)])


# --- placement --------------------------------------------------------------------------------

def ranked(found: DataFrame, capacity: int) -> tuple[DataFrame, np.ndarray]:
    """Pieces with their rank among those of their length, and the histogram."""
    n = found.count()
    salts = max(8, -(-n // SALT_ROWS))
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    cells = materialize(found.groupBy("length", "salt").agg(F.count("*").alias("n")), "cells")
    counts = np.zeros(capacity + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    starts = cells.select("length", "salt", before.alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    rows = (found.withColumn("nth", F.row_number().over(order) - 1)
            .join(starts, ["length", "salt"])
            .withColumn("rank", F.col("before") + F.col("nth"))
            .drop("salt", "before", "nth"))
    return rows, counts


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset."""
    rows, counts = ranked(found, capacity)
    where = slots(plan(counts))
    schema = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                own = length == n
                sequence[own], offset[own] = where.place(int(n), rank[own])
            yield batch(schema, *b.columns[:5], sequence, offset)

    return rows.select(*PIECES.names, "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
               "sequence_id long, offset long")


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None,
         capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces of all documents with their place."""
    found = materialize(pieces(docs, json_path, ranks_path, capacity, id_col, text_col), "pieces")
    return packed(found, capacity)
