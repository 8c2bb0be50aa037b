"""Removal of word windows that occur more than once, by a compacted De Bruijn graph.

A window is ``window`` neighbouring words. Its node is the smallest code among the ``k``-word
runs (k-mers) inside it, so equal windows have equal nodes, and a document is a walk over the nodes
of its windows. Neighbouring windows with one node form a fragment: a path of the De Bruijn graph
that is compacted at once. One row per fragment (about a twelfth of the words) is counted:

* a node seen once has no repeated window;
* a node seen often, each time with the same fragment, does not branch: all its windows repeat;
* a node whose fragments differ branches, where repeated spans begin, end or vary.

Spark joins bring these facts back to the documents. Neighbouring unbranched repeated fragments
merge into spans without a look at single windows; only the windows of branching fragments are
verified one by one, by counting the codes at their source coordinates. Fragments of a document
that holds the same k-mer twice may repeat within themselves and are verified like branching ones.

Every fact is about codes, not rows, so rows that repeat, null ids and equal ids do no harm: each
row is a document and its copies repeat its windows. Null and empty texts, and texts shorter than
a window, keep all their words. Nothing is capped; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from casedesk.llm.frames import batch, named, sliced
from casedesk.llm.words import coded_texts, grams, spans
from casedesk.session import materialize

WINDOW = 35
K = 12
_RESULT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
           ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int64()))]
RESULT = pa.schema(_RESULT)
RESULT_DDL = ("doc_id long, n_words long, n_removed long, kept_sha256 string, "
              "removed array<long>")
OPEN = pa.schema([*_RESULT, ("key", pa.int64()), ("body", pa.binary()),
                  ("sure", pa.list_(pa.int64())), ("windows", pa.list_(pa.int64()))])
OPEN_DDL = RESULT_DDL + ", key long, body binary, sure array<long>, windows array<long>"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    reach = 1
    out = values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(out) - (width - reach)], out[width - reach:]) \
        if width > reach else out


def fragments(codes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Node, first window, end window, code and self-repetition of every fragment."""
    if len(codes) < window:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none.view(np.uint64), none.astype(bool)
    mers = grams(codes, k)
    nodes = sliding_min(mers, window - k + 1)
    first = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
    end = np.append(first[1:], len(nodes))
    node = nodes[first]
    ordered = np.sort(mers)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    return node, first, end, spans(codes, first, end - 1 + window), np.isin(node, again)


def _nodes(window: int, k: int, with_key: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1, 1 << 23):
            keys = b.column(0).to_numpy(zero_copy_only=False)
            held: list[tuple] = []
            for i, _, codes in coded_texts(b.column(1)):
                node, _, _, code, twice = fragments(codes, window, k)
                if with_key:
                    held.append((np.unique(node), keys[i]))
                else:
                    # A second, different code marks the node as one to verify.
                    held.append((np.concatenate((node, node[twice])),
                                 np.concatenate((code, ~code[twice]))))
            nodes = np.concatenate([h[0] for h in held]).view(np.int64)
            other = (np.repeat([h[1] for h in held], [len(h[0]) for h in held]) if with_key
                     else np.concatenate([h[1] for h in held]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(other)],
                                             names=["node", "key" if with_key else "code"])
    return emit


def _removal(raw: bytes, repeated: np.ndarray, window: int) -> tuple:
    """n_words, n_removed, digest of the kept words and the removed spans (start, end, ...)."""
    words = raw.split()  # bytes: exactly the six ASCII blanks
    if not repeated.any():
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), []
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    gone = np.cumsum(steps[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
    kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), edges.tolist()


def _marked(windows: int, first: np.ndarray, end: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The windows of the chosen fragments."""
    return np.repeat(of, end - first) if windows else np.zeros(0, bool)


def _resolve(window: int, k: int):
    """Applies the facts about nodes; leaves open what has branching fragments."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in sliced(batches, 2, 1 << 21):
            ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            bodies = b.column(2).to_pylist()
            plain, branching = b.column(3).to_pylist(), b.column(4).to_pylist()
            raws = [unpack.decompress(z) if z else b"" for z in bodies]
            rows = []
            for i, raw, codes in coded_texts(pa.array(raws, pa.binary())):
                if not plain[i] and not branching[i]:
                    done = _removal(raw, np.zeros(0, bool), window)
                    rows.append((ids[i], *done, None, None, None, None))
                    continue
                node, first, end, _, _ = fragments(codes, window, k)
                node = node.view(np.int64)
                n = max(0, len(codes) - window + 1)
                sure = _marked(n, first, end, np.isin(node, plain[i] or []))
                doubt = _marked(n, first, end, np.isin(node, branching[i] or []))
                if not doubt.any():
                    rows.append((ids[i], *_removal(raw, sure, window), None, None, None, None))
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate(([False], sure, [False]))))
                codes = grams(codes, window)[doubt].view(np.int64)
                rows.append((ids[i], None, None, None, None, keys[i], bodies[i], edges.tolist(),
                             codes.tolist()))
            yield batch(OPEN, *zip(*rows, strict=True))
    return emit


def _finish(window: int):
    """Adds the verified windows of branching fragments."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in sliced(batches, 1, 1 << 21):
            ids, bodies, sure, found = (b.column(i).to_pylist() for i in range(4))
            raws = [unpack.decompress(z) if z else b"" for z in bodies]
            rows = []
            for i, raw, codes in coded_texts(pa.array(raws, pa.binary())):
                repeated = np.isin(grams(codes, window).view(np.int64), found[i] or [])
                for start, end in zip(sure[i][::2], sure[i][1::2], strict=True):
                    repeated[start:end] = True
                rows.append((ids[i], *_removal(raw, repeated, window)))
            yield batch(RESULT, *zip(*rows, strict=True))
    return emit


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text) with the text compressed, as it is shuffled."""
    pack = zstandard.ZstdCompressor(level=3)
    for b in sliced(batches, 2, 1 << 24):
        bodies = [pack.compress(t) if t else None
                  for t in b.column(2).cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bodies, pa.binary())],
                                         names=["doc_id", "key", "body"])


def node_facts(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(node, branches) of all nodes seen more than once; ``docs`` are (key, text)."""
    return (docs.mapInArrow(_nodes(window, k, False), "node long, code long").groupBy("node")
            .agg(F.count("*").alias("n"), F.min("code").alias("low"), F.max("code").alias("high"))
            .where("n > 1").select("node", (F.col("low") != F.col("high")).alias("branches")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and the removed word spans.

    ``removed`` lists start and end of every span of removed words in turn.
    """
    ident, text = named(id_col).cast("long"), named(text_col).cast("string")
    rows = docs.select(ident.alias("doc_id"), F.xxhash64(ident, text).alias("key"),
                       text.alias("text"))
    keyed = rows.select("key", "text")
    facts = node_facts(keyed, window, k)
    walks = keyed.mapInArrow(_nodes(window, k, True), "node long, key long")
    marks = (walks.join(facts, "node").groupBy("key")
             .agg(F.collect_set(F.when(~F.col("branches"), F.col("node"))).alias("plain"),
                  F.collect_set(F.when(F.col("branches"), F.col("node"))).alias("branching")))
    bodies = rows.mapInArrow(_packed, "doc_id long, key long, body binary")
    open_ = materialize(
        bodies.join(marks, "key", "left").select("doc_id", "key", "body", "plain", "branching")
        .mapInArrow(_resolve(window, k), OPEN_DDL), "repeats")
    doubts = open_.where("key is not null").select("key", F.explode("windows").alias("code"))
    repeated = doubts.groupBy("code").count().where("count > 1").select("code")
    verified = (doubts.distinct().join(repeated, "code").groupBy("key")
                .agg(F.collect_set("code").alias("found")))
    rest = (open_.where("key is not null").join(verified, "key", "left")
            .select("doc_id", "body", "sure", "found").mapInArrow(_finish(window), RESULT_DDL))
    done = open_.where("key is null").select("doc_id", "n_words", "n_removed", "kept_sha256",
                                             "removed")
    return done.unionByName(rest)
