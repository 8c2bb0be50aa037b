"""Exact duplicates found by compressed radix tries over whole texts.

Texts are compared after deleting ``[\\x20\\x09-\\x0D]``. Every task first inserts the texts it
reads into a trie of its own, so that copies meet before anything is shuffled; what is shuffled is
one row per distinct text and task, dealt by length and content hash. The receiving task inserts
the full byte strings into a trie again, whose terminal nodes hold the owner (most code points,
then smallest id) and the number of copies.

A trie never holds much more than ``TRIE_BYTES``: beyond that, its largest subtrees are handed on
and removed. On the sending side a subtree handed on is merely a second partial row. On the
receiving side the rows arrive sorted by length and hash, so only the text being read can still
get copies; every other terminal is final when its subtree goes.

Nulls count as empty texts, and empty texts are copies of each other. A null id is larger than any
id. Rows that repeat both id and text, or copies without ids, are copies like any other: one of them
stays. Tables without rows give no rows; further columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from casedesk.llm.frames import batch, fresh, named, sliced
from casedesk.llm.words import texts
from casedesk.session import materialize

TRIE_BYTES = 48 << 20
BLANK = b" \t\n\x0b\x0c\r"
_NODE = 200  # bytes that a node takes besides its label

PARTIAL = pa.schema([("n_bytes", pa.int64()), ("content_hash", pa.int64()),
                     ("body", pa.binary()), ("digest", pa.binary()), ("points", pa.int64()),
                     ("owner", pa.int64()), ("copies", pa.int64())])
OWNER = pa.schema([("digest", pa.binary()), ("owner_points", pa.int64()), ("owner", pa.int64()),
                   ("copies", pa.int64())])


class Node:
    """A trie node: the bytes on the edge to it, its children by first byte, its owner."""

    __slots__ = ("label", "children", "best", "copies", "digest")

    def __init__(self, label: bytes):
        self.label, self.children = label, {}
        self.best, self.copies, self.digest = None, 0, None


def shared_length(a: bytes, b: bytes, at: int) -> int:
    """Length of the common start of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low: at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed radix trie over byte strings with the best owner at every terminal."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def add(self, text: bytes, digest: bytes, best: tuple, copies: int) -> None:
        """``best`` sorts smallest for the owner that stays."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = Node(text[at:])
                node.children[text[at]] = child
                self.size += _NODE + len(child.label)
                node, at = child, len(text)
            elif text.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                n = shared_length(child.label, text, at)
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = upper
                self.size += _NODE
                node, at = upper, at + n
        node.copies += copies
        node.digest = digest
        node.best = best if node.best is None else min(node.best, best)

    def terminals(self, top: Node | None = None, before: bytes = b"",
                  ) -> Iterator[tuple[bytes, Node]]:
        """Text and node of every terminal below ``top``."""
        todo = [(top or self.root, before)]
        while todo:
            node, start = todo.pop()
            text = start + node.label
            if node.copies:
                yield text, node
            todo += [(child, text) for child in node.children.values()]

    def cut(self, limit: int) -> Iterator[tuple[bytes, Node]]:
        """Hands on the largest subtrees below the root until ``limit`` bytes are left."""
        weights = sorted(((self._weight(c), b) for b, c in self.root.children.items()),
                         reverse=True)
        for weight, first in weights:
            if self.size <= limit:
                return
            yield from self.terminals(self.root.children.pop(first))
            self.size -= weight

    def _weight(self, top: Node) -> int:
        total, todo = 0, [top]
        while todo:
            node = todo.pop()
            total += _NODE + len(node.label)
            todo += node.children.values()
        return total


def rank(points: int, doc_id: int | None) -> tuple:
    """Sorts the row first that stays: most code points, then smallest id, nulls last."""
    return (-points, doc_id is None, doc_id or 0)


def _owner(best: tuple) -> int | None:
    return None if best[1] else best[2]


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct text of this task (id, text), or a few if its trie ran full."""
    trie = Trie()

    def rows(found):
        held, size = [], 0
        for text, node in found:
            held.append((len(text), struct.unpack("<q", node.digest[:8])[0], text, node.digest,
                         -node.best[0], _owner(node.best), node.copies))
            size += len(text)
            if size > 1 << 23:
                yield batch(PARTIAL, *zip(*held, strict=True))
                held, size = [], 0
        if held:
            yield batch(PARTIAL, *zip(*held, strict=True))

    for b in sliced(batches, 1):
        ids = b.column(0).to_pylist()
        points = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()
        for i, raw in texts(b.column(1)):
            body = raw.translate(None, BLANK)
            trie.add(body, hashlib.sha256(body).digest(), rank(points[i], ids[i]), 1)
            if trie.size > TRIE_BYTES:
                yield from rows(trie.cut(TRIE_BYTES // 2))
    yield from rows(trie.terminals())


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owners of a partition whose rows are sorted by length and content hash."""
    trie, last, held = Trie(), None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            n_bytes, content, body, digest, points, owner, copies = row
            if trie.size > TRIE_BYTES and (n_bytes, content) != last:
                held += [_answer(node) for _, node in trie.cut(TRIE_BYTES // 2)]
            trie.add(body, digest, rank(points, owner), copies)
            last = (n_bytes, content)
        if len(held) > 10_000:
            yield batch(OWNER, *zip(*held, strict=True))
            held = []
    held += [_answer(node) for _, node in trie.terminals()]
    if held:
        yield batch(OWNER, *zip(*held, strict=True))


def _answer(node: Node) -> tuple:
    return node.digest, -node.best[0], _owner(node.best), node.copies


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, owner_points, owner, copies) of every distinct text."""
    rows = docs.select(named(id_col).cast("long"), named(text_col).cast("string"))
    partial = rows.mapInArrow(
        combined, "n_bytes long, content_hash long, body binary, digest binary, points long, "
                  "owner long, copies long")
    return (partial.repartition("n_bytes", "content_hash")
            .sortWithinPartitions("n_bytes", "content_hash")
            .mapInArrow(merged, "digest binary, owner_points long, owner long, copies long"))


def normal_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text without white space."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")
    return F.sha2(body.cast("binary"), 256)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     ) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256; texts are dropped on the way.

    Of rows that equal the one that stays in id and length, the first by a row number does. The
    numbers are written, as they may differ when they are made again.
    """
    text = named(text_col).cast("string")
    rows = materialize(docs.select(
        named(id_col).cast("long").alias("doc_id"), normal_digest(text).alias("text_sha256"),
        F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("points"),
        F.monotonically_increasing_id().alias("row")), "digests")
    groups = owners(docs, id_col, text_col).withColumn("digest", F.lower(F.hex("digest")))
    first = rows.groupBy(F.col("text_sha256").alias("digest"), F.col("doc_id").alias("owner"),
                         F.col("points").alias("owner_points")).agg(F.min("row").alias("first"))
    same = (groups["owner"].eqNullSafe(first["owner"])
            & (groups["owner_points"] == first["owner_points"]))
    stay = groups.join(first, (groups["digest"] == first["digest"]) & same).select(
        groups["digest"], groups["owner"], groups["copies"], first["first"])
    return rows.join(stay, rows["text_sha256"] == stay["digest"]).select(
        "doc_id", F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"),
        (F.col("row") == F.col("first")).alias("kept"), "text_sha256")


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     ) -> DataFrame:
    """The documents that stay, one of each group, all their columns unchanged."""
    row, digest, points = fresh(docs, "row", "digest", "points")
    text = named(text_col).cast("string")
    left = docs.select(
        F.struct(*[named(c) for c in docs.columns]).alias(row),
        normal_digest(text).alias(digest),
        F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias(points))
    right = (owners(docs, id_col, text_col)
             .select(F.lower(F.hex("digest")).alias("digest_hex"), "owner", "owner_points"))
    own = F.col(row)[id_col].cast("long")
    return (left.join(right, (left[digest] == right["digest_hex"])
                      & own.eqNullSafe(right["owner"])
                      & (left[points] == right["owner_points"]), "left_semi")
            .dropDuplicates([digest]).select(f"{row}.*"))
