"""Hard negatives by best-first search in cover trees over norm-augmented candidates.

Components are whole numbers, floor(scale * x), and scores are integer inner products. A tree holds
about ``TREE`` candidates. Each gets one more coordinate, which brings all of the tree to the same
length M, so that they lie on a sphere and the inner product with a query falls with the angle
between them. Every candidate is a node; a node covers its descendants within an angle, and its
children are a net of it: each covers what is within 1 / ``BASE`` of the node's covering angle, and
no child lies in what an earlier sibling covers. A query at angle t from a node of covering angle r
scores at least |q| M cos(t + r) and at most |q| M cos(t - r) with every descendant, so nodes outside
the window of scores that is asked for, or below the k best found, are skipped; the others are
expanded in the order of their upper bounds, and a node's children are scored exactly.

A window belongs to an anchor and one of its positives, the best rows of its own label; all windows
of an anchor share a descent. Labels of more than ``TREE`` rows have trees of their own, the others
share trees by a hash of the label. Trees are built once, stored, and read as rows. Anchors are cut
into blocks of about ``BLOCK`` and trees into ``LANES``; a task takes one block through the trees
of one lane, one tree at a time, and keeps its k best, so what it holds is bounded, and what it sends
on does not grow with the number of trees.

Rows with a null label or vector or with a null or non-finite component take no part. Rows of other
lengths are not compared. Rows that repeat id, label and vector are one node with a number of
copies and count as rows each, as candidates and, if one is an anchor, as anchors; equal scores go by
the smaller id, null ids last. Zero vectors and empty ones score 0. A component or score beyond 64 bits is an error.
Tables without rows give none. Only the named columns are read, so others do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casedesk.functions.staging import spread
from casedesk.llm.frames import changes, named, runs
from casedesk.session import materialize

SCALE = 256
TREE = 2_048
BLOCK = 16_384
LANES = 16
BASE = 1.3
SALTS = 16
GEMM = 256  # queries scored together against the children of a root
ROUND = 8  # nodes expanded in a query's first round through a tree
EXACT = float(1 << 53)

POINT = "id long, label string, anchor boolean, dim int, body binary"
NODE = ("tree string, no int, dim int, bucket string, shard int, blocks long, first int, "
        "children int, angle double, length double, id long, label string, copies long, "
        "body binary")
FOUND = "key long, place int, other long, score long, copies long"


def _whole_numbers(scale: int):
    """Usable rows with their components as whole numbers."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, bodies = [], []
            for i, values in enumerate(b.column(3)):
                if not values.is_valid or values.values.null_count:
                    continue
                v = np.floor(scale * values.values.to_numpy(zero_copy_only=False).astype(float))
                if not np.isfinite(v).all():
                    if np.isfinite(values.values.to_numpy(zero_copy_only=False)).all():
                        raise OverflowError("a component is beyond 64 bits")
                    continue
                if len(v) and np.abs(v).max() >= 2.0 ** 63:
                    raise OverflowError("a component is beyond 64 bits")
                keep.append(i)
                bodies.append(v.astype("<i8").tobytes())
            kept = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), kept.column(2),
                 pa.array([len(x) // 8 for x in bodies], pa.int32()), pa.array(bodies, pa.binary())],
                names=["id", "label", "anchor", "dim", "body"])
    return emit


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<i8").reshape(len(column), dim)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Order of the points, first child, number of children and covering angle of each, length.

    Nodes are numbered level by level, so that the children of a node follow each other.
    """
    squares = (points * points).sum(1)
    length = float(np.sqrt(squares.max())) if squares.max() else 1.0
    rest = np.sqrt(np.maximum(length * length - squares, 0))
    sphere = np.column_stack([points, rest]) / length
    members = np.arange(1, len(points))
    nodes = [(0, members, _angles(sphere[members] @ sphere[0]))]
    first, children, angle = [], [], []
    for node, members, apart in nodes:  # grows as it is read
        first.append(len(nodes))
        children.append(0)
        angle.append(float(apart.max()) if len(members) else 0.0)
        reach = angle[-1] / BASE
        if angle[-1] < 1e-6:  # equal vectors: no level tells them apart
            nodes += [(m, members[:0], apart[:0]) for m in members]
            children[-1] = len(members)
            continue
        while len(members):
            child, members = members[0], members[1:]
            apart = _angles(sphere[members] @ sphere[child])
            near = apart <= reach
            nodes.append((child, members[near], apart[near]))
            members = members[~near]
            children[-1] += 1
    return (np.array([n for n, _, _ in nodes]), np.array(first), np.array(children),
            np.array(angle), length)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows of the trees whose points come sorted by (dim, bucket, shard)."""
    for table in runs(batches, 3):
        cuts = np.concatenate(([0], changes(table, 3), [table.num_rows]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            rows = table.slice(lo, hi - lo).combine_chunks()
            dim, bucket, shard = (rows.column(i)[0].as_py() for i in range(3))
            points = _matrix(rows.column("body"), dim)
            order, first, children, angle, length = cover_tree(points.astype(float))
            n = len(order)
            rows = rows.take(pa.array(order))
            yield from pa.Table.from_arrays(
                [pa.array([f"{dim}/{shard}/{bucket}"] * n), pa.array(range(n), pa.int32()),
                 *rows.select(["dim", "bucket", "shard", "blocks"]).columns,
                 pa.array(first, pa.int32()), pa.array(children, pa.int32()), pa.array(angle),
                 pa.array([length] * n), *rows.select(["id", "label", "copies", "body"]).columns],
                names=["tree", "no", "dim", "bucket", "shard", "blocks", "first", "children",
                       "angle", "length", "id", "label", "copies", "body"]).combine_chunks(
            ).to_batches()


class Tree:
    """A tree read from its node rows."""

    def __init__(self, rows: pa.Table, dim: int):
        self.whole = _matrix(rows.column("body"), dim)
        self.points = self.whole.astype(float)
        self.most = float(np.abs(self.points).max()) if self.points.size else 0.0
        self.first, self.children, self.angle = (
            rows.column(c).to_numpy() for c in ("first", "children", "angle"))
        self.length = rows.column("length")[0].as_py()
        codes = rows.column("label").combine_chunks().dictionary_encode()
        self.codes = {label: i for i, label in enumerate(codes.dictionary.to_pylist())}
        self.label = codes.indices.to_numpy()
        self.ids = rows.column("id").to_pylist()
        self.copies = rows.column("copies").to_numpy()


class Block:
    """Queries with their windows of scores, and the k best candidates found for each window.

    ``same`` asks for candidates of the query's own label, else for those of any other.
    """

    def __init__(self, rows: pa.Table, dim: int, k: int, same: bool):
        self.dim, self.k, self.same = dim, k, same
        self.keys, self.ids = rows.column("key").to_pylist(), rows.column("id").to_pylist()
        self.whole = _matrix(rows.column("body"), dim)
        self.queries = self.whole.astype(float)
        self.most = float(np.abs(self.queries).max()) if self.queries.size else 0.0
        self.norms = np.sqrt((self.queries * self.queries).sum(1))
        self.labels = rows.column("label").to_pylist()
        self.places = rows.column("places").to_pylist()
        self.low = [np.array(x, np.int64) for x in rows.column("lows").to_pylist()]
        self.high = [np.array(x, np.int64) for x in rows.column("highs").to_pylist()]
        # The lowest score of interest by window: its bound, then that of the k-th best so far.
        self.floor = [x.copy() for x in self.low]
        self.best: list[list[list[tuple]]] = [[[] for _ in x] for x in self.low]

    def _scores(self, tree: Tree, nodes, queries) -> np.ndarray:
        """Exact scores, by floating point where that is exact."""
        if self.dim * self.most * tree.most < EXACT:
            return tree.points[nodes] @ self.queries[queries].T
        a, b = tree.whole[nodes].astype(object), self.whole[queries].T.astype(object)
        return (a @ b).astype(np.int64)

    def _bounds(self, tree: Tree, scores, norms, nodes) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of any descendant, with room for rounding."""
        span = np.maximum(norms * tree.length, 1e-300)
        at, angle = _angles(scores / span), tree.angle[nodes]
        slack = 1e-6 * span + 1e-6
        return (span * np.cos(np.minimum(at + angle, np.pi)) - slack,
                span * np.cos(np.maximum(at - angle, 0)) + slack)

    def _wanted(self, i: int, least, most) -> np.ndarray:
        """Which of some nodes may hold a candidate for a window of the query."""
        floor, high = self.floor[i], self.high[i]
        return ((np.asarray(most)[:, None] >= floor) & (np.asarray(least)[:, None] <= high)).any(1)

    def _itself(self, i: int, tree: Tree, node: int) -> bool:
        """Whether one of a node's rows is the query's own."""
        return (self.same and tree.ids[node] == self.ids[i]
                and bool((tree.whole[node] == self.whole[i]).all()))

    def _take(self, i: int, tree: Tree, scores: np.ndarray, nodes: np.ndarray) -> None:
        """Offers the candidates at some nodes to the windows of query i."""
        floor, high = self.floor[i], self.high[i]
        at = np.flatnonzero((scores >= floor.min()) & (scores <= high.max()))
        if len(at) and len(tree.codes) > 1:
            at = at[(tree.label[nodes[at]] == tree.codes.get(self.labels[i], -1)) == self.same]
        if not len(at):
            return
        scores, nodes = scores[at].astype(np.int64), nodes[at]
        for w in range(len(floor)):
            fits = np.flatnonzero((scores >= floor[w]) & (scores <= high[w]))
            if not len(fits):
                continue
            best = self.best[i][w]
            spare = len(fits) - self.k - self.same  # one of them may be the query itself
            if spare > 0:
                least = np.partition(scores[fits], spare)[spare]
                fits = fits[scores[fits] >= least]
            for j in fits:
                node = nodes[j]
                copies = int(tree.copies[node]) - self._itself(i, tree, node)
                if copies:
                    best.append((-int(scores[j]), tree.ids[node] is None, tree.ids[node] or 0,
                                 copies))
            best.sort()
            del best[self.k:]
            if len(best) == self.k:
                floor[w] = max(floor[w], -best[-1][0])

    def descend(self, tree: Tree) -> None:
        """Takes every query that the tree can answer through it."""
        able = [i for i in range(len(self.keys)) if len(self.low[i]) and
                (self.labels[i] in tree.codes if self.same
                 else set(tree.codes) != {self.labels[i]})]
        top = np.arange(1 + int(tree.children[0]))
        for part in np.array_split(np.array(able, int), 1 + len(able) // GEMM):
            if not len(part):
                continue
            root = self._scores(tree, top[:1], part)[0]
            least, most = self._bounds(tree, root, self.norms[part], top[:1])
            into = np.array([self._wanted(i, least[j: j + 1], most[j: j + 1])[0]
                             for j, i in enumerate(part)])
            part = part[into]
            scores = self._scores(tree, top, part)
            for j, i in enumerate(part):
                self._best_first(i, tree, scores[:, j], top)

    def _best_first(self, i: int, tree: Tree, scores: np.ndarray, nodes: np.ndarray) -> None:
        """Expands the nodes that still matter, those with the greatest bounds first.

        A round expands more nodes than the one before: where bounds tell little apart, few
        rounds are left to do.
        """
        most, least, open_ = np.zeros(0), np.zeros(0), np.zeros(0, int)
        step = ROUND
        while True:
            self._take(i, tree, scores, nodes)
            inner = np.flatnonzero((tree.children[nodes] > 0) & ((nodes > 0)))
            low, high = self._bounds(tree, scores[inner], self.norms[i], nodes[inner])
            most, least = np.concatenate((most, high)), np.concatenate((least, low))
            open_ = np.concatenate((open_, nodes[inner]))
            keep = self._wanted(i, least, most)
            most, least, open_ = most[keep], least[keep], open_[keep]
            if not len(open_):
                return
            order = np.argsort(-most)
            most, least, open_ = most[order], least[order], open_[order]
            first, sizes = tree.first[open_[:step]], tree.children[open_[:step]]
            most, least, open_ = most[step:], least[step:], open_[step:]
            nodes = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
            scores = self._scores(tree, nodes, slice(i, i + 1))[:, 0]
            step *= 2

    def found(self) -> Iterator[pa.RecordBatch]:
        rows = [(key, place, None if no_id else other, -score, copies)
                for key, places, windows in zip(self.keys, self.places, self.best, strict=True)
                for place, best in zip(places, windows, strict=True)
                for score, no_id, other, copies in best]
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["key", "place", "other", "score", "copies"])


def _search(k: int, same: bool):
    """Answers of blocks of queries: rows sorted by task, queries before trees."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, task = None, None
        for table in runs(batches, 3):
            cuts = np.concatenate(([0], changes(table, 3), [table.num_rows]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                rows = table.slice(lo, hi - lo)
                dim = rows.column("dim")[0].as_py()
                if rows.column("kind")[0].as_py() == 0:
                    if block:
                        yield from block.found()
                    block, task = Block(rows, dim, k, same), rows.column("task")[0].as_py()
                elif rows.column("task")[0].as_py() == task:  # else no query fell to this task
                    block.descend(Tree(rows, dim))
        if block:
            yield from block.found()
    return emit


def _with_trees(points: DataFrame) -> DataFrame:
    """Adds bucket, shards (trees of the bucket) and blocks (of anchors of the bucket)."""
    total = points.count()
    labels = points.groupBy("dim", "label").agg(
        F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"))
    shards = F.ceil(F.col("n") / TREE).cast("int")
    shared = F.pmod(F.xxhash64("label"), F.lit(1 + 4 * total // TREE)).cast("string")
    labels = labels.select(
        "dim", "label", shards.alias("shards"), "anchors",
        F.when(shards > 1, F.concat(F.lit("="), "label")).otherwise(
            F.concat(F.lit("#"), shared)).alias("bucket"))
    blocks = labels.groupBy("dim", "bucket").agg(
        F.ceil(F.sum("anchors") / BLOCK).cast("long").alias("blocks"))
    # A label may hold a third of all rows: they are spread over salts.
    labels = labels.join(blocks, ["dim", "bucket"]).drop("anchors").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("body", "id"), F.lit(SALTS)).cast("int")
    return points.withColumn("salt", salt).join(labels, ["dim", "label", "salt"]).drop("salt")


def _answers(trees: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(key, place, other, score, copies): the k best of every lane for each window."""
    columns = ["task", "kind", "tree", "no", "dim", "key", "label", "body", "places", "lows",
               "highs", "first", "children", "angle", "length", "id", "copies"]
    empty = {"tree": "string", "no": "int", "key": "long", "places": "array<int>",
             "lows": "array<long>", "highs": "array<long>", "first": "int", "children": "int",
             "angle": "double", "length": "double", "id": "long", "copies": "long"}

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        return df.withColumn("kind", F.lit(kind)).select(*[
            F.col(c) if c in df.columns or c == "kind" else F.lit(None).cast(empty[c]).alias(c)
            for c in columns])

    both = shaped(queries.withColumn("tree", F.lit("")), 0).unionByName(shaped(trees, 1))
    return (spread(both, "task").sortWithinPartitions("task", "kind", "tree", "no")
            .mapInArrow(_search(k, same), FOUND))


def _percent(score: Column, share: int) -> Column:
    """Greatest whole number of at most so many per cent of a score."""
    part = F.lit(share).cast("decimal(5,2)") / 100
    return F.floor(score.cast("decimal(19,0)") * part).cast("long")


def _place(names: list) -> Column:
    return F.concat_ws("/", *[F.col(n).cast("string") if isinstance(n, str) else n.cast("string")
                              for n in names])


def _first(found: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The n best of what the lanes found, candidates as often as they have copies, with rank."""
    copies = F.sequence(F.lit(1), F.least("copies", F.lit(n)).cast("int"))
    best = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("other"))
    return (found.select(*keys, "other", "score", F.explode(copies).alias("copy")).drop("copy")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n))


def hard_negatives(
    table: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", n_positives: int = 5, n_negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = SCALE,
) -> DataFrame:
    """Per anchor and positive the best rows of other labels that score within the window.

    The window is ``low`` to ``high`` per cent of the positive's score. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = table.select(
        named(id_col).cast("long").alias("id"), named(label_col).cast("string").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        named(vector_col).cast("array<double>").alias("vector")).where("label is not null")
    points = materialize(
        rows.mapInArrow(_whole_numbers(scale), POINT)
        .groupBy("id", "label", "dim", "body")
        .agg(F.count("*").alias("copies"), F.bool_or("anchor").alias("anchor")),
        "points")
    points = materialize(_with_trees(points), "bucketed-points")
    shard = F.pmod(F.xxhash64("id", "body"), F.col("shards")).cast("int")
    keys = ["dim", "bucket", "shard"]
    trees = materialize(
        spread(points.select("dim", "bucket", shard.alias("shard"), "blocks", "id", "label",
                             "copies", "body"), *keys)
        .sortWithinPartitions(*keys, "id", "body").mapInArrow(_plant, NODE), "cover-trees")
    asked = materialize(points.where("anchor").withColumn(
        "key", F.monotonically_increasing_id()), "anchors")

    # The best rows of the anchor's own label, itself among them.
    lane = F.pmod(F.col("shard"), F.lit(LANES))
    own_trees = (trees.where("blocks > 0")
                 .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
                 .withColumn("task", _place(["dim", "block", lane, "bucket"])))
    lanes = F.sequence(F.lit(0), F.least("shards", F.lit(LANES)) - 1)
    everything = (F.array(F.lit(0)).alias("places"), F.array(F.lit(-(1 << 62))).alias("lows"),
                  F.array(F.lit(1 << 62)).alias("highs"))
    own = (asked.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
           .withColumn("lane", F.explode(lanes))
           .withColumn("task", _place(["dim", "block", "lane", "bucket"]))
           .select("task", "dim", "key", "id", "label", "body", *everything))
    positives = _first(_answers(own_trees, own, n_positives, True), n_positives, ["key"])
    windows = positives.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.col("score").alias("positive_score"), F.col("other").alias("positive_id"))))
        .alias("positives"))
    asked = materialize(asked.join(windows, "key"), "windows")

    # The best rows of other labels inside the windows.
    n_blocks = max(1, math.ceil(asked.count() / BLOCK))
    own_lane = F.pmod(F.xxhash64("tree"), F.lit(LANES))
    every_block = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    other_trees = trees.withColumn("block", F.explode(every_block)).withColumn(
        "task", _place(["dim", "block", own_lane]))
    score = "positive_score"
    others = (asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)))
              .withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
              .withColumn("task", _place(["dim", "block", "lane"]))
              .select("task", "dim", "key", "id", "label", "body",
                      F.transform("positives", lambda p: p["rank"]).alias("places"),
                      F.transform("positives", lambda p: -_percent(-p[score], low)).alias("lows"),
                      F.transform("positives", lambda p: _percent(p[score], high)).alias("highs")))
    found = _first(_answers(other_trees, others, n_negatives, False), n_negatives, ["key", "place"])
    anchors = asked.select(
        "key", F.col("id").alias("anchor_id"), "copies", F.inline("positives")).withColumnRenamed(
        "rank", "place")
    # An anchor row that is repeated is answered as often.
    return (found.withColumnRenamed("other", "negative_id").withColumnRenamed("score", "negative_score")
            .join(anchors, ["key", "place"])
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                    "negative_score"))
