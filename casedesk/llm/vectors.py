"""Near-duplicate vectors: spherical k-means cells and blocked cosine products.

Only vectors of equal, non-null label and equal length are compared, by cosine in double precision.
Equal vectors are one node with a number of copies. Centroids are fitted to a sample of at most
``SAMPLE`` vectors; every vector is assigned: its nearest cell is its home. Two vectors of different
homes lie on either side of the plane between the two centroids, and linked ones are at most the
threshold's angle apart, so one of them is within half that angle of the plane. A vector therefore
probes every cell to whose plane it is that close, which loses no link. A pair is found where one of
the two probes the other's home, and counted in one such cell only. Labels of at most ``TILE``
vectors need no cells: each has one of its own.

Cells are brought together in groups of bounded size, and a group with more vectors of a label is dealt
over slots. A vector is sent to its own group, where it is held, and to every other group with a cell that
it probes, where it passes by as a guest: guests are read in batches, however many they are. Groups take
turns, so that about one copy of the vectors is shuffled at a time, as components of their own type. Products
are formed in single precision; where that leaves it open, cosines are formed again in double precision. Out of a
group come counts of links and a spanning forest, never pairs.

Null, empty and zero vectors, those with null or non-finite components, and those without label
link with nothing. Null ids are vectors like others and name a component only where it has no other
id. Rows that repeat are copies of each other. Vectors whose length is not the most frequent one
share one cell per length. Tables without rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from casedesk.llm.frames import changes, named
from casedesk.llm.graph import components
from casedesk.session import briefly, materialize, run_folder, tidy

THRESHOLD = 0.93
SAMPLE = 32_768
CELL_ROWS = 2_048  # vectors of the largest label that a cell should hold
SALTS = 16
MOST_CELLS = 4_096
ROUNDS = 12
TILE = 1_024
GROUP_BYTES = 1 << 24  # of vectors in single precision that a group should hold
CHUNK = 2_048


def _usable(kind: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, label, dim, body): usable vectors as bytes of their components; null if there is none."""
        for b in batches:
            dims, bodies = [], []
            for values in b.column(2):
                body = None
                if values.is_valid and len(values) and not values.values.null_count:
                    v = values.values.to_numpy(zero_copy_only=False).astype(float)
                    if np.isfinite(v).all() and v.any():
                        body = v.astype(kind).tobytes()
                dims.append(len(values) if body else 0)
                bodies.append(body)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(bodies, pa.binary())],
                names=["node", "label", "dim", "body"])
    return emit


def _units(bodies: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors of bodies of equal length."""
    v = np.frombuffer(b"".join(bodies), kind).reshape(len(bodies), -1).astype(float)
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow of the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable_vectors(rows: DataFrame, kind: str) -> DataFrame:
    """(node, label, dim, body, copies) of the distinct usable vectors."""
    return (rows.where("label is not null").select("node", "label", "vector")
            .mapInArrow(_usable(kind), "node long, label string, dim int, body binary")
            .where("dim > 0").groupBy("node")
            .agg(F.first("label").alias("label"), F.first("dim").alias("dim"),
                 F.first("body").alias("body"), F.count("*").alias("copies")))


def k_means(sample: np.ndarray, n_cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids of a sample of unit vectors."""
    random = np.random.default_rng(seed)
    centres = sample[np.sort(random.choice(len(sample), n_cells, replace=False))]
    for _ in range(rounds):
        home = np.concatenate([np.argmax(part @ centres.T, 1)
                               for part in np.array_split(sample, 1 + len(sample) // 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        lost = norm[:, 0] < 1e-9
        sums[lost] = sample[random.choice(len(sample), int(lost.sum()))]
        norm[lost] = 1
        centres = sums / norm
    return centres


def centroids(vectors: DataFrame, dim: int, n: int, largest: int, kind: str) -> np.ndarray:
    """Centroids for n vectors of one length, fitted to a hash sample of bounded size.

    Only equal labels are compared, so the cells are as many as the largest label needs.
    """
    mark = F.xxhash64(F.lit(3), F.col("node"))
    share = min(1.0, 1.2 * SAMPLE / max(1, n))
    level = min(int(-(1 << 63) + share * ((1 << 64) - 1)), (1 << 63) - 1)
    rows = (vectors.where((F.col("dim") == dim) & (mark <= F.lit(level)))
            .select("node", "body", mark.alias("mark")).orderBy("mark", "node").limit(SAMPLE)
            .collect())
    sample = _units([r.body for r in rows], kind)
    cells = max(1, min(MOST_CELLS, largest // CELL_ROWS, len(sample)))
    return k_means(sample, cells)


def _probed(vectors: np.ndarray, centres: np.ndarray, threshold: float,
            ) -> tuple[np.ndarray, np.ndarray]:
    """Home of each unit vector, and which cells it probes, its home among them."""
    cosines = vectors @ centres.T
    home = np.argmax(cosines, 1)
    own, which = np.unique(home, return_inverse=True)
    squares = (centres * centres).sum(1)
    apart = np.sqrt(np.maximum(
        squares[own, None] + squares - 2 * (centres[own] @ centres.T), 0))
    # Sine of half the threshold's angle, rounded up: a probe too many does no harm.
    reach = np.sqrt(max(0.0, (1 - threshold) / 2)) + 1e-6
    near = cosines[np.arange(len(home)), home][:, None] - cosines <= reach * apart[which] + 1e-6
    return home, near


def _cells(centres: np.ndarray, threshold: float, kind: str, per: int):
    """Adds home, its group, the groups of the probed cells, and these cells as bits."""
    dim, starts = centres.shape[1], np.arange(0, len(centres), per)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            dims, large = (b.column(c).to_numpy(zero_copy_only=False) for c in (2, 5))
            homes = np.full(b.num_rows, -1)
            groups: list = [[-1]] * b.num_rows
            bits: list = [None] * b.num_rows
            own = np.flatnonzero((dims == dim) & large)
            for part in np.array_split(own, 1 + len(own) // 512):
                if len(part):
                    units = _units(b.column(3).take(pa.array(part)).to_pylist(), kind)
                    homes[part], near = _probed(units, centres, threshold)
                    in_group = np.logical_or.reduceat(near, starts, axis=1)
                    for i, there, packed in zip(part, in_group, np.packbits(near, axis=1), strict=True):
                        groups[i], bits[i] = np.flatnonzero(there), packed.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(homes, pa.int32()), pa.array(homes // per, pa.int32()),
                 pa.array(groups, pa.list_(pa.int32())), pa.array(bits, pa.binary())],
                names=["node", "label", "dim", "body", "copies", "home", "own", "groups", "bits"])
    return emit


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest number connected to each of 0..n-1 by the links a-b."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


class _Rows:
    """Vectors of one length, sorted by home, with the cells they probe."""

    def __init__(self, table: pa.Table | pa.RecordBatch, kind: str):
        self.node, self.copies, self.home = (
            table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "copies", "home"))
        self.bits, self.bodies, self.kind = table.column("bits"), table.column("body"), kind
        self.units = _units(self.bodies.to_pylist(), kind).astype(np.float32)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(self.home)) + 1, [len(self.home)]))
        self.parts = [slice(at, min(at + CHUNK, int(hi))) for lo, hi in zip(cuts[:-1], cuts[1:])
                      for at in range(int(lo), int(hi), CHUNK)]
        self.packed = None if self.home[0] < 0 else np.frombuffer(
            b"".join(self.bits.to_pylist()), np.uint8).reshape(len(self.home), -1)

    def probes(self, part: slice, cell: int) -> np.ndarray:
        return (self.packed[part, cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)

    def exact(self, rows: np.ndarray) -> np.ndarray:
        return _units(self.bodies.take(pa.array(rows)).to_pylist(), self.kind)


class _Group:
    """Vectors held in one task: their links with each other and with guests."""

    def __init__(self, held: _Rows, threshold: float):
        self.held, self.threshold = held, threshold
        n = len(held.node)
        self.links, self.root = np.zeros(n, np.int64), np.arange(n)
        self.margin = (held.units.shape[1] + 4) * 1.2e-7  # what single precision may be off by
        for i, x in enumerate(held.parts):
            for y in held.parts[i:]:
                c, d = held.home[x.start], held.home[y.start]
                if c != d and not held.probes(x, d).any() and not held.probes(y, c).any():
                    continue
                hit = self.hits(np.arange(x.start, x.stop), held, np.arange(y.start, y.stop))
                if x == y:
                    hit = np.triu(hit, 1)
                if hit.any():
                    _count(hit, self.links[x], held.copies[y])
                    _count(hit.T, self.links[y], held.copies[x])
                    first, some = hit.argmax(0), hit.any(0)
                    self.join(self.root[x][first[some]], self.root[y][some])
                    p, q = np.nonzero(hit & (self.root[x][:, None] != self.root[y]))
                    self.join(self.root[x][p], self.root[y][q])

    def hits(self, a: np.ndarray, others: _Rows, b: np.ndarray) -> np.ndarray:
        cosines = self.held.units[a] @ others.units[b].T
        hit = cosines >= self.threshold - self.margin
        if hit.any():
            p, q = np.nonzero(hit & (cosines < self.threshold + self.margin))
            for at in range(0, len(p), 1 << 16):
                i, j = p[at:at + (1 << 16)], q[at:at + (1 << 16)]
                hit[i, j] = np.einsum(
                    "ij,ij->i", self.held.exact(a[i]), others.exact(b[j])) >= self.threshold
        return hit

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            some, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            to = np.arange(len(self.root))
            to[some] = some[_forest(at[:len(a)], at[len(a):], len(some))]
            self.root = to[self.root]

    def meet(self, guests: _Rows, siblings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, links, near) of guests with links.

        Siblings are dealt to other slots of this group. Otherwise, a pair that probes each other's homes
        is counted in the home of the greater number.
        """
        held = self.held
        links, near = np.zeros(len(guests.node), np.int64), np.full(len(guests.node), -1)
        for y in guests.parts:
            d, sibling = guests.home[y.start], siblings[y.start]
            for x in held.parts:
                c = held.home[x.start]
                xs, ys = np.arange(x.start, x.stop), np.arange(y.start, y.stop)
                if c != d:
                    mine = guests.probes(y, c)
                    if sibling:
                        if not mine.any() and not held.probes(x, d).any():
                            continue
                    else:
                        ys = ys[mine]
                        xs = xs[~held.probes(x, d)] if d > c else xs
                if not len(xs) or not len(ys):
                    continue
                hit = self.hits(xs, guests, ys)
                some = hit.any(0)
                if not some.any():
                    continue
                for rows, numbers, copies, counted in (
                        (xs, self.links, guests.copies[ys], hit), (ys, links, held.copies[xs], hit.T)):
                    found = numbers[rows]
                    _count(counted, found, copies)
                    numbers[rows] = found
                first = self.root[xs][hit.argmax(0)]
                new = some & (near[ys] < 0)
                near[ys[new]] = first[new]
                self.join(self.root[near[ys[some]]], first[some])
                p, q = np.nonzero(hit & (self.root[xs][:, None] != self.root[near[ys]]))
                self.join(self.root[xs][p], self.root[near[ys[q]]])
        some = np.flatnonzero(links)
        return guests.node[some], links[some], held.node[near[some]]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = np.flatnonzero((self.links > 0) | (self.root != np.arange(len(self.root))))
        return self.held.node[some], self.links[some], self.held.node[self.root[some]]


def _count(hit: np.ndarray, links: np.ndarray, copies: np.ndarray) -> None:
    """Adds the copies of all that the rows hit, to a view of their links."""
    if np.count_nonzero(hit) * 8 < hit.size:
        p, q = np.nonzero(hit)
        np.add.at(links, p, copies[q])
    else:
        links += hit.astype(np.int64) @ copies


def _group_links(threshold: float, kind: str, per: int):
    """Links of groups: rows sorted by (label, dim, group, slot), held ones first, then by home."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, group, out, size = None, [], None, [], 0

        def settled() -> _Group | None:
            if waiting:
                return _Group(_Rows(pa.Table.from_batches(waiting).combine_chunks(), kind), threshold)
            return group

        for b in batches:
            cuts = [0, *changes(b, 5), b.num_rows] if b.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = b.slice(lo, hi - lo)
                *now, guest = (part.column(i)[0].as_py() for i in range(5))
                if now != key:
                    group = settled()
                    if group:
                        out.append(group.found())
                    key, waiting, group = now, [], None
                if not guest:
                    waiting.append(part)
                else:
                    group, waiting = settled(), []
                    if group:
                        rows = _Rows(part, kind)
                        out.append(group.meet(rows, rows.home // per == now[2]))
            size += b.num_rows
            if size >= 10_000 and out:
                yield _batch(out)
                out, size = [], 0
        group = settled()
        if group:
            out.append(group.found())
        if out:
            yield _batch(out)
    return emit


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(column), pa.int64()) for column in zip(*found)],
        names=["node", "links", "near"])


def placed_vectors(vectors: DataFrame, threshold: float, kind: str) -> tuple[DataFrame, int]:
    """Vectors with home, groups and probed cells, and the number of cells of a group."""
    labels = materialize(vectors.groupBy("label", "dim").agg(F.count("*").alias("size")),
                         "label-sizes")
    sizes = (labels.groupBy("dim").agg(F.sum("size").alias("n"), F.max("size").alias("largest"))
             .orderBy(F.desc("n"), "dim").first())
    centres, per = np.ones((1, 1)), 1
    if sizes is not None:
        centres = centroids(vectors, sizes.dim, sizes.n, sizes.largest, kind)
        per = max(1, GROUP_BYTES // (4 * sizes.dim) // CELL_ROWS)
    # A label may hold a third of all rows: they are spread over salts.
    large = labels.select("label", "dim", (F.col("size") > TILE).alias("large"), F.explode(
        F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    return (vectors.withColumn("salt", salt).join(large, ["label", "dim", "salt"])
            .select("node", "label", "dim", "body", "copies", "large")
            .mapInArrow(_cells(centres, threshold, kind, per), PLACED)), per


PLACED = ("node long, label string, dim int, body binary, copies long, home int, own int, "
          "groups array<int>, bits binary")


def links(placed: DataFrame, per: int, threshold: float, kind: str) -> DataFrame:
    """(node, links, near): partial numbers of links, and links of a spanning forest."""
    spark, key = placed.sparkSession, ["label", "dim", "group"]
    sizes = placed.groupBy("label", "dim", F.col("own").alias("group")).count()
    most = F.greatest(F.lit(1), F.floor(F.lit(GROUP_BYTES) / (4 * F.col("dim"))))
    # At most one group for every two that are full is dealt over slots.
    slots = F.broadcast(materialize(
        sizes.where(F.col("count") > 2 * most)
        .select(*key, F.ceil(F.col("count") / most).cast("int").alias("slots")), "slots"))
    sent = (placed.withColumn("group", F.explode("groups")).join(slots, key, "left")
            .withColumn("slots", F.coalesce("slots", F.lit(1))))
    copies, n = sent.agg(F.sum("slots"), F.count_if(F.col("group") == F.col("own"))).first()
    turns = max(1, round((copies or 0) / max(1, n)))
    seat = F.when(F.col("group") == F.col("own"), F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"))
    sent = (sent.withColumn("seat", F.coalesce(seat, F.lit(-1)))
            .withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
            .where("slot >= seat").withColumn("guest", F.col("slot") != F.col("seat")))
    order = [*key, "slot"]
    folder = run_folder(spark, "vector-links")
    for turn in range(turns):
        own = sent.where(F.pmod(F.xxhash64(*order), F.lit(turns)) == turn)
        with tidy(spark):
            (own.select(*order, "guest", "home", "node", "copies", "bits", "body")
             .repartition(*order).sortWithinPartitions(*order, "guest", "home")
             .mapInArrow(_group_links(threshold, kind, per), LINKS)
             .write.mode("append").option("compression", "zstd").parquet(folder))
    return spark.read.schema(LINKS).parquet(folder)


LINKS = "node long, links long, near long"


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    vector = named(vector_col).cast("array<double>")
    label = named(label_col).cast("string")
    rows = table.select(named(id_col).cast("long").alias("vec_id"), label.alias("label"),
                        F.xxhash64(label, vector).alias("node"), vector.alias("vector"))
    single = table.schema[vector_col].dataType.elementType == T.FloatType()
    kind = "<f4" if single else "<f8"
    with ExitStack() as stored:
        with briefly(usable_vectors(rows, kind), "vectors") as usable:
            placed, per = placed_vectors(usable, threshold, kind)
            placed = stored.enter_context(briefly(placed, "cells"))
        found = links(placed, per, threshold, kind)
        vectors = materialize(placed.select("node", "copies"), "copies")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    names = components(found.select("node", "near"), "node", "near")
    # Vectors that are no nodes, for want of label or direction, keep their own ids.
    all_rows = rows.select("vec_id", "label", "node")
    nodes = (vectors.select("node", "copies").join(totals, "node", "left")
             .join(names, "node", "left")
             .select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
                     .alias("n_links"), F.coalesce("component", "node").alias("component")))
    own = F.col("label").isNotNull() & F.col("component").isNotNull()
    joined = all_rows.join(nodes, "node", "left").withColumn(
        "component", F.when(own, F.col("component")))
    least = (joined.where("component is not null").groupBy("component")
             .agg(F.min("vec_id").alias("least")))
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return (joined.join(least, "component", "left")
            .select("vec_id", F.when(F.col("component").isNull(), F.lit(0))
                    .otherwise(F.col("n_links")).cast("long").alias("n_links"),
                    component.alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
