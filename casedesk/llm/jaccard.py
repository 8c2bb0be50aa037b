"""Near-duplicate documents: an exact Jaccard self-join with count-vector R-trees.

A document's set is its distinct five-word shingles. Every shingle is hashed into one of
``GROUPS`` groups; the counts per group are a point, and the sum of coordinate minima of two points
bounds the overlap of their sets. R-trees over such points find the pairs whose bound reaches the
threshold, and these are verified on their sets.

Points that could match are brought together by prefixes: two sets that match share one of
their first ``n - ceil(t n) + 1`` shingles in any order that is the same for all documents. The
order puts the (at most ``HOT_KEYS``) most frequent shingles of prefixes last, by their number, so that
passages held by many documents bring nobody together unless a document has little else. The list
of frequent shingles only orders; results are exact whatever is on it. Blocks of frequent shingles
are split into tiles of about ``TILE`` documents.

Links are wanted, not all pairs of a group of copies: equal sets are one node, and two rounds in
which a point takes its best partner of another component, tile by tile, connect the large groups
first. Then every pair of nodes of different components that shares a block, whatever its tiles, and
passes the R-tree is verified, so no link between components is lost. There the tree knows, too, how
many shingles each set has from the block's key on in the common order: what two sets share starts at
their first common key, so in its block the smaller of these numbers bounds the overlap. Two sets
that meet only behind many of their own shingles, as those with a common passage do, give no pair.
A pair comes from the block of its first common key alone, as far as the first ``FIRST_KEYS`` keys of
its sets tell. Before whole sets are fetched, pairs are held against counts in ``FINE`` groups: sets
differ at least by the sum of their differences there. Rows of keys with more than ``CROWDED`` sets bring
these counts along, and their pairs are held against them before they are given out; other blocks
give at most half of ``CROWDED`` pairs a row.

Words are lower-cased in A-Z. Fewer than five words are one shingle; no words, or a null text, make
an empty set, which is linked with nothing. Null ids never become the name of a component unless
it has no other. Rows that repeat are copies. Tables without rows give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from casedesk.llm.frames import changes, fresh, named, runs, sliced
from casedesk.llm.graph import components
from casedesk.llm.words import coded_texts, distinct, grams, spans
from casedesk.session import briefly, materialize

SHINGLE = 5
PERCENT = 80
GROUPS = 64
HOT_KEYS = 1 << 16
HOT_LEAST = 48
TILE = 512
FANOUT = 16
PARTNER_ROUNDS = 2
KEYS_TRIED = 3
FIRST_KEYS = 8
FINE = 1024
CROWDED = 48


# --- sets -------------------------------------------------------------------------------------

def shingles(codes: np.ndarray) -> np.ndarray:
    """The sorted set of a document with these word codes."""
    if 0 < len(codes) < SHINGLE:
        return spans(codes, np.array([0]), np.array([len(codes)]))
    return distinct(grams(codes, SHINGLE))


def set_id(found: np.ndarray) -> int:
    raw = hashlib.blake2b(found.tobytes(), digest_size=8).digest()
    return int.from_bytes(raw, "little", signed=True)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def point_of(found: np.ndarray) -> bytes:
    return np.bincount((found >> np.uint64(58)).astype(np.int64) % GROUPS,
                       minlength=GROUPS).astype("<u4").tobytes()


def fine_of(found: np.ndarray) -> bytes:
    """Counts in finer groups, modulo 256."""
    return np.bincount((found >> np.uint64(54)).astype(np.int64), minlength=FINE).astype("u1").tobytes()


Sets = Iterator[tuple[int, bytes, np.ndarray]]


def _sets(batches: Iterator[pa.RecordBatch], column: int = 0, once: bool = True,
          ) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    """Row, text and set of each document; with ``once``, not those this task has seen."""
    seen: set[int] = set()
    for b in sliced(batches, column, 1 << 23):
        def sets(b: pa.RecordBatch = b) -> Sets:
            for i, raw, codes in coded_texts(b.column(column), lower=True):
                found = shingles(codes)
                if once:
                    name = set_id(found)
                    if name in seen or not len(found):
                        continue
                    seen.add(name)
                yield i, raw, found
        yield b, sets()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, sets in _sets(batches, 2, once=False):
        rows = [(set_id(found), len(found)) for _, _, found in sets]
        sid, n = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(sid, pa.int64()), pa.array(n, pa.int64())],
            names=["doc_id", "row_key", "sid", "n"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys whose frequency decides the order: prefixes and a little beyond."""
    for _, sets in _sets(batches):
        keys = [found[: prefix_length(len(found)) + len(found) // 20] for _, _, found in sets]
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64))], names=["key"])


def hot_keys(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent prefix keys, sorted, and how many documents hold each."""
    counts = materialize(texts.mapInArrow(_windows, "key long").groupBy("key").count()
                         .where(F.col("count") >= HOT_LEAST), "frequent")
    level = F.floor(F.log2("count") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).count().collect()  # a few hundred at most
    total, least = 0, None
    for r in sorted(levels, key=lambda r: -r["level"]):
        total += r["count"]
        if total > HOT_KEYS:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.where(level >= least).toPandas()
    key = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], found["count"].to_numpy(np.int64)[order]


def _prefixes(hot: np.ndarray, counts: np.ndarray) -> Callable:
    """(key, tile, sid, rest) of every prefix key; ``rest`` counts shingles from this one on.

    Keys with many documents have several tiles, counted from one; all others have tile 0.
    """
    tiles = -(-counts // TILE)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches):
            keys, tile, sids, sizes, rests = [], [], [], [], []
            for _, _, found in sets:
                place = np.searchsorted(hot, found)
                place[place == len(hot)] = 0
                is_hot = hot[place] == found if len(hot) else np.zeros(len(found), bool)
                cold, frequent = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
                frequent = frequent[np.argsort(counts[place[frequent]], kind="stable")]
                take = np.concatenate((cold, frequent))[: prefix_length(len(found))]
                name = set_id(found)
                own = np.zeros(len(take), np.int32)
                if len(take) > len(cold):
                    frequent = take[len(cold):]
                    n_tiles = tiles[place[frequent]].astype(np.uint64)
                    chosen = (found[frequent] ^ np.uint64(name & (1 << 64) - 1)) % n_tiles
                    own[len(cold):] = np.where(n_tiles > 1, chosen + np.uint64(1), 0)
                keys.append(found[take])
                tile.append(own)
                sids.append(name)
                sizes.append(len(take))
                rests.append(len(found) - np.arange(len(take), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)),
                     pa.array(np.concatenate(tile)),
                     pa.array(np.repeat(np.array(sids, np.int64), sizes)),
                     pa.array(np.concatenate(rests))],
                    names=["key", "tile", "sid", "rest"])
    return emit


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, tile, sid: each once, without blocks of one set."""
    for table in runs(batches, 2):
        key, tile, sid, rest = (c.to_numpy() for c in table.columns)
        block = np.concatenate(([0], changes(table, 2)))
        one = np.concatenate(([True], sid[1:] != sid[:-1]))
        one[block] = True
        many = np.add.reduceat(one.astype(np.int64), block) > 1
        # A tile of a frequent key may hold one set only and still meet those of other tiles.
        keep = one & np.repeat(many | (tile[block] > 0), np.diff(np.append(block, len(key))))
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[keep]) for c in (key, tile, sid, rest)],
                names=["key", "tile", "sid", "rest"])


# --- R-tree -----------------------------------------------------------------------------------

class RTree:
    """Count vectors in a packed R-tree.

    A node knows its largest coordinates, its smallest set and the most that a set below it can
    still share (``rests``; all of the set if not given).
    """

    def __init__(self, points: np.ndarray, rests: np.ndarray | None = None):
        self.points, self.sizes = points, points.sum(1)
        self.order = self._packed(np.arange(len(points)))
        tops, least = points[self.order], self.sizes[self.order]
        most = least if rests is None else rests[self.order]
        self.levels = [(tops, least, most)]
        while len(tops) > FANOUT:
            cuts = np.arange(0, len(tops), FANOUT)
            tops = np.maximum.reduceat(tops, cuts, axis=0)
            least = np.minimum.reduceat(least, cuts)
            most = np.maximum.reduceat(most, cuts)
            self.levels.append((tops, least, most))

    def _packed(self, rows: np.ndarray) -> np.ndarray:
        """Rows in leaf order: halved along the coordinate that spreads most."""
        if len(rows) <= FANOUT:
            return rows
        own = self.points[rows]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        rows = rows[np.argsort(own[:, axis], kind="stable")]
        half = FANOUT
        while half * 2 < len(rows):
            half *= 2
        return np.concatenate((self._packed(rows[:half]), self._packed(rows[half:])))

    def matches(self, queries: np.ndarray, rests: np.ndarray | None = None,
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, point and bound of all pairs whose overlap could reach the threshold."""
        sizes = queries.sum(1)
        rests = sizes if rests is None else rests
        top = len(self.levels[-1][0])
        q = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, least, most = self.levels[depth]
            # The cheap bound first: coordinates are compared for what it leaves.
            near = ((100 + PERCENT) * np.minimum(rests[q], most[node])
                    >= PERCENT * (sizes[q] + least[node]))
            q, node = q[near], node[near]
            keep, bounds = [], []
            for at in range(0, len(q), 1 << 14):
                part = slice(at, at + (1 << 14))
                bound = np.minimum(queries[q[part]], tops[node[part]]).sum(1)
                keep.append((100 + PERCENT) * bound
                            >= PERCENT * (sizes[q[part]] + least[node[part]]))
                bounds.append(bound)
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            q, node = q[keep], node[keep]
            if depth:
                below = len(self.levels[depth - 1][0])
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q = np.repeat(q, FANOUT)
                real = node < below
                q, node = q[real], node[real]
        bound = np.concatenate(bounds)[keep] if len(keep) else np.zeros(0, np.int64)
        return q, self.order[node], bound


def _padded(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The lists as rows of a matrix, and which of its places hold an entry."""
    lists = pa.concat_arrays(lists.chunks)
    ends = lists.offsets.to_numpy()
    known = np.arange(FIRST_KEYS) < np.diff(ends)[:, None]
    out = np.zeros(known.shape, np.int64)
    out[known] = lists.values.to_numpy()[ends[0]:ends[-1]]
    return out, known


def _common(lists: np.ndarray, known: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the lists of two rows have an entry in common, for each pair."""
    found = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        x, y = a[at:at + (1 << 14)], b[at:at + (1 << 14)]
        same = lists[x][:, :, None] == lists[y][:, None, :]
        found[at:at + (1 << 14)] = (
            same & known[x][:, :, None] & known[y][:, None, :]).any((1, 2))
    return found


def _pairs(one: bool) -> Callable:
    """Candidate pairs of blocks: rows (key, i, j, tile, sid, component, rest, point, earlier), sorted by block.

    With ``one`` every point gets the partner of another component with the best bound, at any
    common key; else pairs come from all blocks that can be that of their first common key, but
    where two sets have one of their earlier keys in common. Of blocks whose rows have a tenth column,
    their finer counts, only the pairs that these allow are given.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            cuts = np.concatenate(([0], changes(table, 3), [table.num_rows]))
            i, j, tile, sid, group, rest = (table.column(c).to_numpy() for c in range(1, 7))
            raw = b"".join(table.column(7).to_pylist())
            points = np.frombuffer(raw, "<u4").reshape(-1, GROUPS).astype(np.int64)
            rest = points.sum(1) if one else rest.astype(np.int64)
            earlier, known = _padded(table.column(8))
            fine = table.column(9) if table.num_columns > 9 else None
            found_a, found_b = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                left = np.arange(lo, hi)
                right = left
                if i[lo] != j[lo]:
                    left, right = left[tile[lo:hi] == i[lo]], left[tile[lo:hi] == j[lo]]
                if not len(left) or not len(right) or hi - lo < 2:
                    continue
                q, p, bound = RTree(points[right], rest[right]).matches(points[left], rest[left])
                a, b = left[q], right[p]
                fit = (group[a] != group[b]) & (sid[a] < sid[b] if i[lo] == j[lo]
                                                else np.ones(len(a), bool))
                a, b, bound = a[fit], b[fit], bound[fit]
                if not one:
                    new = ~_common(earlier, known, a, b)
                    a, b = a[new], b[new]
                if fine is not None and len(a) and fine[lo].is_valid:
                    near = _allowed(fine.slice(lo, hi - lo), points[lo:hi].sum(1), a - lo, b - lo)
                    a, b = a[near], b[near]
                if one and len(a):
                    order = np.lexsort((b, -bound, a))
                    first = np.concatenate(([True], a[order][1:] != a[order][:-1]))
                    a, b = a[order][first], b[order][first]
                swap = sid[a] > sid[b]
                found_a.append(np.where(swap, b, a))
                found_b.append(np.where(swap, a, b))
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                yield pa.RecordBatch.from_arrays([pa.array(sid[a]), pa.array(sid[b])],
                                                 names=["a", "b"])
    return emit


# --- verification -----------------------------------------------------------------------------

def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for _, sets in _sets(batches):
        rows = [(set_id(found), len(found), point_of(found), pack.compress(fine_of(found)),
                 pack.compress(raw)) for _, raw, found in sets]
        if rows:
            sid, n, *parts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid, pa.int64()), pa.array(n, pa.int64()),
                 *[pa.array(p, pa.binary()) for p in parts]],
                names=["sid", "n", "point", "fine", "body"])


def _fine_counts(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    raw = b"".join(unpack.decompress(x) for x in column.to_pylist())
    return np.frombuffer(raw, "u1").reshape(-1, FINE)


def _can_match(a: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether finer counts allow a match of sets with ``total`` shingles, row by row.

    Counts are known modulo 256; two differ at least by the shorter way round.
    """
    way = a - b
    apart = np.minimum(way, -way).sum(1, dtype=np.int64)
    return (100 + PERCENT) * (total - apart) >= 2 * PERCENT * total


def _allowed(fine: pa.ChunkedArray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the finer counts of a block's rows allow a match, for each pair of rows."""
    used, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    counts = _fine_counts(fine.take(pa.array(used)))
    x, y = place[:len(a)], place[len(a):]
    found = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 11):
        part = slice(at, at + (1 << 11))
        found[part] = _can_match(counts[x[part]], counts[y[part]], sizes[a[part]] + sizes[b[part]])
    return found


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, n_a, n_b, fine_a, fine_b) whose finer counts allow a match."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1 << 11):
            b = whole.slice(at, 1 << 11)
            total = b.column(2).to_numpy() + b.column(3).to_numpy()
            close = _can_match(_fine_counts(b.column(4)), _fine_counts(b.column(5)), total)
            yield b.select(["a", "b"]).filter(pa.array(close))


def close_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs without those that differ too much in finer groups."""
    left, right = (sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"),
                               F.col("fine").alias(f"fine_{s}")) for s in "ab")
    return (pairs.join(right, "b").join(left, "a")
            .select("a", "b", "n_a", "n_b", "fine_a", "fine_b")
            .mapInArrow(_close, "a long, b long"))


def matches(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(both) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, body_a, body_b) whose sets match."""
    unpack = zstandard.ZstdDecompressor()

    def set_of(body: bytes) -> np.ndarray:
        raw = pa.array([unpack.decompress(body)], pa.binary())
        return shingles(next(coded_texts(raw, lower=True))[2])

    last, own = None, None
    for b in batches:
        rows = []
        for x, y, body_x, body_y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if x != last:
                last, own = x, set_of(body_x)
            if matches(own, set_of(body_y)):
                rows.append((x, y))
        if rows:
            x, y = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())],
                                             names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("sid").alias("a"), F.col("body").alias("body_a"))
    right = sets.select(F.col("sid").alias("b"), F.col("body").alias("body_b"))
    return (pairs.join(right, "b").join(left, "a").sortWithinPartitions("a")
            .select("a", "b", "body_a", "body_b").mapInArrow(_verify, "a long, b long"))


# --- join -------------------------------------------------------------------------------------

def _with_components(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return rows.withColumn("component", F.col("sid"))
    named_ = found.select(F.col("node").alias("sid"), "component")
    return rows.join(named_, "sid", "left").withColumn("component", F.coalesce("component", "sid"))


def _mixed(shared: DataFrame) -> DataFrame:
    """Rows of blocks that hold several components, with the key's tiles and how many sets hold it."""
    blocks = (shared.groupBy("key")
              .agg(F.min("component").alias("low"), F.max("component").alias("high"),
                   F.max("tile").alias("last_tile"), F.count("*").alias("held"))
              .where("low <> high").select("key", "last_tile", "held"))
    return shared.join(blocks, "key")


def _with_earlier(rows: DataFrame) -> DataFrame:
    """Adds ``earlier``: those of the set's first keys that come before the row's one."""
    place = F.struct((-F.col("rest")).alias("place"), "key")
    first = rows.groupBy("sid").agg(
        F.slice(F.array_sort(F.collect_set(place)), 1, FIRST_KEYS)["key"].alias("first"))
    here = F.array_position("first", F.col("key"))
    before = F.when(here > 0, here - 1).otherwise(F.size("first"))
    return rows.join(first, "sid").withColumn(
        "earlier", F.slice("first", F.lit(1), before.cast("int"))).drop("first")


def _candidates(rows: DataFrame, sets: DataFrame, one: bool) -> DataFrame:
    """Pairs of the rows (key, i, j, tile, sid, component, rest, earlier), each once."""
    columns = ["key", "i", "j", "tile", "sid", "component", "rest", "point", "earlier"]
    if not one:
        columns.append(F.when(F.col("held") > CROWDED, F.col("fine")).alias("fine"))
    return (rows.join(sets.select("sid", "point", "fine"), "sid").select(*columns)
            .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(_pairs(one), "a long, b long").distinct())


def linked_sets(texts: DataFrame) -> DataFrame:
    """(node, component) of all sets that are linked with another one; ``texts`` is one column."""
    hot, counts = hot_keys(texts)
    keys = (texts.mapInArrow(_prefixes(hot, counts), "key long, tile int, sid long, rest int")
            .repartition("key", "tile").sortWithinPartitions("key", "tile", "sid")
            .mapInArrow(_shared, "key long, tile int, sid long, rest int"))
    with briefly(keys, "shared-keys") as shared:
        bodies = texts.mapInArrow(
            _packed_texts, "sid long, n long, point binary, fine binary, body binary")
        bodies = (bodies.join(shared.select("sid").distinct(), "sid").groupBy("sid")
                  .agg(*[F.first(c).alias(c) for c in ("n", "point", "fine", "body")]))
        with briefly(bodies, "sets") as sets:
            return _linked(shared, sets)


def _linked(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) from the rows of shared keys; components are stored."""
    links = found = None
    for turn in range(PARTNER_ROUNDS + 1):
        one = turn < PARTNER_ROUNDS
        with briefly(_mixed(_with_components(shared, found)), "mixed") as rows:
            if one:
                # A few keys of each set do for its partner; every turn takes others.
                tried = (rows.groupBy("sid")
                         .agg(F.slice(F.array_sort(F.collect_set("key")), 1 + turn * KEYS_TRIED,
                                      KEYS_TRIED).alias("keys"))
                         .select("sid", F.explode("keys").alias("key")))
                rows = rows.join(tried, ["sid", "key"]).withColumns(
                    {"i": F.col("tile"), "j": F.col("tile"),
                     "earlier": F.array().cast("array<long>")})
            else:
                other = F.explode(F.sequence(F.least(F.lit(1), "last_tile"), F.col("last_tile")))
                rows = (_with_earlier(rows).withColumn("other", other)
                        .withColumns({"i": F.least("tile", "other"),
                                      "j": F.greatest("tile", "other")}))
            pairs = _candidates(rows, sets, one)
            new = materialize(verified(pairs if one else close_pairs(pairs, sets), sets), "links")
        links = new if links is None else links.union(new)
        found = components(links)
    return found


def row_key(ident: Column, text: Column) -> Column:
    """Tells rows apart by id and text; rows equal in both are one document."""
    return F.xxhash64(ident, text)


def classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, n, component_id, kept_key); the row with the kept key represents all."""
    ident, text = named(id_col).cast("long"), named(text_col).cast("string")
    members = materialize(
        docs.select(ident.alias("doc_id"), row_key(ident, text).alias("row_key"),
                    text.alias("text"))
        .mapInArrow(_members, "doc_id long, row_key long, sid long, n long"), "members")
    found = linked_sets(docs.select(text.alias("text")))
    full = _with_components(members.where("n > 0"), found)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    names = full.groupBy("component").agg(F.min("doc_id").alias("component_id"),
                                          F.min_by("row_key", first).alias("kept_key"))
    return (full.join(names, "component")
            .select("doc_id", "row_key", "n", "component_id", "kept_key")
            .unionByName(members.where("n = 0").select(
                "doc_id", "row_key", "n", F.col("doc_id").alias("component_id"),
                F.col("row_key").alias("kept_key"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    ) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return classified(docs, id_col, text_col).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    ) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns.

    Rows that repeat its id and text go like the other members; empty sets all stay, but rows
    equal in id and text stay once.
    """
    row, ident, key = fresh(docs, "row", "ident", "key")
    keep = (classified(docs, id_col, text_col).where("row_key = kept_key")
            .select(F.col("doc_id").alias("keep_id"), F.col("row_key").alias("keep_key"))
            .distinct())
    own, text = named(id_col).cast("long"), named(text_col).cast("string")
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias(row),
                       own.alias(ident), row_key(own, text).alias(key))
    stay = rows.join(keep, (rows[key] == keep["keep_key"])
                     & rows[ident].eqNullSafe(keep["keep_id"]), "left_semi")
    return stay.dropDuplicates([key, ident]).select(f"{row}.*")
