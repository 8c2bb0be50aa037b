"""Multinomial logistic regression whose coefficients are too many for the driver.

It minimises what Spark ML does: the weighted mean of the loss plus half the squared coefficients
times ``penalty``, intercepts free. Every gradient is a sum of the rows' features times a number per
row and class, so the search keeps these numbers, and what they add to the margins, in a table by
blocks of rows, and the coefficients are made once, at the end. One product with the features goes
through tiles: a block of features takes the numbers of all rows, one block of rows after another, sums
them per feature and gives every row its share of the margins back, so that a task holds the tiles of
one block of features whatever the number of rows. What is sent is in single precision, as the features
are. The steps are Newton's, each solved by conjugate gradients
that need one product and one round of sums (Chronopoulos and Gear); along a step the margins are
known, so its length is found without a product. The driver holds sums and intercepts only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from casedesk.session import remove, run_folder, tidy
from casedesk.sources.files import read_optional
from casedesk.sources.versions import remove_bucketed, write_bucketed

ROWS_PER_BLOCK = 4096
# Entries that the tiles of one block of features should hold.
ENTRIES_PER_TASK = 16_000_000
# Entries that are summed at a time.
ENTRIES_AT_ONCE = 500_000
# A Newton step is solved to this share of its gradient, by so many products at most.
LEAST_SHARE, MOST_PRODUCTS = 0.3, 40
# Lengths of a step that are tried at once.
LENGTHS = [0.5 ** i for i in range(8)]

TILES = "b int, r long, n int, counts binary, places binary, entries binary"
VECTORS = ("a", "m", "x", "kx", "p", "kp", "g")
STATE = "r long, n int, y binary, w binary, " + ", ".join(f"{v} binary" for v in VECTORS)
SOLVED = STATE + ", kg binary, sums array<double>"
SENT = "r long, g binary"
SHARES = "r long, share binary"
MARGINS = "position int, coefficients array<double>"
INTERCEPTS = "class int, intercept double"


@dataclass
class TableRegression:
    """A fitted regression: intercepts, and a table of the coefficients of all classes by position."""

    interceptVector: DenseVector
    margins: DataFrame

    @property
    def numClasses(self) -> int:
        return len(self.interceptVector)

    def save(self, path: str) -> None:
        self.margins.write.mode("overwrite").parquet(f"{path}/coefficients")
        rows = list(enumerate(self.interceptVector.toArray().tolist()))
        self.margins.sparkSession.createDataFrame(rows, INTERCEPTS).coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/intercepts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TableRegression | None":
        """The regression of a folder, if it holds one of this kind."""
        schema = spark.createDataFrame([], INTERCEPTS).schema
        rows = sorted(read_optional(spark, f"{path}/intercepts", schema).collect())
        if not rows:
            return None
        return TableRegression(
            Vectors.dense([r.intercept for r in rows]), spark.read.parquet(f"{path}/coefficients"))


def _array(column: pa.ChunkedArray, i: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), kind)


def _table(columns: dict[str, list], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.record_batch([pa.array(columns[name], kinds[kind]) for name, kind in fields],
                           names=[name for name, _ in fields])


def _tiled(rows: DataFrame, labels: list[int]) -> DataFrame:
    """Rows in blocks: for each block of features their entries in it, and at -1 label and weight.

    A feature lies in the block that its position leaves a rest for. Weights of entries are in single precision.
    """
    blocks = len(labels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BLOCK):
                some = batch.slice(start, ROWS_PER_BLOCK)
                n, r = some.num_rows, (TaskContext.get().partitionId() << 32) + made
                made += 1
                positions, values = some.column("indices"), some.column("values")
                row = np.repeat(np.arange(n), positions.value_lengths().to_numpy())
                positions = positions.flatten().to_numpy()
                values = values.flatten().to_numpy().astype(np.float32)
                out = {"b": [-1], "r": [r], "n": [n], "counts": [b""],
                       "places": [some.column("label").to_numpy().astype(np.int8).tobytes()],
                       "entries": [some.column("weight").to_numpy().tobytes()]}
                for b, label in enumerate(labels):
                    own = positions % blocks == b
                    out["b"].append(label)
                    out["r"].append(r)
                    out["n"].append(n)
                    out["counts"].append(np.bincount(row[own], minlength=n).astype(np.int32).tobytes())
                    out["places"].append((positions[own] // blocks).astype(np.int32).tobytes())
                    out["entries"].append(values[own].tobytes())
                yield _table(out, TILES)

    return rows.select(
        "label", "weight", F.col("features.indices").alias("indices"),
        F.col("features.values").alias("values")).mapInArrow(cut, TILES)


def _labels(spark: SparkSession, blocks: int) -> list[int]:
    """Names of blocks of features such that each has a bucket of its own."""
    bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(blocks)).alias("bucket")
    rows = spark.range(blocks * 64).groupBy(bucket).agg(F.min("id").alias("id")).collect()
    return sorted(r.id for r in rows)


class _Summed:
    """Per feature of a block the sum over the rows: weight times the numbers of the row."""

    def __init__(self, classes: int, width: int):
        self.total, self.waiting, self.size, self.rows = np.zeros((classes, width)), [], 0, 0

    def add(self, tile: tuple[bytes, bytes, bytes], numbers: np.ndarray) -> None:
        places, weight, row = _entries(tile)
        self.waiting.append((places, weight, row + self.rows, numbers.T))
        self.size, self.rows = self.size + len(places), self.rows + len(numbers)
        if self.size >= max(self.total.shape[1], ENTRIES_AT_ONCE):
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            places, weight, rows, numbers = (np.concatenate(x, axis=-1) for x in zip(*self.waiting))
            for c, total in enumerate(self.total):
                total += np.bincount(places, weight * numbers[c, rows], len(total))
        self.waiting, self.size, self.rows = [], 0, 0


def _entries(tile: tuple[bytes, bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the feature, weight and row of each entry of a tile."""
    counts = np.frombuffer(tile[0], np.int32)
    return (np.frombuffer(tile[1], np.int32).astype(np.intp),
            np.frombuffer(tile[2], np.float32).astype(np.float64),
            np.repeat(np.arange(len(counts)), counts))


def _met(tiles: DataFrame, moved: DataFrame, vector: str, labels: list[int]) -> DataFrame:
    """Every tile with the numbers of its rows, a block of features in one task: that of its bucket.

    The join is on the block alone, as the tiles lie, and the tiles are the side that it holds; written as an
    equality, the rows would be a key as well, and both sides would be dealt out by it.
    """
    numbers = moved.select(F.col("r").alias("s"), F.col(vector).alias("g")).withColumn(
        "b", F.explode(F.array(*[F.lit(b) for b in labels])))
    same = (F.col("s") <= F.col("r")) & (F.col("s") >= F.col("r"))
    own = tiles.withColumnRenamed("b", "block")
    return numbers.repartition(len(labels), "b").hint("merge").join(
        own, (F.col("b") == F.col("block")) & same).select(
        "b", "r", "n", "counts", "places", "entries", "g")


def _per_block(batches: Iterator[pa.RecordBatch], classes: int, width: int, kind, row_blocks: int, keep: bool):
    """(block of features, its sums, its tiles if they are kept) from rows sorted by block."""
    last, sums, tiles, met = None, None, [], 0

    def whole():
        if met != row_blocks:
            raise RuntimeError(f"a block of features met {met} of {row_blocks} blocks of rows in a task")
        sums.settle()
        return last, sums.total, tiles

    for batch in batches:
        for b, r, n, counts, places, entries, g in zip(*(c.to_pylist() for c in batch.columns)):
            if b != last:
                if last is not None:
                    yield whole()
                last, sums, tiles, met = b, _Summed(classes, width), [], 0
            tile, met = (counts, places, entries), met + 1
            sums.add(tile, np.frombuffer(g, kind).reshape(n, classes).astype(np.float64, copy=False))
            if keep:
                tiles.append((r, n, tile))
    if last is not None:
        yield whole()


def _product(tiles: DataFrame, moved: DataFrame, labels: list[int], classes: int, size: int,
             row_blocks: int) -> DataFrame:
    """What each block of features adds to the margins of each block of rows."""
    width = math.ceil(size / len(labels))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, total, own in _per_block(batches, classes, width, np.float32, row_blocks, True):
            for r, n, tile in own:
                places, weight, row = _entries(tile)
                share = np.empty((n, classes), np.float32)
                for c in range(classes):
                    share[:, c] = np.bincount(row, weight * total[c, places], n)
                yield _table({"r": [r], "share": [share.tobytes()]}, SHARES)

    return _met(tiles, _short(moved), "g", labels).mapInArrow(add, SHARES)


def _short(moved: DataFrame) -> DataFrame:
    """The numbers of the rows in single precision, as they are sent."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, g in zip(*(c.to_pylist() for c in batch.columns)):
                yield _table({"r": [r], "g": [np.frombuffer(g).astype(np.float32).tobytes()]}, SENT)

    return moved.select("r", "g").mapInArrow(cut, SENT)


def _probabilities(margins: np.ndarray) -> np.ndarray:
    powers = np.exp(margins - margins.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _bent(p: np.ndarray, w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Change of the loss's slope at the margins when these move by ``u``."""
    v = p * u
    return w[:, None] * (v - p * v.sum(axis=1, keepdims=True))


def _block(batch, i: int, classes: int) -> dict[str, np.ndarray]:
    """Vectors of a block of rows; what is not there yet is zero."""
    n = batch.column("n")[i].as_py()
    held = {"y": _array(batch.column("y"), i, np.int8), "w": _array(batch.column("w"), i)}
    for v in [*VECTORS, "kg"]:
        there = v in batch.schema.names and batch.column(v)[i].is_valid
        held[v] = _array(batch.column(v), i).reshape(n, classes) if there else np.zeros((n, classes))
    return held


def _begun(tiles: DataFrame) -> DataFrame:
    """The rows before the first step: all vectors empty."""
    nothing = [F.lit(None).cast("binary").alias(v) for v in VECTORS]
    return tiles.filter("b = -1").select(
        "r", "n", F.col("places").alias("y"), F.col("entries").alias("w"), *nothing)


def _moved(state: DataFrame, classes: int, change) -> DataFrame:
    """The vectors of all blocks, changed by a function of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = _block(batch, i, classes)
                held.update(change(held))
                out = {v: [held[v].tobytes()] for v in ("y", "w", *VECTORS)}
                yield _table(out | {"r": [batch.column("r")[i].as_py()], "n": [len(held["y"])]}, STATE)

    return state.mapInArrow(run, STATE)


def _start(length: float, intercepts: np.ndarray, weights: float, penalty: float):
    """Goes a length along the last step, to where the next one starts: at minus the gradient."""
    def change(held):
        a, m = held["a"] + length * held["x"], held["m"] + length * held["kx"]
        slope = _probabilities(m + intercepts)
        slope[np.arange(len(slope)), held["y"]] -= 1
        g = -(slope * (held["w"] / weights)[:, None] + penalty * a)
        none = np.zeros_like(a)
        return {"a": a, "m": m, "x": none, "kx": none, "p": none, "kp": none, "g": g}
    return change


def _go_on(alpha: float, beta: float, towards: np.ndarray, intercepts: np.ndarray, weights: float,
           penalty: float):
    """One step of conjugate gradients; ``towards`` is what the direction does to the intercepts."""
    def change(held):
        p, kp = held["g"] + beta * held["p"], held["kg"] + beta * held["kp"]
        chances = _probabilities(held["m"] + intercepts)
        bent = _bent(chances, held["w"] / weights, kp + towards) + penalty * p
        return {"p": p, "kp": kp, "x": held["x"] + alpha * p, "kx": held["kx"] + alpha * kp,
                "g": held["g"] - alpha * bent}
    return change


def _solved(moved: DataFrame, parts: DataFrame, classes: int, shifted: np.ndarray,
            intercepts: np.ndarray, weights: float, penalty: float) -> DataFrame:
    """The rows with their product, and the sums that the next step of the search needs."""
    def finish(own: pa.Table, found: pa.Table) -> pa.Table:
        held = _block(own, 0, classes)
        kg = np.zeros_like(held["g"])
        for i in range(found.num_rows):
            kg += _array(found.column("share"), i, np.float32).reshape(kg.shape)
        bent = _bent(_probabilities(held["m"] + intercepts), held["w"] / weights, kg + shifted)
        sums = [(held["g"] * kg).sum(), ((bent + penalty * held["g"]) * kg).sum(), *bent.sum(axis=0)]
        more = _table({"kg": [kg.tobytes()], "sums": [sums]}, "kg binary, sums array<double>")
        return own.append_column("kg", more.column("kg")).append_column("sums", more.column("sums"))

    return moved.groupBy("r").cogroup(parts.groupBy("r")).applyInArrow(finish, SOLVED)


def _tried(state: DataFrame, lengths: list[float], intercepts: np.ndarray, step: np.ndarray,
           classes: int) -> np.ndarray:
    """Sums along a step: three for the penalty; for each length the loss and slopes of the intercepts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = _block(batch, i, classes)
                sums = [(held["a"] * held["m"]).sum(), (held["a"] * held["kx"]).sum(),
                        (held["x"] * held["kx"]).sum()]
                n, w = np.arange(len(held["y"])), held["w"]
                for t in lengths:
                    margins = held["m"] + t * held["kx"] + intercepts + t * step
                    top = margins.max(axis=1)
                    total = top + np.log(np.exp(margins - top[:, None]).sum(axis=1))
                    slope = _probabilities(margins)
                    slope[n, held["y"]] -= 1
                    sums += [(w * (total - margins[n, held["y"]])).sum(), *(w @ slope)]
                yield _table({"sums": [sums]}, "sums array<double>")

    return _sums(state.mapInArrow(run, "sums array<double>"))


def _sums(blocks: DataFrame) -> np.ndarray:
    """Sums over the blocks of rows: a short list of numbers for each."""
    return np.sum([r.sums for r in blocks.select("sums").collect()], axis=0)


def _coefficients(tiles: DataFrame, state: DataFrame, labels: list[int], classes: int, size: int,
                  row_blocks: int) -> DataFrame:
    blocks, width = len(labels), math.ceil(size / len(labels))
    places = {label: b for b, label in enumerate(labels)}

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, total, _ in _per_block(batches, classes, width, np.float64, row_blocks, False):
            positions = np.arange(width, dtype=np.int32) * blocks + places[b]
            total = total[:, positions < size]
            lists = pa.ListArray.from_arrays(
                np.arange(total.shape[1] + 1, dtype=np.int32) * classes, total.T.ravel())
            yield pa.record_batch({"position": positions[positions < size], "coefficients": lists})

    return _met(tiles, state, "a", labels).mapInArrow(give, MARGINS)


def fit(rows: DataFrame, size: int, entries: int, histogram: list[float], penalty: float, folder: str,
        max_iter: int, tol: float) -> TableRegression:
    """Fits ``label, weight, features`` with ``size`` features and ``entries`` of them in all rows.

    ``histogram`` holds the weight of each class. The search ends where the slope is at most ``tol`` times the
    loss, or after ``max_iter`` products. Coefficients are written to ``folder``.
    """
    spark, classes, weights = rows.sparkSession, len(histogram), sum(histogram)
    labels = _labels(spark, max(spark.sparkContext.defaultParallelism, math.ceil(entries / ENTRIES_PER_TASK)))
    home = run_folder(spark, "tiles")
    stored = write_bucketed(_tiled(rows, labels), home, len(labels), "b")
    tiles, row_blocks = stored.filter("b >= 0"), stored.filter("b = -1").count()

    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        """The rows as files; those of the round before go."""
        kept.append(run_folder(spark, "rows"))
        with tidy(spark):
            df.write.option("compression", "zstd").parquet(kept[-1])
        if len(kept) > 1:
            remove(spark, kept.pop(0))
        return spark.read.schema(df.schema).parquet(kept[-1])

    def solved(moved: DataFrame, shifted: np.ndarray) -> tuple[DataFrame, float, float, np.ndarray]:
        parts = _product(tiles, moved, labels, classes, size, row_blocks)
        state = keep(_solved(moved, parts, classes, shifted, intercepts, weights, penalty))
        gg, gbg, *bent = _sums(state)
        return state, gg + shifted @ shifted, gbg + shifted @ np.array(bent), np.array(bent)

    intercepts = np.log1p(histogram)
    intercepts -= intercepts.mean()
    state, products, length, first = _begun(stored), 0, 0.0, None
    loss, *slope = _tried(state, [0.0], intercepts, np.zeros(classes), classes)[3:] / weights
    while True:
        g = -np.array(slope)
        state, gg, gbg, bent = solved(
            _moved(state, classes, _start(length, intercepts, weights, penalty)), g)
        products += 1
        norm = math.sqrt(gg)
        first = first or norm
        if norm <= tol * loss or products >= max_iter:
            break
        enough = norm * min(LEAST_SHARE, math.sqrt(norm / first))
        step, p, s = np.zeros(classes), np.zeros(classes), np.zeros(classes)
        alpha, beta = gg / gbg, 0.0
        for _ in range(MOST_PRODUCTS):
            p, s = g + beta * p, bent + beta * s
            step, g = step + alpha * p, g - alpha * s
            last = gg
            state, gg, gbg, bent = solved(_moved(
                state, classes, _go_on(alpha, beta, p, intercepts, weights, penalty)), g)
            products += 1
            beta = gg / last
            if math.sqrt(max(gg, 0.0)) <= enough or products >= max_iter:
                break
            alpha = gg / (gbg - beta * gg / alpha)
        sums = _tried(state, LENGTHS, intercepts, step, classes)
        tried = [(sums[i] / weights + penalty / 2 * (sums[0] + 2 * t * sums[1] + t * t * sums[2]), t, i)
                 for t, i in zip(LENGTHS, range(3, len(sums), classes + 1))]
        best, length, i = min(tried)
        if not best < loss:
            break
        loss, slope = best, sums[i + 1:i + 1 + classes] / weights
        intercepts = intercepts + length * step

    with tidy(spark):
        _coefficients(tiles, state, labels, classes, size, row_blocks).write.mode("overwrite").parquet(folder)
    remove(spark, kept.pop())
    remove_bucketed(spark, home)
    return TableRegression(Vectors.dense(intercepts - intercepts.mean()), spark.read.parquet(folder))
