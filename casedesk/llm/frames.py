"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that the table does not have yet, however it was named."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = next(n for n in (f"{stem}_{i}" for i in count()) if n.lower() not in taken)
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """A column by its literal name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c.cast(f.type)
         for c, f in zip(columns, schema, strict=True)], schema=schema)


def sliced(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 24,
           ) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one slice take about ``limit`` bytes at most."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total + size > limit and i > start:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += size
        yield b.slice(start)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and all(held[-1].column(i)[held[-1].num_rows - 1] == b.column(i)[0]
                        for i in range(keys)):
            cut = _first_end(b, keys)
            held.append(b.slice(0, cut))
            b = b.slice(cut)
            if not b.num_rows:
                continue
        if held:
            yield pa.Table.from_batches(held)
        last = _last_start(b, keys)
        if last:
            yield pa.Table.from_batches([b.slice(0, last)])
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def changes(table: pa.RecordBatch | pa.Table, keys: int) -> np.ndarray:
    """Where a new group starts, first row excluded."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for i in range(keys):
        values = table.column(i).to_numpy(zero_copy_only=False) \
            if isinstance(table, pa.RecordBatch) else table.column(i).to_numpy()
        new |= values[1:] != values[:-1]
    return np.flatnonzero(new) + 1


def _first_end(b: pa.RecordBatch, keys: int) -> int:
    at = changes(b, keys)
    return int(at[0]) if len(at) else b.num_rows


def _last_start(b: pa.RecordBatch, keys: int) -> int:
    at = changes(b, keys)
    return int(at[-1]) if len(at) else 0
