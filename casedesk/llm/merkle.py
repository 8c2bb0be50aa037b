"""Merkle manifest of a table by nested-interval labels, with a proof for every row.

Rows are leaves; the leaves of a group, in order, make a tree whose nodes hash runs of at most
``FAN`` neighbours, and the groups' roots, in order, make one more tree over all of them. A node is
labelled with the interval of leaf ranks that it covers, [lo, hi), and its level. At a level all
intervals but the last have one width, so ``lo`` divided by the width of the level above is the
bucket in which a node meets its parent: the join that attaches ancestors is an equi-join on group
and bucket with containment of the intervals as its condition, from the roots down, and what a
parent's children cover besides the node's own interval are its siblings.

Ranks come from range partitions of the order, numbered in each task and shifted by the counts
before them, so a group of any size is spread over many tasks; a join key never has more than
``FAN`` rows. The texts are read once and only digests travel on, as 32 bytes each.

Null fields hash as ``-``, empty ones as ``0:``. A null group is a group of its own and comes first,
then groups by their UTF-8 bytes; null ids come first in their group. Rows that share group and id
follow each other by digest, and rows that repeat are leaves each. A text of any length is one
field. A table without rows gives none. Only the named columns are read, so others do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from casedesk.llm.frames import changes, named
from casedesk.session import materialize

FAN = 3
STORED = 2  # levels joined in one job


def field(value: Column) -> Column:
    """A value with the number of its bytes in front; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 over the fields of a row."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the task and the place among the rows of the first column's value."""
    part, last, at = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        starts = np.concatenate(([0], changes(b, 1)))
        place = np.arange(b.num_rows)
        place -= np.repeat(starts, np.diff(np.append(starts, b.num_rows)))
        if b.column(0)[0].as_py() == last:
            place[: starts[1] if len(starts) > 1 else b.num_rows] += at
        last, at = b.column(0)[b.num_rows - 1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(b.num_rows, part), pa.int64()), pa.array(place)],
            names=[*b.schema.names, "part", "place"])


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with ``lo``, their rank from 0 in their group by ``order``, and ``n``, its size.

    The first column, without nulls, is the group.
    """
    group = rows.columns[0]
    # Rows alike in all of the order are told apart, so that no number of them needs one task.
    tied = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), name)
    keys = [group, *order, "tie"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = materialize(
        tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
        .mapInArrow(_numbered, f"{schema}, part long, place long"), f"{name}-placed")
    counts = placed.groupBy(group, "part").agg(F.count("*").alias("rows"))
    # One row per task that holds a part of the group.
    before = counts.alias("a").selectExpr(
        f"`{group}`", "part",
        f"sum(rows) over (partition by `{group}` order by part) - rows as before",
        f"sum(rows) over (partition by `{group}`) as n")
    return materialize(placed.join(before, [group, "part"]).select(
        *rows.columns, (F.col("before") + F.col("place")).alias("lo"), "n"), f"{name}-ranked")


def levels(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """Node tables from the leaves up: group, lo, hi, n, digest, children.

    ``leaves`` holds group, lo, n and digest. A run of one node is hashed like any other; a group
    stops at the level where one node covers it.
    """
    child = F.struct("lo", "hi", "digest")
    nodes = leaves.select(
        "group", "lo", (F.col("lo") + 1).alias("hi"), "n", "digest",
        F.array().cast("array<struct<lo:bigint,hi:bigint,digest:binary>>").alias("children"))
    out, width = [nodes], fan
    most = leaves.agg(F.max("n")).first()[0] or 0
    while width < most * fan:
        runs = (nodes.where("not (lo = 0 and hi = n)")
                .groupBy("group", F.expr(f"lo div {width}").alias("bucket"))
                .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("n").alias("n"),
                     F.sort_array(F.collect_list(child)).alias("children")))
        joined = F.array_join(F.transform("children", lambda c: _hex(c["digest"])), "")
        nodes = materialize(
            runs.select("group", "lo", "hi", "n",
                        F.unhex(F.sha2(joined.cast("binary"), 256)).alias("digest"), "children"),
            f"level-{len(out)}")
        out.append(nodes)
        width *= fan
    return out


def _together(children: Column) -> Column:
    return F.aggregate(children, F.unhex(F.lit("")), lambda all_, c: F.concat(all_, c["digest"]))


def _step(children: Column, lo: Column, hi: Column) -> Column:
    """What the parent's interval holds besides the node's: the siblings before and after it."""
    return F.struct(
        _together(F.filter(children, lambda c: c["hi"] <= lo)).alias("before"),
        _together(F.filter(children, lambda c: c["lo"] >= hi)).alias("after"))


def paths(tree: list[DataFrame], tops: DataFrame | None = None, fan: int = FAN) -> DataFrame:
    """The leaves with ``path``, the siblings level by level up to the root, and ``top``.

    ``tops`` holds, per group, the path that goes on above the group's root, if any; its further
    columns are handed down. ``top`` is the digest of the group's root. Every few levels are stored,
    so that no plan grows with the number of levels.
    """
    extra = [c for c in tops.columns if c not in ("group", "path")] if tops else []
    no_steps = F.array().cast("array<struct<before:binary,after:binary>>")
    above = None
    for depth in range(len(tree) - 1, -1, -1):
        nodes = tree[depth]
        found = nodes.where("lo = 0 and hi = n").withColumn("top", F.col("digest"))
        found = found.join(tops, "group") if tops else found.withColumn("path", no_steps)
        if above is not None:
            width = fan ** (depth + 1)
            parent = above.select(
                F.col("group").alias("p_group"), F.col("lo").alias("p_lo"),
                F.col("hi").alias("p_hi"), F.col("children").alias("p_children"),
                F.col("path").alias("p_path"), "top", *extra)
            inner = nodes.where("not (lo = 0 and hi = n)").join(
                parent, (F.col("group") == F.col("p_group"))
                & F.expr(f"lo div {width} = p_lo div {width}")
                & F.expr("p_lo <= lo and hi <= p_hi"))
            step = _step(F.col("p_children"), F.col("lo"), F.col("hi"))
            found = found.unionByName(inner.select(
                *nodes.columns, "top", F.concat(F.array(step), "p_path").alias("path"), *extra))
        above = materialize(found, f"paths-{depth}") if depth and depth % STORED == 0 else found
    return above.drop("children")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hex digest and a path lead to."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(
        F.concat(_hex(s["before"]), digest, _hex(s["after"])).cast("binary"), 256))


def path_digest(path: Column) -> Column:
    """Hex SHA-256 over all siblings of a path."""
    steps = F.transform(path, lambda s: F.concat(_hex(s["before"]), _hex(s["after"])))
    return F.sha2(F.array_join(steps, "").cast("binary"), 256)


def manifest(table: DataFrame, id_col: str, group_col: str, values: list[str],
             keep: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """Per row: id, leaf, subroot, root (hex digests), path, and the columns of ``keep``.

    ``values`` names the columns that a leaf covers, in order.
    """
    keep = keep or {}
    group = F.coalesce(F.concat(F.lit("+"), named(group_col).cast("string")), F.lit("!"))
    rows = table.select(
        group.alias("group"), named(id_col).cast("long").alias("id"),
        F.unhex(leaf_digest(*[named(v) for v in values])).alias("digest"),
        *[value.alias(f"keep_{name}") for name, value in keep.items()])
    leaves = ranked(rows, ["id", "digest"], "leaves")
    tree = levels(leaves.select("group", "lo", "n", "digest"), fan)
    subroots = reduce(DataFrame.unionByName, [
        nodes.where("lo = 0 and hi = n").select("group", "digest") for nodes in tree])
    tops = ranked(subroots.select(F.lit("").alias("group"), F.col("group").alias("source"),
                                  "digest"), ["source"], "subroots")
    top_tree = levels(tops.select("group", "lo", "n", "digest"), fan)
    top_paths = paths(top_tree, fan=fan).select("lo", "path", F.col("top").alias("root"))
    tops = materialize(tops.join(top_paths, "lo").select(
        F.col("source").alias("group"), "path", "root"), "subroot-paths")
    found = paths(tree, tops, fan).select("group", "lo", "path", "top", "root")
    return leaves.drop("n").join(found, ["group", "lo"]).select(
        "id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("top")).alias("subroot"),
        _hex(F.col("root")).alias("root"), "path",
        *[F.col(f"keep_{name}").alias(name) for name in keep])


def verified(docs: DataFrame, tampered: Column, fan: int = FAN) -> DataFrame:
    """Documents with their proofs, checked after the line breaks of tampered texts went.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    values = ["doc_id", "source", "lang", "n_chars", "text"]
    text = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = leaf_digest(*[F.col(v) for v in values[:-1]], text)
    rows = manifest(docs, "doc_id", "source", values, {"claimed": F.unhex(claimed)}, fan)
    root = folded(_hex(F.col("claimed")), F.col("path"))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        path_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
