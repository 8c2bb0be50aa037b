"""Secret scans by an incremental ledger of blobs.

Every historical version of every text is content-addressed: its blob is the SHA-256 of its UTF-8
bytes. The ledger is a folder of tables that only grow: ``paths`` (path, version, blob) of all that
was ever seen, ``scans`` (blob, rule, rule_version) of what was scanned, and ``findings`` (blob,
rule, rule_version, start, end). An update scans a blob only with the rules, at their versions, it
was not scanned with before, and each distinct blob once, however many paths and versions hold it.
Findings are joined back to all paths, so a secret that a file lost in a later version is still
reported for the version that held it, and a new rule reaches all history that is given again.

An update writes its segments under its number and then a mark that it is whole; segments without
the mark do not count. An update that broke off is given again: it gets the same number and
overwrites what was left. One update runs at a time.

The row that stands for a blob is chosen by id before any text moves, and rows meet the choice by
blob, path and version, so copies that make up a third of all rows spread over the tasks and are not
scanned. The join back to paths is salted.

A null text is an empty one. Texts of any length are scanned whole. A null path is a path like any
other, rows that repeat are rows each, and tables without rows have no findings. Only the named
columns are read, so others do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casedesk.llm.frames import named, sliced
from casedesk.session import materialize, run_folder
from casedesk.sources.files import read_optional

SALTS = 16

PATHS = "update long, path long, version long, blob binary"
SCANS = "update long, blob binary, rule int, rule_version int"
FINDINGS = "update long, blob binary, rule int, rule_version int, start long, end long"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of the pattern whose group has at least ``least`` characters.

    Matches are found from the left and do not overlap; those too short are dropped afterwards.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# The kinds of secrets, in the order in which they are listed.
RULES = (
    Rule("assign", 1, r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                      r"([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
)


def compiled(rule: Rule) -> re.Pattern:
    """The rule's pattern; a single class that repeats is only tried where it is long enough.

    A run of one class is matched whole and can't be cut shorter, so asking for its least length
    in the pattern gives the same matches and skips all the short runs.
    """
    single = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return re.compile(f"{single[1]}{{{rule.least},}}" if single else rule.pattern)


def found(text: str, rule: Rule, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of a rule in code points, end exclusive."""
    for match in pattern.finditer(text):
        if match.end(rule.group) - match.start(rule.group) >= rule.least:
            yield match.span()


def _scanner(rules: tuple[Rule, ...]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [compiled(rule) for rule in rules]
        for b in sliced(batches, 2):
            rows = []
            for blob, todo, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for i in todo:
                    rows += [(blob, i, rules[i].version, *span)
                             for span in found(text or "", rules[i], patterns[i])]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        zip(*rows, strict=True),
                        (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()),
                        strict=True)],
                    names=["blob", "rule", "rule_version", "start", "end"])
    return emit


class Ledger:
    """The tables of a ledger below one folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), tuple(rules)

    def table(self, name: str, schema: str) -> DataFrame:
        kind = self.spark.createDataFrame([], schema).schema
        return read_optional(self.spark, f"{self.folder}/{name}", kind)

    def _whole(self, name: str, schema: str) -> DataFrame:
        """A table without the rows of updates that broke off."""
        return self.table(name, schema).join(self.table("done", "update long"), "update", "left_semi")

    def scans(self) -> DataFrame:
        return self._whole("scans", SCANS)

    def paths(self) -> DataFrame:
        return self._whole("paths", PATHS)

    def findings(self) -> DataFrame:
        """One row per blob, rule, rule version and span."""
        return self._whole("findings", FINDINGS).drop("update")

    def _write(self, df: DataFrame, name: str, update: int) -> None:
        (df.write.mode("overwrite").option("compression", "zstd")
         .parquet(f"{self.folder}/{name}/update={update}"))

    def update(self, texts: DataFrame, path_col: str = "doc_id", text_col: str = "text",
               version: Column | None = None) -> int:
        """Records versions of texts and scans what was not scanned yet; returns its number."""
        last = self.table("done", "update long").agg(F.max("update")).first()[0]
        update = 0 if last is None else last + 1
        text = F.coalesce(named(text_col).cast("string"), F.lit(""))
        rows = texts.select(
            named(path_col).cast("long").alias("path"),
            (F.lit(0) if version is None else version).cast("long").alias("version"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))
        self._write(rows.drop("text"), "paths", update)
        seen = (self.spark.read.schema("path long, version long, blob binary")
                .parquet(f"{self.folder}/paths/update={update}"))

        # Of every blob the row that stands for it, and the rules it still has to meet.
        pairs = seen.groupBy("blob").agg(
            F.min(F.struct(F.col("path").isNull().alias("no_path"), "path", "version"))
            .alias("row")).withColumn("rule", F.explode(F.array(*[
                F.struct(F.lit(i).alias("rule"), F.lit(r.version).alias("rule_version"))
                for i, r in enumerate(self.rules)]))).select("blob", "row", "rule.*")
        todo = (pairs.join(self.scans(), ["blob", "rule", "rule_version"], "left_anti")
                .groupBy("blob").agg(F.first("row").alias("row"),
                                     F.sort_array(F.collect_list("rule")).alias("rules")))
        todo = materialize(todo, "unseen-blobs")
        chosen = todo.select(
            F.col("blob").alias("t_blob"), F.col("row.path").alias("t_path"),
            F.col("row.version").alias("t_version"), "rules")
        whole = rows.join(chosen, (F.col("blob") == F.col("t_blob"))
                          & F.col("path").eqNullSafe(F.col("t_path"))
                          & F.col("version").eqNullSafe(F.col("t_version")))
        spans = whole.select("blob", "rules", "text").mapInArrow(
            _scanner(self.rules), "blob binary, rule int, rule_version int, start long, end long")
        # Rows that repeat path, version and text were scanned each.
        self._write(spans.distinct(), "findings", update)
        versions = F.array(*[F.lit(r.version) for r in self.rules])
        self._write(todo.select("blob", F.explode("rules").alias("rule")).withColumn(
            "rule_version", F.get(versions, F.col("rule"))), "scans", update)
        self._write(self.spark.range(1).select(F.lit(True).alias("whole")), "done", update)
        return update

    def report(self, update: int | None = None) -> DataFrame:
        """Per path and version: blob and findings (start, rule, end) of the current rules, in order.

        All history, or the rows of one update.
        """
        current = F.array(*[F.lit(r.version) for r in self.rules])
        spans = (self.findings()
                 .where(F.col("rule_version") == F.get(current, F.col("rule")))
                 .groupBy("blob").agg(F.sort_array(F.collect_list(
                     F.struct("start", "rule", "end"))).alias("spans"))
                 .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        salt = F.pmod(F.xxhash64("path", "version"), F.lit(SALTS)).cast("int")
        none = F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")
        paths = self.paths()
        if update is not None:
            paths = paths.where(F.col("update") == update)
        return (paths.withColumn("salt", salt).join(spans, ["blob", "salt"], "left")
                .select("path", "version", "blob", F.coalesce("spans", none).alias("spans")))


def span_list(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the number of spans of each kind, base_sha256, spans.

    The ledger is kept in ``folder``, or made anew for this run.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, folder or run_folder(spark, "secrets"), rules)
    update = ledger.update(docs, id_col, text_col)

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == i)).cast("long")

    counts = [count(i).alias(f"n_{rule.kind}") for i, rule in enumerate(rules)]
    listed = span_list(F.col("spans"), rules)
    return ledger.report(update).select(
        F.col("path").alias("doc_id"), *counts,
        F.sha2(listed.cast("binary"), 256).alias("base_sha256"), listed.alias("spans"))
