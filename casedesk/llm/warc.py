"""WARC archives written and read by Spark, with record boundaries verified as a chain.

Writing: a record is one text row of header, blank line and payload, and the text sink's line
separator is the two line ends that close a record, so the sink writes valid archives to any
store. Of records with equal payloads the first by id holds the payload; the others are revisit
records that name it. Payloads under ``SMALLEST`` bytes are always written in full.

Reading: the text source splits archives at every occurrence of the version line, in splits of any
size. An occurrence is only a candidate, as payloads may hold the version line too. Every task
emits for its candidates the offset at which the record would end and the next begin. Whatever
is reachable from the start of the file along these successors is a record, everything else is
payload. Reachability is found by pointer jumping: successors are first followed inside a split,
by the task that read it, so that one row per candidate that another split points to is left;
these double their reach in every join until the chain of the longest file is known.

Offsets are absolute in the uncompressed archive: lengths before a split are summed per file.
A record that holds the version line is put together again from its parts.

Null payloads are empty ones, null ids are written as such and sort last among owners; rows that
repeat an id are records of their own. A file that breaks off or breaks the chain ends there: the
rest is unreachable. Tables without rows give an archive without records, and that none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casedesk.llm.frames import batch, named
from casedesk.session import materialize, run_folder

VERSION = "WARC/1.0\r\n"
END = "\r\n\r\n"
SMALLEST = 100
ID = re.compile(rb"<urn:page:(-?\d+|null)>")

CANDIDATES = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("nth", pa.int64()), ("place", pa.int64()),
    ("size", pa.int64()), ("span", pa.int64()), ("exit_place", pa.int64()),
    ("record_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()),
    ("whole", pa.bool_()), ("raw", pa.binary())])
CANDIDATE_DDL = ("file string, block long, nth long, place long, size long, span long, "
                 "exit_place long, record_id long, uri string, record_type string, "
                 "refers_to long, payload_bytes long, digest string, whole boolean, raw binary")


# --- writing ----------------------------------------------------------------------------------

def with_revisits(pages: DataFrame, id_col: str, payload_col: str,
                  smallest: int = SMALLEST) -> DataFrame:
    """(record_id, uri, payload, bytes, digest, refers_to); only columns that are written."""
    payload = F.coalesce(named(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        named(id_col).cast("long").alias("record_id"), payload.alias("payload"),
        (named("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string"))
        .alias("uri"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha2(payload.cast("binary"), 256).alias("digest"))
    # Copies are grouped by digest without their payloads; the sums are made before the shuffle.
    owner = (rows.where(F.col("bytes") >= smallest).groupBy("digest")
             .agg(F.min("record_id").alias("owner"), F.count("*").alias("copies"))
             .where("copies > 1").select("digest", "owner"))
    again = F.col("owner").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("owner")) & (
        F.col("bytes") >= smallest)
    return (rows.join(owner, "digest", "left")
            .withColumn("refers_to", F.when(again, F.col("owner"))).drop("owner"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(record_id.cast("string"), F.lit("null")),
                    F.lit(">"))


def record_text(date: str) -> Column:
    """Header, blank line and block of a record."""
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.lit("")).otherwise(F.col("payload"))
    # Line ends in a URI would end its header line.
    uri = F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]+", " ")
    return F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("record_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        F.when(again, _line("WARC-Refers-To", _urn(F.col("refers_to")))).otherwise(F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("X-Payload-Length", F.col("bytes").cast("string")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id",
                   payload_col: str = "html", date: str = "2024-01-01T00:00:00Z",
                   compression: str | None = "gzip", records_per_file: int = 20_000) -> None:
    """Writes one record per row to archive files below ``path``."""
    rows = with_revisits(pages, id_col, payload_col)
    (rows.select(record_text(date).alias("value"))
     .write.option("lineSep", END).option("maxRecordsPerFile", records_per_file)
     .option("compression", compression or "none").text(path))


# --- reading ----------------------------------------------------------------------------------

def header_of(part: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """Header fields, lower-cased, and where the block starts; None if this is no header."""
    end = part.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in part[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not fields.get(b"content-length", b"").isdigit():
        return None
    return fields, end + 4


def _number(value: bytes | None) -> int | None:
    found = ID.search(value or b"")
    return int(found[1]) if found and found[1] != b"null" else None


def _fields(part: bytes) -> tuple:
    """Length of the record after its version line and its fields, or nulls."""
    found = header_of(part)
    if not found:
        return None, None, None, None, None, None, None, False
    fields, start = found
    stop = start + int(fields[b"content-length"])
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    uri = fields.get(b"warc-target-uri", b"").decode("utf-8", "replace")
    whole = len(part) >= stop
    if kind == "revisit":
        length = int(fields.get(b"x-payload-length", b"0"))
        digest = fields.get(b"warc-payload-digest", b"").decode().partition(":")[2]
    else:
        length = stop - start
        digest = hashlib.sha256(part[start:stop]).hexdigest() if whole else None
    return (stop + len(END), _number(fields.get(b"warc-record-id")), uri, kind,
            _number(fields.get(b"warc-refers-to")), length, digest, whole)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts between version lines, with places relative to the split's first byte.

    A part's place is that of the version line before it. ``exit_place`` is where the chain that
    starts here leaves the split, ``span`` the length of the record itself. Only parts that are
    not exactly one record keep their bytes.
    """
    step = len(VERSION)
    rows: list[list] = []
    split, place = None, 0

    def leaving() -> Iterator[pa.RecordBatch]:
        ends: dict[int, int] = {}
        for row in reversed(rows):  # a successor lies behind its record
            if row[5] is not None:
                following = row[3] + row[5]
                row[6] = ends[row[3]] = ends.get(following, following)
        for at in range(0, len(rows), 5_000):
            yield batch(CANDIDATES, *zip(*rows[at: at + 5_000], strict=True))

    for b in batches:
        for part, file, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (file, block) != split:
                yield from leaving()
                rows, split, place = [], (file, block), 0
            length, *fields = _fields(part)
            rows.append([file, block, len(rows), place - step, len(part),
                         None if length is None else length + step, None, *fields,
                         None if length == len(part) else part])
            place += len(part) + step
    yield from leaving()


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """All occurrences of the version line, with absolute offsets and successors."""
    lines = (spark.read.option("lineSep", VERSION).text(path)
             .select(F.col("value").cast("binary").alias("value"),
                     F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block")))
    found = materialize(lines.mapInArrow(_candidates, CANDIDATE_DDL), "candidates")
    lengths = found.groupBy("file", "block").agg(
        F.sum(F.col("size") + len(VERSION)).alias("total"))
    before = F.sum("total").over(Window.partitionBy("file").orderBy("block")) - F.col("total")
    starts = lengths.select("file", "block", before.alias("start"))
    return (found.join(starts, ["file", "block"])
            .withColumn("offset", F.col("start") + F.col("place"))
            .withColumn("successor", F.col("offset") + F.col("span"))
            .withColumn("leaves_to", F.col("start") + F.col("exit_place")))


def entries(links: DataFrame) -> DataFrame:
    """(file, offset): the start of every file and where its chain enters another split.

    Found by pointer jumping over the candidates that another split leads to.
    """
    goals = links.select("file", F.col("leaves_to").alias("offset")).where("offset is not null")
    starts = links.where("offset = 0").select("file", "offset")
    steps = materialize(
        links.where("leaves_to is not null").select("file", "offset", "leaves_to")
        .join(goals.union(starts).distinct(), ["file", "offset"], "left_semi"), "steps")
    known = materialize(starts, "known")
    had = known.count()
    jumps = steps.withColumnRenamed("leaves_to", "jump").join(
        links.select("file", F.col("offset").alias("jump")), ["file", "jump"], "left_semi")
    while True:
        jumps = materialize(jumps.select("file", "offset", "jump"), "jumps")
        ahead = known.join(jumps, ["file", "offset"]).select("file", F.col("jump").alias("offset"))
        known = materialize(known.union(ahead).distinct(), "known")
        grown = known.count()
        if grown == had:
            return known
        had = grown
        again = jumps.select("file", F.col("offset").alias("jump"), F.col("jump").alias("far"))
        jumps = jumps.join(again, ["file", "jump"]).select(
            "file", "offset", F.col("far").alias("jump"))


def _walk(split):
    """Reachable candidates of one split from its entry on."""
    following = dict(zip(split.offset, split.successor, strict=True))
    reached = set()
    for at in split.offset[split.entry]:
        while at in following and at not in reached:
            reached.add(at)
            at = following[at]
    return split.loc[split.offset.isin(reached), ["file", "offset"]]


def verified(found: DataFrame) -> DataFrame:
    """The candidates with ``reached``: whether the chain from the file's start comes by."""
    links = found.select("file", "block", "offset", "successor", "leaves_to")
    known = entries(links).withColumn("entry", F.lit(True))
    marked = links.where("successor is not null").join(known, ["file", "offset"], "left").select(
        "file", "block", "offset", "successor", F.coalesce("entry", F.lit(False)).alias("entry"))
    reached = marked.groupBy("file", "block").applyInPandas(_walk, "file string, offset long")
    return found.join(reached.withColumn("reached", F.lit(True)), ["file", "offset"], "left") \
        .withColumn("reached", F.coalesce("reached", F.lit(False)))


RECORD_DDL = ("record_id long, uri string, record_type string, refers_to long, "
              "payload_bytes long, digest string, whole boolean")


def _joined(parts):
    """Fields of a record from its parts."""
    import pandas as pd

    parts = parts.sort_values("offset")
    raw = VERSION.encode().join(bytes(p) for p in parts.raw)
    fields = _fields(raw)[1:]
    return pd.DataFrame([fields], columns=[c.split()[0] for c in RECORD_DDL.split(", ")]).astype(
        {"record_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, uri, record_type, refers_to, payload_bytes, digest) of every whole record."""
    found = materialize(verified(candidates(spark, path)), "verified")
    fields = [c.split()[0] for c in RECORD_DDL.split(", ")]
    single = found.where("reached and raw is null").select(fields)
    parts = found.where("raw is not null")
    # The last record that starts before a part owns it, if it reaches that far.
    order = Window.partitionBy("file").orderBy("offset").rowsBetween(
        Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("reached"), F.struct("offset", "successor")),
                 ignorenulls=True).over(order)
    split = (parts.withColumn("own", own).where("offset < own.successor")
             .select("file", F.col("own.offset").alias("own"), "offset", "raw")
             .groupBy("file", "own").applyInPandas(_joined, RECORD_DDL))
    return single.union(split).where("whole").drop("whole")


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html",
               compression: str | None = "gzip") -> DataFrame:
    """Writes the pages as archives into the shared folder and reads them back."""
    spark = pages.sparkSession
    path = run_folder(spark, "warc")
    write_archives(pages, path, id_col, payload_col, compression=compression)
    return read_archives(spark, path)
