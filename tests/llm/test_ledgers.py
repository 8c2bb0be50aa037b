"""Secret ledger, Merkle manifest and hard negatives against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casedesk.llm import merkle, negatives, secrets
from tests.llm.conftest import rows_of

NO_VECTORS = "vec_id long, embedding array<float>, label int"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Secrets

KINDS = (("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
         ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))


def plain_spans(text):
    found = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}")
             for i, (kind, pattern, group, least) in enumerate(KINDS)
             for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [f[2] for f in sorted(found)]


def plain_scan(rows):
    out = []
    for doc_id, text in rows:
        spans = plain_spans(text)
        listed = ",".join(spans)
        out.append((doc_id, *(sum(s.startswith(k[0] + ":") for s in spans) for k in KINDS),
                    sha(listed), listed))
    return sorted(out, key=str)


SECRET_ROWS = [
    (1, "PassWord = 'abcdefghijkl' and api_key:0123456789abcdef0"), (2, None), (3, ""),
    (4, "token: secret: abcdefghijklmnop"), (5, "tokén = é token=é token=abcdefghijkl　"),
    (6, "AKIA" + "A" * 14 + " AKIA" + "B" * 13 + " AKIAAKIA" + "0" * 12), (6, "x"),
    (7, "a" * 15 + " " + "a" * 16 + "g" + "0123456789ABCDEF0123456789abcdef"),
    (8, "paſſword=abcdefghijklmnop toKen=abcdefghijklmnop"),
    (9, ("filler " * 30_000) + "secret=aaaaaaaaaaaaaaaa"), (None, "secret=aaaaaaaaaaaaaaaa"),
    (None, None), (10, "passwd=\"token=abcdefghijkl\" apikey==abcdefghijkl"),
] + [(100 + i, "secret=copied.copied.copied") for i in range(40)]


def test_secrets_of_odd_rows(spark):
    rows = SECRET_ROWS + SECRET_ROWS[:4]  # repeated rows are rows each
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    clash = docs.withColumns({c: F.lit("x") for c in ("blob", "rule", "update", "path", "version")})
    assert rows_of(secrets.scan(clash)) == plain_scan(rows)
    assert secrets.scan(docs.where("false")).count() == 0


def test_only_unseen_blobs_and_rule_versions_are_scanned(spark, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path))
    first = spark.createDataFrame([(1, "token=aaaaaaaaaaaa"), (2, "none"), (3, "none")],
                                  "doc_id long, text string")
    assert ledger.update(first, version=F.lit(1)) == 0
    assert ledger.scans().count() == 2 * 3
    # The secret leaves path 1, and comes back under path 4.
    second = spark.createDataFrame([(1, "none"), (4, "token=aaaaaaaaaaaa"), (5, "AKIA" + "0" * 14)],
                                   "doc_id long, text string")
    assert ledger.update(second, version=F.lit(2)) == 1
    assert ledger.scans().where("update = 1").count() == 3
    # One rule gets a new version: it alone meets all blobs again.
    rules = (secrets.RULES[0], secrets.Rule("access", 2, r"AKIA[A-Z0-9]+", 0, 19),
             secrets.RULES[2])
    newer = secrets.Ledger(spark, str(tmp_path), rules)
    assert newer.update(first.unionByName(second), version=F.lit(3)) == 2
    assert sorted(r.rule for r in newer.scans().where("update = 2").collect()) == [1, 1, 1]

    def found(book, **where):
        listed = book.report(**where).select(
            "path", "version", secrets.span_list(F.col("spans"), book.rules).alias("s"))
        return {(r.path, r.version, r.s) for r in listed.collect() if r.s}

    assert found(ledger) >= {(1, 1, "assign:0:18"), (4, 2, "assign:0:18"), (5, 2, "access:0:18")}
    assert (5, 2, "access:0:18") not in found(newer)
    assert found(newer, update=2) == {(1, 3, "assign:0:18"), (4, 3, "assign:0:18")}


@pytest.mark.parametrize("lost", ["done", "scans", "findings"])
def test_an_update_that_broke_off_is_given_again(spark, tmp_path, lost):
    ledger = secrets.Ledger(spark, str(tmp_path))
    rows = [(1, "token=aaaaaaaaaaaa"), (2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written = ledger._write

    def breaking(df, name, update):
        if name == lost:
            raise OSError("gone")
        written(df, name, update)

    ledger._write = breaking
    with pytest.raises(OSError):
        ledger.update(docs)
    assert ledger.report().count() == 0 and ledger.findings().count() == 0
    ledger._write = written
    assert ledger.update(docs) == 0
    assert rows_of(secrets.scan(docs, str(tmp_path / "other"))) == plain_scan(rows)
    assert ledger.findings().count() == 1 and ledger.scans().count() == 6


# Merkle manifest

def plain_manifest(rows, fan=3):
    """Rows: (doc_id, source, lang, n_chars, text)."""
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + fan])) for i in range(0, len(out[-1]), fan)])
        return out

    def path(levels, i):
        for level in levels[:-1]:
            start = i // fan * fan
            yield level[start:i], level[i + 1:start + fan]
            i //= fan

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            text = row[4].replace("\n", "") if tampered and row[4] is not None else row[4]
            steps = [*path(trees[g], i), *path(top, k)]
            fold = leaf((*row[:4], text))
            for before, after in steps:
                fold = sha("".join(before) + fold + "".join(after))
            out.append((row[0], leaf(row), trees[g][-1][0], top[-1][0],
                        sha("".join(x for b, a in steps for x in b + a)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def checked(docs, **kw):
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return merkle.verified(docs, mark % 2 == 0, **kw)


def test_manifest_of_odd_rows(spark, odd_rows):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows]
    rows += [(500 + i, "big", "en", None, "two\nlines" * (i % 3)) for i in range(61)]
    rows += [(900, "one", None, 1, "\n"), (901, "\U0001F600", "en", 1, "x"), (902, "", "en", 1, "x")]
    rows += [(903, "copies", "en", 1, "a\nb")] * 10
    docs = spark.createDataFrame(
        rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(6)
    clash = docs.withColumns({c: F.lit(1) for c in ("group", "lo", "n", "digest", "part", "keep_claimed")})
    assert rows_of(checked(clash)) == plain_manifest(rows)
    assert checked(docs.where("false")).count() == 0
    lone = docs.where("doc_id = 900")
    assert rows_of(checked(lone)) == plain_manifest([rows[-13]])


def test_intervals_nest(spark):
    rows = spark.range(200).select(
        F.lit("g").alias("group"), F.col("id").alias("lo"), F.lit(200).cast("long").alias("n"),
        F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    tables = merkle.levels(rows, 5)
    assert [t.count() for t in tables] == [200, 40, 8, 2, 1]
    for below, above in zip(tables, tables[1:]):
        inside = {(r.lo, r.hi) for r in below.collect()}
        for r in above.collect():
            cover = [(c.lo, c.hi) for c in r.children]
            assert cover[0][0] == r.lo and cover[-1][1] == r.hi and set(cover) <= inside
            assert all(a[1] == b[0] for a, b in zip(cover, cover[1:]))


# Hard negatives

def plain_negatives(rows, anchor, n_positives=5, n_negatives=10):
    """Rows: (vec_id, embedding, label)."""
    usable = []
    for i, (vec_id, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        usable.append((i, vec_id, label, [int(np.floor(256 * float(np.float32(x)))) for x in vector]))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, vec_id, label, q in usable:
        if vec_id is None or not anchor(vec_id):
            continue
        scores = [(sum(a * b for a, b in zip(q, other)), other_id, other_label)
                  for j, other_id, other_label, other in usable if j != i and len(other) == len(q)]
        for positive, p_id, _ in sorted((s for s in scores if s[2] == label), key=order)[:n_positives]:
            fits = [s for s in scores if s[2] != label
                    and 30 * positive <= 100 * s[0] <= 90 * positive]
            out += [(vec_id, p_id, rank, n_id, positive, s) for rank, (s, n_id, _)
                    in enumerate(sorted(fits, key=order)[:n_negatives], 1)]
    return sorted(out, key=str)


def vector_rows(seed, n, dim=8, labels=4, spread=0.4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = (centres[r.integers(6)] + spread * r.normal(size=dim)) * r.choice((0.5, 1, 3))
        rows.append((i, [float(x) for x in v.astype(np.float32)],
                     0 if i % 3 == 0 else int(r.integers(labels))))
    return rows


def mined(spark, rows, every=10, **kw):
    table = spark.createDataFrame(rows, NO_VECTORS).repartition(4)
    return rows_of(negatives.hard_negatives(table, F.col("vec_id") % every == 0, **kw))


def test_negatives_over_many_trees_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TREE", 60)
    monkeypatch.setattr(negatives, "BLOCK", 8)
    monkeypatch.setattr(negatives, "LANES", 3)
    rows = vector_rows(1, 700) + [(2_000 + i, [0.25] * 8, 100 + i % 50) for i in range(200)]
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_odd_rows(spark):
    rows = vector_rows(2, 120)
    nan, inf = float("nan"), float("inf")
    rows += [(130, None, 1), (140, [1.0] * 8, None), (150, [nan] * 8, 1), (160, [inf] * 8, 1),
             (170, [0.0] * 8, 1), (180, [], 1), (190, [], 2), (200, [1.0, 2.0], 1),
             (210, [1.0, 1.0], 1), (220, [0.5, 1.0], 2), (None, rows[3][1], 2), (0, *rows[0][1:]),
             (0, *rows[0][1:]), (230, [None] + [1.0] * 7, 1), (7, rows[7][1], 2)]
    rows += [(300 + i, [0.5] * 8, i % 2) for i in range(40)]
    table = spark.createDataFrame(rows, NO_VECTORS).withColumns(
        {c: F.lit("x") for c in ("id", "body", "anchor", "copies", "bucket")})
    found = negatives.hard_negatives(table, F.col("vec_id") % 10 == 0)
    assert rows_of(found) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []


def test_scores_too_large_for_floating_point(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randrange(1 << 20, 1 << 21)) for _ in range(4)], i % 2) for i in range(40)]
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1)])


def test_cover_tree_covers_and_separates():
    points = np.floor(256 * np.array([v for _, v, _ in vector_rows(5, 400)]))
    order, first, children, angle, length = negatives.cover_tree(points)
    assert sorted(order) == list(range(400))
    rest = np.sqrt(np.maximum(length ** 2 - (points ** 2).sum(1), 0))
    sphere = (np.column_stack([points, rest]) / length)[order]
    below = [[] for _ in order]
    for node in reversed(range(400)):
        for child in range(first[node], first[node] + children[node]):
            below[node] += [child, *below[child]]
        if below[node]:
            apart = np.arccos(np.clip(sphere[below[node]] @ sphere[node], -1, 1))
            assert apart.max() <= angle[node] + 1e-9
        own = range(first[node], first[node] + children[node])
        for a in own:
            assert angle[a] <= angle[node] / negatives.BASE + 1e-9 or angle[node] < 1e-6
    assert sum(map(len, below[:1])) == 399
