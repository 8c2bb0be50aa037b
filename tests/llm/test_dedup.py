"""Exact, near and substring duplicates against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from casedesk import session
from casedesk.llm import exact, graph, jaccard, substrings
from tests.llm import brute
from tests.llm.conftest import rows_of, words


def test_exact_rows(odd_docs, odd_rows):
    assert rows_of(exact.exact_duplicates(odd_docs)) == brute.exact([r[:2] for r in odd_rows])


def test_exact_with_a_full_trie(odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(exact, "TRIE_BYTES", 4_000)
    table = [(len(t), exact.struct.unpack("<q", d[:8])[0], t, d) for t, d in (
        (t, exact.hashlib.sha256(t).digest()) for t in (
            (r[1] or "").encode().translate(None, exact.BLANK) for r in odd_rows))]
    trie, parts = exact.Trie(), []
    for n, (_, _, text, digest) in enumerate(table + table):
        trie.add(text, digest, (0, False, n), 1)
        if trie.size > exact.TRIE_BYTES:
            parts += [(t, node.copies) for t, node in trie.cut(exact.TRIE_BYTES // 2)]
    parts += [(t, node.copies) for t, node in trie.terminals()]
    copies = {}
    for text, n in parts:
        copies[text] = copies.get(text, 0) + n
    assert len(parts) > len(copies)
    assert copies == {t[2]: 2 * sum(u[2] == t[2] for u in table) for t in table}


def test_unique_documents_keep_all_columns(odd_docs, odd_rows, no_docs):
    clash = odd_docs.withColumnRenamed("lang", "digest").withColumnRenamed("n_chars", "row_0")
    kept = exact.unique_documents(clash)
    assert kept.columns == clash.columns
    want = {(r[0], r[4]) for r in brute.exact([r[:2] for r in odd_rows]) if r[3]}
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == \
        sorted(str(w[0]) for w in want)
    assert exact.unique_documents(no_docs).count() == 0
    assert exact.exact_duplicates(no_docs).count() == 0


def test_one_row_stays_of_repeated_rows_and_of_copies_without_ids(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (1, "ab", "x"), (None, "c", "x"), (None, "c", "x"),
            (None, None, "x"), (None, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, points string").repartition(3)
    assert rows_of(exact.exact_duplicates(docs)) == brute.exact([r[:2] for r in rows])
    kept = exact.unique_documents(docs).collect()
    assert sorted((r.text or "") for r in kept) == ["", "a b", "c"]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)]
    edges += [(i, i + 1) for i in range(1_000, 1_060)] + [(5_000, 5_001 + i) for i in range(50)]
    sets = brute.Sets(6_000)
    for a, b in edges:
        sets.join(a, b)
    least = brute.least_ids(list(range(6_000)), sets)
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert {f.node: f.component for f in found} == {x: least[x] for x in ends}


def test_jaccard_rows(odd_docs, odd_rows, no_docs):
    assert rows_of(jaccard.near_duplicates(odd_docs)) == brute.jaccard([r[:2] for r in odd_rows])
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_jaccard_with_frequent_shingles_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_LEAST", 5)
    monkeypatch.setattr(jaccard, "TILE", 6)
    r = random.Random(9)
    base, passage = words(r, 60, 10_000), words(r, 60, 10_000)
    rows = []
    for i in range(60):  # near copies, and texts that share a passage only
        changed = base.split()
        for _ in range(r.randrange(3)):
            changed[r.randrange(60)] = f"c{r.randrange(9)}"
        rows.append((i, " ".join(changed)))
        rows.append((100 + i, passage + " " + words(r, r.randrange(5, 60), 10_000)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(jaccard.near_duplicates(docs)) == brute.jaccard(rows)


def test_jaccard_pairs_below_the_threshold_are_few(spark, monkeypatch):
    """Texts somewhat alike share most of their keys: a pair is given once, and dropped unfetched."""
    monkeypatch.setattr(jaccard, "PARTNER_ROUNDS", 0)
    seen, candidates, verified = {}, jaccard._candidates, jaccard.verified

    def watched(rows, sets, one):
        columns = [c for c in ("key", "i", "j", "tile", "sid", "component", "rest", "point", "earlier")
                   if c in rows.columns + sets.columns]
        seen["emitted"] = (rows.join(sets.select("sid", "point"), "sid").select(*columns)
                           .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                           .mapInArrow(jaccard._pairs(one), "a long, b long").count())
        pairs = candidates(rows, sets, one)
        seen["pairs"] = pairs.count()
        return pairs

    def counted(pairs, sets):
        seen["verified"] = pairs.count()
        return verified(pairs, sets)

    monkeypatch.setattr(jaccard, "_candidates", watched)
    monkeypatch.setattr(jaccard, "verified", counted)
    r = random.Random(5)
    base = words(r, 400, 10_000).split()
    rows = []
    for i in range(40):
        changed = list(base)
        for at in r.sample(range(400), 9):
            changed[at] = f"c{r.randrange(10_000)}"
        rows.append((i, " ".join(changed)))
    rows += [(100 + i, rows[i][1] + " tail") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(jaccard.near_duplicates(docs)) == brute.jaccard(rows)
    assert seen["pairs"] > 500
    assert seen["emitted"] < 2 * seen["pairs"]
    assert seen["verified"] < seen["pairs"] / 5


def test_jaccard_pairs_of_crowded_keys_are_in_proportion(spark, monkeypatch):
    """Keys of many texts somewhat alike give the pairs that could match, not the square of the texts."""
    monkeypatch.setattr(jaccard, "PARTNER_ROUNDS", 0)
    seen, candidates = {}, jaccard._candidates

    def watched(rows, sets, one):
        pairs = candidates(rows, sets, one)
        seen["pairs"] = pairs.count()
        return pairs

    monkeypatch.setattr(jaccard, "_candidates", watched)
    r = random.Random(6)
    base = words(r, 400, 10_000).split()
    rows = []
    for i in range(130):
        changed = list(base)
        for at in r.sample(range(400), 12):
            changed[at] = f"c{r.randrange(10_000)}"
        rows.append((i, " ".join(changed)))
    rows += [(200 + i, rows[i][1] + " tail") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(jaccard.near_duplicates(docs)) == brute.jaccard(rows)
    assert 20 <= seen["pairs"] < 2 * len(rows)


def test_jaccard_leaves_no_working_tables(spark, odd_docs, tmp_path, monkeypatch):
    """Keys and texts are needed until the links are known, and take room no longer."""
    monkeypatch.setattr(session, "shared_folder", lambda *_: str(tmp_path))
    classes = rows_of(jaccard.near_duplicates(odd_docs))
    assert classes
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.glob("casedesk-*/*")}
    assert "links" in left and not left & {"shared-keys", "sets", "mixed"}


def test_finer_counts_drop_no_match():
    r = np.random.default_rng(2)
    for n, changed in ((40, 4), (396, 40), (396, 60), (9000, 900), (300_000, 30_000)):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[r.permutation(len(a))[changed:]],
                                      r.integers(0, 1 << 63, changed).astype(np.uint64))))
        pack = jaccard.zstandard.ZstdCompressor().compress
        row = pa.RecordBatch.from_pydict({
            "a": [1], "b": [2], "n_a": [len(a)], "n_b": [len(b)],
            "fine_a": [pack(jaccard.fine_of(a))], "fine_b": [pack(jaccard.fine_of(b))]})
        kept = sum(x.num_rows for x in jaccard._close(iter([row])))
        assert kept >= jaccard.matches(a, b)


def test_rtree_finds_all_that_the_bound_allows():
    r = np.random.default_rng(1)
    points = r.poisson(3, (200, jaccard.GROUPS)).astype(np.int64)
    points[100:] = np.maximum(0, points[:100] + r.integers(-1, 2, (100, jaccard.GROUPS)))
    tree = jaccard.RTree(points)
    got = {(int(a), int(b)) for a, b, _ in zip(*tree.matches(points), strict=True)}
    n = points.sum(1)
    want = {(i, j) for i in range(200) for j in range(200)
            if 180 * np.minimum(points[i], points[j]).sum() >= 80 * (n[i] + n[j])}
    assert got == want and len(want) < 200 * 200


def test_representatives(odd_docs, odd_rows):
    kept = [r.doc_id for r in jaccard.representatives(odd_docs).collect()]
    classes = brute.jaccard([r[:2] for r in odd_rows])
    assert {k for k in kept if k is not None} == {c for _, _, c in classes if c is not None}
    assert len(kept) == len({c for _, n, c in classes if n}) + 4  # and each empty row


def test_repeats(odd_docs, odd_rows, no_docs):
    got = rows_of(substrings.remove_repeats(odd_docs), "doc_id", "n_words", "n_removed",
                  "kept_sha256")
    assert got == brute.repeats([r[:2] for r in odd_rows])
    assert substrings.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("window,k", [(6, 3), (35, 12)])
def test_repeats_in_periodic_texts(spark, window, k):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(r.choice(("a b", "a", "x y z"))[::2])
                         for _ in range(r.choice((0, 5, 6, 7, 36, 80))))) for i in range(60)]
    rows += [(90, "a " * 200), (91, " ".join(f"v{i % 40}" for i in range(100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.remove_repeats(docs, window, k)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == \
        brute.repeats(rows, window)
    for row in got.collect():
        assert sum(b - a for a, b in zip(row.removed[::2], row.removed[1::2], strict=True)) == \
            row.n_removed
