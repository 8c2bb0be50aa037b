"""Toxicity, vectors, mixing, packing and the pipeline."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casedesk.llm import jaccard, mixing, packing, queries, toxicity, vectors
from tests.llm import brute
from tests.llm.conftest import rows_of, words


# --- toxicity

def labelled_docs(spark, n=600):
    r, rows, labels = random.Random(3), [], []
    for i in range(n):
        toxic = i % 8 == 0
        text = words(r, r.randrange(20, 80), 3_000).split()
        for _ in range(3 if toxic else 0):
            text[r.randrange(len(text))] = r.choice(("vile", "vilest", "Rotten,", "nasty."))
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(toxic)))
    return (rows, labels, spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity_of_held_out_rows(spark):
    rows, _, docs, labels = labelled_docs(spark)
    index = toxicity.learn(docs, labels)
    found = {r.doc_id: r for r in toxicity.scores(docs, index).collect()}
    for doc_id, _ in rows:
        assert found[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert found[doc_id].predicted == int(doc_id % 8 == 0) == int(found[doc_id].score >= 0.5)
    assert all(not found[e.doc_id].held_out for r in found.values() for e in r.evidence)
    kept = {r.doc_id for r in toxicity.clean_documents(docs, index).collect()}
    assert kept == {i for i, _ in rows if i % 8}


def test_nearest_are_exact():
    r = np.random.default_rng(5)
    n, terms = 300, 30
    vectors_ = []
    for _ in range(n):
        own = np.unique(r.integers(0, terms, r.integers(0, 5)))
        vectors_.append((own, r.integers(1, 4, len(own)).astype(float)))
    labels = r.integers(0, 2, n).astype(float)
    index = toxicity.build(np.arange(terms).astype(np.uint64), r.random(terms) + 1,
                           list(range(n)), labels, vectors_)
    dense = np.concatenate(index.rows, 1)[:, :len(index.ids)]
    for own, counts in vectors_[:100]:
        if len(own):
            query = index.vector(own, counts)
            cosines = np.round(query @ dense[own], 12)
            best = np.lexsort((np.arange(len(cosines)), -cosines))[:15]
            best = best[cosines[best] > 0]
            got, values = index.nearest(own, query, 15)
            assert got.tolist() == best.tolist() and np.allclose(values, cosines[best])


def test_toxicity_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (20, None), (21, 0), (22, 7)],
                                   "doc_id long, toxic int")
    index = toxicity.learn(odd_docs, labels)
    found = toxicity.scores(odd_docs, index).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.score <= 1 for r in found)
    none = toxicity.learn(no_docs, labels.limit(0))
    assert toxicity.scores(no_docs, none).count() == 0
    assert {r.score for r in toxicity.scores(odd_docs, none).collect()} == {0.0}
    assert toxicity.clean_documents(odd_docs, none).count() == len(odd_rows)


def test_only_near_copies_of_the_same_label_are_dropped(spark):
    r, rows, sets, kept = random.Random(12), [], {}, []
    boilerplate = words(r, 60, 5_000)
    for i in range(40):
        base = words(r, 100, 5_000)
        own = [base, base] + [base.split() for _ in range(5)]
        for k, text in enumerate(own[2:]):  # from far to near
            for _ in range((12, 8, 5, 3, 1)[k]):
                text[r.randrange(len(text))] = f"new{r.randrange(10**6)}"
            own[2 + k] = " ".join(text)
        own.append(f"{boilerplate} {words(r, 60, 5_000)}")
        rows += [(len(rows) + k, r.randrange(2), text) for k, text in enumerate(own)]
    rows += [(10_000, 0, "one two"), (10_001, 0, "one two"), (10_002, 1, ""), (10_003, 1, None)]
    for n, toxic, text in rows:
        w = (text or "").split()
        sets[n] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
        if not any(toxic == t and len(sets[n] & sets[m]) >= 0.8 * len(sets[n] | sets[m]) > 0
                   for m, t in kept):
            kept.append((n, toxic))
    sample = spark.createDataFrame(rows, "n long, toxic int, text string").repartition(3)
    dropped = {x.n for x in toxicity.near_copies(sample).collect()}
    assert dropped == set(sets) - {n for n, _ in kept} and len(dropped) > 40


def test_shared_passages_drop_no_example(spark):
    r = random.Random(13)
    passage = words(r, 60, 5_000)
    rows = [(i, f"{passage} {words(r, 40, 5_000)} {('fine', 'vile')[i % 2]}") for i in range(200)]
    index = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"),
                           spark.createDataFrame([(i, i % 2) for i, _ in rows],
                                                 "doc_id long, toxic int"))
    assert sorted(index.ids) == [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]


# --- vectors

def vector_rows():
    r, rows = np.random.default_rng(8), []
    for i in range(60):
        base = r.normal(size=8)
        for k in range(r.integers(1, 6)):
            rows.append((len(rows), (base + r.normal(scale=0.12, size=8) * k).tolist(), i % 3))
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [None] + [1.0] * 7, 1),
             (503, [float("nan")] * 8, 1), (504, rows[0][1], None), (505, rows[0][1], 0),
             (0, rows[0][1], 0), (None, rows[0][1], 0), (506, [1.0, 2.0], 0), (507, [2.0, 4.0], 0),
             (508, [], 0), (None, None, None), (509, [1e300] * 8, 2), (510, [1e-300] * 8, 2)]
    return rows


@pytest.mark.parametrize("tile", [vectors.TILE, 7])
def test_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "CELL_ROWS", 60)
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = vectors.near_duplicates(table)
    want = [(i, n, c) for i, n, c in brute.vectors([(i, v, k) for i, v, k in rows
                                                    if not v or v[0] not in (1e300, 1e-300)])]
    got = [r for r in rows_of(found, "vec_id", "n_links", "component_id")
           if r[0] not in (509, 510)]
    assert got == want
    big = {r[0]: r[1:] for r in rows_of(found) if r[0] in (509, 510)}
    assert big == {509: (1, 509, True), 510: (1, 509, False)}
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_recall_of_links(spark):
    path = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in queries.table(spark, path, "embeddings")
            .select("vec_id", "embedding", "label").collect()]
    by = defaultdict(list)
    for i, v, label in rows:
        by[label].append((i, v))
    want = Counter()
    for members in by.values():
        m = np.array([v for _, v in members], float)
        m /= np.linalg.norm(m, axis=1)[:, None]
        for i, n in zip([i for i, _ in members], (m @ m.T >= 0.93).sum(1) - 1, strict=True):
            want[i] = int(n)
    got = {r.vec_id: r.n_links for r in queries.op9_vector_dedup(spark, path).collect()}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.9 * sum(want.values())


def test_no_link_is_lost_between_hundreds_of_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 10)
    r = np.random.default_rng(21)
    base = r.normal(size=(1_500, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    aside = r.normal(size=base.shape)
    aside -= (aside * base).sum(1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    rows = np.concatenate((base, 0.935 * base + np.sqrt(1 - 0.935 ** 2) * aside))
    want = (rows @ rows.T >= 0.93).sum(1) - 1
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)],
                                  "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: x.n_links for x in vectors.near_duplicates(table).collect()}
    assert [got[i] for i in range(len(rows))] == want.tolist() and want.min() >= 1


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_are_shuffled_about_once_at_a_time_and_groups_are_dealt_over_slots(spark, monkeypatch, kind):
    """Many groups of cells, some of them with more vectors than a task holds, in turns."""
    monkeypatch.setattr(vectors, "TILE", 40)
    monkeypatch.setattr(vectors, "CELL_ROWS", 30)
    monkeypatch.setattr(vectors, "GROUP_BYTES", 60 * 4 * 8)
    monkeypatch.setattr(vectors, "CHUNK", 16)
    r, rows = np.random.default_rng(4), []
    crowd = r.normal(size=8)
    for i in range(420):
        v = crowd + r.normal(scale=0.15, size=8) if i % 4 == 0 else r.normal(size=8)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 10 // 8))
    rows += [(1000 + i, v, label) for i, v, label in rows[:30]]
    sent, pieces = [], vectors.links

    def watched(placed, per, *args):
        sent.append((per, placed.selectExpr("max(size(groups))", "max(own)").first()))
        return pieces(placed, per, *args)

    monkeypatch.setattr(vectors, "links", watched)
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    got = rows_of(vectors.near_duplicates(table), "vec_id", "n_links", "component_id")
    assert got == brute.vectors(rows)
    assert sent[0][0] == 2 and min(sent[0][1]) >= 2


# --- mixing

def test_mix(odd_docs, odd_rows, no_docs):
    found = mixing.mix(odd_docs)
    again = mixing.mix(odd_docs.repartition(7))
    assert rows_of(found) == rows_of(again)
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len(brute.split(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, brute.targets([sizes[s] for s in order]), strict=True))
    source = defaultdict(set)
    for r in odd_rows:
        source[r[0], len(brute.split(r[1]))].add(r[3])
    taken = Counter()
    for r in found.collect():
        own = next(s for s in source[r.doc_id, r.size] if sizes[s] == r.source_size
                   and abs(target[s] - r.target) < 1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[own] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    words_ = Counter()
    for r in mixed.collect():
        words_[r.source] += len(brute.split(r.text))
    assert +words_ == +taken
    assert mixing.mix(no_docs).count() == mixing.mixed_documents(no_docs).count() == 0


def test_highest_quotients():
    r = random.Random(6)
    for _ in range(50):
        shares = [r.randrange(1, 1_000) for _ in range(r.randrange(1, 9))]
        seats = r.randrange(0, 60)
        got = [0] * len(shares)
        for _ in range(seats):
            best = max(range(len(shares)), key=lambda i: (shares[i] / (2 * got[i] + 1), -i))
            got[best] += 1
        assert mixing.sainte_lague(shares, seats).tolist() == got


@pytest.mark.parametrize("shares, seats", [
    ([900.0] + [0.3] * 333, 1_000), ([28_800 * 3] + [30] * 333, 1_000),
    ([1.0] * 10_000, 4_321), ([1 / (i + 1) for i in range(10_000)], 30_000),
    ([0.0, 5.0, 0.0], 7)])
def test_thousands_of_unequal_shares(shares, seats):
    heap = [(-s, i, 0) for i, s in enumerate(shares) if s]
    heapq.heapify(heap)
    got = [0] * len(shares)
    for _ in range(seats):
        _, i, k = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-shares[i] / (2 * k + 3), i, k + 1))
    assert mixing.sainte_lague(shares, seats).tolist() == got


def test_tiny_sources_meet_their_targets(spark):
    rows = [(0, "big", "w " * 5_000)] + [(1 + i, f"s{i:03}", "w " * n) for i, n in enumerate((1, 5, 10, 31, 32, 33, 100))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for r in mixing.mix(docs).collect():
        assert abs(r.taken - r.target) <= 0.5 and r.taken <= 3 * r.size


# --- packing

def test_packing(odd_docs, odd_rows, no_docs):
    from tokenizers import Tokenizer

    json_path, ranks_path = packing.public_vocabulary()
    encoder = Tokenizer.from_file(json_path)
    found = packing.pack(odd_docs, json_path, ranks_path).collect()
    want = []
    for r in odd_rows:
        ids = np.array(encoder.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        for n, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            want.append((r[0], n, start, length, zlib.crc32(ids[start:start + length].tobytes())))
    assert sorted((tuple(r[:5]) for r in found), key=str) == sorted(want, key=str)
    filled = defaultdict(list)
    for r in found:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in found)
    assert len(filled) <= -(-total // 2048) + 1
    assert packing.pack(no_docs, json_path, ranks_path).count() == 0


def test_both_encoders_agree():
    json_path, ranks_path = packing.public_vocabulary()
    slow, fast = packing.encoder(json_path, None), packing.encoder(json_path, ranks_path)
    r = random.Random(1)
    signs = [" ", "  ", "\n", "\t", "a", "Été", "ß", "'s", "1", "23", "!?", "<|endoftext|>", "\u3000",
             "中文", "🙂", "\x0b", "\x00", "Ɛ", "don't", " " * 40, "ǅ", "²", "_"]
    for _ in range(400):
        text = "".join(r.choice(signs) for _ in range(r.randrange(30)))
        assert slow(text) == fast(text)


def test_plan_uses_every_piece():
    r = np.random.default_rng(3)
    for n in (1, 50, 3_000):
        counts = np.bincount(r.integers(1, 257, n), minlength=257)
        used = np.zeros(257, int)
        for p in packing.plan(counts):
            assert sum(p.lengths) <= 256
            np.add.at(used, list(p.lengths), p.repeats)
        assert (used == counts).all()


# --- pipeline

def test_pipeline_stages(spark):
    path = "/root/testdata/sf0.001"
    docs = queries.table(spark, path, "documents")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, path)
    index = toxicity.learn(docs, queries.table(spark, path, "labels"))
    toxic = {r.doc_id for r in toxicity.scores(docs, index).where("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == \
        {r.doc_id for r in docs.collect()} - toxic
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    unique = stages["exact_dedup"](spark, clean, path)
    assert {r.doc_id for r in unique.collect()} == {r[0] for r in brute.exact(rows) if r[3]}
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    apart = stages["jaccard_join"](spark, unique, path)
    assert rows_of(apart, "doc_id") == sorted(
        {(c,) for _, _, c in brute.jaccard(rows)}, key=str)
    mixed = stages["mix_sources"](spark, apart, path)
    for step in (clean, unique, apart, mixed):
        assert step.dtypes == docs.dtypes
    size = {r.doc_id: r.taken for r in mixing.mix(apart).collect()}
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(brute.split(r.text))
    assert +got == Counter({k: v for k, v in size.items() if v})


def test_pipeline_run(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                             "offset"]
    assert found.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{n}" for n in range(1, 11)] + ["pipeline"]
    assert set(queries.oracle_sql()) <= set(names)
    assert jaccard.prefix_length(10) == 3
