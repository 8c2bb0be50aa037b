"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Learning reads a sample of at most ``EXAMPLES`` labelled rows outside the held-out fifth, picked by
hash. Terms are words (runs of ASCII letters, digits and all bytes above) and their first 4, 5 and
6 bytes, which stand for stems. Of the examples, in order of their ids, one is dropped if the sets of
five-word runs of it and of a kept one of the same label have a Jaccard similarity of ``NEAR`` or
more, so that a text that was copied often has one vote. Min-hash values only name the candidates,
which are compared on whole sets; texts of fewer words are all kept. The vocabulary holds the terms of at least ``LEAST_DOCS``
examples that a likelihood-ratio test finds tied to the label, strict enough for as many tests as
there are terms; of more than ``TERMS`` such terms the strongest. Document frequencies are counted over all documents.

The examples' unit vectors form an inverted index whose postings are cut into blocks of
``BLOCK`` examples with the largest weight in each. For a document the sums of these maxima bound
the cosines in every block; blocks are scored from the best bound down until no bound exceeds the
k-th cosine found, so the k nearest examples are exact. Their votes, weighted by cosine, are
calibrated by a logistic curve fitted to the examples' own votes, each without itself. A document
that shares no term with any example gets the share of toxic ones among such examples.

The index depends on the documented bounds only and is sent to every task; documents are scored
where they are read. Null and empty texts hold no term. Without labelled rows all scores are 0.
Null ids are never held out nor labelled; labels that contradict each other for an id count as
toxic; rows that repeat are scored each; tables without rows give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from casedesk.llm.frames import batch, named, sliced
from casedesk.llm.words import HELD, codes_in, coded_texts, distinct, grams, mixed, texts
from casedesk.session import materialize

EXAMPLES = 8_192
TERMS = 4_096
LEAST_DOCS = 4
HEADS = (4, 5, 6)
BLOCK = 32
NEAREST = 15
EVIDENCE = 3
FOLDS = 5
NEAR = 0.8
SIGNATURES = 32
SHARED = 8  # equal min-hash values of a candidate: at similarity 0.8 fewer come once in 10^11 pairs

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


# --- terms ------------------------------------------------------------------------------------

def _term_lists(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and codes of all terms of each text, repeats included."""
    def coded(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
        joined = np.frombuffer(b"\n".join(raw for _, raw in held), np.uint8)
        kinds, starts = codes_in(joined, True, _GAP, HEADS)
        kinds = [mixed(codes + np.uint64(i)) for i, codes in enumerate(kinds)]
        ends = np.cumsum([len(raw) + 1 for _, raw in held])
        cuts = np.concatenate(([0], np.searchsorted(starts, ends)))
        for k, (i, _) in enumerate(held):
            yield i, np.concatenate([codes[cuts[k]:cuts[k + 1]] for codes in kinds])

    held, size = [], 0
    for i, raw in texts(column):
        held.append((i, raw))
        size += len(raw)
        if size >= HELD:
            yield from coded(held)
            held, size = [], 0
    if held:
        yield from coded(held)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest five-word codes under several mixings, as bytes; null without five words."""
    salts = [np.uint64(0x9E37 * (s + 1)) for s in range(SIGNATURES)]
    for b in sliced(batches, 2):
        found = []
        for _, _, codes in coded_texts(b.column(2), lower=True):
            runs = distinct(grams(codes, 5))
            found.append(np.array([mixed(runs ^ s).min() for s in salts]).tobytes()
                         if len(runs) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())],
                                         names=["n", "toxic", "signature"])


def _groups(signatures: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Smallest number connected to each row by pairs of candidates."""
    least = np.arange(len(labels))
    for i in range(1, len(labels)):
        shared = (signatures[:i] == signatures[i]).sum(1)
        met = np.unique(least[:i][(shared >= SHARED) & (labels[:i] == labels[i])])
        if len(met):
            least[:i][np.isin(least[:i], met)] = least[i] = met[0]
    return least


def _near_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n of rows, sorted by group and n, that are near copies of a kept one of their group."""
    last, kept, signatures = None, [], np.zeros((0, SIGNATURES), np.uint64)
    for b in sliced(batches, 3):
        dropped = []
        for i, _, codes in coded_texts(b.column(3), lower=True):
            if b.column(0)[i].as_py() != last:
                last, kept = b.column(0)[i].as_py(), []
                signatures = np.zeros((0, SIGNATURES), np.uint64)
            runs = distinct(grams(codes, 5))
            own = np.frombuffer(b.column(2)[i].as_py(), np.uint64)
            near = np.flatnonzero((signatures == own).sum(1) >= SHARED)
            if any(_alike(runs, kept[k]) for k in near):
                dropped.append(b.column(1)[i].as_py())
            else:
                kept.append(runs)
                signatures = np.vstack((signatures, own))
        yield pa.RecordBatch.from_arrays([pa.array(dropped, pa.int64())], names=["n"])


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``NEAR`` or more."""
    if min(len(a), len(b)) < NEAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= NEAR * (len(a) + len(b) - both) - 1e-9


def near_copies(sample: DataFrame) -> DataFrame:
    """(n) of the examples (n, toxic, text) to drop as near copies of kept ones of their label."""
    signed = sample.select("n", "toxic", "text").mapInArrow(
        _signatures, "n long, toxic int, signature binary").where("signature is not null")
    rows = sorted(signed.collect(), key=lambda r: r.n)
    signatures = np.frombuffer(b"".join(r.signature for r in rows), np.uint64)
    least = _groups(signatures.reshape(-1, SIGNATURES), np.array([r.toxic for r in rows]))
    sizes = np.bincount(least, minlength=len(rows))
    grouped = [(int(g), r.n, bytes(r.signature)) for g, r in zip(least, rows, strict=True)
               if sizes[g] > 1]
    groups = sample.sparkSession.createDataFrame(grouped, "group long, n long, signature binary")
    return (sample.select("n", "text").join(F.broadcast(groups), "n")
            .select("group", "n", "signature", "text")
            .repartition("group").sortWithinPartitions("group", "n")
            .mapInArrow(_near_copies, "n long"))


def _labelled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 1):
        labels = b.column(0).to_pylist()
        terms, toxic = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, codes in _term_lists(b.column(1)):
            own = np.unique(codes)
            terms.append(own)
            toxic.append(np.full(len(own), labels[i]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(terms).view(np.int64)),
             pa.array(np.concatenate(toxic), pa.int64())], names=["term", "toxic"])


def _known(codes: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the vocabulary's terms among the codes."""
    at = np.searchsorted(vocabulary, codes)
    at[at == len(vocabulary)] = 0
    hit = at[vocabulary[at] == codes] if len(vocabulary) else at[:0]
    return np.unique(hit, return_counts=True)


# --- index ------------------------------------------------------------------------------------

@dataclass
class Index:
    """Examples as a matrix of unit vectors over the vocabulary, cut into blocks."""

    vocabulary: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    postings: list[tuple[np.ndarray, np.ndarray]]  # per term: examples, weights
    tops: np.ndarray  # per term and block: largest weight
    empty_share: float
    curve: tuple[float, float] = (1.0, 0.0)
    rows: list = field(default_factory=list)  # per block: dense weights

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weight = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt((weight * weight).sum())
        return weight / norm if norm else weight

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1,
                ) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest positive cosine and their cosines; ties by number."""
        bounds = weights @ self.tops[terms]
        order = np.argsort(-bounds, kind="stable")
        found, cosines, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for block in order:
            # Equal cosines are decided by number, so an equal bound still has to be scored.
            if bounds[block] <= 0 or (len(found) >= k and bounds[block] < least - 1e-12):
                break
            lo = block * BLOCK
            own = np.round(weights @ self.rows[block][terms], 12)
            if lo <= without < lo + BLOCK:
                own[without - lo] = 0
            hit = np.flatnonzero(own > 0)
            found = np.concatenate((found, hit + lo))
            cosines = np.concatenate((cosines, own[hit]))
            if len(found) > k:
                best = np.lexsort((found, -cosines))[:k]
                found, cosines = found[best], cosines[best]
            if len(found) >= k:
                least = cosines.min()
        best = np.lexsort((found, -cosines))
        return found[best], cosines[best]

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic votes, with one vote of weight 0.1 for the examples without terms."""
        return float((cosines @ self.labels[found] + 0.1 * self.empty_share)
                     / (cosines.sum() + 0.1))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if len(terms):
            found, cosines = self.nearest(terms, self.vector(terms, counts), NEAREST)
            if len(found):
                return self.calibrated(self.vote(found, cosines)), found, cosines
        none = np.zeros(0, np.int64)
        return self.empty_share, none, none

    def calibrated(self, vote: float) -> float:
        slope, shift = self.curve
        return float(1 / (1 + np.exp(-np.clip(slope * vote + shift, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with softened targets and a small penalty."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        gradient = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        hessian = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()],
                            [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def build(vocabulary: np.ndarray, idf: np.ndarray, ids: list, labels: np.ndarray,
          vectors: list[tuple[np.ndarray, np.ndarray]]) -> Index:
    """The index over examples given as (terms, counts)."""
    empty = np.array([not len(t) for t, _ in vectors], bool)
    toxic = labels.astype(float)
    share = float((toxic[empty].sum() + toxic.mean()) / (empty.sum() + 1)) if len(toxic) else 0.0
    # Examples of the same terms stand together, so that few blocks have high bounds at once.
    order = sorted(np.flatnonzero(~empty), key=lambda i: (
        vectors[i][0][np.argmax(idf[vectors[i][0]])], tuple(vectors[i][0])))
    n_blocks = -(-len(order) // BLOCK)
    index = Index(vocabulary, idf, np.array([ids[i] for i in order], object),
                  toxic[order] if order else np.zeros(0), [], np.zeros((len(vocabulary), n_blocks)),
                  share)
    dense = np.zeros((len(vocabulary), n_blocks * BLOCK))
    for n, i in enumerate(order):
        terms, counts = vectors[i]
        dense[terms, n] = index.vector(terms, counts)
    index.rows = [np.ascontiguousarray(dense[:, lo: lo + BLOCK])
                  for lo in range(0, n_blocks * BLOCK, BLOCK)]
    index.postings = [(np.flatnonzero(row), row[row > 0]) for row in dense]
    for term, (who, weight) in enumerate(index.postings):
        np.maximum.at(index.tops[term], who // BLOCK, weight)
    votes = []
    for n, i in enumerate(order):
        terms, counts = vectors[i]
        found, cosines = index.nearest(terms, index.vector(terms, counts), NEAREST, without=n)
        votes.append(index.vote(found, cosines) if len(found) else share)
    if order:
        index.curve = logistic(np.array(votes), index.labels)
    return index


# --- learning ---------------------------------------------------------------------------------

def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
             most: int) -> DataFrame:
    """(n, doc_id, toxic, text) of at most ``most`` labelled rows that are not held out."""
    ident = named(id_col).cast("long")
    usable = (labels.select(ident.alias("doc_id"), named(label_col).cast("int").alias("toxic"))
              .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)
                     & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total = usable.count()
    mark = F.xxhash64(F.lit(11), F.col("doc_id"))
    # The hash bound thins the rows out before the few that are left are ordered.
    share = min(1.0, 1.2 * most / max(1, total))
    level = int(-(1 << 63) + share * ((1 << 64) - 1))
    picked = usable.where(mark <= F.lit(min(level, (1 << 63) - 1))).orderBy(mark).limit(most)
    found = docs.select(ident.alias("doc_id"), named(text_col).cast("string").alias("text"))
    # Documents that repeat an id can't add examples beyond the bound: one row of each id.
    rows = (found.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic")
            .agg(F.max("text").alias("text")))
    return materialize(rows.withColumn("n", F.col("doc_id")), "examples")


def _evidence(a: Column, both: Column, n_toxic: int, n_all: int) -> Column:
    """Log-likelihood ratio of a term's counts against independence of the labels."""
    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))

    cells = (a, both - a, n_toxic - a, n_all - n_toxic - both + a)
    edges = (both, n_all - both, F.lit(n_toxic), F.lit(n_all - n_toxic))
    return sum(map(part, cells), part(F.lit(n_all))) - sum(map(part, edges), F.lit(0.0))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", most: int = EXAMPLES) -> Index:
    """The index over a bounded sample of labelled documents."""
    sample = examples(docs, labels, id_col, text_col, label_col, most)
    dropped = [(r.n,) for r in near_copies(sample).collect()]
    spark = docs.sparkSession
    chosen = sample.join(F.broadcast(spark.createDataFrame(dropped, "n long")), "n", "left_anti")
    n_toxic, n_all = chosen.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_clean = n_all - n_toxic
    vocabulary = np.zeros(0, np.uint64)
    if n_toxic and n_clean:
        counts = (chosen.select("toxic", "text")
                  .mapInArrow(_labelled_terms, "term long, toxic long").groupBy("term")
                  .agg(F.sum("toxic").alias("a"), F.count("*").alias("both")))
        counts = materialize(counts.where(F.col("both") >= LEAST_DOCS), "terms")
        # Of as many tests as there are terms, about one in three may pass by chance alone.
        least = math.log(max(1, counts.count())) + 1
        gain = _evidence(F.col("a"), F.col("both"), n_toxic, n_all)
        terms = (counts.withColumn("gain", gain).where(F.col("gain") >= least)
                 .orderBy(F.desc("gain"), "term").limit(TERMS))
        found = [r.term for r in terms.collect()]
        vocabulary = np.sort(np.array(found, np.int64).view(np.uint64))
    idf = document_frequencies(docs, vocabulary, text_col)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2):
            rows = [_known(codes, vocabulary) for _, codes in _term_lists(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([t for t, _ in rows], pa.list_(pa.int64())),
                 pa.array([c for _, c in rows], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "terms", "counts"])

    rows = sorted(chosen.select("doc_id", "toxic", "text").mapInArrow(
        vectors, "doc_id long, toxic int, terms array<long>, counts array<long>").collect(),
        key=lambda r: r.doc_id)
    return build(vocabulary, idf, [r.doc_id for r in rows],
                 np.array([r.toxic for r in rows], float),
                 [(np.array(r.terms, np.int64), np.array(r.counts, float)) for r in rows])


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray, text_col: str) -> np.ndarray:
    """Inverse document frequencies of the vocabulary over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for b in sliced(batches, 0):
            total[-1] += b.num_rows
            for _, codes in _term_lists(b.column(0)):
                total[_known(codes, vocabulary)[0]] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(total)], names=["term", "n"])

    rows = (docs.select(named(text_col).cast("string").alias("text"))
            .mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
            .collect())
    total = np.zeros(len(vocabulary) + 1)
    for r in rows:
        total[r.term] = r.n
    return np.log((1 + total[-1]) / (1 + total[:-1])) + 1


# --- scoring ----------------------------------------------------------------------------------

SCORED = pa.schema([
    ("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.struct(
        [("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))])


def _scored(index: Index):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            scores, evidence = [], []
            for _, codes in _term_lists(b.column(1)):
                score, found, cosines = index.score(*_known(codes, index.vocabulary))
                scores.append(score)
                evidence.append([
                    {"doc_id": index.ids[i], "cosine": float(c), "toxic": int(index.labels[i])}
                    for i, c in zip(found[:EVIDENCE], cosines, strict=False)])
            yield batch(SCORED, b.column(0), scores, evidence)
    return emit


def scores(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text",
           ) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence (the nearest examples)."""
    rows = docs.select(named(id_col).cast("long"), named(text_col).cast("string"))
    found = rows.mapInArrow(
        _scored(index), "doc_id long, score double, "
                        "evidence array<struct<doc_id: long, cosine: double, toxic: int>>")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def clean_documents(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, at):
            found = [index.score(*_known(codes, index.vocabulary))[0]
                     for _, codes in _term_lists(b.column(at))]
            yield b.filter(pa.array([s < 0.5 for s in found]))

    return docs.mapInArrow(judge, docs.schema)
