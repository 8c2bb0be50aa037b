"""Plain versions of the operators, for tables that fit in memory."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

BLANK = re.compile(r"[\x20\x09-\x0D]")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


class Sets:
    """Union-find over row numbers."""

    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def least_ids(ids, sets):
    """Smallest id of each row's set, None where it has none."""
    least = {}
    for i, doc_id in enumerate(ids):
        top = sets.find(i)
        if doc_id is not None:
            least[top] = min(least.get(top, doc_id), doc_id)
    return [least.get(sets.find(i)) for i in range(len(ids))]


def exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0))
    out, settled = [], set()
    for doc_id, text in rows:
        body = BLANK.sub("", text or "")
        best = min(groups[body])
        keep = None if best[1] else best[2]
        stays = doc_id == keep and -len(text or "") == best[0] and body not in settled
        if stays:
            settled.add(body)
        out.append((doc_id, keep, len(groups[body]), stays,
                    hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def shingle_sets(rows):
    out = []
    for _, text in rows:
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                           "abcdefghijklmnopqrstuvwxyz")) for w in split(text)]
        out.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words
                   else set())
    return out


def jaccard(rows):
    found, sets = shingle_sets(rows), Sets(len(rows))
    for i, j in combinations(range(len(rows)), 2):
        if found[i] and found[j]:
            both = len(found[i] & found[j])
            if 100 * both >= 80 * (len(found[i]) + len(found[j]) - both):
                sets.join(i, j)
    least = least_ids([r[0] for r in rows], sets)
    return sorted(((r[0], len(s), n) for r, s, n in zip(rows, found, least, strict=True)), key=str)


def repeats(rows, window=35):
    texts = [(doc_id, split(text)) for doc_id, text in rows]
    seen = Counter(tuple(w[i:i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for doc_id, words in texts:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def archives(rows):
    owner = {}
    for page_id, page in rows:
        raw = (page or "").encode()
        if len(raw) >= 100 and page_id is not None:
            owner[raw] = min(owner.get(raw, page_id), page_id)
    out = []
    for page_id, page in rows:
        raw = (page or "").encode()
        first = owner.get(raw)
        again = len(raw) >= 100 and first is not None and first != page_id
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(),
                    "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def targets(sizes, weights=(5, 2, 1), repeats_=3):
    """By steps of floating point, as a table would be shared out by hand."""
    weight = [weights[i % 3] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weight[i] for i in free)
        share = {i: left * weight[i] / whole for i in free}
        full = [i for i in free if share[i] > repeats_ * sizes[i]]
        if not full:
            for i in free:
                out[i] = share[i]
            return out
        for i in full:
            out[i] = float(repeats_ * sizes[i])
            left -= out[i]
            free.remove(i)
    return out


def vectors(rows, threshold=0.93):
    import numpy as np

    sets, links, usable = Sets(len(rows)), [0] * len(rows), []
    for i, (_, v, label) in enumerate(rows):
        if v and label is not None and None not in v and np.isfinite(v).all() and any(v):
            usable.append(i)
    for i, j in combinations(usable, 2):
        a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
        if rows[i][2] == rows[j][2] and len(a) == len(b) and \
                a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
            sets.join(i, j)
            links[i] += 1
            links[j] += 1
    least = least_ids([r[0] for r in rows], sets)
    return sorted(((r[0], n, c) for r, n, c in zip(rows, links, least, strict=True)), key=str)
