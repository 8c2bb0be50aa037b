"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is the sequence of its leaf blocks (``dom``). Features of a block are the tags of its
ancestors, the words of their classes, ids and roles, and its text: length, share of linked
characters, punctuation, digits, place in the page. Two labels, content and other, are chained
with weights that depend on whether two neighbours have the same parent. The field is trained by
maximum likelihood on labelled pages and decoded by Viterbi; the blocks labelled content are joined
in page order by one space.

The labelled pages are laid out by rules that put known content and known menus, notices, adverts,
forms, comments and the like into many kinds of markup, with the prose of at most ``PAGES_READ``
pages of the table as their text. Training takes a few seconds on the driver and its weights are
a few hundred numbers.

Nothing of a page is dropped or capped besides blocks that are not content. A null or empty page has
no text. Rows that repeat are extracted each, null ids and urls are kept, a table without rows gives
none.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casedesk.llm.dom import Leaf, Place, leaves, root
from casedesk.llm.frames import batch, named, sliced

PAGES_READ = 400  # pages whose prose fills the labelled pages
PAGE_CHARS = 20_000  # longest page that is read for its prose
PAGES_MADE = 1_200
EPOCHS = 150
PENALTY = 5e-5
CONTENT, OTHER = "", ""  # marks of the labels in the pages made for training

RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()),
                    ("n_chars", pa.int64())])


# --- features ---------------------------------------------------------------------------------

def text_features(leaf: Leaf, i: int, n: int) -> list[str]:
    text = leaf.text
    words = text.count(" ") + 1
    linked = 4 * leaf.linked // max(1, len(text))
    out = [f"words:{min(words.bit_length(), 7)}", f"linked:{linked}", f"tag:{leaf.place.tag}",
           f"place:{4 * i // n}"]
    if text[-1] in ".!?:;\"”»…":
        out.append("stops")
    if "©" in text or "|" in text or "»" in text:
        out.append("signs")
    if ", " in text or ". " in text:
        out.append("prose")
    if sum(c.isdigit() for c in text[:80]) * 4 > min(len(text), 80):
        out.append("digits")
    return out


def features(found: list[Leaf]) -> list[list[str]]:
    n = len(found)
    return [[*leaf.place.features, *text_features(leaf, i, n)] for i, leaf in enumerate(found)]


def siblings(found: list[Leaf]) -> list[int]:
    """For every block but the first, whether it has the parent of the block before."""
    return [int(a.place.parent is b.place.parent or a.place is b.place)
            for a, b in zip(found, found[1:], strict=False)]


# --- field ------------------------------------------------------------------------------------

@dataclass
class Field:
    """Weights of a linear chain with the labels 0 (other) and 1 (content)."""

    weights: dict[str, float]
    steps: np.ndarray  # [same parent, label before, label]

    def labels(self, found: list[Leaf]) -> list[int]:
        """The most probable labels, by Viterbi; equal paths prefer ``other``."""
        if not found:
            return []
        n, get = len(found), self.weights.get
        by_place: dict[int, float] = {}
        scores = []
        for i, leaf in enumerate(found):
            base = by_place.get(id(leaf.place))
            if base is None:
                base = by_place[id(leaf.place)] = sum(get(f, 0.0) for f in leaf.place.features)
            scores.append(base + get("bias", 0.0)
                          + sum(get(f, 0.0) for f in text_features(leaf, i, n)))
        steps = self.steps.tolist()
        zero, one = 0.0, scores[0]
        back = []
        for same, score in zip(siblings(found), scores[1:], strict=True):
            t = steps[same]
            from_one = (one + t[1][0] > zero + t[0][0], one + t[1][1] > zero + t[0][1])
            back.append(from_one)
            zero, one = (max(zero + t[0][0], one + t[1][0]),
                         max(zero + t[0][1], one + t[1][1]) + score)
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int], list[int]]], epochs: int = EPOCHS) -> Field:
    """Maximum likelihood with a quadratic penalty, by full-batch Adam steps.

    A page is (features of its blocks, sibling flags, labels). All pages go through the
    forward-backward recursion side by side.
    """
    names = sorted({f for blocks, _, _ in pages for block in blocks for f in block} | {"bias"})
    number = {f: i for i, f in enumerate(names)}
    longest = max(len(blocks) for blocks, _, _ in pages)
    shape = (len(pages), longest)
    mask, label = np.zeros(shape), np.zeros(shape, int)
    same = np.zeros((len(pages), longest), int)
    row, column, feature = [], [], []
    for p, (blocks, flags, labels) in enumerate(pages):
        mask[p, :len(blocks)] = 1
        label[p, :len(blocks)] = labels
        same[p, 1:len(blocks)] = flags
        for i, block in enumerate(blocks):
            own = [number[f] for f in {*block, "bias"}]
            row += [p] * len(own)
            column += [i] * len(own)
            feature += own
    cell = np.array(row) * longest + np.array(column)
    feature = np.array(feature)
    w, steps = np.zeros(len(names)), np.zeros((2, 2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(steps), np.zeros_like(steps)]
    pair_mask = mask[:, 1:] * mask[:, :-1]
    truth = np.zeros((2, 2, 2))
    np.add.at(truth, (same[:, 1:], label[:, :-1], label[:, 1:]), pair_mask)
    for epoch in range(1, epochs + 1):
        score = np.bincount(cell, w[feature], shape[0] * shape[1]).reshape(shape) * mask
        emit = np.stack([np.zeros(shape), score], 2)
        move = steps[same]  # page, place, before, label
        ahead, behind = np.zeros((*shape, 2)), np.zeros((*shape, 2))
        ahead[:, 0] = emit[:, 0]
        for i in range(1, longest):
            new = _log_sum(ahead[:, i - 1, :, None] + move[:, i], 1) + emit[:, i]
            ahead[:, i] = np.where(mask[:, i, None] > 0, new, ahead[:, i - 1])
        for i in range(longest - 2, -1, -1):
            new = _log_sum(move[:, i + 1] + (emit[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
            behind[:, i] = np.where(mask[:, i + 1, None] > 0, new, 0)
        total = _log_sum(ahead[:, -1], 1)
        single = np.exp(ahead + behind - total[:, None, None])[..., 1] * mask
        both = (ahead[:, :-1, :, None] + move[:, 1:]
                + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None])
        both = np.exp(np.minimum(both, 0)) * pair_mask[..., None, None]
        guess = np.zeros((2, 2, 2))
        np.add.at(guess, same[:, 1:], both)
        count = mask.sum()
        slope_w = (np.bincount(feature, (single - label * mask).ravel()[cell], len(names)) / count
                   + PENALTY * w)
        slope_s = (guess - truth) / count + PENALTY * steps
        for values, slope, k in ((w, slope_w, 0), (steps, slope_s, 2)):
            moments[k] = 0.9 * moments[k] + 0.1 * slope
            moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * slope * slope
            first = moments[k] / (1 - 0.9 ** epoch)
            second = moments[k + 1] / (1 - 0.99 ** epoch)
            values -= 0.15 * first / (np.sqrt(second) + 1e-8)
    return Field(dict(zip(names, w.tolist(), strict=True)), steps)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


# --- labelled pages ---------------------------------------------------------------------------

CONTENT_ELEMENTS = (
    "article", "article", "article", "main", "div class=content", "div id=content",
    "div id=main-content", "div class=post-body", "div class=entry-content",
    "section class=article-body", "div class=story", "td class=body", "div role=main", "div",
    "article class=post", "div class=text", "section")
OTHER_ELEMENTS = {
    "links": ("nav", "nav class=menu", "header", "ul class=menu", "div class=navigation",
              "div id=nav", "div class=sidebar", "aside", "div class=breadcrumb",
              "div class=pagination", "div class=share", "div class=social", "div class=related",
              "div class=tags", "footer", "div class=topbar", "div"),
    "line": ("div class=ad", "div class=ads", "div class=advert", "div class=advertisement",
             "div class=sponsored", "div class=promo", "div class=banner", "footer",
             "div class=footer", "div class=copyright", "header", "div id=header",
             "div class=notice", "div class=cookie-notice", "div class=cookie", "div role=alert",
             "div class=alert", "div class=popup", "div class=modal", "div class=disclaimer",
             "div class=newsletter", "aside", "aside class=sidebar", "div class=byline",
             "div class=consent", "noscript", "div role=banner", "div role=contentinfo",
             "div class=subscribe", "div class=widget", "div role=complementary", "div"),
    "form": ("form", "form class=search", "form class=newsletter", "div class=login"),
    "prose": ("section class=comments", "div id=comments", "div class=comment", "ol class=comments",
              "div class=comment-list", "div class=replies", "div class=discussion",
              "div class=reviews", "section id=responses", "aside", "div class=sidebar", "footer",
              "div class=ad", "div class=notice", "div class=related", "div class=promo")}


class Maker:
    """Lays out labelled pages from a pool of lines."""

    def __init__(self, pool: list[str], seed: int):
        self.random, self.pool = random.Random(seed), pool

    def prose(self, mark: str, low: int, high: int) -> str:
        words: list[str] = []
        want = self.random.randint(low, high)
        while len(words) < want:
            words += self.random.choice(self.pool).split()
        text = " ".join(words[:want]).replace("&", "&amp;").replace("<", "&lt;")
        if self.random.random() < 0.85 and want > 6:
            text = text.rstrip(".,;") + "."
        return mark + text

    def wrapped(self, element: str, inner: str) -> str:
        tag, _, attrs = element.partition(" ")
        name, _, value = attrs.partition("=")
        attrs = f' {name}="{value}"' if attrs else ""
        if tag == "td":
            return f"<table><tr><td{attrs}>{inner}</td></tr></table>"
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def content(self) -> str:
        pick = self.random.random
        out = []
        if pick() < 0.8:
            title = f"<h1>{self.prose(CONTENT, 1, 10)}</h1>"
            out.append(f"<header>{title}</header>" if pick() < 0.1 else title)
        for _ in range(self.random.randint(1, 12)):
            kind = pick()
            if kind < 0.7:
                text = self.prose(CONTENT, 1, 90)
                if pick() < 0.15:
                    words = text.split(" ")
                    at = self.random.randrange(len(words))
                    words[at] = f'<a href="/x">{words[at]}</a>'
                    text = " ".join(words)
                if pick() < 0.15:
                    out.append(f"<p><b>{text}<br>")
                else:
                    out.append(f"<p>{text}</p>" if pick() < 0.9 else text + "<br><br>")
            elif kind < 0.78:
                out.append(f"<h2>{self.prose(CONTENT, 1, 8)}</h2>")
            elif kind < 0.86:
                items = "".join(f"<li>{self.prose(CONTENT, 1, 25)}</li>"
                                for _ in range(self.random.randint(1, 6)))
                out.append(self.wrapped(self.random.choice(("ul", "ol")), items))
            elif kind < 0.91:
                out.append(f"<blockquote>{self.prose(CONTENT, 5, 40)}</blockquote>")
            elif kind < 0.95:
                cells = "".join(f"<td>{self.prose(CONTENT, 1, 6)}</td>" for _ in range(4))
                out.append(f"<table><tr>{cells}</tr></table>")
            else:
                out.append(f"<pre>{self.prose(CONTENT, 3, 30)}</pre>")
        while pick() < 0.45:
            out.insert(self.random.randint(0, len(out)), self.other(inside=True))
        return self.wrapped(self.random.choice(CONTENT_ELEMENTS), "".join(out))

    def other(self, inside: bool = False) -> str:
        kind = self.random.choice(tuple(OTHER_ELEMENTS))
        elements = [e for e in OTHER_ELEMENTS[kind] if not inside or e not in ("div", "header")]
        element = self.random.choice(elements)
        if kind == "links":
            inner = "".join(f'<li><a href="/y">{self.prose(OTHER, 1, 4)}</a></li>'
                            for _ in range(self.random.randint(2, 8)))
            inner = inner if element.startswith("ul") else f"<ul>{inner}</ul>"
        elif kind == "line":
            text = self.prose(OTHER, 2, 25)
            inner = text if self.random.random() < 0.6 else f"<p>{text}</p>"
            if element.startswith(("footer", "div class=copy")) and self.random.random() < 0.6:
                inner = inner.replace(OTHER, OTHER + "&copy; ", 1)
        elif kind == "form":
            inner = (f"<label>{self.prose(OTHER, 1, 5)}</label><input><p>"
                     f"{self.prose(OTHER, 2, 20)}</p><button>{self.prose(OTHER, 1, 2)}</button>")
        else:
            inner = "".join(f"<p>{self.prose(OTHER, 4, 70)}</p>"
                            for _ in range(self.random.randint(1, 4)))
        return self.wrapped(element, inner)

    def page(self) -> str:
        before = [self.other() for _ in range(self.random.randint(0, 3))]
        after = [self.other() for _ in range(self.random.randint(0, 4))]
        body = "".join((*before, self.content(), *after))
        if self.random.random() < 0.2:
            body = self.wrapped(self.random.choice(("div", "div class=container", "div id=page")),
                                body)
        return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


def labelled(page: str, top: Place) -> tuple[list[Leaf], list[int]]:
    """The blocks of a page made for training and their labels, marks removed."""
    found, labels = leaves(page, top), []
    for leaf in found:
        labels.append(int(CONTENT in leaf.text))
        leaf.text = leaf.text.replace(CONTENT, "").replace(OTHER, "") or "x"
    return found, labels


def trained(pool: list[str], n_pages: int = PAGES_MADE, seed: int = 1) -> Field:
    maker, top = Maker(pool or ["Some words, and more of them."], seed), root()
    pages = []
    for _ in range(n_pages):
        found, labels = labelled(maker.page(), top)
        pages.append((features(found), siblings(found), labels))
    return train(pages)


def prose_pool(pages: DataFrame, html_col: str, most: int = PAGES_READ) -> list[str]:
    """Lines of text from at most ``most`` pages, picked by hash."""
    page = named(html_col).cast("string")
    mark = F.xxhash64(page)
    usable = pages.select(page.alias("page"), mark.alias("mark")).where(
        F.length("page").between(1, PAGE_CHARS))
    total = usable.count()
    level = min(int(-(1 << 63) + min(1.0, 1.5 * most / max(1, total)) * ((1 << 64) - 1)),
                (1 << 63) - 1)
    rows = (usable.where(F.col("mark") <= F.lit(level)).orderBy("mark", "page").limit(most)
            .collect())
    top, pool = root(), set()
    for r in rows:
        pool |= {leaf.text for leaf in leaves(r.page, top)}
    return sorted(pool)


# --- extraction -------------------------------------------------------------------------------

def main_text(page: str, field: Field, top: Place) -> str:
    found = leaves(page, top)
    return " ".join(leaf.text for leaf, label in zip(found, field.labels(found), strict=True)
                    if label)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id",
            url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    field = field or trained(prose_pool(pages, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = root()
        for b in sliced(batches, 2, 1 << 23):
            found = [main_text(page or "", field, top) for page in b.column(2).to_pylist()]
            if len(top.below) > 500:  # chains of elements seen so far
                top = root()
            yield batch(RESULT, b.column(0), b.column(1), found, [len(t) for t in found])

    return pages.select(named(id_col).cast("long"), named(url_col).cast("string"),
                        named(html_col).cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
