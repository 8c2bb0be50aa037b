"""Leaf blocks of web pages: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSHOWN = frozenset("script style template iframe object canvas audio video head title noembed "
                    "noframes select option textarea datalist".split())
UNSHOWN_IN = {"math": frozenset(("annotation", "annotation-xml")),
              "svg": frozenset(("desc", "metadata"))}
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog "
                  "dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
                  "header hgroup hr html label legend li main menu nav noscript ol option p pre "
                  "section select summary table tbody td textarea tfoot th thead tr ul".split())
INSIDE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl table menu".split())
SECTIONS = frozenset("article main aside nav footer header form section noscript".split())
NO_PARAGRAPH = BLOCK - frozenset("body html button label option select textarea".split())

# Quotes hold a value only behind an equals sign, as browsers read it; elsewhere they are letters, and
# so is one that never closes.
TAG = re.compile(r"<(?:!--(?P<comment>)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
                 r"(?P<attrs>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"
                 r"\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)?+)?+)*+)>|[!?/][^>]*+>)")
NAMED = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none")
TOKEN = re.compile(r"[a-z]+")


@dataclass
class Place:
    """A chain of open elements.

    Its features name all elements of the chain (``in:``, ``is:``) and the innermost one that
    says what it is by its tag or by its class, id or role (``near:``).
    """

    tag: str
    parent: Place | None
    features: frozenset[str]  # of all elements of the chain
    block: bool
    shown: bool
    link: bool
    depth: int = 0
    below: dict = field(default_factory=dict)

    def child(self, tag: str, attrs: str) -> Place:
        found = self.below.get((tag, attrs))
        if found is None:
            own = {f"in:{tag}"}
            for _, a, b, c in NAMED.findall(attrs):
                own |= {f"is:{t}" for t in TOKEN.findall((a or b or c).lower())}
            known = {f[3:] for f in own if f.startswith("is:")} | ({tag} & SECTIONS)
            near = {f"near:{name}" for name in known} or {
                f for f in self.features if f.startswith("near:")}
            if HIDDEN.search(attrs):
                own.add("hidden")
            above = {f for f in self.features if not f.startswith("near:")}
            features = frozenset(above | own | near)
            if features == self.features:  # deep nesting of one tag shares its set
                features = self.features
            shown = self.shown and tag not in UNSHOWN and not any(
                tag in names and f"in:{outer}" in above for outer, names in UNSHOWN_IN.items())
            found = Place(tag, self, features, tag in BLOCK, shown, self.link or tag == "a",
                          self.depth + 1)
            # Attributes of no interest may differ without end, and be of any length; chains of any
            # length are not worth keeping beyond their page.
            if len(self.below) < 2_000 and len(attrs) <= 1_000 and self.depth < 200:
                self.below[tag, attrs] = found
        return found


class Open:
    """The open elements of a page: as a chain, by tag, and the blocks among them.

    Every element is pushed and closed once, and no question walks the chain, so a page takes time
    in proportion to its length however deep it is nested.
    """

    def __init__(self, top: Place):
        self.chain, self.blocks = [top], [top]
        self.by_tag: dict[str, list[Place]] = {}

    def push(self, place: Place) -> None:
        self.chain.append(place)
        self.by_tag.setdefault(place.tag, []).append(place)
        if place.block:
            self.blocks.append(place)

    def close(self, place: Place) -> None:
        """Closes the element and all within it."""
        while True:
            last = self.chain.pop()
            self.by_tag[last.tag].pop()
            if last.block:
                self.blocks.pop()
            if last is place:
                return

    def nearest(self, tags: tuple[str, ...] | frozenset[str]) -> Place | None:
        """The innermost open element with one of these tags."""
        found = [own[-1] for own in map(self.by_tag.get, tags) if own]
        return max(found, key=lambda place: place.depth, default=None)

    def make_room(self, name: str) -> None:
        """Closes what the new element can't stand in: open paragraphs, items of the same list."""
        while True:
            if name in NO_PARAGRAPH and self.blocks[-1].tag == "p":
                self.close(self.blocks[-1])
            item = self.nearest(INSIDE[name]) if name in INSIDE else None
            if item is None:
                return
            around = self.nearest(LISTS)
            if around is not None and around.depth > item.depth:
                return
            self.close(item)


@dataclass
class Leaf:
    """Text of a block, its nearest block element and how many of its characters are links."""

    text: str
    place: Place
    linked: int


def root() -> Place:
    return Place("", None, frozenset(), True, True, False)


def leaves(page: str, top: Place) -> list[Leaf]:
    """The blocks of a page in order; white space is collapsed, references are decoded."""
    out: list[Leaf] = []
    parts: list[tuple[str, bool]] = []
    stack, place, block, at, n = Open(top), top, top, 0, len(page)
    last = page.rfind(">") + 1  # with no tag behind it, none is read in vain up to the end

    def close() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(t.strip()) for t, link in parts if link)
                out.append(Leaf(text, block, min(linked, len(text))))
            parts.clear()

    def add(raw: str) -> None:
        if raw and place.shown:
            parts.append((html.unescape(raw) if "&" in raw else raw, place.link))

    while at < n:
        found = TAG.search(page, at, last)
        if not found:
            stop = page.find("<!--", at)  # a comment needs no end
            add(page[at:] if stop < 0 else page[at:stop])
            break
        add(page[at:found.start()])
        at = found.end()
        if found["comment"] is not None:
            stop = page.find("-->", max(at - 2, 0))
            at = n if stop < 0 else stop + 3
            continue
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            same = stack.by_tag.get(name)
            node = same[-1] if same else None
            if node:
                if name in BLOCK or block.depth > node.depth:
                    close()
                stack.close(node)
                place, block = stack.chain[-1], stack.blocks[-1]
            elif name == "p":
                close()
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCK:
            close()
            stack.make_room(name)
            place, block = stack.chain[-1], stack.blocks[-1]
        if name in VOID:
            continue
        attrs = found["attrs"]
        if name == "text":  # a label of a drawing
            add(" ")
        if attrs.endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            stop = re.compile(rf"(?i)</{name}\b[^>]*>").search(page, at)
            at = stop.end() if stop else n
            continue
        place = place.child(name, attrs)
        stack.push(place)
        block = stack.blocks[-1]
    close()
    return out
