"""Main text of web pages: the maximum-scoring contiguous run of words and tags.

A page is a sequence of words and tags. A word's score is a sum of learned weights: of the tags, roles, class and id
words around it, tags told apart by where they stand (below the innermost article or main element, above it, or in a
page's plain flow), of standing beside such an element that holds most of the page's words, and of lines that
are all links. A tag's score is negative, by its name. The weights come from labelled pages: for words a logistic
regression on what lies in and out of the labelled regions, for tags log ratios of counts. One linear scan finds the
run with the highest sum. Words of negative weight, and tags among them, score 0 so that an advert cannot split an
article in two; they are left out of the run's text, and the rest is joined block by block.

Defined results: a null or empty page has empty text, as has a page without a word of positive weight; character
references are decoded once; white space in a block becomes one space; blocks are joined by one newline. Broken
markup, cut-off pages, deep nesting and very long pages are read in one pass. Repeated rows are read alike; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.labelled_pages import pages as labelled

TOKEN = re.compile(
    r"<!--(?P<note>.*?)(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<broken>/?[a-zA-Z][^>]*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr",
}
#: Tags that say something about the words in them; fixed values.
TELLING = {
    "address", "article", "aside", "audio", "blockquote", "button", "canvas", "dialog", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "head", "header", "li", "main", "map", "menu", "nav", "object", "p", "pre", "section", "select", "svg", "video",
}
#: Tags whose text only shows if they do not work.
EMBEDDED = {"applet", "audio", "canvas", "head", "map", "object", "svg", "video"}
MAIN_TAGS = {"article", "main"}
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Weights are whole numbers of this part, so that sums do not depend on their order.
UNIT = 1 << 20
FLOW, ABOVE, BELOW = "flow", "above", "below"
BIAS, BESIDE, LINKS = "bias", "beside", "links"
#: An opening tag of these ends an open one of the same kind.
CLOSES_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(text)}


def features(name: str, attrs: str) -> list[str]:
    """What an element says: its tag, role, class and id words, and whether it is hidden."""
    out = ["tag embedded" if name in EMBEDDED else f"tag {name}"] if name in TELLING else []
    if not attrs or attrs.isspace() or name in ("html", "body"):
        return out
    has = _attributes(attrs)
    if "hidden" in has or has.get("aria-hidden") == "true" or "display:none" in has.get("style", "").replace(" ", "").lower():
        out.append("hidden")
    if has.get("role"):
        out.append(f"role {has['role'].lower()}")
    for token in f"{has.get('class', '')} {has.get('id', '')}".split():
        words = [w.lower() for w in PARTS.findall(token)]
        if words:
            out.append("name " + " ".join(words))
    return out


def parts(feature: str) -> list[str]:
    """What is learned of a feature. What a name's first word does to the others is learned apart: no-sidebar, left-sidebar."""
    if not feature.startswith("name "):
        return [feature]
    _, first, *rest = feature.split()
    return [f"first {first}", *[f"rest {w}" for w in rest]] if rest else [f"word {first}"]


class _Place:
    """Open elements, and the sum of the weights of what they say, kept up to date element by element."""

    def __init__(self, weights: dict[str, int]):
        self.weights = weights
        self.stack: list[tuple[str, list[str]]] = []
        self.names: Counter[str] = Counter()
        self.counts: dict[str, Counter[str]] = {FLOW: Counter(), ABOVE: Counter(), BELOW: Counter()}
        #: What the elements since each open main element say.
        self.since: list[Counter[str]] = []
        self.score = weights.get(BIAS, 0)

    def _weight(self, where: str, feature: str) -> int:
        """A name never speaks for a story: a wrapper's would outweigh that of an advert in it."""
        found = sum(self.weights.get(f, 0) for f in parts(feature))
        return min(found, 0) if feature.startswith(("name", "role")) else found + self.weights.get(f"{where} {feature}", 0)

    def _count(self, where: str, found: Iterable[tuple[str, int]]) -> None:
        own = self.counts[where]
        for f, n in found:
            before = own[f]
            own[f] = before + n
            if (before > 0) != (own[f] > 0):
                self.score += self._weight(where, f) * (1 if n > 0 else -1)
            if not own[f]:
                del own[f]

    def push(self, name: str, attrs: str) -> None:
        said = features(name, attrs)
        self.stack.append((name, said))
        self.names[name] += 1
        if name in MAIN_TAGS:
            # what is open so far is now above
            moved, where = (self.since[-1], BELOW) if self.since else (dict(self.counts[FLOW]), FLOW)
            moved = Counter(moved)
            self._count(where, [(f, -n) for f, n in moved.items()])
            self._count(ABOVE, moved.items())
            self.since.append(Counter())
            self.moved = getattr(self, "moved", [])
            self.moved.append((where, moved))
        where = BELOW if self.since else FLOW
        if self.since:
            self.since[-1].update(said)
        self._count(where, [(f, 1) for f in said])

    def pop(self) -> str:
        name, said = self.stack.pop()
        self.names[name] -= 1
        where = BELOW if self.since else FLOW
        self._count(where, [(f, -1) for f in said])
        if self.since:
            self.since[-1].subtract(said)
        if name in MAIN_TAGS:
            self.since.pop()
            where, moved = self.moved.pop()
            self._count(ABOVE, [(f, -n) for f, n in moved.items()])
            self._count(where, moved.items())
        return name

    def said(self) -> set[str]:
        """The features that the score sums."""
        said = [(where, f) for where, own in self.counts.items() for f in own]
        return {BIAS, *(x for _, f in said for x in parts(f)), *(f"{where} {f}" for where, f in said if f.startswith(("tag", "hidden")))}


def tokens(page: str, place: _Place) -> Iterator[tuple[str, str]]:
    """(kind, text): a tag's name, a text or a note, with place as it is there; a closing tag's place is in its element."""
    stack, at = place.stack, 0
    while True:
        m = TOKEN.search(page, at)
        upto = m.start() if m else len(page)
        if upto > at:
            yield "text", page[at:upto]
        if not m:
            return
        at = m.end()
        if m["note"] is not None:
            yield "note", m["note"]
        elif m["cdata"] is not None:
            yield "text", html.escape(m["cdata"])
        elif m["name"]:
            name = m["name"].lower()
            if m["close"]:
                if name in RAW or name in VOID:
                    if name == "br":
                        yield "tag", name
                    continue
                yield "tag", name
                if place.names[name]:
                    while place.pop() != name:
                        pass
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                yield "tag", name
                continue
            if name in CLOSES_P and any(n == "p" for n, _ in stack[-4:]):
                while stack and stack[-1][0] in INLINE:
                    place.pop()
                if stack and stack[-1][0] == "p":
                    place.pop()
            if stack and name in SIBLINGS and stack[-1][0] in SIBLINGS[name]:
                place.pop()
            if name not in VOID and not m["attrs"].endswith("/"):
                place.push(name, m["attrs"])
            yield "tag", name


class _Piece:
    """A text and where it stands; number counts tokens, block counts blocks."""

    __slots__ = ("block", "inside", "link", "main", "number", "said", "score", "text", "words")

    def __init__(self, number: int, block: int, text: str, place: _Place, inside: bool, learn: bool):
        self.number, self.block, self.text, self.words = number, block, text, len(text.split())
        self.score, self.main, self.link, self.inside = place.score, bool(place.since), place.names["a"] > 0, inside
        self.said = place.said() if learn else set()


def pieces(page: str, weights: dict[str, int], learn: bool = False) -> tuple[list[_Piece], list[tuple[int, str, int, bool]]]:
    """The texts of a page with their scores, and its tags: (token number, name, score of the place, inside the label)."""
    place, texts, tags = _Place(weights), [], []
    inside, block = False, 0
    for number, (kind, text) in enumerate(tokens(page, place)):
        if kind == "note":
            inside = inside if not learn else text == "+" or inside and text != ""
        elif kind == "text":
            texts.append(_Piece(number, block, text, place, inside, learn))
        else:
            tags.append((number, text, place.score, inside))
            block += text not in INLINE
    linked: dict[int, bool] = {}
    for p in texts:
        if any(map(str.isalnum, p.text)):
            linked[p.block] = linked.get(p.block, True) and p.link
    # words of positive weight so far: does a main element hold the most of them?
    held = sum(p.words if p.main else -p.words for p in texts if p.score > 0)
    beside = held >= 0 and any(p.main and p.words and p.score > 0 for p in texts)
    for p in texts:
        for name, on in ((BESIDE, beside and not p.main), (LINKS, linked.get(p.block, False))):
            if on:
                p.score += weights.get(name, 0)
                p.said |= {name} if learn else set()
    return texts, tags


def _regression(rows: list[set[str]], y: np.ndarray, n: np.ndarray, ridge: float, rounds: int = 15) -> dict[str, float]:
    """Weights of a logistic regression on binary features, by Newton steps; words of names, but for first ones, stay at most 0."""
    names = sorted(set().union(*rows))
    index = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, row in enumerate(rows):
        x[i, [index[f] for f in row]] = 1.0
    w = np.zeros(len(names))
    named = np.array([f.startswith(("word", "rest", "role")) for f in names])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + ridge * w
        # a word stays at 0 as long as it would rise
        free = ~(named & (w >= 0) & (slope <= 0))
        own = x[:, free]
        step = np.linalg.solve((own.T * (n * np.maximum(p * (1 - p), 1e-6))) @ own + ridge * np.eye(own.shape[1]), slope[free])
        w[free] -= step
        w[named] = np.minimum(w[named], 0.0)
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(names, w.tolist(), strict=True))


def fit_weights(pages: Iterable[str], ridge: float = 0.02) -> dict[str, int]:
    """Weights of features, and of tags under "cost <name>", in units."""
    pages = list(pages)
    weights: dict[str, int] = {}
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    # which element holds the most words is judged by the weights of the round before
    for _ in range(2):
        seen: Counter[tuple[frozenset, bool]] = Counter()
        for page in pages:
            for p in pieces(page, weights or {BIAS: 1}, learn=True)[0]:
                if p.words:
                    seen[frozenset(p.said), p.inside] += 1
        rows = list(seen)
        found = _regression([set(r[0]) for r in rows], np.array([float(r[1]) for r in rows]), np.array([float(seen[r]) for r in rows]), ridge)
        weights = {f: round(w * UNIT) for f, w in found.items()}
    for page in pages:
        for _, name, score, where in pieces(page, weights, learn=True)[1]:
            if score > 0:
                (inside if where else outside)[name] += 1
    for name in {*inside, *outside}:
        # a tag never speaks for content
        weights[f"cost {name}"] = round((min(math.log((inside[name] + 1.0) / (outside[name] + 1.0)), 0.0) - 0.05) * UNIT)
    return weights


@functools.cache
def learned() -> dict[str, int]:
    return fit_weights(labelled())


OTHER_TAG = -0.3


def main_text(page: str | None, weights: dict[str, int] | None = None) -> str:
    """The page's main text."""
    if not page:
        return ""
    weights = learned() if weights is None else weights
    texts, tags = pieces(page, weights)
    other = round(OTHER_TAG * UNIT)
    scored = [(p.number, p.words * p.score if p.score > 0 else 0) for p in texts]
    scored += [(number, weights.get(f"cost {name}", other) if score > 0 else 0) for number, name, score, _ in tags]
    total = best = begin = 0
    region = (0, -1)
    for number, score in sorted(scored):
        if total <= 0:
            total, begin = 0, number
        total += score
        if total > best:
            best, region = total, (begin, number)
    # a block that the region touches belongs to it as a whole
    touched = {p.block for p in texts if p.words and p.score > 0 and region[0] <= p.number <= region[1]}
    blocks: dict[int, list[str]] = {}
    for p in texts:
        if p.block in touched and p.score > 0:
            blocks.setdefault(p.block, []).append(p.text)
    joined = (" ".join(html.unescape("".join(x)).split()) for x in blocks.values())
    return "\n".join(x for x in joined if x)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    weights = learned()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(p, weights) for p in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    kinds = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return kinds.mapInPandas(run, "page_id long, url string, text string, n_chars long")
