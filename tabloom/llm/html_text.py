"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score by where they stand: the log-odds, from labelled pages,
that a word inside such elements (tag names and class or id names on its path) belongs to the article. Tags
score negative, less so those that labelled articles are full of. One linear scan finds the contiguous run
with the best sum; its words are the text. Elements that never hold content are passed over and left out.

Names as of menus, comments and advertisements leave an element out if a whole class, id or role is the name; as a
part of one they are a feature of low odds. Neither holds for an element around the page's article, or with most
of the words that look like content, nor for names of a state (``has-sidebar``, ``ad-free``), nor for paragraphs,
headings and ids of sections.

Labelled pages are those with exactly one ``article`` element: what it holds is the content. Weights come from
counts over a bounded sample of pages, and start from fixed pseudo-counts, so that tables without any
labelled page work as well.

Null and empty pages give empty text; so do pages without a word of positive score. Unclosed, crossed and
cut-off tags are read as they come. Repeated rows give equal rows. Other columns pass through.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Expected number of pages that the weights are counted on.
LABELLED_PAGES = 4_000
SEED = 5
#: The feature of places inside an element with a suspect part of a name.
SOFT = "#named"
#: Log-odds are kept within these limits; tags cost at least the least.
MOST, TAG_COST = 3.0, 0.3

# Elements of the HTML standard.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "menclose", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "mspace", "msqrt", "mstyle",
    "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics",
}
#: Elements whose words are never content.
NEVER = RAW | {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "object", "audio", "video", "canvas", "annotation", "annotation-xml"}
#: Names in class, id or role that mark an element as no content.
_NAMES = (
    r"(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|sidebar|aside|footer|masthead|notice|cookies?|consent|gdpr|"
    r"comments?|respond|replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|popup|modal|pagination|pager|widget|login|signup|toolbar|tags)"
)
WHOLE_NAME, PART_NAME = re.compile(_NAMES), re.compile(rf"(?:^|[^a-z]){_NAMES}(?:$|[^a-z])")
#: Names that tell how an element around others looks.
STATE = re.compile(r"(?:with|without|has|have|no|not|is|hide|show|fixed|sticky)[-_].*|.*[-_](?:free|open|opened|closed|on|off|enabled|disabled|active|visible|hidden|collapsed|expanded)")
#: Elements of running text, whose names say nothing of the kind; ids of sections are made from their titles.
TEXTUAL = {"html", "body", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "xmp", "blockquote", "figure", "figcaption", "math"}
#: Headers of a site, not of an article.
SITE_HEADER = re.compile(r"(?:^|[^a-z])(?<!entry-)(?<!article-)(?<!post-)(?<!content-)(?<!story-)header(?:$|[^a-z])")
#: Containers that say nothing about what they hold.
PLAIN = {"html", "body", "div", "section", "center", "table", "tbody", "thead", "tr", "td", "th"}
#: An element that is left out needs no feature; one that is not, because of what it holds, says nothing.
FEATURELESS = INLINE | PLAIN | NEVER
_CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>])*?)(?:>|\Z)|([^<]+|<)", re.S)
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"[\s\x00]+")


class Token:
    """A word run or a tag: ``text`` (None for tags), ``tag``, the features of its place, the suspects around, and flags."""

    __slots__ = ("text", "tag", "place", "suspects", "never", "labelled")

    def __init__(self, text, tag, place, suspects, labelled):
        self.text, self.tag, self.place, self.suspects, self.labelled = text, tag, place, suspects, labelled
        self.never = False


class Suspect:
    """An element that may hold no content: ``soft`` ones only lower the odds; ``fixed`` ones yield to nothing but an article in them."""

    __slots__ = ("soft", "fixed", "marked", "marks", "score")

    def __init__(self, soft, fixed, marked):
        self.soft, self.fixed, self.marked = soft, fixed, marked  # marked: inside of an article or main element
        self.marks, self.score = {"article": 0, "main": 0}, 0.0


def _suspect(name: str, rest: str, depth: int, marked: dict[str, int]) -> Suspect | None:
    if name in NEVER and name != "form":
        return Suspect(False, True, dict(marked))
    names = []
    if name not in TEXTUAL:
        for kind, *values in _NAMED.findall(rest):
            if kind.lower() != "id" or name != "section" and not depth:
                names += [x for x in "".join(values).lower().split() if not STATE.fullmatch(x)]
    if name == "form" or any(WHOLE_NAME.fullmatch(x) for x in names):
        return Suspect(False, False, dict(marked))
    if not depth and (name == "header" or any(SITE_HEADER.search(x) for x in names)):
        return Suspect(False, False, dict(marked))
    return Suspect(True, False, dict(marked)) if any(PART_NAME.search(x) for x in names) else None


def tokens(page: str, weights: Weights | None = None) -> list[Token]:
    """The tokens of a page, with what the suspects around them come to; ``weights`` tell which hold most of it."""
    marks = {"article": 0, "main": 0}
    read = list(_tokens(page, marks))
    mark = "article" if marks["article"] else "main"
    total = 0.0
    if weights is not None:
        for t in read:
            if t.text is not None and not any(x.fixed for x in t.suspects):
                score = max(0.0, weights.word(t.place, False)) * len(t.text.split())
                total += score
                for x in t.suspects:
                    x.score += score

    def cleared(x: Suspect) -> bool:
        if x.marks[mark] and marks[mark] == 1:
            return True
        if x.fixed or marks[mark] and not x.marks[mark] and not x.marked[mark]:
            return False
        return x.score > total / 2

    decided: dict[tuple[Suspect, ...], tuple[bool, bool]] = {}
    for t in read:
        if t.suspects:
            if t.suspects not in decided:
                left = [x.soft for x in t.suspects if not cleared(x)]
                decided[t.suspects] = not all(left), any(left)
            t.never, soft = decided[t.suspects]
            if soft:
                t.place += (SOFT,)
    return read


def _tokens(page: str, marks: dict[str, int]) -> Iterator[Token]:
    """Read a page from left to right; one token per tag and per run of text between tags. Counts article and main elements."""
    path: list[tuple[str, tuple[str, ...], tuple[Suspect, ...]]] = []  # name, features, suspects
    opened: Counter = Counter()  # the names on the path
    depth = 0  # of article elements

    def closed() -> str:
        gone = path.pop()[0]
        opened[gone] -= 1
        return gone

    at = 0
    while at < len(page):
        match = _TOKEN.match(page, at)
        at = match.end()
        close, name, rest, text = match.groups()
        if text is not None:
            yield Token(html.unescape(text), None, path[-1][1] if path else (), path[-1][2] if path else (), depth > 0)
            continue
        if name is None:
            continue
        name = name.lower()
        if close:
            if opened[name]:
                while path:
                    gone = closed()
                    depth -= gone == "article"
                    if gone == name:
                        break
            yield Token(None, "/" + name, path[-1][1] if path else (), path[-1][2] if path else (), depth > 0)
            continue
        while path and name not in INLINE and path[-1][0] in _CLOSED_BY.get(name, ()):
            closed()
        if name not in INLINE and opened["p"] and name in {"p", "div", "article", "section", "footer", "ul", "ol", "table", "h1", "h2", "h3", "aside", "nav", "form"}:
            # A block ends an open paragraph and the inline elements that were left open in it.
            while (gone := closed()) != "p":
                depth -= gone == "article"
        named = " ".join(a or b or c for _, a, b, c in _NAMED.findall(rest)).lower()
        suspects = path[-1][2] if path else ()
        if (suspect := _suspect(name, rest, depth, {m: opened[m] for m in marks})) is not None:
            suspects += (suspect,)
        if name in marks:
            marks[name] += 1
            for x in suspects:
                x.marks[name] += 1
        features = (path[-1][1] if path else ()) + ((name,) if name == "a" or name not in FEATURELESS else ()) + tuple(f".{x}" for x in named.split()[:8])
        yield Token(None, name, features, suspects, depth > 0)
        if name in VOID or rest.endswith("/"):
            continue
        path.append((name, features[-24:], suspects))
        opened[name] += 1
        depth += name == "article"
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
        elif name == "xmp":
            end = re.compile(r"</xmp\b", re.I).search(page, at)
            text, at = page[at : end.start() if end else len(page)], end.start() if end else len(page)
            yield Token(text, None, features, suspects, depth > 0)


def counts(page: str) -> Counter:
    """(feature, inside) counts of a labelled page; empty for others."""
    read = tokens(page)
    out: Counter = Counter()
    if sum(t.tag == "article" for t in read) != 1:
        return out
    for t in read:
        # What is passed over in any case says nothing about the rest.
        if t.never:
            continue
        if t.tag is not None:
            out[f"<{t.tag}", t.labelled] += 1
        elif n := len(t.text.split()):
            for feature in set(t.place) - {"article"}:
                out[feature, t.labelled] += n
            out["", t.labelled] += n
    return out


#: Pseudo-counts (inside, outside) that the weights start from.
START = {"": (30.0, 20.0), "p": (50.0, 5.0), "h1": (20.0, 3.0), "main": (50.0, 5.0), "article": (80.0, 2.0), "a": (2.0, 20.0), "li": (10.0, 20.0), "pre": (20.0, 1.0), "blockquote": (20.0, 1.0)}
START[SOFT] = (0.5, 60.0)
START |= {f"<{name}": (20.0, 10.0) for name in ("p", "/p", "br", "b", "h2", "h3", "blockquote", "em", "strong", "i", "/b", "/em")}


class Weights:
    """Log-odds of features and tags."""

    def __init__(self, counted: dict[tuple[str, bool], float]) -> None:
        total = {}
        for (feature, inside), n in counted.items():
            total.setdefault(feature, [0.0, 0.0])[not inside] += n
        self.odds = {}
        for feature in {*total, *START}:
            a, b = START.get(feature, (1.0, 1.0))
            x, y = total.get(feature, (0.0, 0.0))
            self.odds[feature] = max(-MOST, min(MOST, math.log((a + x + 1) / (b + y + 1))))

    def word(self, place: tuple[str, ...], never: bool) -> float:
        """Score of one word at a place: the mean of the two most telling features.

        Words that are left out of the text in any case neither help nor part a region.
        """
        if never:
            return 0.0
        known = sorted((self.odds[f] for f in place if f in self.odds), key=abs, reverse=True)[:2]
        return sum(known) / len(known) if known else max(-0.5, min(0.5, self.odds[""]))

    def tag(self, name: str) -> float:
        return -TAG_COST - max(0.0, -self.odds.get(f"<{name}", 0.0)) / MOST


def extract(page: str | None, weights: Weights) -> str:
    """The text of the best region of a page."""
    if not page:
        return ""
    read = tokens(page, weights)
    best, best_span, total, begin = 0.0, (0, 0), 0.0, 0
    for i, t in enumerate(read):
        if t.never:
            continue
        total += weights.tag(t.tag) if t.tag is not None else weights.word(t.place, t.never) * len(t.text.split())
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, best_span = total, (begin, i + 1)
    blocks: list[list[str]] = [[]]
    for t in read[slice(*best_span)]:
        if t.tag is not None:
            if t.tag.lstrip("/") not in INLINE:
                blocks.append([])
        elif not t.never:
            blocks[-1].append(t.text)
    return "\n".join(x for x in (_SPACE.sub(" ", "".join(b)).strip() for b in blocks) if x)


def learn(pages: DataFrame, column: str = "html", key: str = "page_id", sample: int = LABELLED_PAGES) -> Weights:
    """Count features over a sample of the pages; the sums, one row per feature seen there, go to the driver."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(key)), 11) / F.lit(float(1 << 53))
    some = pages.where(draw < sample / max(1, pages.count())).select(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: Counter = Counter()
            for page in batch.column(0).to_pylist():
                out.update(counts(page or ""))
            yield pa.RecordBatch.from_pydict({"feature": [f for f, _ in out], "inside": [i for _, i in out], "n": [float(n) for n in out.values()]}, schema=pa.schema([("feature", pa.string()), ("inside", pa.bool_()), ("n", pa.float64())]))

    summed = some.mapInArrow(run, "feature string, inside boolean, n double").groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    return Weights({(r.feature, r.inside): r.n for r in summed.collect()})


def main_text(pages: DataFrame, weights: Weights, column: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars``."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    others = [c for c in pages.columns if c != column]
    if clash := {c.lower() for c in others} & {"text", "n_chars"}:
        raise ValueError(f"Columns have the names of results: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = [extract(page, shared.value) for page in part.column(names.index(column)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in others), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*others, "text", "n_chars"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != column]
    return pages.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
