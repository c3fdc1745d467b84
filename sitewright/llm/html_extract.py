"""Main text of web pages by tag-path ratios.

A page's text is cut into segments, each with its root-to-leaf path of elements. Per path,
text length and punctuation are aggregated over its segments, with link text counting little;
both, and the share of text that is no menu, are smoothed along the page between similar
paths and fused into one ratio. Marks of content (``article``, ``main``) and names of
boilerplate (menus, notices, forms, comments) scale a path's ratio as evidence. Paths whose
ratio reaches a threshold are content; the elements that hold them are content nodes, whose
other paths follow unless they are menus or named boilerplate.

The page is read in one forward pass, paths are nodes of a tree that is built on the way, and
open elements are found by tag, so time and memory grow with the page, however deep or broken
its markup is. As in browsers, a tag that no ``>`` ends runs to the end of the page, and a
quote that nothing closes ends with its tag.

Results by case: a null or empty page, or one without content, gives an empty text; null ids
and urls stay null; repeated rows are extracted each; other columns are not carried; an
empty table gives an empty result. White space is what ``str.split`` takes as such.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text: to the end of the page if open, or only if closed.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("noscript template svg math object canvas audio video select datalist".split())
#: Void elements, and elements that stay inside a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var br img wbr".split())
#: Elements that end an open paragraph, and those that end an open one of the same kind.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul dd dt".split())
CLOSES_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div body".split())
#: Elements within a content node that hold no section of their own, and headings.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th section hgroup details summary address center".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
LISTS = frozenset(("ul", "ol", "dl", "table"))
CONTENT_TAGS = frozenset(("article", "main"))
#: What names boilerplate: elements, words of classes, ids and roles, and words that say nothing beside them.
BOILER_TAGS = frozenset("head nav header footer aside form button menu dialog".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " sidebar aside header masthead footer copyright comment comments commentlist disqus respond reply replies notice notices alert cookie cookies consent gdpr"
    " popup modal overlay share sharing social related recommended newsletter subscribe signup login search searchbox pagination pager toolbar widget widgets skip hidden complementary".split()
)
GENERIC_WORDS = frozenset("site page list box wrap wrapper container area block section inner outer bar top bottom left right main global primary secondary item items links link button buttons form text content contentinfo thread form icons icon group row col column unit slot the a of and".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: A tag with quoted values, and one that ends at the first sign that can end it.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMED = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.IGNORECASE)
HREF = re.compile(r"\bhref\b", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: What evidence makes of a ratio: named boilerplate, names with other words, text outside a page's marks.
NAMED_BOILER, HALF_NAMED, UNMARKED = 0.001, 0.7, 0.05
#: The part of a page's plain text from which its marks are believed.
MARKS_HOLD = 1 / 3
#: What a link's character counts for at least (in paragraphs and headings, which seldom are
#: menus, and elsewhere) and at most (with PUNCTUATED marks a segment).
PROSE_LINK, LINK_LEAST, LINK_MOST, PUNCTUATED = 0.4, 0.1, 0.5, 2
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Share of the mean ratio that passes, and share of text that is no menu.
PASS, PLAIN = 0.6, 0.35
#: Weights along the page, by distance.
SMOOTH = ((-2, 0.14), (-1, 0.6), (0, 1.0), (1, 0.6), (2, 0.14))


@dataclass
class Paths:
    """The tree of paths; its nodes are numbered from 0, the root."""

    known: dict[tuple[int, str], int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    own: list[float] = field(default_factory=lambda: [1.0])  # what the element's own names say
    evidence: list[float] = field(default_factory=lambda: [1.0])  # with those above it, once settled
    mark: list[int] = field(default_factory=lambda: [-1])  # the outermost marked element above or at the node, alike

    def below(self, parent: int, tag: str, label: str, evidence: float) -> int:
        found = self.known.get((parent, label))
        if found is None:
            found = self.known[parent, label] = len(self.parent)
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            self.tag.append(tag)
            self.own.append(evidence)
        return found

    def settle(self, segments: list[Segment]) -> None:
        """Evidence and marks of all paths, from the root down.

        A form that holds much of the page's plain text is the page's frame, no form of it.
        """
        plain = [0] * len(self.parent)
        for s in segments:
            plain[s.path] += max(0, s.size - s.linked)
        for p in range(len(plain) - 1, 0, -1):  # a node's number is above its parent's
            plain[self.parent[p]] += plain[p]
        for p in range(1, len(plain)):
            above, tag, own = self.parent[p], self.tag[p], self.own[p]
            # A title block inside the content is no site header.
            frame = tag == "header" and self.mark[above] >= 0 or tag == "form" and plain[p] and plain[p] >= MARKS_HOLD * plain[0]
            own = NAMED_BOILER if tag in BOILER_TAGS and not frame else own
            self.evidence.append(min(own, self.evidence[above]))
            self.mark.append(self.mark[above] if self.mark[above] >= 0 or tag not in CONTENT_TAGS or own < 1 else p)

    def alike(self, a: int, b: int) -> float:
        """Shared root part of two paths; the walk is as long as what lies between them."""
        deepest = max(self.depth[a], self.depth[b], 1)
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.parent[a]
        return self.depth[a] / deepest


@dataclass
class Segment:
    block: int
    path: int
    raw: str
    size: int  # characters, white space folded
    linked: int  # of them in links
    marks: int


def folded(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


def named(names: list[str]) -> float:
    """What an element's names say: 1, or the evidence of boilerplate."""
    found = 1.0
    for name in names:
        words = [w.lower() for w in WORD.findall(name)]
        telling = [w for w in words if w not in GENERIC_WORDS and not w.isdigit()]
        hits = sum(w in BOILER_WORDS for w in telling)
        if hits:
            found = min(found, NAMED_BOILER if hits == len(telling) else HALF_NAMED)
    return found


class Reader:
    """One page's segments, in one forward pass."""

    def __init__(self, page: str):
        self.page, self.paths, self.segments = page, Paths(), []
        self.open_: list[tuple[str, int]] = []  # tag, path
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements, by tag
        self.inline: list[tuple[str, int]] = []  # open inline elements that name boilerplate
        self.parts: list[str] = []
        self.links: list[str] = []
        self.anchor = -1  # open elements around an open link
        self.block, self.lists = 0, 0

    def cut(self) -> None:
        """End a segment."""
        if self.parts:
            raw = "".join(self.parts)
            text = folded(raw)
            if text:
                path = self.inline[-1][1] if self.inline else self.open_[-1][1] if self.open_ else 0
                self.segments.append(Segment(self.block, path, raw, len(text), sum(len(folded(x)) for x in self.links), len(PUNCTUATION.findall(text))))
            self.parts, self.links = [], []

    def flush(self) -> None:
        """End a block."""
        self.cut()
        self.inline.clear()
        self.block += 1

    def close(self, tags: tuple[str, ...], bounds: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of one of the tags, if no bound lies within it."""
        last = lambda ts: max((self.places[t][-1] for t in ts if self.places.get(t)), default=-1)
        at = last(tags)
        if at < 0 or last(bounds) > at:
            return
        self.flush()
        for tag, _ in self.open_[at:]:
            self.places[tag].pop()
        del self.open_[at:]
        if self.anchor > at:
            self.anchor = -1

    def start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self.close(("p",), SCOPES)
        if tag in CLOSES_OWN:
            self.close(CLOSES_OWN[tag], SCOPES - {tag})
        if tag in VOID or (tag in ("html", "body") and self.places.get(tag)):
            return
        evidence, label = self.named(tag, attributes)
        if tag in LISTS:  # a list may be a menu and the next one not
            self.lists += 1
            label += f"#{self.lists}"
        parent = self.open_[-1][1] if self.open_ else 0
        self.places[tag].append(len(self.open_))
        self.open_.append((tag, self.paths.below(parent, tag, label, evidence)))

    def named(self, tag: str, attributes: str) -> tuple[float, str]:
        """An element's evidence and its label in paths: the tag and its classes."""
        if not attributes or tag in ("html", "body"):
            return 1.0, tag
        names = [(m[0].lower(), x) for m in NAMED.findall(attributes) for x in (m[1] or m[2] or m[3]).split()]
        if tag in PROSE:  # an anchor's name says what is written there, not what it is
            names = [n for n in names if n[0] != "id"]
        evidence = named([x for _, x in names])
        if tag in CONTENT_TAGS and not any(w.lower().startswith(("comment", "repl")) for _, x in names for w in WORD.findall(x)):
            evidence = 1.0
        return evidence, ".".join([tag, *sorted(x for k, x in names if k == "class")])

    def inside(self, tag: str, end: bool, attributes: str) -> None:
        """A tag that stays inside its block."""
        if tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.anchor = len(self.open_) if not end and HREF.search(attributes) else -1
        if end and self.inline and self.inline[-1][0] == tag:
            self.cut()
            self.inline.pop()
        elif not end and tag not in VOID and attributes:
            evidence, label = self.named(tag, attributes)
            if evidence == NAMED_BOILER or tag in BOILER_TAGS:
                self.cut()
                parent = self.inline[-1][1] if self.inline else self.open_[-1][1] if self.open_ else 0
                self.inline.append((tag, self.paths.below(parent, tag, label, evidence)))

    def text(self, a: int, b: int) -> None:
        if b > a:
            self.parts.append(self.page[a:b])
            if self.anchor >= 0:
                self.links.append(self.parts[-1])

    def read(self) -> Reader:
        page, at, scan, pattern = self.page, 0, 0, TAG
        unclosed: set[str] = set()
        while True:
            i = page.find("<", scan)
            sign = page[i + 1 : i + 2] if i >= 0 else ""
            if i < 0 or not sign:
                self.text(at, len(page))
                break
            if sign in "!?":
                self.text(at, i)
                ends = "-->" if page.startswith("<!--", i) else "]]>" if page.startswith("<![CDATA[", i) else ">"
                j = page.find(ends, i + 2)
                at = scan = len(page) if j < 0 else j + len(ends)
                continue
            if not (sign.isascii() and sign.isalpha()) and not (sign == "/" and page[i + 2 : i + 3].isalpha()):
                scan = i + 1  # a sign of the text
                continue
            self.text(at, i)
            m = pattern.match(page, i)
            if m is None and pattern is TAG:  # quotes swallow the rest of the page: they end no more
                pattern = BARE_TAG
                m = pattern.match(page, i)
            if m is None:
                break  # an unfinished tag at the page's end
            at = scan = m.end()
            end, tag, attributes = m[1] == "/", m[2].lower(), m[3]
            if tag in RAW or tag in SKIPPED:
                if not end and not attributes.endswith("/") and tag not in unclosed:
                    over = re.compile(rf"</{tag}\b[^>]*+>", re.IGNORECASE).search(page, at)
                    if over is None:
                        unclosed.add(tag)
                    at = scan = over.end() if over else len(page) if tag in RAW else at
            elif tag in INLINE:
                self.inside(tag, end, attributes)
            elif end:
                self.close((tag,))
                self.flush()
            else:
                self.flush()
                self.start(tag, attributes)
        self.flush()
        return self


def path_ratios(segments: list[Segment], paths: Paths) -> tuple[dict[int, float], dict[int, float]]:
    """Of each path: the ratio fused of text length and punctuation, scaled by evidence, and the share of text that is no menu."""
    size, linked, marks, count = (defaultdict(float) for _ in range(4))
    for s in segments:
        size[s.path] += s.size
        linked[s.path] += min(s.linked, s.size)
        marks[s.path] += s.marks
        count[s.path] += 1
    own = {}
    for p, n in count.items():
        a_link = PROSE_LINK if paths.tag[p] in PROSE else LINK_LEAST
        a_link += (LINK_MOST - a_link) * min(1, marks[p] / (PUNCTUATED * n))
        plain = (size[p] - linked[p] + a_link * linked[p]) / size[p]
        own[p] = (plain * size[p] / n, plain * marks[p] / n, plain)
    total, weight = {p: [0.0, 0.0, 0.0] for p in own}, dict.fromkeys(own, 0.0)
    for k, s in enumerate(segments):
        sums = total[s.path]
        for step, w in SMOOTH:
            if 0 <= k + step < len(segments):
                other = segments[k + step].path
                w *= paths.alike(s.path, other) ** 2 if other != s.path else 1
                weight[s.path] += w
                for i, x in enumerate(own[other]):
                    sums[i] += w * x
    ratio, plain = {}, {}
    for p, (length, punctuation, share) in total.items():
        w = weight[p]
        ratio[p] = paths.evidence[p] * (length / w) * math.log1p(punctuation / w)
        plain[p] = share / w
    return ratio, plain


def outside_marks(segments: list[Segment], paths: Paths) -> float:
    """The evidence for text outside a page's marks: none where they hold little of its text."""
    plain = [(s.size - s.linked, paths.mark[s.path] >= 0) for s in segments if paths.evidence[s.path] > NAMED_BOILER]
    inside = sum(n for n, marked in plain if marked)
    return UNMARKED if inside and inside >= MARKS_HOLD * sum(n for n, _ in plain) else 1.0


def content_of(segments: list[Segment], paths: Paths) -> list[Segment]:
    """The segments that make up a page's main text."""
    paths.settle(segments)
    outside = outside_marks(segments, paths)
    paths.evidence = [e if m >= 0 else e * outside for e, m in zip(paths.evidence, paths.mark, strict=True)]
    ratio, plain = path_ratios(segments, paths)
    mass = [(s.size, ratio[s.path]) for s in segments if paths.evidence[s.path] > UNMARKED]
    if not mass:
        return []
    least = PASS * sum(n * r for n, r in mass) / sum(n for n, _ in mass)
    strong = {p for p in ratio if plain[p] >= PLAIN and ratio[p] >= least}
    nodes = set()
    for p in strong:
        node = p if paths.mark[p] < 0 else paths.mark[p]
        while paths.mark[p] < 0 and node and (node == p or paths.tag[node] in TEXTUAL):
            node = paths.parent[node]
        nodes.add(node)
    # Down the tree (a node's number is above its parent's): within a content node or not.
    within = [0] * len(paths.parent)  # 1 if so, 2 if only as far as elements hold no section
    for p in range(len(within)):
        if p in nodes:
            within[p] = 2 if paths.tag[p] in ("", "html", "body") else 1
        elif p and (above := within[paths.parent[p]]):
            within[p] = 1 if above == 1 else 2 if paths.tag[p] in TEXTUAL or paths.tag[p] in INLINE else 0
    chosen = [s.path in strong or bool(within[s.path] and plain[s.path] >= PLAIN and paths.evidence[s.path] >= HALF_NAMED) for s in segments]
    if outside == 1:  # a title may stand before the node
        for k in range(len(segments) - 2, -1, -1):
            s = segments[k]
            if chosen[k + 1] and not chosen[k] and paths.tag[s.path] in HEADINGS and plain[s.path] >= PLAIN and paths.evidence[s.path] > HALF_NAMED:
                chosen[k] = True
    return [s for s, c in zip(segments, chosen, strict=True) if c]


def main_text(page: str | None) -> str:
    """The main text of one page, blocks joined by an empty line."""
    if not page:
        return ""
    reader = Reader(page).read()
    blocks: dict[int, str] = {}
    for s in content_of(reader.segments, reader.paths):
        blocks[s.block] = blocks.get(s.block, "") + s.raw
    return "\n\n".join(map(folded, blocks.values()))


def extract(df: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns and ``text`` of each page; one narrow pass, a page at a time."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], names=[*keep, "text"])

    return df.select(*keep, F.col(html_col).cast("string").alias("__html")).mapInArrow(run, schema)
