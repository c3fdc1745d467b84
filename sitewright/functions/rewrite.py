"""URL rewriting inside columns of text, markup, CSS, JSON, serialized and shortcode values.

``rewrite_column`` is the job: a native test picks the rows that may hold a source address,
and only those pass through an Arrow-batched UDF whose helpers below edit spans of the
original text. A format's own parser finds its strings, each string goes back through
``Rewriter.value``, and the format is written again around it, so nested formats keep their
lengths and escapes. Values deeper than DEPTH stay as they are.
"""

from __future__ import annotations

import base64
import html
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions.values import may_contain_url
from sitewright.operators.tree import longest_prefix
from sitewright.shared import materialize

#: Nested calls, and nesting of serialized values, beyond which a value stays as it is.
DEPTH, SERIAL_DEPTH = 16, 512
#: Backslashes before a separator that still count as its spelling, and what may end a base (fixed
#: by the text formats that are recognised).
MOST_BACKSLASHES = 8
ENDS = frozenset(" \t\r\n,!;)]}<>\"'`")
#: What a base cannot follow: it would be a part of a longer name or path.
JOINS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+\\/@-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
TARGET_PATH = re.compile(r"(?:/[A-Za-z0-9_:-]+)*")
NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F]*|[0-9]+)\Z")


def host_fits(host: str) -> bool:
    """Whether a host can stand in text of unknown escaping; one that ends in a number must be an address."""
    labels = host.rstrip(".").split(".")
    return host.isascii() and ":" not in host and (not NUMBER.match(labels[-1]) or (len(labels) <= 4 and all(map(NUMBER.match, labels))))


class Rule:
    """One mapping; ``ok`` if both sides can be told and written in text."""

    def __init__(self, source: str, target: str):
        s, t = urlsplit(source), urlsplit(target)
        self.source, self.target = source, target
        self.scheme, self.host, self.path = s.scheme.lower(), s.netloc.lower(), s.path.rstrip("/")
        self.base = s.netloc + self.path
        self.same = source == target
        self.to_scheme, self.to_host, self.to_port = t.scheme.lower(), t.hostname or "", t.port
        self.to_path = self.path if self.same else t.path.removesuffix("/")
        plain = all(not (u.query or u.fragment or "@" in u.netloc) for u in (s, t)) and s.scheme and s.netloc and t.netloc
        spelt = self.base.isascii() and not re.search(r"[\s\x00-\x1f\x7f]", self.base)
        self.ok = bool(plain and spelt and (self.same or (TARGET_PATH.fullmatch(self.to_path) and host_fits(self.to_host))))


def backslashes(text: str, at: int) -> int:
    """How many stand right before a place (one more than count if there are more)."""
    n = 0
    while n <= MOST_BACKSLASHES and at > n and text[at - n - 1] == "\\":
        n += 1
    return n


def spelt_slash(text: str, at: int) -> int:
    """The length of a slash with its backslashes at a place, 0 if there is none."""
    n = at
    while n < len(text) and text[n] == "\\" and n - at <= MOST_BACKSLASHES:
        n += 1
    return n + 1 - at if n < len(text) and text[n] == "/" and n - at <= MOST_BACKSLASHES else 0


def ends_base(text: str, at: int) -> bool:
    """Whether a base may end at a place: at a separator, a delimiter, or a sentence's full stops."""
    if at < len(text) and text[at] == ".":
        while at < len(text) and text[at] == ".":
            at += 1
        return at == len(text) or text[at] in ENDS
    return at == len(text) or text[at] in "/?#" or text[at] in ENDS or spelt_slash(text, at) > 0


@dataclass(frozen=True)
class Opening:
    """What stands before a host: its scheme with the colon's spelling, and its slashes' spelling."""

    start: int
    scheme: str = ""
    colon: str = ""
    slash: str = ""


def opening(text: str, host: int) -> Opening | None:
    """The opening of a URL whose host starts at a place; None if that is no start of one."""
    at = host
    if at and text[at - 1] == "@":  # user information, which only slashes may precede
        at -= 1
        while at and not text[at - 1].isspace() and text[at - 1] not in "<>@/\\":
            at -= 1
        if at == host - 1 or not at or text[at - 1] != "/":
            return None
    if not at or text[at - 1] != "/":
        return None if at and text[at - 1] in JOINS else Opening(at)
    escape = backslashes(text, at - 1)
    first = at - 1 - escape  # past the first slash, which is spelt as the second
    if escape > MOST_BACKSLASHES or not first or text[first - 1] != "/" or backslashes(text, first - 1) != escape:
        return None
    start, slash = first - 1 - escape, "\\" * escape + "/"
    if not start or text[start - 1] != ":":
        return None if start and text[start - 1] in JOINS else Opening(start, slash=slash)
    escape = backslashes(text, start - 1)
    word = end = start - 1 - escape
    while word and text[word - 1] in SCHEME:
        word -= 1
    if escape > MOST_BACKSLASHES or word == end or (word and text[word - 1] in JOINS):
        return None
    return Opening(word, text[word:end], "\\" * escape + ":", slash)


class Bases:
    """The rules' source bases: hosts found by one search, then path segments looked up in a tree."""

    def __init__(self, rules: list[Rule]):
        self.hosts: dict[str, dict] = {}
        for rule in rules:
            node = self.hosts.setdefault(rule.host, {"next": {}, "rules": []})
            for segment in rule.path.split("/")[1:]:
                node = node["next"].setdefault(segment, {"next": {}, "rules": []})
            node["rules"].append(rule)
        spelt = sorted(map(re.escape, self.hosts), key=len, reverse=True)
        self.search = re.compile("|".join(spelt), re.IGNORECASE | re.ASCII).search if spelt else lambda text, at: None

    def paths(self, text: str, at: int, node: dict, slash: str = "") -> Iterator[tuple[list[Rule], int, str]]:
        """Rules whose base goes on at a place, longest first: with its end and its first slash."""
        if node["next"] and (n := spelt_slash(text, at)):
            for size in sorted({len(s) for s in node["next"]}, reverse=True):
                below = node["next"].get(text[at + n : at + n + size])
                if below is not None:
                    yield from self.paths(text, at + n + size, below, slash or text[at : at + n])
        yield node["rules"], at, slash

    def found(self, text: str) -> Iterator[tuple[Rule, Opening, int, int, str]]:
        """The bases in a text, in order: rule, opening, the base's bounds and the slash to write."""
        at = 0
        while (hit := self.search(text, at)) is not None:
            at = hit.start() + 1
            before = opening(text, hit.start())
            if before is None:
                continue
            for rules, end, inner in self.paths(text, hit.end(), self.hosts[hit[0].lower()]):
                fits = next((r for r in rules if before.scheme.lower() in ("", r.scheme)), None)
                if fits is None or not ends_base(text, end):
                    continue
                slash = before.slash or inner
                if fits.to_path and not slash:  # a new slash is spelt as one that is there
                    if not (n := spelt_slash(text, end)):
                        continue
                    slash = text[end : end + n]
                yield fits, before, hit.start(), end, slash or "/"
                at = end
                break


def spliced(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, new in sorted(edits):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


# Attributes that hold URLs, by element, and those that hold lists of them.
URL_ATTRIBUTES = {
    "a": "href", "applet": "codebase", "area": "href", "audio": "src", "base": "href", "blockquote": "cite", "body": "background", "button": "formaction", "command": "icon",
    "del": "cite", "embed": "src", "form": "action", "frame": "longdesc src", "head": "profile", "html": "manifest", "iframe": "longdesc src", "image": "href",
    "img": "longdesc src usemap lowsrc highsrc", "input": "src usemap formaction", "ins": "cite", "link": "href", "object": "classid codebase data usemap", "q": "cite",
    "script": "src", "source": "src", "track": "src", "video": "poster src",
}
URL_LISTS = {"applet": "archive", "img": "srcset", "source": "srcset", "object": "archive"}
#: A tag with quoted values, and one that ends at the first sign that can end it.
TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
BARE_TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>[^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]++)(\s*+=\s*+)(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>`]++))")


def tags_of(text: str) -> Iterator[tuple[int, int, str | None, re.Match | None]]:
    """Comments (start, end, inner text) and tags (start, end, match) of markup, in one pass."""
    at, pattern, comments = 0, TAG, True
    while (at := text.find("<", at)) >= 0:
        if comments and text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            comments = end >= 0
            if comments:
                yield at, end + 3, text[at + 4 : end], None
                at = end + 3
                continue
        after = text[at + 1 : at + 3]
        m = None
        if after[:1].isalpha() or (after[:1] == "/" and after[1:].isalpha()):
            m = pattern.match(text, at)
            if m is None and after[:1].isascii() and after.isascii():
                pattern = BARE_TAG  # quotes swallow the rest: from here on they end no more
                m = pattern.match(text, at)
                if m is None and text.find(">", at) < 0:
                    return
        if m is None:
            at += 1
            continue
        yield at, m.end(), None, m
        at = m.end()


CSS_URL = re.compile(r"url\(\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"')\s]*))\s*\)|@import\s+(?:\"([^\"]*)\"|'([^']*)')|(image-set\()", re.IGNORECASE)
#: Within an image set: its candidates, and what opens or closes a bracket.
CSS_CANDIDATE = re.compile(r"url\(\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"')\s]*))\s*\)|\"([^\"]*)\"|'([^']*)'|(\()|(\))", re.IGNORECASE)
TYPED = re.compile(r"type\(\s*$", re.IGNORECASE)
JSON_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*"')
COLON = re.compile(r"\s*:")
BLOCK = re.compile(r"(\s*/?wp:[a-z][a-z0-9/_-]*\s+)(\{.*\})(\s*/?\s*)", re.DOTALL)
SHORTCODE = re.compile(r"\[(?P<tag>[A-Za-z][\w-]*+)(?P<attrs>(?:[^\[\]\"']++|\"[^\"\[\]]*+\"|'[^'\[\]]*+'|[\"'])*+)\]")
TABLE_CELL, CELL_STYLE, PERCENT = re.compile(r"[^,|]+"), re.compile(r"(?:\[[^\]\r\n]*\])*"), re.compile(r"%[0-9A-Fa-f]{2}")
SHORTCODE_ATTRIBUTE = re.compile(r"([\w-]+)=(\"([^\"]*)\"|'([^']*)')")
SERIAL_SCALAR = re.compile(rb"N;|b:[01];|i:[+-]?\d+;|d:[^;]+;|[rR]:\d+;")
SERIAL_STRING, SERIAL_CLASS = re.compile(rb"s:(\d+):\""), re.compile(rb"\":(\d+):\{")
SERIAL_OPEN = re.compile(rb"a:(\d+):\{|O:(\d+):\"")
#: Values whose inside is opaque: a custom class's, by its length, and an enumeration's case.
SERIAL_CUSTOM, SERIAL_CASE = re.compile(rb"C:(\d+):\""), re.compile(rb"E:(\d+):\"")


def b64_codec(change: Callable[[str], str], text: str) -> str:
    """Base64 of percent-encoded or plain text; what does not read as either stays."""
    try:
        inner = base64.b64decode(text.strip(), validate=True).decode()
    except ValueError:
        return text
    coded = "%3C" in inner or "%3A" in inner
    plain = unquote(inner) if coded else inner
    new = change(plain)
    return text if new == plain else base64.b64encode((quote(new, safe="!~*'()") if coded else new).encode()).decode()


def percent_codec(change: Callable[[str], str], text: str) -> str:
    plain = unquote(text)
    new = change(plain)
    return text if new == plain else quote(new, safe="!~*'(),;")


def table_codec(change: Callable[[str], str], text: str) -> str:
    """Percent-encoded cells between commas and bars, each behind its style markers."""

    def cell(m: re.Match) -> str:
        style = CELL_STYLE.match(m[0]).end()
        coded = m[0][style:]
        new = change(unquote(coded)) if PERCENT.search(coded) else None
        return m[0] if new is None or new == unquote(coded) else m[0][:style] + quote(new, safe="!~*'()")

    return TABLE_CELL.sub(cell, text)


def link_codec(change: Callable[[str], str], text: str) -> str:
    """Pipe-delimited fields with percent-encoded values."""
    fields = [f.split(":", 1) for f in text.split("|")]
    return "|".join(f"{f[0]}:{percent_codec(change, f[1]) if f[0] == 'url' else f[1]}" if len(f) > 1 else f[0] for f in fields)


def safe_codec(change: Callable[[str], str], text: str) -> str:
    return "#E-8_" + b64_codec(change, text[5:]) if text.startswith("#E-8_") else change(text)


Codec = Callable[[Callable[[str], str], str], str]
# Known encoded bodies ("") and attributes, by tag; callers add their own.
CODECS: dict[str, dict[str, Codec]] = {
    "vc_table": {"": table_codec}, "vc_raw_html": {"": b64_codec}, "vc_raw_js": {"": b64_codec},
    "vc_btn": {"link": link_codec, "url": link_codec}, "vc_button2": {"link": link_codec, "url": link_codec}, "vc_cta_button2": {"link": link_codec},
    "vc_custom_heading": {"link": link_codec, "url": link_codec}, "vc_gallery": {"custom_links": safe_codec, "custom_srcs": safe_codec}, "vc_gmaps": {"link": safe_codec},
    "vc_gitem_image": {"url": link_codec}, "vc_gitem_zone": {"url": link_codec}, "vc_gitem_zone_a": {"url": link_codec}, "vc_gitem_zone_b": {"url": link_codec},
    "vc_icon": {"link": link_codec, "url": link_codec}, "vc_images_carousel": {"custom_links": safe_codec}, "vc_posts_slider": {"custom_links": safe_codec},
    "vc_single_image": {"url": link_codec},
}


def is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


class Rewriter:
    """A mapping's rules, longest source first, over each format."""

    def __init__(self, mapping: dict[str, str], base: str | None = None, codecs: dict[str, dict[str, Codec]] | None = None, children: dict[str, frozenset[str]] | None = None):
        rules = sorted((Rule(s, t) for s, t in mapping.items()), key=lambda r: -len(r.base))
        self.rules, self.base = [r for r in rules if r.ok], base
        self.bases = Bases(self.rules)
        self.codecs = CODECS if codecs is None else CODECS | codecs
        self.children = children or {}

    def text(self, text: str) -> str:
        """Source bases in text of unknown escaping, each by the longest rule that it spells."""
        edits = []
        for rule, before, start, end, slash in self.bases.found(text):
            if rule.same or rule.host in self.children:
                continue
            colon = before.colon or ":"
            if before.scheme and before.scheme.lower() != rule.to_scheme:
                edits.append((before.start, before.start + len(before.scheme), rule.to_scheme))
            port = "" if rule.to_port is None else f"{colon}{rule.to_port}"
            path = "".join(slash if c == "/" else colon if c == ":" else c for c in rule.to_path)
            edits.append((start, end, rule.to_host + port + path))
        return spliced(text, edits) if edits else text

    def url(self, url: str, base: str | None = None) -> str:
        """One declared URL: page-relative ones stay, root-relative ones resolve on the base."""
        bare = url.strip("".join(map(chr, range(33))))
        if not bare or bare[0] in "#?" or not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|[/\\]", bare):
            return url
        base = base or self.base
        absolute = re.match(r"https?://", bare, re.IGNORECASE) is not None
        full = bare if absolute else urljoin(base, bare) if base else bare
        parts = urlsplit(full)
        host = parts.netloc.rpartition("@")[2].lower()
        for rule in self.rules:
            under = parts.path == rule.path or parts.path.startswith(rule.path + "/") or not rule.path
            if host != rule.host or not under or (absolute and parts.scheme.lower() != rule.scheme):
                continue
            path = unquote(parts.path).lower().rstrip("/")
            if rule.same or any(path == c or path.startswith(c + "/") for c in self.children.get(host, ())):
                return url
            if absolute:
                return self.text(url) if host not in self.children else f"{rule.target.removesuffix('/')}{full[full.index(parts.netloc) + len(parts.netloc) + len(rule.path) :]}"
            if bare.startswith("//"):
                return self.text(url)
            return rule.to_path + bare[len(rule.path) :]
        return url

    def css(self, text: str, depth: int = 0) -> str:
        edits: list[tuple[int, int, str]] = []

        def change(m: re.Match, groups: range) -> None:
            k = next((g for g in groups if m[g]), 0)
            if k and not m[k].lower().startswith("data:"):
                edits.append((m.start(k), m.end(k), self.url(m[k]) if "\\" not in m[k] else self.text(m[k])))

        at = 0
        while (m := CSS_URL.search(text, at)) is not None:
            at = m.end()
            if m[6] is None:
                change(m, range(1, 6))
                continue
            open_ = 1  # brackets of an image set; its strings and url()s are its candidates
            while open_ and (c := CSS_CANDIDATE.search(text, at)) is not None:
                typed = c[4] is not None or c[5] is not None
                if not (typed and TYPED.search(text, max(0, c.start() - 16), c.start())):
                    change(c, range(1, 6))
                open_ += (c[6] is not None) - (c[7] is not None)
                at = c.end()
            if open_:
                break  # it never ends
        return spliced(text, edits)

    def json(self, text: str, depth: int = 0, dumps: Callable[[str], str] = json.dumps, hint: str | None = None) -> str:
        """String values (not keys) of a JSON document, each by the hint; malformed text stays."""
        if not is_json(text):
            return text
        edits = []
        for m in JSON_STRING.finditer(text):
            if COLON.match(text, m.end()):
                continue  # a key
            old = json.loads(m[0])
            new = self.value(old, hint, depth + 1)
            if new != old:
                coded = dumps(new)
                if '\\"' not in m[0]:
                    coded = coded.replace('\\"', "\\u0022") if dumps is not json.dumps else coded
                edits.append((m.start(), m.end(), coded.replace("/", "\\/") if "\\/" in m[0] else coded))
        return spliced(text, edits)

    def serialized(self, raw: bytes, depth: int = 0, hint: str | None = None) -> bytes | None:
        """String values (not keys) of a serialized value with their byte lengths; None if malformed.

        What a class serialized in its own way is opaque and stays.
        """
        out, at = [], 0
        stack: list[list] = [[1, False]]  # values still to come, whether a key is next
        while stack:
            top = stack[-1]
            if top[0] == 0 and len(stack) > 1:
                if raw[at : at + 1] != b"}":
                    return None
                out.append(b"}")
                at += 1
                stack.pop()
                continue
            if top[0] == 0:
                break
            key = top[1]
            if m := SERIAL_SCALAR.match(raw, at):
                out.append(m[0])
                at = m.end()
            elif m := SERIAL_STRING.match(raw, at):
                end = m.end() + int(m[1])
                body = raw[m.end() : end]
                if len(body) != int(m[1]) or raw[end : end + 2] != b'";':
                    return None
                if not key:
                    body = self.value(body.decode("utf-8", "surrogateescape"), hint, depth + 1).encode("utf-8", "surrogateescape")
                out.append(b's:%d:"%s";' % (len(body), body))
                at = end + 2
            elif not key and (m := SERIAL_CUSTOM.match(raw, at)):
                size = SERIAL_CLASS.match(raw, m.end() + int(m[1]))
                end = size.end() + int(size[1]) if size else len(raw)
                if raw[end : end + 1] != b"}":
                    return None
                out.append(raw[at : end + 1])
                at = end + 1
            elif not key and (m := SERIAL_CASE.match(raw, at)):
                end = m.end() + int(m[1])
                if raw[end : end + 2] != b'";':
                    return None
                out.append(raw[at : end + 2])
                at = end + 2
            elif not key and (m := SERIAL_OPEN.match(raw, at)):
                head, count = m.end(), m[1]
                if m[2] is not None:
                    more = SERIAL_CLASS.match(raw, m.end() + int(m[2]))
                    if more is None:
                        return None
                    head, count = more.end(), more[1]
                if len(stack) > SERIAL_DEPTH:
                    return raw  # beyond the nesting limit the whole value stays
                out.append(raw[at:head])
                at = head
                top[0], top[1] = top[0] - 1, len(stack) > 1  # after a container's value comes a key
                stack.append([2 * int(count), True])
                continue
            else:
                return None
            top[0], top[1] = top[0] - 1, len(stack) > 1 and not key
        return b"".join(out) if at == len(raw) else None

    def blocks(self, comment: str, depth: int) -> str:
        """A block comment's attribute tree, with the escapes that keep it a comment."""
        m = BLOCK.fullmatch(comment)
        if m is None:
            return comment

        def dumps(s: str) -> str:
            coded = json.dumps(s, ensure_ascii=False)
            return reduce(lambda t, e: t.replace(*e), (("--", "\\u002d\\u002d"), ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")), coded)

        return m[1] + self.json(m[2], depth, dumps, "markup") + m[3]

    def shortcodes(self, text: str, depth: int = 0) -> str:
        """Known encoded bodies and attributes; other attributes are left to the text pass."""

        out, at = [], 0
        inner = lambda s: self.value(s, "markup", depth + 1)
        for m in SHORTCODE.finditer(text) if "[" in text else ():
            known = self.codecs.get(m["tag"])
            if known is None or m.start() < at:
                continue
            edits = []
            for a in SHORTCODE_ATTRIBUTE.finditer(text, m.start("attrs"), m.end("attrs")):
                if a[1] in known:
                    k = 3 if a[3] is not None else 4
                    edits.append((a.start(k), a.end(k), known[a[1]](inner, a[k])))
            end = m.end()
            if "" in known:
                close = text.find(f"[/{m['tag']}]", end)
                # The next shortcode of the tag would nest: such a body is not known.
                if close > end and text.find(f"[{m['tag']}", end, close) < 0:
                    edits.append((end, close, known[""](inner, text[end:close])))
                    end = close
            for a, b, new in edits:
                out += [text[at:a], new]
                at = b
            if edits:
                out.append(text[at:end])
                at = end
        return "".join([*out, text[at:]]) if out else text

    def html(self, text: str, depth: int = 0) -> str:
        """URL attributes, style, block comments, JSON scripts, then the text between tags."""
        out, at, raw = [], 0, ""
        for start, end, comment, m in tags_of(text):
            if start < at or (raw and not (m and m["end"] and m["tag"].lower() == raw)):
                continue
            out.append(self._between(text[at:start], raw, depth))
            at, raw = end, ""
            if m is None:
                out.append(f"<!--{self.blocks(comment, depth)}-->")
                continue
            tag = m["tag"].lower()
            if m["end"]:
                out.append(m[0])
                continue
            edits = []
            for a in ATTRIBUTE.finditer(m["attrs"]):
                k = next(i for i in (3, 4, 5) if a[i] is not None)
                old = html.unescape(a[k])
                new = self._attribute(tag, a[1].lower(), old, depth)
                if new != old:
                    coded = new.replace("&", "&amp;").replace('"', "&quot;") if "&" in a[k] or k != 4 else new.replace("'", "&#039;")
                    edits.append((a.start(k), a.end(k), coded if html.unescape(a[k]) != a[k] or "&" in new or '"' in new else new))
            out.append(f"<{m['tag']}{spliced(m['attrs'], edits)}>")
            if tag in ("style", "script"):
                raw = tag
                if tag == "script" and re.search(r"type\s*=\s*[\"']?[\w.+/-]*json", m["attrs"], re.IGNORECASE):
                    stop = re.compile(r"</script", re.IGNORECASE).search(text, at)
                    stop = stop.start() if stop else len(text)
                    out.append(self.json(text[at:stop], depth))
                    at = stop
        return "".join([*out, self._between(text[at:], raw, depth)])

    def _between(self, text: str, raw: str, depth: int) -> str:
        if raw == "style":
            return self.css(text)
        return self.text(self.shortcodes(text, depth))

    def _attribute(self, tag: str, name: str, value: str, depth: int) -> str:
        if name == "style":
            return self.css(value)
        if name in URL_LISTS.get(tag, "").split():
            return re.sub(r"[^\s,]\S*", lambda m: self.url(m[0]), value)
        if name in URL_ATTRIBUTES.get(tag, "").split() and (new := self.url(value)) != value:
            return new
        if value[:1] in ("{", "["):
            return self.value(value, depth=depth + 1)
        return self.text(self.shortcodes(value, depth)) if name != "class" else value

    def value(self, value: str, hint: str | None = None, depth: int = 0) -> str:
        """A stored value: serialized, JSON, markup or text. Hint markup or skip; the hint goes
        down to the values inside. Shortcodes are read in markup only."""
        if not value or hint == "skip" or depth >= DEPTH:
            return value
        if value[0] in "asOC" and re.match(r"[aOC]:\d+:|s:\d+:\"", value):
            raw = value.encode("utf-8", "surrogateescape")
            if (done := self.serialized(raw, depth, hint)) is not None:
                return done.decode("utf-8", "surrogateescape")
        if value.lstrip(" \t\r\n")[:1] in ("{", "[", '"') and is_json(value):
            return self.json(value, depth, hint=hint)
        return self.html(value, depth) if hint == "markup" else self.text(value)


FORMATS = ("value", "text", "url", "html", "css", "json", "serialized", "shortcodes", "blocks")


def rewritten(value: Column, mapping: dict[str, str], *, hint: str | None = None, form: str = "value", base: str | None = None, codecs: dict[str, dict[str, Codec]] | None = None, children: dict[str, frozenset[str]] | None = None) -> Column:
    """``value`` rewritten by the dispatcher or one format; rows that cannot hold a source
    address never reach Python. Null stays null.

    ``codecs`` adds encoded shortcode bodies and attributes by tag, ``children`` the paths of
    child sites by host, whose links stay, ``base`` the page's address, on which root-relative
    links resolve.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown form: {form}")
    if hint == "skip":
        return value

    @F.pandas_udf("string")
    def change(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = Rewriter(mapping, base, codecs, children)  # prepared once for a partition
        for values in batches:
            yield values.map(lambda v: one(r, v))

    def one(r: Rewriter, v: str | None) -> str | None:
        if v is None:
            return None
        if form == "value":
            return r.value(v, hint)
        if form == "serialized":
            done = r.serialized(v.encode("utf-8", "surrogateescape"))
            return v if done is None else done.decode("utf-8", "surrogateescape")
        if form == "blocks":
            return r.html(v)
        return getattr(r, form)(v)

    hosts = sorted({urlsplit(s).netloc for s in mapping})
    test = may_contain_url(value, hosts, tuple(CODECS | (codecs or {})))
    if base is not None and (form in ("url", "html", "css") or hint == "markup"):
        test = test | value.contains("/")
    return F.when(test, change(F.when(test, value))).otherwise(value)


#: Repeated values that a column's cache holds, the sketch's counters, and bytes up to which it is broadcast.
CACHED, COUNTERS, CACHE_BYTES = 1000, 10_000, 32 << 20


def rewrite_repeated(df: DataFrame, column: str, mapping: dict[str, str], **how) -> DataFrame:
    """``df`` with ``column`` rewritten, each of its most repeated values once.

    A sketch of frequent items (over hashes, merged from all tasks) finds up to CACHED values
    that occur again and again; they are rewritten once, broadcast after their bytes are
    counted, and joined back by value; only the other rows reach Python in place. What the
    sketch misses is rewritten row by row, to the same result.
    """
    value, spark = F.col(f"`{column}`"), df.sparkSession
    found = df.where(value.isNotNull()).select(F.xxhash64(value).alias("h")).agg(F.expr(f"approx_top_k(h, {CACHED}, {COUNTERS})").alias("t")).first()["t"] or []
    heavy = [x["item"] for x in found if x["count"] > 1]
    if not heavy:
        return rewrite_column(df, column, mapping, **how)
    hashes = spark.createDataFrame([(h,) for h in heavy], "h long")
    values = df.select(value.alias("old"), F.xxhash64(value).alias("h")).join(F.broadcast(hashes), "h").select("old").distinct()
    # Written, so that each is rewritten once, whatever reads them.
    cache = materialize(values.select("old", rewritten(F.col("old"), mapping, **how).alias("new")), "cache")
    size = cache.agg(F.sum(F.octet_length("old") + F.octet_length("new"))).first()[0] or 0
    if size > CACHE_BYTES:
        return rewrite_column(df, column, mapping, **how)
    known = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), value.alias("__value"))
    met = known.join(F.broadcast(cache), F.col("__value") == F.col("old"), "left")
    rest = rewritten(F.when(F.col("old").isNull(), F.col("__value")), mapping, **how)
    met = met.select("__row", F.when(F.col("old").isNull(), rest).otherwise(F.col("new")).alias("__value"))
    return met.select(*(F.col("__value").alias(c) if c == column else F.col(f"__row.`{c}`").alias(c) for c in df.columns))


def rewrite_column(df: DataFrame, column: str, mapping: dict[str, str], *, out: str | None = None, **how) -> DataFrame:
    """``df`` with ``column`` rewritten (into ``out`` if given), as ``rewritten`` does it."""
    return df.withColumn(out or column, rewritten(F.col(f"`{column}`"), mapping, **how))


# Formats of well-known columns. Callers' hints, with or without a prefix, come first.
HINTS = {"posts.post_content": "markup", "posts.post_content_filtered": "markup", "posts.post_excerpt": "markup", "comments.comment_content": "markup", "term_taxonomy.description": "markup"}


def rewrite_tables(tables: dict[str, DataFrame], mapping: dict[str, str], *, prefix: str = "", hints: dict[str, str] | None = None, **how) -> dict[str, DataFrame]:
    """Every text column of each table by its hint, all in one projection a table.

    ``base``, ``codecs`` and ``children`` are as in ``rewritten``.
    """
    known, done = HINTS | (hints or {}), {}
    for name, df in tables.items():
        hint = lambda c, name=name: known.get(f"{name}.{c}", known.get(f"{name.removeprefix(prefix)}.{c}"))
        columns = []
        for f in df.schema:
            value = F.col(f"`{f.name}`")
            columns.append(rewritten(value, mapping, hint=hint(f.name), **how).alias(f.name) if f.dataType.simpleString() == "string" else value)
        done[name] = df.select(*columns)
    return done


def map_urls(urls: DataFrame, mapping: DataFrame, url_col: str = "url") -> DataFrame:
    """``mapped`` for each URL: the longest source base on whole segments, its suffix kept.

    Hosts are compared in lower case, and user information of the URL is left aside and goes
    with the base. ``mapping(source, target)`` is looked up depth by depth
    (``tree.longest_prefix``): native, without a shuffle of the URLs.
    """
    url = F.col(f"`{url_col}`")
    address = F.regexp_extract(url, r"^([^?#]*)", 1)
    lead = F.regexp_extract(address, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?(?:[^/@]*@)?", 0)  # scheme and user information
    low = lambda c: F.concat(F.lower(F.substring_index(c, "/", 1)), F.substring(c, F.char_length(F.substring_index(c, "/", 1)) + 1, F.char_length(c)))
    bare = F.substring(address, F.char_length(lead) + 1, F.char_length(address))
    bases = mapping.select(low(F.rtrim("source", F.lit("/"))).alias("prefix"), "target")
    found = longest_prefix(urls, low(F.rtrim(bare, F.lit("/"))), bases, "__m")
    suffix = F.substring(url, F.char_length(lead) + F.char_length("__m.prefix") + 1, F.char_length(url))
    return found.select(*(F.col(f"`{c}`") for c in urls.columns), F.when(F.col("__m").isNull(), url).otherwise(F.concat("__m.target", suffix)).alias("mapped"))
