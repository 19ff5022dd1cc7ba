"""Text, fields and lists out of HTML.

A page is read once by the standard library's parser into a small tree; the functions are
Arrow-batched. Selectors are those of `selectors`; one that is refused finds nothing, and its reason stands in the row
where the function has a place for it. Filter rows before these columns are made: they are the dear part of a plan.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections.abc import Iterator
from datetime import datetime
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparrowline.functions.selectors import Page, SelectorError, refusal

# Tags that end a line, that hold no visible text, that are never closed.
BLOCK = set("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
HIDDEN = {"script", "style", "noscript", "template"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
KEPT = {"p", "br", "ul", "ol", "li", "h1", "h2", "h3", "h4", "strong", "b", "em", "i", "a", "img", "table", "tr", "td", "th", "tbody", "thead"}
KEPT_ATTRIBUTES = {"a": ("href",), "img": ("src", "alt")}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "table")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.table: Page | None = None
        self.children: list[Node | str] = []

    def nodes(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self, edge_sign: str = "\n") -> Iterator[str]:
        """Visible texts in order, a line feed or another sign at the edges of blocks."""
        todo: list[Node | str] = [self]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in HIDDEN:
                edge = [edge_sign] if c.tag in BLOCK else []
                todo += [*edge, *reversed(c.children), *edge]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "p", "tr", "td", "th", "dt", "dd") and self.at.tag == tag:
            self.leave()
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def leave(self):
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        if self.open.get(tag):
            while self.at.tag != tag:
                self.leave()
            self.leave()

    def handle_data(self, data):
        self.at.children.append(data)


def parse(text: str) -> Node:
    tree = _Tree()
    tree.feed(text)
    tree.close()
    return tree.root


def table(node: Node) -> Page:
    """The table of the page that a node is in, kept with its root."""
    while node.parent:
        node = node.parent
    if node.table is None:
        node.table = Page(node)
    return node.table


def select(scope: Node, text: str) -> list[Node]:
    """Elements that a selector finds below a node, in document order; a selector's steps may reach above it.

    The page's table is made at the first call and kept with its root: a tree that is changed
    afterwards must not be selected from again.
    """
    return table(scope).select(text, scope)


def found(scope: Node, text: str) -> list[Node]:
    """The same, and nothing for a selector that is refused: `refusal` says why."""
    try:
        return select(scope, text)
    except SelectorError:
        return []


def flat(node: Node) -> str:
    return " ".join("".join(t if t != "\n" else " " for t in node.texts()).split())


def lines(node: Node) -> str:
    """Text with a line for each block, two blank lines at the most."""
    text = "".join(node.texts()).replace("\r", "")
    text = re.sub(r"[ \t\f\v\xa0]*\n[ \t\f\v\xa0]*", "\n", re.sub(r"[ \t\f\v\xa0]+", " ", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _column(kind: str):
    """A column function of a function on one text; null gives null."""

    def make(f):
        @functools.wraps(f)
        def column(c: Column, *options) -> Column:
            @F.pandas_udf(kind)
            def run(s: pd.Series) -> pd.Series:
                return s.map(lambda x: None if x is None else f(x, *options))

            return run(c)

        column.plain = f
        return column

    return make


# Fixed value: what tells markup from text.
MARKUP = re.compile(r"<[A-Za-z/!][^>]*>|&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]\w{1,31});")
#: A sign that stands for the edge of a block.
EDGE = "\0"


@_column("string")
def html_text(text: str) -> str:
    """Lines of text where there is markup, edges of blocks that meet being one end of a line; other texts as they are.

    Blank lines stay where the text itself has them, one at a time.
    """
    if not MARKUP.search(text):
        return text
    between = re.split(EDGE, "".join(parse(text.replace(EDGE, "")).texts(EDGE)))
    blocks = ("\n".join(re.sub(r"[^\S\n]+", " ", row).strip() for row in block.split("\n")).strip() for block in between)
    return "\n".join(re.sub(r"\n{3,}", "\n\n", block) for block in blocks if block)


@_column("string")
def visible_text(text: str) -> str:
    """All text that a page shows, white space squeezed."""
    root = parse(text)
    body = next((n for n in root.nodes() if n.tag == "body"), root)
    return flat(body)


@_column("string")
def block_text(text: str) -> str:
    return lines(parse(text))


@_column("array<struct<index:int,title:string,link:string>>")
def list_items(text: str, item: str, title: str, base: str) -> list[dict]:
    """Items of a list page: place, title and absolute link (null where there is none)."""
    out = []
    for i, node in enumerate(found(parse(text), item)):
        named = found(node, title)
        link = next((n for n in node.nodes() if n.tag == "a" and n.attrs.get("href")), None)
        out.append({"index": i, "title": flat(named[0] if named else node), "link": urljoin(base, link.attrs["href"]) if link else None})
    return out


@_column("map<string,string>")
def detail_fields(text: str, selectors: tuple) -> dict[str, str | None]:
    """Fields of a detail page by (name, selector) pairs; a field that is not found is null."""
    root = parse(text)
    by_name = {name: found(root, s) for name, s in selectors}
    return {name: (lines(nodes[0]) or None) if nodes else None for name, nodes in by_name.items()}


@_column("map<string,int>")
def selector_counts(text: str, selectors: tuple) -> dict[str, int]:
    """How many elements each of some (name, selector) pairs finds."""
    root = parse(text)
    return {name: len(found(root, s)) for name, s in selectors}


@_column("array<struct<selector:string,matches:int,reason:string>>")
def selector_matches(text: str, selectors: tuple) -> list[dict]:
    """How many elements each selector finds, or why it is refused."""
    root = parse(text)
    return [{"selector": s, "matches": None if why else len(select(root, s)), "reason": why} for s in selectors for why in [refusal(s)]]


@_column("boolean")
def images_to_read(text: str, most: int = 400) -> bool:
    """The page has images, and the text of its body is shorter than `most`."""
    root = parse(text)
    body = next((n for n in root.nodes() if n.tag == "body"), root)
    return any(n.tag == "img" for n in body.nodes()) and len(flat(body)) < most


@_column("map<string,string>")
def page_parts(text: str, base: str) -> dict[str, str | None]:
    """What a page shows, its lines, its HTML with known tags only and its image, of one parse."""
    root = parse(text)
    body = next((n for n in root.nodes() if n.tag == "body"), root)
    return {"visible": flat(body), "blocks": lines(root), "html": shown_html(root, base), "image": image_of(root)}


@_column("string")
def page_image(text: str) -> str | None:
    """The page's own image for sharing, else its best icon: touch icons first, then the largest."""
    return image_of(parse(text))


def image_of(root: Node) -> str | None:
    for n in root.nodes():
        if n.tag == "meta" and n.attrs.get("property") == "og:image" and n.attrs.get("content"):
            return n.attrs["content"]

    def worth(n: Node) -> tuple:
        sizes = [int(x) for x in re.findall(r"\d+", n.attrs.get("sizes", ""))]
        return "apple-touch-icon" in n.attrs.get("rel", ""), max(sizes, default=0)

    icons = [n for n in root.nodes() if n.tag == "link" and "icon" in n.attrs.get("rel", "") and n.attrs.get("href")]
    return max(icons, key=worth).attrs["href"] if icons else None


@_column("array<string>")
def json_ld(text: str, kind: str) -> list[str]:
    """Structured data of one type in a page, each as canonical JSON; lists and graphs are opened."""
    out: list[str] = []
    for node in parse(text).nodes():
        if node.tag != "script" or node.attrs.get("type") != "application/ld+json":
            continue
        try:
            todo = [json_value("".join(c for c in node.children if isinstance(c, str)))]
        except ValueError:
            continue
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo = x + todo
            elif isinstance(x, dict):
                types = x.get("@type")
                if kind in (types if isinstance(types, list) else [types]):
                    out.append(canonical_json(x))
                todo += [x["@graph"]] if "@graph" in x else []
    return list(dict.fromkeys(out))


def canonical_json(x) -> str:
    """JSON with sorted keys and no spaces of its own choice: equal values give equal texts."""
    return json.dumps(x, ensure_ascii=False, sort_keys=True)


def _shown(node: Node, inside: str, base: str) -> str:
    """An element of what it holds: its own tag if that is known, nothing if it is empty."""
    if node.tag not in KEPT:
        return inside
    said = ""
    for name in KEPT_ATTRIBUTES.get(node.tag, ()):
        value = node.attrs.get(name) or (node.attrs.get("data-src", "") if name == "src" else "")
        if value and not value.lower().lstrip().startswith("javascript:"):
            said += f' {name}="{entities.escape(urljoin(base, value) if name in ("href", "src") else value)}"'
    if node.tag in VOID:
        return f"<{node.tag}{said}>" if node.tag == "br" or said else ""
    return f"<{node.tag}{said}>{inside}</{node.tag}>" if inside.strip() else ""


@_column("string")
def sanitized(text: str, base: str) -> str:
    """Only known tags and attributes, links made absolute, empty elements left out. Pages may be nested at any depth."""
    return shown_html(parse(text), base)


def shown_html(root: Node, base: str) -> str:
    open_ = [(root, iter(root.children), [])]
    while True:
        node, rest, parts = open_[-1]
        child = next(rest, None)
        if child is None:
            open_.pop()
            shown = _shown(node, "".join(parts), base)
            if not open_:
                return shown.strip()
            open_[-1][2].append(shown)
        elif isinstance(child, str):
            parts.append(re.sub(r"\s+", " ", entities.escape(child, quote=False)))
        elif child.tag not in HIDDEN:
            open_.append((child, iter(child.children), []))


@_column("string")
def labelled(text: str, labels: tuple) -> str | None:
    """What follows the first label in the page's lines: the rest of its line, else the next line."""
    rows = [r for r in lines(parse(text)).split("\n") if r.strip()]
    for i, row in enumerate(rows):
        for label in labels:
            if row.lower().lstrip().startswith(label.lower()):
                rest = row.strip()[len(label) :].strip(" :：-")
                return rest or (rows[i + 1].strip() if i + 1 < len(rows) else None)
    return None


@F.pandas_udf(StringType())
def joined_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link against the page it stands in."""
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link)])


@F.pandas_udf(StringType())
def canonical_json_hash(text: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text in canonical form; null for what is no JSON."""
    import hashlib

    def one(t):
        try:
            return hashlib.sha256(canonical_json(json_value(t)).encode()).hexdigest()
        except (ValueError, RecursionError):
            return None

    return text.map(one)


def json_value(text: str | None):
    """What a JSON text says; a ValueError for what is none, or is nested deeper than the reader goes."""
    try:
        return json.loads(text)
    except (TypeError, RecursionError) as e:
        raise ValueError(str(e)) from e


def flattened(value, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, text) of all leaves of a JSON value, in order; places in lists are written *."""
    todo = [(path, value)]
    while todo:
        at, x = todo.pop()
        if isinstance(x, (dict, list)):
            inside = x.items() if isinstance(x, dict) else (("*", v) for v in x)
            todo += [(f"{at}.{k}" if at else str(k), v) for k, v in inside][::-1]
        elif x is not None and str(x).strip():
            yield at, str(x).lower() if isinstance(x, bool) else str(x)


@_column("array<struct<path:string,value:string>>")
def json_leaves(text: str) -> list[dict]:
    """All leaves of a JSON text; none for what is no JSON."""
    try:
        return [{"path": p, "value": v} for p, v in flattened(json_value(text))]
    except ValueError:
        return []


# Fixed value: letters of the pages' language.
LANGUAGE = re.compile(r"[가-힣]")
# Fixed value: links and files; from so many letters of the language on, a line with one is a sentence.
LINK = re.compile(r"https?://|www\.|\.(?:png|jpe?g|gif|svg|webp|pdf|docx?|hwp|xlsx?|zip)\b", re.IGNORECASE)
LINK_SENTENCE = 4
# Fixed value: what dates and times of day look like.
DATE_SHAPE = re.compile(r"\d{2,4}[.\-/년]\s?\d{1,2}|\d{1,2}:\d{2}")
# Fixed value: dates in digits only, by their length.
DATE_DIGITS = {8: "%Y%m%d", 12: "%Y%m%d%H%M", 14: "%Y%m%d%H%M%S"}
# Fixed value: keys whose four digits are a time of day.
TIME_KEY = re.compile(r"(?:tm|time)$", re.IGNORECASE)
# Fixed value: words for nothing.
EMPTY_WORDS = {"null", "none", "true", "false", "undefined"}
# Fixed value: the shortest line that counts as repeated.
REPEATED = 8
#: Codes of systems: signs of identifiers only, and a digit among them or no small letter.
CODE = re.compile(r"(?=[^0-9]*[0-9])[A-Za-z0-9_.\-:/+#]+|[A-Z0-9_.\-:/+#]+")


def _is_date(digits: str) -> bool:
    try:
        return digits.isdigit() and bool(datetime.strptime(digits, DATE_DIGITS[len(digits)]))
    except (KeyError, ValueError):
        return False


def is_said(key: str, line: str) -> bool:
    """A line of a payload that a reader is told: no link, and a sentence, a date, a time, or a word that is no code."""
    if LINK.search(line) and len(LANGUAGE.findall(line)) < LINK_SENTENCE:
        return False
    if LANGUAGE.search(line) or re.search(r"\s", line):
        return True
    if DATE_SHAPE.search(line) or _is_date(line) or (TIME_KEY.search(key) and re.fullmatch(r"\d{4}", line)):
        return True
    return line.lower() not in EMPTY_WORDS and bool(re.search("[A-Za-z0-9]", line)) and not CODE.fullmatch(line)


def payload_values(value) -> Iterator[tuple[str, str, tuple[int, ...]]]:
    """(key, text, places in the lists above) of each text and number of a JSON value, in order; entries of a list have the list's key."""
    todo: list[tuple] = [("", value, ())]
    while todo:
        key, x, places = todo.pop()
        if isinstance(x, dict):
            todo += [(str(k), v, places) for k, v in x.items()][::-1]
        elif isinstance(x, list):
            todo += [(key, v, (*places, i)) for i, v in enumerate(x)][::-1]
        elif isinstance(x, str) or (isinstance(x, int | float) and not isinstance(x, bool)):
            yield key, str(x), places


@_column("string")
def payload_text(text: str) -> str:
    """What a payload tells a reader, a line each; the first line of a value has its key before it, markup is made lines.

    A longer line stands once in each cell of the lists above it: what two entries share is kept in both. Empty for what is no JSON.
    """
    try:
        value = json_value(text)
    except ValueError:
        return ""
    out: list[str] = []
    told: set[tuple] = set()
    for key, said, places in payload_values(value):
        first = f"{key}: " if key else ""
        for line in filter(None, map(str.strip, html_text.plain(said).split("\n"))):
            same = places, re.sub(r"\s+", " ", line)
            if not is_said(key, line) or (len(same[1]) >= REPEATED and same in told):
                continue
            told.add(same)
            out.append(first + line)
            first = ""
    return "\n".join(out)


@_column("array<struct<path:string,size:int,index:int,key:string,value:string>>")
def json_entries(text: str, deepest: int = 6, least: int = 2) -> list[dict]:
    """Values of the objects in each list of objects of a JSON text: the list's path and size, the object's place, the key.

    Lists inside lists, lists of other things and lists of fewer than `least` objects are left out.
    """
    out: list[dict] = []
    try:
        todo = [("", json_value(text), 0)]
    except ValueError:
        return out
    while todo:
        path, x, depth = todo.pop()
        if not isinstance(x, dict) or depth > deepest:
            continue
        for k, v in x.items():
            at = f"{path}.{k}" if path else str(k)
            if not isinstance(v, list):
                todo.append((at, v, depth + 1))
            elif len(v) >= least and all(isinstance(e, dict) for e in v):
                for i, entry in enumerate(v):
                    found = [{"path": at, "size": len(v), "index": i, "key": p, "value": w.strip()} for p, w in flattened(entry)]
                    out += [f for f in found if "*" not in f["key"]]
    return out
