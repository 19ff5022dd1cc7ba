"""What a posting's page says outside its fields: its body once, labelled values, links, ids, and items of HTML lists.

Each function reads a page once. They are Arrow-batched like those of `html`, which has the tree and the selectors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, quote, urljoin, urlsplit

from sparrowline.functions.html import BLOCK, HIDDEN, Node, _column, flat, found, lines, parse, select, table
from sparrowline.functions.selectors import refusal
from sparrowline.functions.text import NOTHING_LISTED

# Fixed value: parts of a page around a posting, by tag and by class.
FURNITURE, FURNITURE_CLASSES = {"header", "footer", "nav", "aside"}, ("aside", "footer", "gnb")
# Fixed value: elements that a reader of a page's structure has no use for.
NOISE = {"script", "style", "noscript", "template", "svg", "iframe", "link", "meta"}
# Fixed value: elements whose own text is no label.
NO_LABEL = {"script", "style", "option", "button"}
# Fixed value: placeholders of link templates.
PLACEHOLDER = re.compile(r"\{([A-Za-z_][A-Za-z0-9_:.-]*)(?:\|arg(\d+))?\}")
# Fixed value: arguments of calls.
QUOTED, CALL = re.compile(r"'([^']*)'|\"([^\"]*)\""), re.compile(r"\(([^()]*)\)")
# Fixed value: signs that stay as they are in a link.
KEPT_IN_URL = "/?:=&%+#"
# Fixed value: signs around a label.
LABEL_EDGE = " :：\u00a0\t\n"
# Fixed value: labels of deadlines, then those of periods.
DEADLINE = (
    r"(?:서류\s*)?(?:접수|지원|모집|채용)?\s*마감\s*(?:일|일시|기한|날짜)?",
    r"(?:서류\s*)?(?:접수|지원|모집|채용)\s*기간",
)
# Fixed value: a date, which may have its weekday and a time.
ONE_DATE = (
    r"\d{2,4}\s*[.\-/년]\s*\d{1,2}\s*[.\-/월]\s*\d{1,2}\s*일?\.?"
    r"(?:\s*\(\s*[월화수목금토일]\s*\))?"
    r"(?:\s*\(?\s*(?:오전|오후|AM|PM)?\s*\d{1,2}\s*[:시]\s*(?:\d{2})?\s*분?\s*\)?)?"
)
# Fixed value: a date, or a period of two.
DATE_SPAN = re.compile(rf"{ONE_DATE}(?:\s*[~〜\-]\s*{ONE_DATE})?")
# Fixed value: what a text with a date has in it.
HAS_DATE = re.compile(r"\d{2,4}\s*[.\-/년]\s*\d{1,2}\s*[.\-/월]\s*\d{1,2}")
# Fixed value: how a period without its end ends.
OPEN_PERIOD = re.compile(r"[~〜]\s*$")
# How far around a title its body may be, and how much text that has at least.
NEAR_LEVELS, NEAR_TEXT = 6, 300
# Ancestors that may hold an item's link, the longest value beside a label, lengths of ids, elements read for ids.
ANCESTORS, LONGEST_VALUE, ID_LENGTH, ID_NODES = 3, 200, (3, 64), 40
#: Characters from the start of an element in which a deadline and its label stand.
HEAD = 400


def above(node: Node) -> Iterator[Node]:
    while node.parent:
        node = node.parent
        yield node


def tight(text: str) -> str:
    return re.sub(r"[\s\u200b]+", "", text)


def images(node: Node) -> list[str]:
    return [n.attrs.get("src") or n.attrs.get("data-src") or "" for n in node.nodes() if n.tag == "img"]


def is_furniture(node: Node) -> bool:
    """A part of the page around a posting, by its tag or its class."""
    return node.tag in FURNITURE or any(part in node.attrs.get("class", "") for part in FURNITURE_CLASSES)


def bodies(root: Node, body: str) -> list[Node]:
    """Elements of a selector, but for those inside another one, empty ones, and those that say what one before said."""
    said, out, outside = set(), [], 0
    for node in found(root, body):
        at = root.table.of_node[id(node)]
        if at < outside:
            continue
        outside = root.table.end[at]
        key = tight(flat(node)) or "|".join(images(node))
        if key and key not in said:
            said.add(key)
            out.append(node)
    return out


def without_furniture(node: Node) -> Node:
    """A copy of an element without the page's own parts in it."""
    copy = Node(node.tag, node.attrs, None)
    todo = [(node, copy)]
    while todo:
        old, new = todo.pop()
        for c in old.children:
            if isinstance(c, Node) and not is_furniture(c):
                new.children.append(Node(c.tag, c.attrs, new))
                todo.append((c, new.children[-1]))
            elif isinstance(c, str):
                new.children.append(c)
    return copy


@_column("string")
def source_text(text: str, body: str) -> str:
    """A posting's whole text: what is around its body, one element up; around several bodies the nearest element that
    holds all; the bodies themselves where that is the page. Empty where there is no body."""
    root = parse(text)
    some = bodies(root, body)
    if not some:
        return ""
    page = root.table
    last = page.of_node[id(some[-1])]
    around = page.parent[page.of_node[id(some[0])]]
    while page.end[around] <= last:
        around = page.parent[around]
    if page.nodes[around].tag in ("body", "html", ""):
        return "\n".join(lines(n) for n in some)
    return lines(without_furniture(page.nodes[around]))


class Said:
    """What each element of a page says, as spans of one text with single spaces: no element's text is put together twice."""

    def __init__(self, root: Node):
        self.page = page = table(root)
        self.starts, self.ends = [0] * len(page), [0] * len(page)
        self.own = bytearray(len(page))
        parts: list[str] = []
        size, spaced, todo = 0, True, [root]
        while todo:
            x = todo.pop()
            if isinstance(x, int):
                self.ends[x] = size
                if page.nodes[x].tag in BLOCK and not spaced:
                    parts.append(" ")
                    size, spaced = size + 1, True
            elif isinstance(x, str):
                text = re.sub(r"\s+", " ", x)
                text = text[1:] if spaced and text[:1] == " " else text
                if text:
                    parts.append(text)
                    size, spaced = size + len(text), text[-1] == " "
            elif x.tag not in HIDDEN:
                at = page.of_node[id(x)]
                if x.tag in BLOCK and not spaced:
                    parts.append(" ")
                    size, spaced = size + 1, True
                self.starts[at] = self.ends[at] = size
                self.own[at] = any(isinstance(c, str) and not c.isspace() for c in x.children)
                todo += [at, *reversed(x.children)]
        self.text = "".join(parts)
        #: Whether an element is a part of the page around the posting, or in one.
        self.aside = bytearray(len(page))
        for at in range(1, len(page)):
            self.aside[at] = self.aside[page.parent[at]] or is_furniture(page.nodes[at])

    def of(self, at: int, most: int) -> str:
        """The first characters that an element says, without the signs around a label."""
        lo = self.starts[at]
        return self.text[lo : min(self.ends[at], lo + most)].strip(LABEL_EDGE)

    def labels(self) -> Iterator[int]:
        """Elements with a text of their own, outside the page's own parts."""
        for at in range(1, len(self.page)):
            if self.own[at] and not self.aside[at] and self.page.nodes[at].tag not in NO_LABEL:
                yield at

    def beside(self, at: int, label: str) -> int | None:
        """The next element beside one that only holds the label, or beside what only wraps it."""
        page = self.page
        while at and self.of(at, len(label) + 16) == label:
            inside = page.children[page.parent[at]]
            if page.place[at] < len(inside):
                return inside[page.place[at]]
            at = page.parent[at]
        return None


@_column("map<string,string>")
def labelled_info(text: str, labels: tuple, known: str = "") -> dict[str, str]:
    """What stands beside each of some labels, but for what the known text says already; the first of each counts."""
    said = Said(parse(text))
    seen, out, longest = tight(known), {}, max(map(len, labels), default=0)
    for at in said.labels():
        label = said.of(at, longest + 16)
        if label not in labels or label in out:
            continue
        cell = said.beside(at, label)
        value = said.text[said.starts[cell] : min(said.ends[cell], said.starts[cell] + LONGEST_VALUE + 3)].strip() if cell else ""
        if value and len(value) <= LONGEST_VALUE and tight(label + value) not in seen:
            out[label] = value
    return out


@_column("string")
def labelled_deadline(text: str) -> str:
    """The date or period right after a deadline's label, in its cell or the next; labels of deadlines before those of periods."""
    return deadline_in(parse(text))


def deadline_in(root: Node) -> str:
    said = Said(root)
    heads = [(at, said.of(at, HEAD)) for at in said.labels()]
    for pattern in DEADLINE:
        for at, head in heads:
            if not (m := re.match(pattern, head)):
                continue
            rest = head[m.end() :].strip(LABEL_EDGE)
            if not rest and (cell := said.beside(at, head)):
                rest = said.of(cell, HEAD)
            if date := DATE_SPAN.match(rest):
                return date[0].strip()
    return ""


def _body_near(title: Node) -> Node | None:
    """The nearest ancestor of a title that has enough text beside it, or a picture; none where that is the page."""
    size = len(tight(flat(title)))
    for level, up in enumerate(above(title)):
        if level >= NEAR_LEVELS or up.tag in ("body", "html", ""):
            return None
        own = without_furniture(up)
        if len(tight(flat(own))) - size >= NEAR_TEXT or any(x and not x.lower().endswith(".svg") for x in images(own)):
            return own
    return None


@_column("map<string,string>")
def posting_detail(text: str, selectors: tuple) -> dict[str, str]:
    """Fields of a detail page by (name, selector) pairs, `title` and `body` among them, empty where nothing is found.

    A deadline that holds no date, or only the start of a period, is looked for by its label; a body that its selector misses
    is looked for near the title. `_unread` names what a posting cannot do without and has not: title, and a body of text or images.
    `_refused` is there only where selectors are not understood, and says why.
    """
    root, chosen = parse(text), dict(selectors)
    refused = {name: why for name, s in selectors if (why := refusal(s))}
    whole = {name: "\n".join(lines(n) for n in bodies(root, s)) if name == "body" else flat(next(iter(found(root, s)), Node("", {}, None))) for name, s in selectors}
    end = whole.get("recruitment_end_at", "")
    if not HAS_DATE.search(end) or OPEN_PERIOD.search(end):
        whole["recruitment_end_at"] = deadline_in(root) or end
    pictured = any(any(images(n)) for n in bodies(root, chosen["body"]))
    if not whole["body"] and not pictured and whole["title"] and (near := _body_near(select(root, chosen["title"])[0])):
        whole["body"], pictured = lines(near), any(images(near))
    unread = [*(["title"] if not whole["title"] else []), *(["body"] if not whole["body"] and not pictured else [])]
    return whole | {"_unread": ",".join(unread)} | ({"_refused": "; ".join(f"{n}: {why}" for n, why in refused.items())} if refused else {})


def _refused(**selectors: str) -> str | None:
    """Why selectors are not understood, by name; empty ones ask for nothing."""
    return "; ".join(f"{name}: {why}" for name, s in selectors.items() if s and (why := refusal(s))) or None


@_column("array<struct<index:int,title:string,link:string,date:string,company:string,failed:string>>")
def posting_items(text: str, item: str, title: str, link: str, date: str, company: str, base: str) -> list[dict]:
    """Items of a list page: place, title, absolute link, date and company. `failed` says what keeps an item from being read (title, link),
    which then stands beside the good ones. Without a link's selector the list page itself is the link. Selectors that are not
    understood give one row that says why."""
    if why := _refused(item=item, title=title, link=link, date=date, company=company):
        return [{"index": None, "title": None, "link": None, "date": None, "company": None, "failed": why}]
    out = []
    for i, node in enumerate(select(parse(text), item)):
        said = {name: flat(next(iter(select(node, s)), Node("", {}, None))) if s else "" for name, s in (("title", title), ("date", date), ("company", company))}
        url, why = item_link(node, link, "") if link else (base, None)
        failed = ",".join([*([] if said["title"] else ["title"]), *(["link"] if why else [])]) or None
        out.append({"index": i, **said, "link": urljoin(base, url) if url else None, "failed": failed})
    return out


def argument(call: str, number: int) -> str:
    """The n-th quoted argument of a call, counted from 1; of a call without quotes the n-th number."""
    found = [a or b for a, b in QUOTED.findall(call)]
    if not found and (inside := CALL.search(call)):
        found = [x.strip() for x in inside[1].split(",") if x.strip().isdecimal()]
    return found[number - 1].strip() if 0 < number <= len(found) else ""


def followable(url: str) -> bool:
    return bool(url.strip()) and not url.strip().startswith("#") and urlsplit(url.strip()).scheme in ("", "http", "https")


def item_link(item: Node, link: str, template: str) -> tuple[str | None, str | None]:
    """(link, why there is none) of a list's item: an element of the selector in it, the item itself, or one of the nearest
    around it; its href, or the template filled with its attributes and arguments of their calls."""
    target = item
    if link:
        inside = select(item, link)
        up = [n for n in (item, *list(above(item))[:ANCESTORS]) if n.parent and table(n).finds(link, n)]
        target = next(iter([*inside, *up]), None)
        if target is None:
            return None, "no element"
    elif not template:
        return None, "no selector"
    if not template:
        url = target.attrs.get("href", "").strip()
        return (url, None) if followable(url) else (None, "no link to follow" if url else "no href")
    lacking: list[str] = []

    def value(m: re.Match) -> str:
        said = target.attrs.get(m[1].lower(), "").strip()
        said = argument(said, int(m[2])) if m[2] else said
        if not said:
            lacking.append(m[0])
        return quote(said, safe=KEPT_IN_URL)

    url, filled = PLACEHOLDER.subn(value, template)
    if not filled or lacking or not followable(url):
        return None, "nothing to fill in" if not filled else f"empty: {lacking[0]}" if lacking else "no link to follow"
    return url, None


@_column("array<struct<index:int,link:string,reason:string>>")
def item_links(text: str, item: str, link: str, template: str = "") -> list[dict]:
    """The link of each of a list's items, or why it has none."""
    if why := _refused(item=item, link=link):
        return [{"index": None, "link": None, "reason": why}]
    each = (item_link(node, link, template) for node in select(parse(text), item))
    return [{"index": i, "link": url, "reason": why} for i, (url, why) in enumerate(each)]


def _is_id(value: str) -> bool:
    return ID_LENGTH[0] <= len(value) <= ID_LENGTH[1] and any(c.isdigit() for c in value)


@_column("array<struct<kind:string,detail:string,value:string>>")
def id_candidates(text: str, link: str = "") -> list[dict]:
    """What may be an item's id, likeliest first, each value once: the link's last part and its query, then data attributes and their digits."""
    found: list[tuple[str, str, str]] = []
    href = next((n.attrs["href"] for n in parse(text).nodes() if n.attrs.get("href")), "") if not link else link
    parts = urlsplit(href)
    if "/" in parts.path.rstrip("/"):
        found.append(("path", "last", parts.path.rstrip("/").rsplit("/", 1)[-1]))
    found += [("query", k, v.strip()) for k, v in parse_qsl(parts.query)]
    for node in [n for n in parse(text).nodes() if n.tag][: ID_NODES + 1]:
        for name, value in node.attrs.items():
            if name.startswith("data-"):
                found += [("attribute", name, value.strip()), ("digits", name, "".join(c for c in value if c.isdigit()))]
    first: dict[str, tuple] = {}
    for kind, detail, value in found:
        if _is_id(value):
            first.setdefault(value, (kind, detail))
    return [{"kind": k, "detail": d, "value": v} for v, (k, d) in first.items()]


@_column("array<struct<index:int,id:string,title:string,link:string,failed:string>>")
def fragment_items(text: str, item: str, title: str, id_attribute: str, template: str) -> list[dict]:
    """Items of a list that comes as a piece of HTML: place, id (`selector@attribute`), title and link by id; `failed`
    names what an item lacks, and it has no link then."""
    at, name = id_attribute.rsplit("@", 1)
    if why := _refused(item=item, title=title, id=at):
        return [{"index": None, "id": None, "title": None, "link": None, "failed": why}]
    out = []
    for i, node in enumerate(select(parse(text), item)):
        named = select(node, title)
        holder = next(iter(select(node, at)), None) if at else node
        own, said = (holder.attrs.get(name, "").strip() if holder else ""), flat(named[0]) if named else ""
        failed = ",".join(field for field, value in (("title", said), ("id", own)) if not value) or None
        out.append({"index": i, "id": own or None, "title": said or None, "link": None if failed else template.replace("{id}", own), "failed": failed})
    return out


@_column("string")
def nothing_listed(text: str) -> str | None:
    """The words by which a page says that nothing is listed; null where it does not."""
    said = flat(parse(text))
    return next((m[0] for p in NOTHING_LISTED if (m := re.search(p, said))), None)


def _names(node: Node) -> list[str]:
    """Selectors that fit an element, the most particular first."""
    classes = [c for c in node.attrs.get("class", "").split() if re.fullmatch(r"[\w-]+", c)]
    return [node.tag + "".join(f".{c}" for c in classes), *(f"{node.tag}.{c}" for c in classes), node.tag]


@_column("string")
def repeating_item(text: str, item: str, title: str, steps: int = 6) -> str:
    """The selector of a list's items, each with exactly one title: the given one if it is so; else that of the nearest
    ancestors of the titles, one for each title, that no other element fits; else the given one."""
    root = parse(text)
    titles, items = found(root, title), found(root, item)
    if len(titles) < 2 or (items and len(items) == len(titles) and all(len(select(n, title)) == 1 for n in items)):
        return item
    for step in range(steps):
        around = [next((up for i, up in enumerate(above(t)) if i == step), None) for t in titles]
        if None in around or not around[0].tag or len({id(n) for n in around}) < len(titles):
            break
        for name in _names(around[0]):
            if {id(n) for n in found(root, name)} == {id(n) for n in around}:
                return name
    return item


@_column("string")
def reduced(text: str, siblings: int = 3, most: int = 20_000) -> str:
    """A page's structure for a reader: tags with id and class, texts, the first few of siblings that look alike, cut at a length."""
    out: list[str] = []
    size, todo = 0, [parse(text)]
    while todo and size < most:
        x = todo.pop()
        if isinstance(x, str):
            piece = re.sub(r"\s+", " ", x)
        else:
            said = "".join(f' {k}="{x.attrs[k]}"' for k in ("id", "class", "href") if x.attrs.get(k))
            piece = f"<{x.tag}{said}>" if x.tag else ""
            alike: dict[tuple, int] = {}
            inside: list[Node | str] = []
            for c in x.children:
                if isinstance(c, Node):
                    kind = (c.tag, c.attrs.get("class"))
                    alike[kind] = alike.get(kind, 0) + 1
                    if c.tag in NOISE or alike[kind] > siblings:
                        continue
                inside.append(c)
            todo += [*([f"</{x.tag}>"] if x.tag else []), *reversed(inside)]
        out.append(piece)
        size += len(piece)
    return "".join(out)[:most].strip()
