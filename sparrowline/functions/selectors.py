"""CSS selectors over a page's tree.

A selector is compiled once a process. It is matched against a table of the page's elements in
document order (parent, sibling before, places among siblings, end of subtree), made once a page.
Each step of a selector is one pass over that table, so the cost is elements times steps whatever
the page nests, and all elements that a selector finds are known at once: finding them inside one
element of a list is a slice of that result.

Understood: lists, `>`, `+`, `~` and descendants; tags, `*`, `.class`, `#id`, escapes; attributes with
`=`, `~=`, `|=`, `^=`, `$=`, `*=`, `!=` and the flag `i`; `:not`, `:is`, `:where`, `:has`, `:nth-child(an+b of S)` and
its kin, `:first-child` and its kin, `:empty`, `:root`, `:contains`. Anything else is refused by a
`SelectorError` that says what and where; column functions give that reason in the row.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Callable
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from sparrowline.functions.html import Node

_ESCAPE = r"\\[0-9a-fA-F]{1,6}\s?|\\[^\n]"
IDENT = rf"-?(?:[a-zA-Z_]|[^\x00-\x7f]|{_ESCAPE}|-)(?:[\w-]|[^\x00-\x7f]|{_ESCAPE})*"
STRING = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"
ATTRIBUTE = rf"\[\s*({IDENT})\s*(?:([~|^$*!]?=)\s*({STRING}|[^\s\]\"']+)\s*([iIsS])?\s*)?\]"
NTH = r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*"

Test = Callable[["Page", int], bool]
#: Steps of a selector: how it stands to the step before, and what an element must pass.
Steps = list[tuple[str, list[Test]]]


class SelectorError(ValueError):
    """A selector that is not understood, with the reason."""


class Page:
    """A page's elements in document order. Number 0 is the document itself, which no selector finds."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.parent, self.before, self.end = [-1], [-1], [0]
        self.place, self.place_of_type, self.after, self.after_of_type = [1], [1], [0], [0]
        self.of_node = {id(root): 0}
        self.found: dict[object, list[int]] = {}
        self._text: tuple[str, list[int], list[int]] | None = None
        todo: list[tuple[Node, int]] = [(root, 0)]
        self.children: list[list[int]] = [[]]
        while todo:
            node, at = todo.pop()
            if node is not root:
                at = self._add(node, at)
            todo += [(c, at) for c in reversed(node.children) if not isinstance(c, str)]
        for at in range(len(self.nodes) - 1, 0, -1):
            self.end[at] = max(self.end[at], at + 1)
            self.end[self.parent[at]] = max(self.end[self.parent[at]], self.end[at])
        for inside in self.children:
            seen: dict[str, int] = {}
            for after, i in enumerate(reversed(inside), 1):
                seen[self.nodes[i].tag] = seen.get(self.nodes[i].tag, 0) + 1
                self.after[i], self.after_of_type[i] = after, seen[self.nodes[i].tag]
            seen = {}
            for place, i in enumerate(inside, 1):
                seen[self.nodes[i].tag] = seen.get(self.nodes[i].tag, 0) + 1
                self.place[i], self.place_of_type[i] = place, seen[self.nodes[i].tag]

    def _add(self, node: Node, parent: int) -> int:
        at, inside = len(self.nodes), self.children[parent]
        self.of_node[id(node)] = at
        self.nodes.append(node)
        self.parent.append(parent)
        self.before.append(inside[-1] if inside else -1)
        inside.append(at)
        self.children.append([])
        for column in (self.end, self.place, self.place_of_type, self.after, self.after_of_type):
            column.append(0)
        return at

    def __len__(self) -> int:
        return len(self.nodes)

    def text(self) -> tuple[str, list[int], list[int]]:
        """All text of the page and where each element's begins and ends in it."""
        if self._text is None:
            starts, ends, parts, size = [0] * len(self), [0] * len(self), [], 0
            todo: list = [self.nodes[0]]
            while todo:
                x = todo.pop()
                if isinstance(x, str):
                    parts.append(x)
                    size += len(x)
                elif isinstance(x, int):
                    ends[x] = size
                else:
                    at = self.of_node[id(x)]
                    starts[at] = size
                    todo += [at, *reversed(x.children)]
            self._text = "".join(parts), starts, ends
        return self._text

    def fits(self, selectors: tuple[Steps, ...]) -> bytearray:
        """For each element whether a list of selectors finds it."""
        out = bytearray(len(self))
        for steps in selectors:
            for i in self._last(steps):
                out[i] = 1
        return out

    def _last(self, steps: Steps) -> list[int]:
        now: bytearray | None = None
        for how, tests in steps:
            reach = None if now is None else self._reached(how, now)
            now = bytearray(len(self))
            for i in range(1, len(self)):
                if (reach is None or reach[i]) and all(t(self, i) for t in tests):
                    now[i] = 1
        return [i for i, x in enumerate(now) if x]

    def _reached(self, how: str, now: bytearray) -> bytearray:
        """Elements that stand so to one that is found."""
        out = bytearray(len(self))
        for i in range(1, len(self)):
            p, b = self.parent[i], self.before[i]
            if how == " ":
                out[i] = now[p] or out[p]
            elif how == ">":
                out[i] = now[p]
            elif b >= 0:
                out[i] = now[b] or (how == "~" and out[b])
        return out

    def _holding(self, how: str, now: bytearray) -> bytearray:
        """Elements to which one that is found stands so."""
        out = bytearray(len(self))
        for i in range(len(self) - 1, 0, -1):
            p, b = self.parent[i], self.before[i]
            if how == " ":
                out[p] |= now[i] | out[i]
            elif how == ">":
                out[p] |= now[i]
            elif b >= 0:
                out[b] |= now[i] | (out[i] if how == "~" else 0)
        return out

    def having(self, selectors: tuple[Steps, ...]) -> bytearray:
        """For each element whether a list of selectors finds something that starts from it."""
        out = bytearray(len(self))
        for steps in selectors:
            now = bytearray(b"\1" * len(self))
            for how, tests in reversed(steps):
                for i in range(1, len(self)):
                    if now[i] and not all(t(self, i) for t in tests):
                        now[i] = 0
                now[0] = 0
                now = self._holding(how, now)
            for i, x in enumerate(now):
                out[i] |= x
        return out

    def kept(self, key: object, make: Callable[[], bytearray]) -> bytearray:
        """What has been worked out for this page under a key."""
        if key not in self.found:
            self.found[key] = make()
        return self.found[key]

    def select(self, text: str, inside: Node | None = None) -> list[Node]:
        """Elements that a selector finds, in document order; those within an element, or all."""
        key = "all", text
        if key not in self.found:
            found = self.fits(compiled(text))
            self.found[key] = [i for i in range(1, len(self)) if found[i]]
        some = self.found[key]
        if inside is not None and (at := self.of_node[id(inside)]):
            some = some[bisect_left(some, at + 1) : bisect_left(some, self.end[at])]
        return [self.nodes[i] for i in some]


    def finds(self, text: str, node: Node) -> bool:
        """A selector finds this element."""
        at = self.of_node[id(node)]
        self.select(text, node)
        some = self.found["all", text]
        place = bisect_left(some, at)
        return place < len(some) and some[place] == at


def _plain(text: str) -> str:
    """An identifier or the inside of a string without its escapes."""
    return re.sub(r"\\([0-9a-fA-F]{1,6})\s?|\\(.)", lambda m: chr(int(m[1], 16)) if m[1] and 0 < int(m[1], 16) < 0x110000 else m[2] or "\ufffd", text, flags=re.S)


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, reason: str):
        raise SelectorError(f"{reason} at {self.at}: {self.text!r}")

    def take(self, pattern: str) -> re.Match | None:
        m = re.compile(pattern, re.S).match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def list(self, relative: bool = False, inside: bool = False) -> tuple[Steps, ...]:
        out = []
        while True:
            out.append(self.steps(relative))
            self.take(r"\s*")
            if self.take(","):
                continue
            if inside and self.take(r"\)"):
                return tuple(out)
            if not inside and self.at == len(self.text):
                return tuple(out)
            self.fail("unexpected sign" if self.at < len(self.text) else "unexpected end")

    def steps(self, relative: bool) -> Steps:
        self.take(r"\s*")
        how = " "
        if m := self.take(r"([>+~])\s*"):
            how = m[1] if relative else self.fail("nothing before a combinator")
        out = [(how, self.tests())]
        while True:
            space = self.take(r"\s+")
            if m := self.take(r"([>+~])\s*"):
                how = m[1]
            elif space and self.at < len(self.text) and self.text[self.at] not in ",)":
                how = " "
            else:
                return out
            out.append((how, self.tests()))

    def tests(self) -> list[Test]:
        start, out = self.at, []
        if m := self.take(IDENT):
            out.append(_tag(_plain(m[0]).lower()))
        else:
            self.take(r"\*")
        while True:
            if m := self.take(rf"\.({IDENT})"):
                out.append(_class(_plain(m[1])))
            elif m := self.take(rf"#((?:[\w-]|[^\x00-\x7f]|{_ESCAPE})+)"):
                out.append(_attribute("id", "=", _plain(m[1]), False))
            elif m := self.take(ATTRIBUTE):
                value = m[3] or ""
                value = _plain(value[1:-1] if value[:1] in ("'", '"') else value)
                out.append(_attribute(_plain(m[1]).lower(), m[2] or "", value, (m[4] or "").lower() == "i"))
            elif m := self.take(rf":(?!:)({IDENT})(\()?"):
                out.append(self.pseudo(m[1].lower(), bool(m[2])))
            elif self.at == start:
                self.fail("nothing to select" if self.at == len(self.text) or self.text[self.at] in ",)>+~" else "not understood")
            elif self.at < len(self.text) and self.text[self.at] not in " \t\r\n\f,)>+~":
                self.fail("not understood")
            else:
                return out

    def pseudo(self, name: str, called: bool) -> Test:
        if called and name in ("not", "is", "where", "matches", "has"):
            start = self.at
            inner = self.list(relative=name == "has", inside=True)
            key = name == "has", self.text[start : self.at]
            if name == "has":
                return lambda page, i: bool(page.kept(key, lambda: page.having(inner))[i])
            return lambda page, i: bool(page.kept(key, lambda: page.fits(inner))[i]) is not (name == "not")
        if called and name in ("contains", "-soup-contains"):
            said = []
            while m := self.take(rf"\s*({STRING}|[^\s,)\"']+)\s*(?:,(?=\s*[^\s)])|(?=\)))"):
                said.append(_plain(m[1][1:-1] if m[1][:1] in "'\"" else m[1]))
            if not said or not self.take(r"\)"):
                self.fail("no text to look for")
            return lambda page, i: any(_says(page, i, x) for x in said)
        if called and name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
            m = self.take(NTH)
            if not m:
                self.fail("no number")
            a, b = {"odd": (2, 1), "even": (2, 0)}.get(m[1]) or ((0, int(m[5])) if m[5] else (int(m[2] + "1" if m[2] in ("", "+", "-") else m[2]), int(f"{m[3] or '+'}{m[4] or 0}")))
            inner, start = None, self.at
            if name.endswith("child") and self.take(r"of\s"):
                inner = self.list(inside=True)
            elif not self.take(r"\)"):
                self.fail("not understood")
            return _nth(name, a, b, inner, self.text[start : self.at])
        plain = {
            "first-child": ("place",),
            "last-child": ("after",),
            "only-child": ("place", "after"),
            "first-of-type": ("place_of_type",),
            "last-of-type": ("after_of_type",),
            "only-of-type": ("place_of_type", "after_of_type"),
        }
        if not called and name in plain:
            columns = plain[name]
            return lambda page, i: all(getattr(page, c)[i] == 1 for c in columns)
        if not called and name == "root":
            return lambda page, i: page.parent[i] == 0
        if not called and name == "empty":
            return lambda page, i: not any(not isinstance(c, str) or c.strip() for c in page.nodes[i].children)
        return self.fail(f":{name} is not supported")


def _says(page: Page, i: int, said: str) -> bool:
    """The element's text holds another; where that stands in the page is looked up once."""
    text, starts, ends = page.text()
    key = "says", said
    if key not in page.found:
        page.found[key] = [m.start() for m in re.finditer(f"(?={re.escape(said)})", text)]
    places = page.found[key]
    at = bisect_left(places, starts[i])
    return at < len(places) and places[at] + len(said) <= ends[i]


def _tag(name: str) -> Test:
    return lambda page, i: page.nodes[i].tag == name


def _class(name: str) -> Test:
    return lambda page, i: name in page.nodes[i].attrs.get("class", "").split()


def _attribute(name: str, how: str, value: str, any_case: bool) -> Test:
    value = value.lower() if any_case else value

    def test(page: Page, i: int) -> bool:
        said = page.nodes[i].attrs.get(name)
        if said is None:
            return how == "!="
        said = said.lower() if any_case else said
        if how == "":
            return True
        if how in ("=", "!="):
            return (said == value) is (how == "=")
        if how == "~=":
            return value in said.split()
        if how == "|=":
            return said == value or said.startswith(f"{value}-")
        if not value:
            return False
        return said.startswith(value) if how == "^=" else said.endswith(value) if how == "$=" else value in said

    return test


def _nth(name: str, a: int, b: int, inner: tuple[Steps, ...] | None, key: str) -> Test:
    column = ("after" if "last" in name else "place") + ("_of_type" if name.endswith("type") else "")

    def among(page: Page) -> list[int]:
        """Each element's place among those of its siblings that the inner selector finds; 0 for others."""
        found, out = page.fits(inner), [0] * len(page)
        for inside in page.children:
            n = 0
            for i in reversed(inside) if "last" in name else inside:
                n += found[i]
                out[i] = n if found[i] else 0
        return out

    def test(page: Page, i: int) -> bool:
        place = getattr(page, column)[i] if inner is None else page.kept((column, key), lambda: among(page))[i]
        if not place:
            return False
        return place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0

    return test


@functools.lru_cache(maxsize=4096)
def compiled(text: str) -> tuple[Steps, ...]:
    if not text.strip():
        raise SelectorError("an empty selector")
    return _Reader(text.strip()).list()


def refusal(text: str) -> str | None:
    """Why a selector is not understood; null where it is."""
    try:
        compiled(text)
    except SelectorError as e:
        return str(e)
    return None
