"""Leaf blocks of a web page: runs of text between block elements, with the path of elements above them.

A page is read in one pass, in time that grows with its length whatever it nests. Comments, scripts,
styles, templates, titles and other text that no reader sees make no blocks. Elements that a page
leaves open are closed as browsers do for paragraphs, list items, table cells and options; end tags
without start are ignored. Character references are decoded, white space (Unicode's, so a
no-break space too) becomes one space, and a block is trimmed; `<br>` is white space.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select"
    " summary table tbody td tfoot th thead tr ul".split()
)
#: Text in these is not read: they are dropped with all they hold.
UNREAD = "script|style|noscript|template|textarea|iframe|title|object|svg"
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({UNREAD})(?![\w-]){_INSIDE}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(/?)([a-z][^\s/>]*+)({_INSIDE}|[^>]*+)>|</?[a-z][^>]*+\Z",
    re.I | re.S,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What a start tag closes, and what stops the search for it.
_CLOSED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_INSIDE_P = {"button", "label", "option", "optgroup", "select", "legend", "caption"}
_SEEN_THROUGH = {"p", "div"} | _INSIDE_P


class Block(NamedTuple):
    #: Place of its path in the table of paths.
    path: int
    text: str
    #: Characters inside links.
    linked: int


class Paths:
    """Paths of elements as a table: an entry's parent, tag, and the words of its class, id and role.

    Equal paths of any pages share an entry, so what is worked out for a path is worked out once.
    """

    def __init__(self):
        self.parents, self.tags, self.words, self._known = [-1], [""], [()], {}

    def __len__(self) -> int:
        return len(self.tags)

    def child(self, parent: int, tag: str, attributes: str) -> int:
        key = parent, tag, attributes if "=" in attributes else ""
        found = self._known.get(key)
        if found is None:
            named = " ".join("".join(m.groups("")[1:]) for m in _NAMED.finditer(key[2]))
            words = tuple(w.lower() for w in _WORDS.findall(html.unescape(named)))
            found = self._known[key] = len(self.tags)
            self.parents.append(parent)
            self.tags.append(tag)
            self.words.append(words)
        return found


def blocks_of(page: str, paths: Paths) -> list[Block]:
    """The page's leaf blocks that hold text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    open_tags: dict[str, int] = {}
    pieces: list[str] = []
    linked, link_depth, path = 0, None, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(path, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def pop_until(depth: int) -> None:
        nonlocal path, link_depth
        while len(stack) > depth:
            open_tags[stack.pop()[0]] -= 1
        path = stack[-1][1] if stack else 0
        if link_depth is not None and len(stack) < link_depth:
            link_depth = None

    def close_implied(tag: str) -> None:
        if tag not in _INSIDE_P and open_tags.get("p"):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    pop_until(depth)
                    break
        if tag in _CLOSED:
            closed, stop = _CLOSED[tag]
            if not any(open_tags.get(t) for t in closed):
                return
            lowest, depth = None, len(stack) - 1
            while depth >= 0 and stack[depth][0] not in stop:
                if stack[depth][0] in closed:
                    lowest = depth
                elif lowest is not None or stack[depth][0] not in _SEEN_THROUGH:
                    break
                depth -= 1
            if lowest is not None:
                pop_until(lowest)

    at = 0
    for token in _TOKEN.finditer(page):
        start, end = token.span()
        if start > at:
            text = page[at:start]
            if "&" in text:
                text = html.unescape(text)
            pieces.append(text)
            if link_depth is not None:
                linked += len(text)
        at = end
        tag = token[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            link_depth = None if token[2] else len(stack)
        elif tag not in BLOCKS:
            continue
        elif token[2]:
            if open_tags.get(tag):
                flush()
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        pop_until(depth)
                        break
            elif tag == "p":
                flush()
        else:
            flush()
            close_implied(tag)
            if tag != "hr":
                path = paths.child(path, tag, token[4])
                stack.append((tag, path))
                open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        pieces.append(html.unescape(page[at:]))
    flush()
    return out
