"""Selectors against a plain matcher that tries every way, over random pages and selectors."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparrowline.functions import coverage, html, pages
from sparrowline.functions.selectors import SelectorError, compiled, refusal

TAGS, CLASSES = ["div", "p", "li", "a", "b"], ["x", "y", "z"]


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(1, 4)):
        if rng.random() < 0.2:
            out += rng.choice(["text", " ", "job"])
            continue
        tag = rng.choice(["div", "a", "b", "i"])  # nothing that closes itself
        said = f' class="{" ".join(rng.sample(CLASSES, rng.randrange(3)))}"' if rng.random() < 0.6 else ""
        said += f' href="/{rng.choice(["job", "a-b", "x y"])}"' if rng.random() < 0.4 else ""
        out += f"<{tag}{said}>{random_page(rng, depth + 1) if depth < 4 else ''}</{tag}>"
    return out


class Plain:
    """A naive matcher over steps written as plain data: (how, tag, [(kind, value)])."""

    def __init__(self, root):
        self.root = root

    def siblings(self, n):
        return [c for c in n.parent.children if not isinstance(c, str)]

    def fits(self, n, compound):
        tag, tests = compound
        if tag and n.tag != tag:
            return False
        for kind, value in tests:
            beside = self.siblings(n)
            same = [c for c in beside if c.tag == n.tag]
            href = n.attrs.get("href")
            ok = {
                "class": lambda: value in n.attrs.get("class", "").split(),
                "has href": lambda: href is not None,
                "starts": lambda: href is not None and href.startswith(value),
                "ends": lambda: href is not None and href.endswith(value),
                "holds": lambda: href is not None and value in href,
                "nth": lambda: beside.index(n) + 1 in [value[0] * k + value[1] for k in range(50)],
                "nth last": lambda: beside[::-1].index(n) + 1 in [value[0] * k + value[1] for k in range(50)],
                "nth type": lambda: same.index(n) + 1 in [value[0] * k + value[1] for k in range(50)],
                "not": lambda: not self.fits(n, value),
                "has child": lambda: any(not isinstance(c, str) and self.fits(c, value) for c in n.children),
                "has below": lambda: any(c is not n and self.fits(c, value) for c in n.nodes()),
            }[kind]()
            if not ok:
                return False
        return True

    def walk(self, n, steps):
        if not self.fits(n, steps[-1][1]):
            return False
        if len(steps) == 1:
            return True
        how = steps[-1][0]
        up = n.parent
        if how == ">":
            return up is not self.root and self.walk(up, steps[:-1])
        if how == " ":
            while up is not self.root:
                if self.walk(up, steps[:-1]):
                    return True
                up = up.parent
            return False
        beside = self.siblings(n)
        at = beside.index(n)
        some = beside[max(0, at - 1) : at] if how == "+" else beside[:at]
        return any(self.walk(b, steps[:-1]) for b in some)


def random_compound(rng, simple=False):
    tag, tests, said = "", [], ""
    if rng.random() < 0.5:
        tag = said = rng.choice(["div", "a", "b", "i"])
    for _ in range(rng.randrange(0 if tag else 1, 3)):
        kind = rng.choice(["class", "has href", "starts", "ends", "holds"] if simple else ["class", "class", "has href", "starts", "ends", "holds", "nth", "nth last", "nth type", "not", "has child", "has below"])
        value: object = None
        if kind == "class":
            value = rng.choice(CLASSES)
            said += f".{value}"
        elif kind == "has href":
            said += "[href]"
        elif kind in ("starts", "ends", "holds"):
            value = rng.choice(["/job", "b", "a-", "x y"])
            said += "[href%s%s]" % ({"starts": "^=", "ends": "$=", "holds": "*="}[kind], f'"{value}"' if rng.random() < 0.5 or " " in value or "/" in value else value)
        elif kind.startswith("nth"):
            value = rng.choice([(0, 1), (0, 2), (2, 1), (2, 0), (3, 2), (-1, 2), (1, 2)])
            name = {"nth": "nth-child", "nth last": "nth-last-child", "nth type": "nth-of-type"}[kind]
            said += f":{name}({value[1] if not value[0] else f'{value[0]}n+{value[1]}'})"
        else:
            value, inner = random_compound(rng, simple=True)
            said += {"not": ":not(%s)", "has child": ":has(> %s)", "has below": ":has(%s)"}[kind] % inner
        tests.append((kind, value))
    return (tag, tests), said or "*"


@pytest.mark.parametrize("seed", range(150))
def test_selectors_are_a_plain_walk(seed):
    rng = random.Random(seed)
    root = html.parse(random_page(rng))
    plain = Plain(root)
    for _ in range(6):
        lists, said = [], []
        for _ in range(rng.choice([1, 1, 2])):
            steps, text = [], ""
            for k in range(rng.randrange(1, 4)):
                how = rng.choice([" ", ">", "+", "~"])
                compound, words = random_compound(rng)
                text += words if not k else (f" {how} " if how != " " else " ") + words
                steps.append((how, compound))
            lists.append(steps)
            said.append(text)
        selector = rng.choice([",", ", "]).join(said)
        want = [n for n in root.nodes() if n is not root and any(plain.walk(n, s) for s in lists)]
        assert [id(n) for n in html.select(root, selector)] == [id(n) for n in want], selector
        for scope in want[:3]:
            inside = {id(n) for n in scope.nodes()} - {id(scope)}
            assert [id(n) for n in html.select(scope, selector)] == [id(n) for n in want if id(n) in inside]


@pytest.mark.parametrize("text", ["", " ", "li >", "> li", "a,,b", "a[href", "a[=x]", "li::before", ":hover", ":not(", "a:nth-child(x)", "..a", "#", "a $ b", "svg|a", ".1a"])
def test_what_is_refused_has_a_reason(text):
    with pytest.raises(SelectorError):
        compiled(text)
    assert refusal(text)


def test_escapes_and_signs():
    root = html.parse("<a class='w-1/2 가' id='1st'>x</a><a href='A.HTML'>y</a>")
    for text in (".w-1\\/2", ".가", "#\\31 st", "[id='1st']", "a:first-child", "[class~='가']"):
        assert [n.children for n in html.select(root, text)] == [["x"]], text
    assert [n.children for n in html.select(root, "a[href$=html i]")] == [["y"]] and html.select(root, "a[href$=html]") == []


def test_one_bad_selector_ends_no_job(spark):
    page = F.lit("<ul><li><a href=/1>one</a></ul>")
    row = spark.range(1).select(
        pages.posting_items(page, "li:hover", "a", "a", "", "", "https://x.example").alias("items"), pages.item_links(page, "li", "a[", "").alias("links"),
        pages.posting_detail(page, (("title", "a"), ("body", "ul >"))).alias("detail"), html.list_items(page, "li >", "a", "https://x.example").alias("none"),
        html.detail_fields(page, (("title", "li > a"), ("body", "::x"))).alias("fields"), pages.source_text(page, "a::b").alias("text"),
    ).first()
    assert row["items"][0]["index"] is None and row["items"][0].failed.startswith("item: :hover is not supported")
    assert row.links[0].reason.startswith("link: ") and row.detail["title"] == "one" and row.detail["_refused"].startswith("body: ")
    assert row.none == [] and row.fields == {"title": "one", "body": None} and row.text == ""


def test_checks_of_nothing(spark):
    rows = spark.createDataFrame([(None, None, None), ("{}", "", ""), ('{"list": {"item": "li"}, "detail": null}', "<li>", None), ("[]", "", "")], "s string, l string, d string")
    found = [r.c for r in rows.select(coverage.checks(F.col("s"), F.col("l"), F.col("d")).alias("c")).collect()]
    assert [f[0].name for f in found] == ["selectors", "list.item", "list.item", "selectors"]
    assert [(f.name, f.status) for f in found[2]] == [("list.item", "ok"), ("list.title", "failed")]


def test_buttons_and_options_are_no_labels():
    deadline = pages.labelled_deadline.plain
    assert deadline("<button>마감일 2024.1.1</button><select><option>마감일 2024.1.2</option></select>") == ""
    assert deadline("<div><button>마감일</button></div><p>마감일: 2024.1.3 까지</p>") == "2024.1.3"


def test_deep_pages_are_read_in_linear_time():
    import time

    def seconds(n):
        page = "".join(f"<div class=d{i % 7}>step {i} " for i in range(n)) + "<span>마감일</span><span>2024.1.1</span>"
        began = time.perf_counter()
        assert pages.labelled_deadline.plain(page) == "2024.1.1"
        assert pages.labelled_info.plain(page, ("마감일",)) == {"마감일": "2024.1.1"}
        return time.perf_counter() - began

    seconds(100)
    began = time.perf_counter()
    assert html.parse("<div>" * 20_000 + "</b></p>" * 20_000).nodes()
    assert time.perf_counter() - began < 5
    assert seconds(20_000) < 20 * max(seconds(2_000), 0.05)


def test_payloads_tell_what_a_reader_is_told():
    said = html.payload_text.plain
    assert said('{"a": {"place": "서울 (본사)", "body": "<p>line one</p><p>line two</p>"}}') == "place: 서울 (본사)\nbody: line one\nline two"
    assert said('{"x": "https://x.example\\n■ 급여 : 협의"}') == "x: ■ 급여 : 협의"
    assert said('{"l": [{"k": "같은 문장을 두 번 말한다", "e": "같은 문장을 두 번 말한다"}, {"k": "같은 문장을 두 번 말한다"}]}') == "\n".join(["k: 같은 문장을 두 번 말한다"] * 2)
    assert said('{"a": "Seoul", "b": "Seoul", "m": "[Finance]", "c": "FORM", "d": "a1", "n": 7.5, "t": true}') == "a: Seoul\nb: Seoul\nm: [Finance]"
    assert said("no json") == said("[]") == said("null") == ""
