"""The queries over whole pages that have no SQL, against a plain walk of a tree that another reader makes."""

from __future__ import annotations

import html as entities
import os
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import duckdb
import pytest

from pyspark.sql import functions as F

from sparrowline.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())


class Walk(HTMLParser):
    """Events of a page, in order: (start, tag, attributes), (end, tag), (text, words)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.events = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.events.append(("end", tag, {}))

    def handle_data(self, data):
        self.events.append(("text", data, {}))


def shown(page, whole=False):
    """Texts that the page shows (of its body, or of all of it), with a line feed at each edge of a block."""
    out, hidden, inside = [], 0, whole
    for kind, x, _ in Walk(page).events:
        if kind == "text":
            out.append(x if inside and not hidden else "")
            continue
        hidden += {"start": 1, "end": -1}[kind] * (x in ("script", "style"))
        inside = inside or x == "body"
        if x in BLOCKS and inside:
            out.append("\n\n" if x == "br" else "\n")
    return "".join(out)


@pytest.fixture(scope="module")
def given():
    return dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


def squeezed(text):
    return " ".join(text.split())


def test_visible_text(spark, given):
    assert {r.page_id: r.text for r in rows(spark, "html_visible_text")} == {i: squeezed(shown(h)) for i, h in given.items()}


def test_block_text(spark, given):
    """The same words, in the same lines; how many blank lines stand between is told by other tests."""
    for r in rows(spark, "html_block_text"):
        want = [squeezed(x) for x in shown(given[r.page_id], whole=True).split("\n") if x.strip()]
        assert [x for x in r.text.split("\n") if x] == want
        assert "\n\n\n" not in r.text and r.text == r.text.strip()


def test_list_items(spark, given):
    want = []
    for i, page in given.items():
        nav = page[page.index("<nav>") : page.index("</nav>")]
        for place, (link, text) in enumerate(re.findall(r'<li><a href="([^"]*)">(.*?)</a></li>', nav, re.S)):
            want.append((i, place, squeezed(entities.unescape(text)), urljoin("https://example.com/list/", entities.unescape(link))))
    assert sorted((r.page_id, r["index"], r.title, r.link) for r in rows(spark, "html_list_items")) == sorted(want)


def test_detail_fields(spark, given):
    for r in rows(spark, "html_detail_fields"):
        page = given[r.page_id]
        title = squeezed(entities.unescape(re.search(r"<title>(.*?)</title>", page, re.S)[1]))
        assert squeezed(r.title or "") == title and r.none is None
        if "<p>" not in page:
            assert r.first is None
            continue
        start = squeezed(entities.unescape(re.sub("<[^>]*>", "", re.split("</p>|<br>|<p>", page[page.index("<p>") + 3 :])[0])))
        assert squeezed(r.first or "").startswith(start)


def test_sanitized(spark, given):
    allowed = {"p", "br", "ul", "ol", "li", "h1", "h2", "h3", "h4", "strong", "b", "em", "i", "a", "img", "table", "tr", "td", "th", "tbody", "thead"}
    for r in rows(spark, "html_sanitize"):
        events, page = Walk(r.html).events, given[r.page_id]
        assert {x for kind, x, _ in events if kind == "start"} <= allowed
        assert all(set(a) <= {"href", "src", "alt"} and all(v.startswith("http") for k, v in a.items() if k != "alt") for kind, _, a in events if kind == "start")
        # All words of the page but for hidden ones, in order: titles stand outside the body.
        said = "".join(x for kind, x, _ in events if kind == "text")
        assert re.sub(r"\s", "", said) == re.sub(r"\s", "", shown(page, whole=True))
        links = [urljoin("https://example.com/", a["href"]) for kind, x, a in Walk(page).events if kind == "start" and x == "a"]
        assert [a["href"] for kind, x, a in events if kind == "start" and x == "a"] == links


def test_json_ld(spark, given):
    assert {r.page_id: r.found for r in rows(spark, "jsonld_extract")} == {i: [f'{{"@type": "JobPosting", "id": {i}}}'] for i in given}


def test_a_single_file_is_dealt_to_all_cores(spark, tmp_path):
    """Columns over pages are dear by row: a table of one row group must not be one task."""
    from sparrowline.sources.tables import dealt, table

    spark.range(20_000).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = dealt(spark, str(tmp_path), "part")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2 * min(sizes)
    assert sorted(r.id for r in rows.collect()) == sorted(r.id for r in table(spark, str(tmp_path), "part").collect())


def test_queries_over_pages_deal_their_rows(spark):
    import os

    from sparrowline.plans import registry

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    for name in ("delivery_html_made", "page_fields_made", "selectors_made", "coverage_verdicts", "pieces_with_signs", "rules_html_text", "selector_coverage"):
        assert "RoundRobinPartitioning" in registry.queries()[name](spark, sf)._jdf.queryExecution().toString()
