from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

from sparrowline.llm import main_text
from sparrowline.llm.html_blocks import Paths, blocks_of
from sparrowline.llm.page_layouts import page

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def texts(source):
    return [b.text for b in blocks_of(source, Paths())]


def test_blocks_of_ragged_markup():
    assert texts("<p>a<b>b</b>c<br>d &amp; e&nbsp;f<p>g<ul><li>h<li>i</ul>j") == ["abc d & e f", "g", "h", "i", "j"]
    assert texts("x<!-- <p>y</p> --><script>var t='</p><p>z';</script><STYLE>p{}</style><noscript>n</noscript>w") == ["xw"]
    assert texts('<div title="a > b">one</div><table><tr><td>two<td>three<tr><th>four</table></div></p>five') == ["one", "two", "three", "four", "five"]
    assert texts("<div>1 &lt; 2 & 3 < 4</div><a href='x") == ["1 < 2 & 3 < 4"]
    assert texts("<p>open <!-- never closed <p>gone") == ["open"] and texts("") == [] == texts(" \n<p></p>")


def test_blocks_know_their_path_and_links():
    paths = Paths()
    [nav, rest] = blocks_of("<nav class='mainMenu top-bar'><a href=#>go</a></nav><div>see <a href=#>this</a></div>", paths)
    assert paths.tags[nav.path] == "nav" and paths.words[nav.path] == ("main", "menu", "top", "bar")
    assert nav.linked == len(nav.text) == 2 and rest.linked == 4 and paths.tags[rest.path] == "div"


def test_deep_and_hostile_pages_take_linear_time():
    for source in ("<div>" * 200_000 + "x", "<ul><li>" * 50_000 + "</b></li>" * 50_000 + "<td>y" * 50_000, "<a " * 200_000, "<p '" * 100_000, "<td><div>" * 50_000 + "<li>" * 50_000 + "z"):
        blocks_of(source, Paths())


def test_made_pages_are_read_as_they_were_made():
    for seed in range(300):
        source, known = page(seed)
        assert texts(source) == [" ".join(text.split()) for _, text in known]


def plain_scores(model, paths, blocks):
    """The labeller step by step, one block after the other."""
    size = model.state.shape[1]
    inputs = [(main_text.path_vectors(paths)[b.path], main_text.text_vectors([b])[0]) for b in blocks]
    hidden = np.zeros((len(blocks), 2 * size))
    for direction, order in enumerate((range(len(blocks)), range(len(blocks) - 1, -1, -1))):
        h = c = np.zeros(size)
        for t in order:
            z = inputs[t][0] @ model.paths[direction] + inputs[t][1] @ model.texts[direction] + h @ model.state[direction] + model.bias[direction]
            i, f, o = (1 / (1 + np.exp(-z[k * size : (k + 1) * size])) for k in range(3))
            c = f * c + i * np.tanh(z[3 * size :])
            h = o * np.tanh(c)
            hidden[t, direction * size : (direction + 1) * size] = h
    return hidden @ model.label + model.threshold


def test_labelling_together_is_step_by_step():
    model, paths = main_text.trained(), Paths()
    pages = [blocks_of(page(s)[0], paths) for s in range(7_000, 7_020)] + [[]]
    by_path = main_text.path_vectors(paths) @ model.paths
    some = [p for p in pages if p]
    want = [plain_scores(model, paths, p) for p in some]
    assert np.allclose(main_text.scores(model, by_path, some), np.concatenate(want), atol=1e-3)
    for blocks, found in zip(some, want):
        assert np.allclose(main_text._long_scores(model, by_path, blocks, chunk=5), found, atol=1e-3)
    alone = [main_text.labels(model, paths, [p])[0].tolist() for p in pages]
    assert [x.tolist() for x in main_text.labels(model, paths, pages)] == alone == [x.tolist() for x in main_text.labels(model, paths, pages, chunk=4)]


def test_the_learned_gradient_is_the_numeric_one():
    paths, rng = Paths(), np.random.default_rng(0)
    pages = [blocks_of(page(s)[0], paths)[:6] for s in range(20, 26)]
    pages = [p for p in pages if p]
    path = main_text.path_vectors(paths)[[b.path for p in pages for b in p]].astype(np.float64)
    text = np.concatenate([main_text.text_vectors(p) for p in pages]).astype(np.float64)
    label = rng.integers(0, 2, len(path)).astype(np.float64)
    lengths = np.array([len(p) for p in pages])
    trainer = main_text._Trainer(3, 1)
    trainer.model = main_text.Model(*[w.astype(np.float64) for w in trainer.model])
    seen = []
    trainer._update = lambda gradients, rate: seen.append(gradients)
    trainer.learn(path, text, label, lengths, 0)
    for k, w in enumerate(trainer.model):
        at = tuple(int(rng.integers(n)) for n in w.shape) if k != 0 else tuple(np.argwhere(np.abs(seen[0][0]) > 1e-4)[0])
        losses = []
        for step in (1e-4, -1e-4):
            moved = w.copy()
            moved[at] += step
            other = main_text._Trainer(3, 1)
            other.model = trainer.model._replace(**{main_text.Model._fields[k]: moved})
            other._update = lambda gradients, rate: None
            losses.append(other.learn(path, text, label, lengths, 0))
        assert abs((losses[0] - losses[1]) / 2e-4 - seen[0][k][at]) < 1e-4


def test_held_out_pages():
    """Pages that the labeller has never seen: at least 0.99 of their blocks are labelled right."""
    paths, pages, known = Paths(), [], []
    for seed in range(50_000, 50_500):
        source, labels = page(seed)
        pages.append(blocks_of(source, paths))
        known += [label for label, _ in labels]
    found = np.concatenate(main_text.labels(main_text.trained(), paths, pages))
    assert (found == np.array(known)).mean() >= 0.99


HAND = """<html><body><header class="site-header"><a href="/">The Daily Paper</a></header><div class="cookie-banner"><p>We use cookies.</p><button>Accept</button></div>
<div id="nav"><ul><li><a href="/a">Sports</a></li><li><a href="/b">Politics</a></li></ul></div>
<div class="post-content"><h1>A title &amp; more</h1><p>First   paragraph of
the story, with <a href="/x">a link</a>.</p><div class="ad-slot">Buy now!</div><p>Second paragraph of the story. It goes on.</p><ul><li>One point.</li><li>Another point.</li></ul></div>
<section class="comments"><h3>2 Comments</h3><div class="comment"><p>I liked this story very much. Thank you.</p></div></section>
<aside><h4>Related</h4><ul><li><a href="/c">Other story</a></li></ul></aside><form><label>Email</label><input><button>Send</button></form>
<footer>&copy; 2024 The Daily Paper</footer></body></html>"""


def test_a_page_of_another_hand():
    want = ["A title & more", "First paragraph of the story, with a link.", "Second paragraph of the story. It goes on.", "One point.", "Another point."]
    assert main_text.main_texts(main_text.trained(), [HAND]) == ["\n\n".join(want)]


def test_edges(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        long = "<article><h1>Long</h1>" + "".join(f"<p>Paragraph {i} of a very long page, with words.</p>" for i in range(20_000)) + "</article><footer>end</footer>"
        rows = [(1, "u", HAND), (1, "u", HAND), (None, None, HAND), (2, "v", None), (3, "w", ""), (4, "x", "<nav><a href=#>a</a></nav>"), (5, "y", long)]
        kind = "page_id long, url string, html string, text string, HTML int"
        frame = spark.createDataFrame([(*r, "t", 1) for r in rows], kind)
        found = main_text.extract(frame)
        assert found.columns == ["page_id", "url", "text", "n_chars"]
        got = sorted(map(tuple, found.collect()), key=repr)
        model = main_text.trained()
        want = sorted([(i, u, t := main_text.main_texts(model, [h or ""])[0], len(t)) for i, u, h in rows], key=repr)
        assert got == want
        by_id = {r[0]: r for r in got}
        assert by_id[2][2:] == by_id[3][2:] == ("", 0) and by_id[5][2].count("\n\n") == 20_000
        assert main_text.extract(frame.limit(0)).collect() == []
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pages_against_their_article_elements(spark):
    """The tables' pages name their article; the labeller is not told, and finds it."""
    rows = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    found = {r.page_id: r.text for r in main_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    right = 0
    for page_id, source in rows:
        paths, want = Paths(), []
        for b in blocks_of(source, paths):
            at = b.path
            while at > 0 and paths.tags[at] != "article":
                at = paths.parents[at]
            want += [b.text] if at > 0 else []
        right += found[page_id] == "\n\n".join(want)
    assert len(found) == len(rows) and right >= 0.98 * len(rows)
