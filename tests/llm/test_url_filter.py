from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from sparrowline.llm import url_filter as U


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/7x?q#f", "http://a.example.com/en/6", "http://notexample.com/en/7",
    "http://x.net/de/8", "http://example.net/de/8/", "http://example.net/de", "http://com/en/", "http://a.com?x=/en/",
    "http://a.org#/es/", "x://y://z.org/es/1", "http://É.org/es/é\n/x?", "http://a.org/es/1", "http://a.org/es/1", "http://fr.org/fr/9",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, score int")
    found = U.judge(df).collect()
    assert len(found) == len(URLS)
    for r in found:
        host, path, rule, verdict = plain(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert U.judge(df.limit(0)).count() == 0


def test_one_class_only_allows_the_rest(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/1"), (2, "http://b.fr/x")], "page_id long, url string")
    assert {r.page_id: (r.verdict, r.score) for r in U.judge(df).collect()} == {1: ("block", None), 2: ("allow", None)}


class PlainModel:
    """The same model by dictionaries: counts of (context, next character) by class; 0: accepted, 1: rejected."""

    def __init__(self, accepted, rejected):
        self.counts = tuple(Counter(g for t in texts for g in self.grams(t)) for texts in (accepted, rejected))
        self.after = [{}, {}]
        for c in (0, 1):
            for gram, n in self.counts[c].items():
                self.after[c].setdefault(gram[:-1], []).append(n)

    @staticmethod
    def grams(text):
        padded = U.START * U.ORDER + text + U.END
        return [padded[i - k : i + 1] for i in range(U.ORDER, len(padded)) for k in range(U.ORDER + 1)]

    def probability(self, c, window):
        if not window:
            return 1 / U.KINDS
        lower, here = self.probability(c, window[1:]), self.after[c].get(window[:-1])
        if not here:
            return lower
        return (self.counts[c][window] + len(here) * lower) / (sum(here) + len(here))

    def score(self, text):
        padded = U.START * U.ORDER + text + U.END
        windows = [padded[i : i + U.ORDER + 1] for i in range(len(text) + 1)]
        return sum(math.log(self.probability(1, w) / self.probability(0, w)) for w in windows) / len(windows)


def test_probabilities_are_witten_bell_and_sum_to_one():
    model = PlainModel(["abab", "abcb"], ["bbbb"])
    for context in ("ab", "zz", "\x02\x02ab"):
        seen = sorted({g[-1] for c in (0, 1) for g in model.counts[c]})
        for c in (0, 1):
            p = [model.probability(c, context + x) for x in seen]
            rest = (U.KINDS - len(seen)) * model.probability(c, context + "\u2603")
            assert math.isclose(sum(p) + rest, 1.0)
    assert model.score("bbbb") > 0 > model.score("abab")


def test_scores_are_those_of_the_plain_model(spark):
    rng = np.random.default_rng(5)
    texts = ["", "a", "\u2603\u2603", "x" * 400] + ["".join(rng.choice(list("abc/.7"), size=int(n))) for n in rng.integers(1, 30, 200)]
    texts = list(dict.fromkeys(texts))
    kinds = [(int(k == 1), int(k == 2)) for k in rng.integers(0, 3, len(texts))]
    rows = spark.createDataFrame([(i, t, *k) for i, (t, k) in enumerate(zip(texts, kinds))], "id long, text string, accepted int, rejected int")
    model = PlainModel(*([t for t, k in zip(texts, kinds) if k[c]] for c in (0, 1)))
    found = {r.id: r.score for r in U.scored(rows).collect()}
    assert len(found) == len(texts)
    assert all(math.isclose(found[i], model.score(t), abs_tol=1e-9) for i, t in enumerate(texts))


def test_verdicts_of_the_whole_are_those_of_the_plain_model(spark):
    rng = np.random.default_rng(6)
    ends = ["a.com/en/", "b.net/de/", "c.org/es/", "d.fr/en/", "e.fr/de/"]
    urls = [f"https://{rng.choice(list('pqrs'))}{ends[rng.integers(0, 5)]}{''.join(rng.choice(list('xyz123'), size=6))}" for _ in range(500)]
    urls += urls[:30] + ["https://hot.fr/en/x"] * 300
    found = U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    plain_of = {u: plain(u) for u in urls}
    text = {u: h + p for u, (h, p, _, _) in plain_of.items()}
    names = sorted(set(text.values()))
    kept = spark.createDataFrame([(t,) for t in names], "text string").selectExpr("text", "pmod(xxhash64(text, 'kept'), 5) = 0 AS kept")
    kept = {r.text for r in kept.collect() if r.kept}
    decided = {text[u]: v for u, (_, _, _, v) in plain_of.items() if v}
    model = PlainModel(*([t for t in names if decided.get(t) == v and t not in kept] for v in ("allow", "block")))
    limit = U.threshold(*(np.array([model.score(t) for t in names if decided.get(t) == v and t in kept]) for v in ("allow", "block")))
    assert len(found) == len(urls)
    for r in found:
        score = model.score(text[urls[r.page_id]])
        assert math.isclose(r.score, score, abs_tol=1e-9)
        if abs(score - limit) > 1e-9:
            assert r.verdict == (decided.get(text[urls[r.page_id]]) or ("block" if score > limit else "allow"))


def test_threshold_is_the_best_split():
    rng = np.random.default_rng(1)
    a, r = rng.normal(0, 1, 200), rng.normal(2, 1, 150)
    cut = U.threshold(a, r)
    gain = lambda x: (a <= x).mean() - (r <= x).mean()
    assert gain(cut) >= max(gain(x) for x in np.r_[a, r]) - 1e-9


def test_model_learns_what_rules_do(spark):
    rows = [(i, f"http://h{i % 7}.{'example.com/en' if i % 3 else 'site.net/de'}/{i}") for i in range(600)]
    rows += [(1000 + i, f"http://h{i}.other.fr/{'en' if i % 2 else 'de'}/{i}") for i in range(40)]
    found = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert found[1001].score > found[1000].score


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_the_cut_is_that_of_all_scores(spark, seed):
    """Over 10,000 scores a class: the best cut of all of them, not of some."""
    rng = np.random.default_rng(seed)
    a, r = np.round(rng.normal(-0.3, 1, 30_000), 9), np.round(rng.normal(0.3, 1, 25_000), 9)
    scores = spark.createDataFrame(pd.DataFrame({"blocked": np.r_[np.zeros(len(a), int), np.ones(len(r), int)], "score": np.r_[a, r]})).repartition(7)
    assert abs(U.best_cut(scores) - U.threshold(a, r)) < 1e-12
    assert U.best_cut(scores.filter("blocked = 0")) == 0.0
