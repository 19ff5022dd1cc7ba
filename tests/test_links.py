"""Inference against plain loops, imports against a plain database."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparrowline.operators import inference as I
from sparrowline.operators import merge as M

ENTRIES = "site string, request int, path string, size int, index int, key string, value string"


def squeezed(t):
    return " ".join(t.split())


def same_title(a, b):
    a, b = squeezed(a), squeezed(b)
    return a == b or (len(a) >= 6 and a in b and len(a) * 2 >= len(b))


def plain_list(found, titles):
    best = {}
    for site in {t[0] for t in titles}:
        mine = [squeezed(t) for s, t in titles if s == site and squeezed(t)]
        groups = {}
        for s, request, path, size, *_, value in found:
            if s == site:
                groups.setdefault((request, path, size), set()).update(t for t in mine if same_title(t, value))
        good = [(-len(h), abs(k[2] - len(mine)), k[0], k[1], k) for k, h in groups.items() if len(h) >= 2 and len(h) * 2 >= min(len(mine), k[2])]
        if good:
            n, _, _, _, k = min(good)
            best[site] = (*k, -n)
    return best


def plain_id(found, links):
    best = {}
    for site in {x[0] for x in found}:
        mine = sorted((p, link) for s, p, link in links if s == site)
        hits = {}
        for s, request, path, _, index, key, value in sorted(found):
            if s == site and 3 <= len(value) <= 64 and re.search(r"\d", value):
                token = re.compile(rf"(?<![0-9A-Za-z]){re.escape(value)}(?![0-9A-Za-z])")
                link = next((x for _, x in mine if token.search(x)), None)
                if link:
                    hits.setdefault(key, []).append(((request, path, index), value, link, token))
        usable = {k: sorted(h, key=lambda x: x[0]) for k, h in hits.items() if len(h) >= 2 and len({x[2] for x in h}) == len(h)}
        if usable:
            top = max((len(h), len(h[0][1])) for h in usable.values())
            best[site] = {(k, h[0][3].sub("{id}", h[0][2], count=1)) for k, h in usable.items() if (len(h), len(h[0][1])) == top}
    return best


@pytest.mark.parametrize("seed", range(2))
def test_inference_is_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    words = ["Engineer", "Senior  data", "QA", "Clerk (m/f)", "a.b", "Köln", "lead", "12"]
    found, titles, links = [], [], []
    for site in ("s", "t", "u"):
        for i in range(12):
            title = " ".join(rng.choices(words, k=rng.randrange(1, 4))) + (f" {i}" if rng.random() < 0.6 else "")
            if rng.random() < 0.7:
                titles.append((site, title if rng.random() < 0.7 else f" {title} "))
            value = title if rng.random() < 0.5 else f"x{title}y" if rng.random() < 0.5 else f"[{title}] and much more than twice as long as that {title}"
            found.append((site, rng.randrange(2), rng.choice(["a", "b.c"]), 6, i, "name", value))
            number = rng.choice([f"{100 + i}", f"A-{i}", f"/{10 + i}", f"{i}x-", "100", "a.b1"])
            found.append((site, 0, "a", 6, i, "no", number))
            found.append((site, 0, "a", 6, i, "seq", f"{i:03d}"))
            at = rng.choice(["https://x.example/v/%s?k=1", "https://x.example/%s", "https://x.example/p%s/", "https://x.example/v?id=%s&n=%s9"])
            links.append((site, i, at.replace("%s", number if rng.random() < 0.8 else f"{i:03d}", 1).replace("%s", number)))
    frames = [spark.createDataFrame(rows, kind) for rows, kind in ((found, ENTRIES), (titles, "site string, title string"), (links, "site string, place int, link string"))]
    got = {r.site: (r.request, r.path, r["size"], r.hits) for r in I.list_of_titles(frames[0], frames[1]).collect()}
    assert got == plain_list(found, titles)
    ids = {r.site: (r.key, r.template) for r in I.id_and_template(frames[0], frames[2]).collect()}
    want = plain_id(found, links)
    assert ids.keys() == want.keys() and all(ids[s] in want[s] for s in ids)


def test_a_very_large_site_is_no_nested_loop(spark):
    n = 100_000
    ids = spark.range(n).withColumn("site", F.concat(F.lit("s"), F.floor(F.col("id") / (n + 1))))
    number = F.col("id") + 1_000_000
    found = ids.select("site", F.lit(0).alias("request"), F.lit("jobs").alias("path"), F.lit(n).alias("size"), F.col("id").cast("int").alias("index"), F.explode(F.array(
        F.struct(F.lit("name").alias("key"), F.concat(F.lit("Engineer no "), number).alias("value")), F.struct(F.lit("no").alias("key"), number.cast("string").alias("value")),
    )).alias("e")).select("site", "request", "path", "size", "index", "e.*")
    titles = ids.select("site", F.concat(F.lit("Engineer no "), number).alias("title"))
    links = ids.select("site", F.col("id").alias("place"), F.concat(F.lit("https://x.example/v/"), number, F.lit("?p=1")).alias("link"))
    began = time.perf_counter()
    best, made = I.list_of_titles(found, titles), I.id_and_template(found, links)
    assert [tuple(r) for r in best.collect()] == [("s0", 0, "jobs", n, n)]
    assert [tuple(r) for r in made.collect()] == [("s0", "no", "https://x.example/v/{id}?p=1")]
    assert time.perf_counter() - began < 90
    for df in (best, made):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


SITE, JOB = "id long, parent_id long, name string", "id long, site_id long, url string, body string, hash string"
EDIT, TAG = "id long, job_id long, part int, field string, value string", "id long, job_id long, site_id long, tag string"
ENTITIES = [
    M.Entity("sites", ["parent_id", "name"], {"parent_id": "sites"}),
    M.Entity("jobs", ["site_id", "hash"], {"site_id": "sites"}, {"hash": ["site_id", "body"]}),
    M.Entity("edits", ["job_id", "part", "field"], {"job_id": "jobs"}),
    M.Entity("tags", ["job_id", "site_id", "tag"], {"job_id": "jobs", "site_id": "sites"}),
]
KINDS = {"sites": SITE, "jobs": JOB, "edits": EDIT, "tags": TAG}


def frames(spark, tables):
    return {name: spark.createDataFrame(tables.get(name, []), kind) for name, kind in KINDS.items()}


OURS = {
    "sites": [(1, None, "root"), (2, 1, "a"), (7, None, "other")],
    "jobs": [(10, 2, "u1", "text one", None), (11, 7, "u2", "text two", None)],
    "edits": [(5, 10, 1, "title", "ours")],
    "tags": [(1, 10, 2, "x")],
}
THEIRS = {
    # root > a > deep > deeper, in no order of ids; "a" stands under another parent as well
    "sites": [(40, 30, "deeper"), (30, 21, "deep"), (21, 20, "a"), (20, None, "root"), (22, None, "a"), (23, None, "a")],
    "jobs": [(100, 21, "v1", "text one", "their hash"), (101, 40, "v2", "text one", "h"), (102, 22, "v3", "text two", "h"), (103, 22, "v4", "text two", "h")],
    "edits": [(1, 100, 1, "title", "theirs"), (2, 100, 2, "title", "theirs"), (3, 103, 1, "title", "by copy"), (4, 102, 1, "title", "by first")],
    "tags": [(9, 100, 21, "x"), (8, 101, 40, None), (7, 101, 40, None), (6, None, 20, "site only")],
}


def with_hashes(spark, tables):
    made = frames(spark, tables)
    made["jobs"] = made["jobs"].withColumn("hash", M.content_hash([F.col("site_id").cast("string"), F.col("body")]))
    return made


def test_import_of_four_entities(spark):
    found = M.import_all(ENTITIES, with_hashes(spark, OURS), frames(spark, THEIRS))
    assert found.rejected.isEmpty()
    sites = {r.id: (r.parent_id, r.name) for r in found.tables["sites"].collect()}
    # 20 is our root, 21 our a below it; 22 and 23 are one new row; then deep and deeper by levels.
    assert sites == {1: (None, "root"), 2: (1, "a"), 7: (None, "other"), 8: (None, "a"), 9: (2, "deep"), 10: (9, "deeper")}
    jobs = sorted((r.id, r.site_id, r.url) for r in found.tables["jobs"].collect())
    assert jobs == [(10, 2, "u1"), (11, 7, "u2"), (12, 10, "v2"), (13, 8, "v3")]
    edits = sorted((r.id, r.job_id, r.part, r.value) for r in found.tables["edits"].collect())
    assert edits == [(5, 10, 1, "ours"), (6, 10, 2, "theirs"), (7, 13, 1, "by copy")]
    tags = sorted((r.id, r.job_id or 0, r.site_id, r.tag or "") for r in found.tables["tags"].collect())
    assert tags == [(1, 10, 2, "x"), (2, 0, 1, "site only"), (3, 12, 10, "")]
    assert {(r.entity, r.added, r.known) for r in found.counts.collect()} == {("sites", 3, 3), ("jobs", 2, 2), ("edits", 2, 2), ("tags", 2, 2)}
    again = M.import_all(ENTITIES, found.tables, frames(spark, THEIRS))
    assert {(r.entity, r.added) for r in again.counts.collect()} == {("sites", 0), ("jobs", 0), ("edits", 0), ("tags", 0)}


def test_a_broken_reference_rejects_the_import_by_name(spark):
    broken = THEIRS | {"edits": [*THEIRS["edits"], (9, 999, 1, "title", "x")], "sites": [*THEIRS["sites"], (50, 51, "ring"), (51, 50, "ring")]}
    found = M.import_all(ENTITIES, with_hashes(spark, OURS), frames(spark, broken))
    rejected = {tuple(r) for r in found.rejected.collect()}
    assert rejected == {("edits", 9, "job_id", 999, "broken_reference"), ("sites", 50, "parent_id", 51, "ring"), ("sites", 51, "parent_id", 50, "ring")}
    assert {(r.added, r.known) for r in found.counts.collect()} == {(0, 0)}
    assert sorted(map(tuple, found.tables["edits"].collect())) == OURS["edits"]


def test_import_of_nothing_and_into_nothing(spark):
    found = M.import_all(ENTITIES, with_hashes(spark, OURS), frames(spark, {}))
    assert {(r.added, r.known) for r in found.counts.collect()} == {(0, 0)} and found.rejected.isEmpty()
    found = M.import_all(ENTITIES, frames(spark, {}), frames(spark, THEIRS))
    assert {(r.entity, r.added, r.known) for r in found.counts.collect()} == {("sites", 5, 1), ("jobs", 3, 1), ("edits", 3, 1), ("tags", 3, 1)}
