from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparrowline.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_fingerprint_is_the_plain_one():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "One  TWO", "é È\x0bÉ Z", "a b c\x85d e f"]
    texts += [" ".join(rng.choice(["The", "cat", "É", "x\ty", "on"]) for _ in range(n)) for n in (3, 4, 50, 400)]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 100)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_linked_is_brute_force_inside_groups():
    rng = random.Random(2)
    for sizes in ([200, 40, 3, 2, 2, 1], [700], [2], [130, 130, 129]):
        fps, groups = [], []
        for g, n in enumerate(sizes):
            seeds = [rng.getrandbits(64) for _ in range(max(1, n // 5))]
            fps += [near(rng, rng.choice(seeds), rng.randint(0, 5)) for _ in range(n)]
            groups += [g] * n
        label = simhash.linked(np.array(fps, dtype=np.uint64), np.array(groups))
        at = 0
        for n in sizes:
            assert (label[at : at + n] - at).tolist() == plain_components(fps[at : at + n])
            at += n


def test_every_near_pair_meets_in_a_table():
    rng = random.Random(3)
    for distinct in (10, 1 << 25, 1 << 40):
        masks = simhash.block_masks(distinct)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = near(rng, a, 3)
            assert any(a & m == b & m for m in masks)


def test_components_by_edges(spark):
    fps = [near(random.Random(i), 12345, i % 4) for i in range(60)] + list(range(0, 64 * 40, 64 * 3))
    rng = random.Random(4)
    chain = [rng.getrandbits(64)]
    for _ in range(40):
        chain.append(near(rng, chain[-1], 3))
    fps = sorted(set(fps + chain))
    want = plain_components(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for tile in (4096, 16):
        found = simhash.components(simhash.edges(spark.createDataFrame([(f,) for f in signed], "fp long"), tile)).collect()
        root = {r.node: r.root for r in found}
        groups: dict = {}
        for f, w in zip(signed, want):
            groups.setdefault(w, set()).add(root.get(f, f))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def documents(spark, rows):
    return spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source="s", TEXT="x", fp=1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, root string, fp long")


def test_clusters_and_deduplicate_with_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base), (9, base), (None, base), (7, base + " tail"), (1, None), (2, ""), (3, "other text here now"),
            (3, "other text here now"), (8, "x " * 5000), (4, "quite unlike all of the rest of them")]
    docs = documents(spark, rows)
    found = simhash.clusters(docs).collect()
    assert len(found) == len(rows)
    want = {5: 5, 9: 5, None: 5, 7: 5, 1: 1, 2: 1, 3: 3, 8: 8, 4: 4}
    assert all(want[r.doc_id] == r.component_id for r in found)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 8]
    empty = documents(spark, [])
    assert simhash.clusters(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def plain_clusters(rows):
    """fingerprint and component_id of whole texts, by loops over all pairs."""
    import xxhash

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t) for _, t in rows]
    label = plain_components(prints)
    least: dict = {}
    for (i, _), w in zip(rows, label):
        if i is not None:
            least[w] = min(least.get(w, i), i)
    return sorted((str(i), f"{f:016x}", least.get(w)) for (i, _), f, w in zip(rows, prints, label))


def test_clusters_of_a_table_are_brute_force(spark):
    """The whole result, with chains of near copies, groups of equal texts, short, empty and null texts."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(60):
        text = rng.choices(words, k=rng.choice([1, 2, 3, 12, 60, 200]))
        for _ in range(rng.randrange(1, 6)):
            rows.append((n, " ".join(text) if rng.random() < 0.9 else " ".join(text).upper()))
            n += rng.randrange(1, 4)
            if len(text) > 12 and rng.random() < 0.7:  # a chain: each is near the one before
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(words)
    rows += [(None, rows[0][1]), (n + 1, None), (n + 2, ""), (n + 3, " \n"), rows[3]]
    rng.shuffle(rows)
    found = simhash.clusters(documents(spark, rows))
    got = sorted((str(r.doc_id), f"{r.fp % (1 << 64):016x}", r.component_id) for r in found.collect())
    assert got == plain_clusters(rows)


def test_pairs_within_the_radius_meet_again_in_the_other_bits():
    rng = random.Random(5)
    for mask in (simhash.block_masks(10)[1], simhash.block_masks(1 << 25)[3]):
        masks = simhash.rest_masks(mask)
        assert sum(masks) == (1 << 64) - 1 - mask and len(masks) == 4
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << bit for bit in rng.sample([i for i in range(64) if not mask >> i & 1], 3))
            assert any(a & m == b & m for m in masks)


def test_a_hot_bucket_is_keyed_again_and_a_hub_stays_split(spark):
    """All fingerprints agree in 16 bits, a third hangs on one hub, and adaptive execution is off: rows per bucket and task are looked at."""
    rng = random.Random(12)
    hub = rng.getrandbits(48)
    near = {hub} | {hub ^ sum(1 << b for b in rng.sample(range(48), rng.randint(1, 3))) for _ in range(1000)}
    others = {rng.getrandbits(48) for _ in range(3000)}
    frame = spark.createDataFrame([(f,) for f in near | others], "fp long")
    n, tile = frame.count(), 256
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = simhash.bucketed(frame, simhash.block_masks(n), tile, simhash.RADIUS)
        # Cut into tiles alone, the shared block would give each row n / tile copies; keyed again it gives four, and the others one each.
        assert met.count() < 12 * n
        assert met.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 2.5 * tile
        found = simhash.components(simhash.edges(frame, tile=tile)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    root = {r.node: r.root for r in found}
    assert len({root.get(f, f) for f in near}) == 1
    assert sum(f in root for f in others) < 3
    want = plain_components(sorted(near | others))
    groups: dict = {}
    for f, w in zip(sorted(near | others), want):
        groups.setdefault(w, set()).add(root.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
