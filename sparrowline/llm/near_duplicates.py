"""Near-duplicates by SimHash for filtering: word shingles of a chosen similarity, found by fingerprint, confirmed by text.

`simhash.clusters` links fingerprints of 64 bits within 3 bits, which near copies often exceed: texts
that share a part s of their shingles (Jaccard) differ in arccos(2s / (1 + s)) / pi of their
bits, in 15 % where s = 0.8. Here a document has a fingerprint of 128 bits over shingles of WORDS
words. Documents with the same one are a class; the other classes are compared, in the same bit-sliced
way, in tables keyed by random bits of the first 64. There are as many bits as make buckets of about BUCKET
classes and as many tables as make a pair at REACH differing bits meet with probability FOUND, both by
formula at any size of the table. In its bucket a class is linked with the class nearest to it
and with the nearest of those before it, within RADIUS bits: two links a class and
table. A link counts if the Jaccard similarity of the two texts' shingles, computed
exactly, is SIMILARITY at least. Those links join most classes. Then every other pair of a bucket within RADIUS bits
whose classes are not joined yet is compared as well, so that none is left out because nearer classes
stand between. Such pairs can be many, in a family whose texts are near each other but not near enough. So they never are rows: the classes
that have one are dealt with their texts to tiles of the bucket, a task compares a tile's pairs, each in the first table that shows it, and
gives the links of a spanning forest, fewer than the tile has classes. Components of all links are the groups.

A pair is missed only if no table shows it; tests measure the share found.

Defined cases: as in simhash; texts of equal fingerprint are one class without a look at their texts.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.common import matched, pick, written
from sparrowline.llm.simhash import bucketed, close_pairs, components, fingerprint_words, large_first, one_of_each, shingle_runs, whole_buckets, xxh3_128

WORDS, SIMILARITY = 5, 0.8
#: Of 128 bits: links reach so far; tables are made for pairs so far apart.
RADIUS, REACH, FOUND = 27, 22, 0.95
BUCKET = 128
#: Classes, and bytes of text, of the chunks that a bucket's unjoined classes are dealt to; two make a tile.
CHUNK, CHUNK_BYTES = 256, 16 << 20
#: Bytes of texts and shingles that a worker remembers.
REMEMBERED = 96 << 20


def table_masks(classes: int, bucket: int = BUCKET, seed: int = 5) -> list[int]:
    """Masks of the bits, of 64, that each table's key holds."""
    bits = max(0, round(math.log2(max(1, classes) / bucket)))
    if not bits:
        return [0]
    meet = math.prod((128 - REACH - i) / (128 - i) for i in range(bits))
    tables = math.ceil(math.log(1 - FOUND) / math.log(1 - meet))
    rng = random.Random(seed)
    return [sum(1 << b for b in rng.sample(range(64), bits)) for _ in range(tables)]


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint_words(t.as_py(), WORDS, xxh3_128) for t in b.column(2)], dtype="<u8").reshape(-1, 2).view(np.int64)
        columns = [pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "text_hash", "fp", "fp2"])


def _nearest_rows(keys: np.ndarray, fp: np.ndarray, fp2: np.ndarray) -> pa.RecordBatch:
    """a, b: each class of a bucket with the nearest one, and with the nearest of those before it."""
    take, groups = large_first(keys)
    prints = np.stack([fp[take], fp2[take]], axis=1)
    found = [np.stack(x) for x in close_pairs(prints.view(np.uint64), groups, RADIUS)]
    i, j, bits = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
    a, b = [], []
    for own, other, far in ((j, i, bits), (np.r_[i, j], np.r_[j, i], np.r_[bits, bits])):
        order = np.lexsort((other, far, own))
        first = order[np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])] if len(order) else order
        a.append(own[first])
        b.append(other[first])
    a, b = np.concatenate(a), np.concatenate(b)
    named = [pa.array(np.ascontiguousarray(prints[at, k])) for at in (np.maximum(a, b), np.minimum(a, b)) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(named, names=["a", "a2", "b", "b2"])


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return whole_buckets(batches, _nearest_rows)


def _rest_rows(keys: np.ndarray, table: np.ndarray, fp: np.ndarray, fp2: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """The classes of a bucket that have one within RADIUS whose root is another."""
    take, groups = large_first(keys)
    prints, roots = np.stack([fp[take], fp2[take]], axis=1), root[take]
    some = np.zeros(len(take), dtype=bool)
    for i, j, _ in close_pairs(prints.view(np.uint64), groups, RADIUS):
        apart = roots[i] != roots[j]
        some[i[apart]] = some[j[apart]] = True
    columns = [pa.array(np.ascontiguousarray(c[take][some])) for c in (keys, table, fp, fp2, root)]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "t", "fp", "fp2", "root"])


def _rest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return whole_buckets(batches, _rest_rows)


def _tile_links(rows: list[tuple], masks: np.ndarray, similarity: Callable) -> Iterator[tuple[int, int]]:
    """Links of a tile's rows (t, across, node, fp, fp2, root, side, text), none between what the roots or links before it join."""
    t, across, node, fp, fp2, root, side, text = zip(*rows)
    prints, side = np.array([fp, fp2], dtype=np.int64).T.view(np.uint64), np.array(side)
    label = np.unique(root, return_inverse=True)[1]
    earlier = masks[: t[0]]
    for i in range(len(rows) - 1):
        differ = prints[i + 1 :] ^ prints[i]
        near = (np.bitwise_count(differ).sum(axis=1) <= RADIUS) & (label[i + 1 :] != label[i])
        if across[0]:  # pairs of one chunk meet in that chunk's own tile
            near &= side[i + 1 :] != side[i]
        at = np.flatnonzero(near)
        at = at[((differ[at, :1] & earlier) != 0).all(axis=1)] + i + 1
        for j in at.tolist():
            if label[i] != label[j] and similarity(text[i], text[j]) >= SIMILARITY:
                label[label == label[j]] = label[i]
                yield node[i], node[j]


def _tile_batches(batches: Iterator[pa.RecordBatch], masks: np.ndarray, similarity: Callable) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile, their first three columns; one tile is held at a time."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        found = np.array(list(_tile_links(rows, masks, similarity)), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], names=["a", "b"])

    tile, held = None, []
    for b in batches:
        for bucket, x, y, t, *row in zip(*(c.to_pylist() for c in b.columns)):
            if tile != (bucket, x, y):
                if len(held) > 1:
                    yield links(held)
                tile, held = (bucket, x, y), []
            held.append((t, x != y, *row))
    if len(held) > 1:
        yield links(held)


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """The distinct shingles, as the first halves of their hashes."""
    parts = [np.unique(xxh3_128(s)[:, 0]) for s in shingle_runs(text, WORDS)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype="<u8")


_known: dict[bytes | None, np.ndarray] = {}
_held = 0


def _remembered(text: bytes | None) -> np.ndarray:
    """The same; a text that is compared again and again is hashed once."""
    global _held
    found = _known.get(text)
    if found is None:
        found = shingle_hashes(text)
        size = found.nbytes + len(text or b"") + 300
        if _held + size > REMEMBERED:
            _known.clear()
            _held = 0
        if size <= REMEMBERED:
            _known[text] = found
            _held += size
    return found


def jaccard(x: bytes | None, y: bytes | None) -> float:
    a, b = sorted((_remembered(x), _remembered(y)), key=len)
    at = b.searchsorted(a)
    both = int((b[at[at < len(b)]] == a[at < len(b)]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [jaccard(x.as_py(), y.as_py()) >= SIMILARITY for x, y in zip(batch.column(2), batch.column(3))]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _texts(rows: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text: a class has the text of its first document."""
    chosen = classes.join(nodes.distinct(), "node").select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    texts = rows.join(chosen, same).select("node", F.col("text").cast("binary").alias("text")).dropDuplicates(["node"])
    return written(texts, "texts")


def _confirmed(rows: DataFrame, classes: DataFrame, near: DataFrame) -> DataFrame:
    """Those pairs of classes whose texts are similar."""
    texts = _texts(rows, classes, near.select(F.col("a").alias("node")).union(near.select("b")))
    pairs = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return written(pairs.mapInArrow(_confirm_batches, "a long, b long"), "links")


def _rest_links(rows: DataFrame, classes: DataFrame, rest: DataFrame, masks: list[int]) -> DataFrame:
    """a, b: links that join what all pairs of rest(bucket, t, node, fp, fp2, root) join whose roots differ."""
    similarity, tables = jaccard, np.array(masks, dtype=np.uint64)
    texts = _texts(rows, classes, rest.select("node"))
    sized = written(rest.join(texts.select("node", F.octet_length("text").alias("size")), "node"), "sized")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.coalesce(F.sum("size"), F.lit(0)) / CHUNK_BYTES)).cast("int")
    per = written(sized.groupBy("bucket").agg(F.count("*").alias("n"), chunks.alias("chunks")), "chunks")
    dealt = matched(sized, per, ["bucket"], "n").withColumn("side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least(x, "side").alias("x"), F.greatest(x, "side").alias("y")))
    columns = ["t", "node", "fp", "fp2", "root", "side"]
    met = dealt.select("bucket", F.explode(tiles).alias("tile"), *columns).select("bucket", "tile.x", "tile.y", *columns)
    by = ["bucket", "x", "y"]
    met = met.join(texts, "node").select(*by, *columns, "text").repartition(*by).sortWithinPartitions(*by, "node")

    def run(batches):
        return _tile_batches(batches, tables, similarity)

    return written(met.mapInArrow(run, "a long, b long"), "rest_links")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, root: a row for each row of `docs`; rows of a group have the same root."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    as_bytes = rows.withColumn("text", F.col("text").cast("binary"))
    prints = written(as_bytes.mapInArrow(_fingerprint_batches, "doc_id long, text_hash long, fp long, fp2 long"), "fingerprints")
    node = F.xxhash64("fp", "fp2").alias("node")  # a class's name
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = prints.groupBy("fp", "fp2").agg(F.min(name).alias("first"), F.count("*").alias("rows"))
    classes = written(classes.select("fp", "fp2", node, "first.doc_id", "first.text_hash", "rows"), "classes")
    masks = table_masks(classes.count())
    near = bucketed(classes.select("fp", "fp2"), masks).mapInArrow(_compare_batches, "a long, a2 long, b long, b2 long")
    near = written(near.select(F.xxhash64("a", "a2").alias("a"), F.xxhash64("b", "b2").alias("b")).distinct(), "near")
    links = _confirmed(rows, classes, near)
    roots = components(links)
    # All pairs that the nearest links have not joined.
    joined = classes.select("fp", "fp2", "node").join(roots, "node", "left").select("fp", "fp2", F.coalesce("root", "node").alias("root"))
    rest = bucketed(written(joined, "joined"), masks, table=True).mapInArrow(_rest_batches, "bucket long, t int, fp long, fp2 long, root long")
    rest = written(rest.withColumn("node", node), "rest")
    more = _rest_links(rows, classes, rest, masks)
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    rooted = classes.select("fp", "fp2", "node", "rows").join(roots, "node", "left")
    rooted = written(rooted.select("fp", "fp2", "rows", F.coalesce("root", "node").alias("root")), "roots")
    return matched(prints, rooted, ["fp", "fp2"], "rows").select("doc_id", "text_hash", "root")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` but for near-duplicates: of each group the document with the smallest id stays."""
    return one_of_each(docs, written(groups(docs), "groups"))
