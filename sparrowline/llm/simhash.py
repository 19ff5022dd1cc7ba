"""SimHash near-duplicates: fingerprints, links by bit-sliced comparison, components.

Fingerprint: the text with A-Z lower-cased, words between ASCII white space, all shingles of
three words (the whole sequence if there are fewer), XXH64 with seed 42 of each; a bit is set
if it is set in over half of the hashes. No word: fingerprint zero.

Links: equal fingerprints are one class and are never compared. Distinct fingerprints meet in
tables keyed by some of their bit blocks: with 3 differing bits at most, any r of r + 3 blocks
agree for some choice of r, so every pair within the radius meets. Inside a bucket, bit planes
are stored vertically, 64 candidates to a word; differing bits are added up by carry-save
counters and words whose candidates are all over the radius are abandoned. A bucket above
`tile` fingerprints is cut into tiles of two chunks, so that no task gets it whole and every
pair is still compared. A bucket gives one edge for each fingerprint that it links, not one for
each pair. Components come from repeated large-star and small-star steps on those edges.

Defined cases: a null or empty text has fingerprint zero and links like any other; repeated
rows fall into one class; a null doc_id takes part but never names a component unless all of
its documents have none; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.common import matched, one_of_twins, pick, written

BITS, RADIUS, SEED, WORDS = 64, 3, 42, 3
#: Texts are cut into pieces of about so many bytes, between words, which bounds a task's memory.
PIECE = 1 << 20
#: Rows whose buckets are compared at a time.
PORTION = 1 << 18
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE and (cut := SPACE.search(text, at + PIECE)):
            end = cut.start()
        yield text[at:end].lower().split()
        at = end


def shingle_runs(text: bytes | None, words: int) -> Iterator[list[bytes]]:
    """All shingles of a text, in lists of bounded size; the whole sequence where there are fewer words."""
    carried: list[bytes] = []
    some = False
    for found in _pieces(text or b""):
        found = carried + found
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
        if shingles:
            some = True
            yield shingles
        carried = found[max(0, len(found) - words + 1) :]
    if carried and not some:
        yield [b" ".join(carried)]


def xxh64(shingles: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=len(shingles))[:, None]


def xxh3_128(shingles: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, shingles)), dtype="<u8").reshape(-1, 2)


def fingerprint_words(text: bytes | None, words: int, hashes) -> np.ndarray:
    """The fingerprint of one text, 64 bits to a number."""
    ones, n = 0, 0
    for shingles in shingle_runs(text, words):
        h = hashes(shingles)
        for i in range(0, len(h), 32768):
            part = np.ascontiguousarray(h[i : i + 32768])
            bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
            ones = ones + np.add.reduce(bits, axis=0, dtype=np.uint16).astype(np.int64)
        n += len(h)
    return np.packbits(ones * 2 > n, bitorder="little").view("<u8") if n else np.zeros(2, dtype="<u8")


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of one text by three words and XXH64, unsigned."""
    return int(fingerprint_words(text, WORDS, xxh64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in b.column(2)), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's 64 bits as a long), written to the shared folder."""
    rows = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.col("text").cast("binary").alias("text"),
    )
    return written(rows.mapInArrow(_fingerprint_batches, "doc_id long, text_hash long, fp long"), "fingerprints")


def bit_planes(fps: np.ndarray, spare: int) -> np.ndarray:
    """[bits, words]: bit b of fingerprint i is bit i % 64 of word i // 64 in plane b; `spare` words of zeros follow.

    fps: a row a fingerprint, 64 bits to a number.
    """
    n = -(-len(fps) // 64) * 64
    padded = np.zeros((n, fps.shape[1]), dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    return np.concatenate([planes, np.zeros((len(planes), spare), dtype="<u8")], axis=1)


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j in place; a class is named by its smallest place."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def close_pairs(fps: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) of the places i < j of a group that differ in `radius` bits at most.

    `groups` holds the groups' numbers, equal ones together and larger groups first. Place i is
    compared with i + d for d = 1, 2, ..., for all places at once, bit plane by bit plane: two planes and
    the lowest counter make a sum and a carry, which goes up the counters. Words whose 64 pairs
    have all run over the counters are abandoned.
    """
    n = len(fps)
    if n < 2:
        return
    cuts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    sizes = np.diff(cuts)
    planes = bit_planes(fps, spare=int(sizes[0]) // 64 + 2)
    for d in range(1, int(sizes[0])):
        reach = int(cuts[np.searchsorted(-sizes, -d, side="left")])  # the end of the groups with over d places
        together = np.zeros(-(-reach // 64) * 64, dtype=np.uint8)
        same = groups[:reach][: n - d] == groups[d : d + reach]
        together[: len(same)] = same
        mask = np.packbits(together, bitorder="little").view("<u8")
        word = np.flatnonzero(mask)
        mask = mask[word]
        skip, by = divmod(d, 64)
        counters = [np.zeros(len(word), dtype="<u8") for _ in range(radius.bit_length())]
        over = np.zeros(len(word), dtype="<u8")
        for p in range(0, len(planes), 2):
            x, y = (
                planes[q, word]
                ^ (
                    (planes[q, word + skip] >> np.uint64(by)) | (planes[q, word + skip + 1] << np.uint64(64 - by))
                    if by
                    else planes[q, word + skip]
                )
                for q in (p, p + 1)
            )
            half = counters[0] ^ x
            carry = (counters[0] & x) | (half & y)
            counters[0] = half ^ y
            for k in range(1, len(counters)):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if p % 8 == 6:
                alive = (mask & ~over) != 0
                if not alive.all():
                    word, mask, over = (a[alive] for a in (word, mask, over))
                    counters = [c[alive] for c in counters]
                if not len(word):
                    break
        if len(word):
            lanes = np.unpackbits((mask & ~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            bits = sum(((c[at] >> lane.astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k for k, c in enumerate(counters))
            i = (word[at] * 64 + lane)[bits <= radius]
            yield i, i + d, bits[bits <= radius]


def linked(fps: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each place the smallest place that it is linked with, directly or not, inside its group."""
    label = np.arange(len(fps))
    for i, j, _ in close_pairs(fps[:, None], groups, RADIUS):
        _merge(label, i, j)
    return label


def large_first(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the buckets with several rows, larger buckets first. keys: the buckets' numbers, in runs."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    take = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in order] or [np.zeros(0, int)])
    return take, np.repeat(np.arange(len(order)), sizes[order])


def _link_rows(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    """One edge for each fingerprint that is linked inside its bucket."""
    take, groups = large_first(keys)
    chosen = fps[take]
    label = linked(chosen.view(np.uint64), groups)
    at = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(chosen[at]), pa.array(chosen[label[at]])], names=["a", "b"])


def whole_buckets(batches: Iterator[pa.RecordBatch], compare) -> Iterator[pa.RecordBatch]:
    """`compare(keys, *columns)` of whole buckets, many at a time. Rows arrive sorted by bucket, their first column."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        rows += b.num_rows
        if rows < PORTION:
            continue
        columns = [np.concatenate(x) for x in zip(*held)]
        other = np.flatnonzero(columns[0] != columns[0][-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            yield compare(*(c[:last] for c in columns))
        held, rows = [[c[last:] for c in columns]], len(columns[0]) - last
    if rows:
        yield compare(*(np.concatenate(x) for x in zip(*held)))


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return whole_buckets(batches, _link_rows)


def block_masks(distinct: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that a table's key holds: about as many bits as the number of fingerprints has."""
    keep = 1 if distinct <= 1 << 22 else 2 if distinct <= 1 << 30 else 3
    blocks = keep + radius
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(c) for c in combinations(block, keep)]


def rest_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks of `radius` + 1 blocks of the bits that a mask leaves: two fingerprints within the radius agree in one block at least."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [round(i * len(free) / (radius + 1)) for i in range(radius + 2)]
    return [sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bucketed(nodes: DataFrame, masks: list[int], tile: int = 4096, radius: int | None = None, table: bool = False) -> DataFrame:
    """bucket, with `table` the mask's number t, and the columns of nodes(fp, ...), sorted by bucket: nodes meet where they agree in all bits of a mask.

    A bucket above `tile` nodes, which a family of texts with much in common makes, is keyed again by blocks of the other bits where
    all pairs within `radius` bits are wanted: each node goes to a few smaller buckets, and every such pair meets in one. What is above
    `tile` still, or where no radius is given, is cut into tiles of two chunks, so that no task gets a bucket whole and every pair meets.
    """
    keyed = nodes.select("*", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])).alias("t", "key"))
    per = written(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    columns = [c for c in nodes.columns]
    dealt = matched(keyed, per, ["t", "key"], "n").select("t", "key", F.lit(-1).alias("block"), F.lit(0).cast("long").alias("inner"), *columns, "n")
    large = per.filter(F.col("n") > tile)
    if radius is not None and not large.isEmpty():
        again = F.array(*[F.array(*[F.lit(_signed(m)).cast("long") for m in rest_masks(mask, radius)]) for mask in masks])
        hot = keyed.join(F.broadcast(large.select("t", "key")), ["t", "key"])  # fewer than a row for each `tile` nodes and mask
        hot = hot.withColumn("_masks", F.element_at(again, F.col("t") + 1))
        hot = hot.select("t", "key", F.posexplode("_masks").alias("block", "_mask"), *columns)
        hot = hot.select("t", "key", "block", F.col("fp").bitwiseAND(F.col("_mask")).alias("inner"), *columns)
        by = ["t", "key", "block", "inner"]
        inner = written(hot.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1"), "inner_buckets")
        dealt = dealt.filter(F.col("n") <= tile).unionByName(matched(hot, inner, by, "n").select(*by, *columns, "n"))
    dealt = dealt.withColumn("chunks", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
    own = F.pmod(F.xxhash64(*columns), F.col("chunks")).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"))
    )
    by = ["t", "key", "block", "inner", "i", "j"]
    met = dealt.select(*by[:4], F.explode(tiles).alias("x"), *columns).select(*by[:4], "x.i", "x.j", *columns)
    met = met.repartition(*by).sortWithinPartitions(*by, *columns)
    return met.select(F.xxhash64(*by).alias("bucket"), *(["t"] if table else []), *columns)


def edges(distinct_fps: DataFrame, tile: int = 4096) -> DataFrame:
    """a, b: fingerprints linked inside a bucket; together they connect all that links connect."""
    met = bucketed(distinct_fps, block_masks(distinct_fps.count()), tile, RADIUS)
    return met.mapInArrow(_compare_batches, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of the edges(a, b) the smallest node of its component.

    Large-star and small-star steps in turn, until neither changes the edges. Each round is
    written to the shared folder, so that a lost executor costs one round at most. Edges of a hub stay
    where they are: its smallest neighbour goes to them.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = written(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = matched(both, written(least, "least"), ["a"], "n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), "edges")
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = matched(large, least, ["a"], "n").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(least.select("a", "m")).distinct(), "edges")
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root, component_id: a row for each row of `docs`.

    root names the component among fingerprints; component_id is the smallest doc_id in it.
    """
    rows = fingerprints(docs)
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "classes")
    roots = components(edges(classes.select("fp")))
    roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    tied = classes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first_id")
    least = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    tied = tied.join(least, "root").select(F.col("fp").alias("node"), "root", "component_id")
    classes = classes.join(tied, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"), "rows"
    )
    found = matched(rows, written(classes, "classes"), ["fp"], "rows")
    return found.select("doc_id", "text_hash", "fp", "root", "component_id")


def hex_digits(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` but for near-duplicates, by found(doc_id, text_hash, root): of each root the
    document with the smallest id stays, of several rows with it the one with the smallest hash of its text, then of all columns."""
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = written(found.groupBy("root").agg(F.min(name).alias("first"), F.count("*").alias("rows")), "first")
    stays = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("text_hash") == F.col("first.text_hash"))
    judged = written(
        matched(found, first, ["root"], "rows")
        .groupBy("doc_id", "text_hash")
        .agg(F.bool_or(stays).alias("stays"), F.count("*").alias("n")),
        "judged",
    )
    names = [f"_{i}" for i in range(len(docs.columns))]
    key_id, key_text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = docs.toDF(*names).withColumns({"_id": key_id.cast("long"), "_hash": F.xxhash64(key_text)})

    def same(table: DataFrame) -> Column:
        return F.col("_id").eqNullSafe(table["doc_id"]) & (F.col("_hash") == table["text_hash"])

    goes, again = judged.filter(~F.col("stays")), judged.filter("stays AND n > 1")
    kept = rows.join(goes, same(goes), "left_anti")
    if again.isEmpty():
        return kept.select(*names).toDF(*docs.columns)
    twins = one_of_twins(kept.join(again, same(again), "left_semi"), names, ["_id", "_hash"])
    return kept.join(again, same(again), "left_anti").select(*names).unionByName(twins).toDF(*docs.columns)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` but for near-duplicates by `clusters`."""
    return one_of_each(docs, written(clusters(docs).select("doc_id", "text_hash", "root"), "clusters"))
