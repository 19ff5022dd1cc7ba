"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Fitting: k-means in two levels gives the coarse centroids, about the square root of the number of
vectors, and k-means of the residuals' parts gives the codebooks. Both are fitted on a sample
taken by a hash of the id: LIST_SAMPLE vectors for each list, SAMPLE_LEAST at least, SAMPLE_MOST
at most, and no more than SAMPLE_BYTES hold, as the driver fits them.

Index: every vector gets its nearest centroid's list and a byte for each part of its residual. Codes and
ids are kept apart from the vectors. Neighbouring lists share a shard; a list larger than a
shard is cut by a hash of the id, so no task gets more than a shard.

Measuring: while all rows are indexed, MEASURED of the queries, taken by a hash, are compared with every one of them,
exactly and by codes. What they find sets the number of lists to probe, the smallest that reaches PROBED of
their true neighbours, so queries unlike the other vectors are no worse off. Where the SHORTLIST best by codes hold less
than CODED of the true ones (vectors or components of very unequal size), the vectors themselves stand in place of the codes.

Search: a query probes the lists whose centroids are best for it, and further ones
until they hold CANDIDATES vectors. A query travels to each shard that it probes, once. There an asymmetric
distance table (the query's exact parts against all codes) gives approximate inner products for
all members of the probed lists, and the SHORTLIST best go on. The short lists of a query are
merged by a tree to one of SHORTLIST vectors; only these are computed again, in double precision from
the original vectors, at the shards that hold them.

Defined cases: see vectors; zero vectors take no part either; equal scores go to the smaller
vec_id; a query is never its own candidate; fewer than k are returned only where the table has no
more; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.common import written
from sparrowline.llm.vectors import TopLists, best_columns, by_dimension, steps, first_of_id, matrix, merged, ranks, tile_rows

#: Bounds of the rows that the index is fitted on.
LIST_SAMPLE, SAMPLE_LEAST, SAMPLE_MOST = 32, 20_000, 1 << 20
#: Bytes of the sample as doubles: what the driver holds, whatever the vectors' length.
SAMPLE_BYTES = 256 << 20
CODES, CODED_SAMPLE = 256, 8192
MEASURED, PROBED, CODED, CANDIDATES, SHORTLIST = 128, 0.97, 0.98, 512, 100
#: Rows of a shard at most, and queries of a tile at most, about.
SHARD_ROWS, QUERIES_AT_ONCE, ROWS_AT_ONCE = 65_536, 64, 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """k centres at most; a centre that loses all its points keeps its place."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=column, minlength=len(centres)) for column in x.T], axis=1)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * np.einsum("ij,ij->i", centres, centres)
    steps = (np.argmin(half - x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096))
    return np.concatenate([np.zeros(0, dtype=np.int64), *steps])


def centroids(x: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """About `lists` centres: the cells of a coarser k-means are divided by one of their own, so that
    centres of a cell follow each other."""
    groups = kmeans(x, max(1, int(lists**0.5)), seed=seed)
    own = nearest(x, groups)
    parts = (x[own == g] for g in range(len(groups)))
    return np.concatenate([kmeans(part, max(1, round(lists * len(part) / len(x))), seed=seed) for part in parts if len(part)])


@dataclass
class Index:
    """What is fitted: centres of lists, codebooks of the parts of residuals; what is measured: lists to probe, whether codes will do."""

    centres: np.ndarray
    cuts: list[int]
    books: list[np.ndarray]
    probes: int
    coded: bool = True

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        parts = zip(self.cuts, self.cuts[1:], self.books)
        return own, np.stack([nearest(rest[:, a:b], book).astype(np.uint8) for a, b, book in parts], axis=1)

    def decode(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[own] + np.concatenate([book[code] for book, code in zip(self.books, codes.T)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """[part, code, query]: inner products of the queries' parts with all codes."""
        out = np.zeros((len(self.books), CODES, len(q)), dtype=np.float32)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out[m, : len(book)] = book @ q[:, a:b].T
        return out

    def probed(self, q: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """[query, list]: whether the list is probed: the first `probes`, and more until they hold `least` vectors."""
        order = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1) - sizes[order]  # by the lists before
        out = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(out, order, (held < least) | (np.arange(order.shape[1]) < self.probes), axis=1)
        return out


def fit(sample: np.ndarray, count: int, k: int, seed: int = 3) -> Index:
    """An index for `count` vectors, fitted on the sample."""
    dim = sample.shape[1]
    centres = centroids(sample, max(1, min(int(count**0.5), len(sample) // LIST_SAMPLE)), seed=seed)
    own = nearest(sample, centres)
    rng = np.random.default_rng(seed)
    some = rng.permutation(len(sample))[:CODED_SAMPLE]
    rest = sample[some] - centres[own[some]]
    parts = min(-(-dim // 2), 64)
    cuts = [round(i * dim / parts) for i in range(parts + 1)]
    books = [kmeans(rest[:, a:b], CODES, seed=seed) for a, b in zip(cuts, cuts[1:])]
    return Index(centres, cuts, books, 1)


@dataclass
class Measure:
    """Some queries, and their best of all rows: exactly, and by codes."""

    ids: np.ndarray
    queries: np.ndarray
    k: int

    def met(self, ids: np.ndarray, kinds: list[np.ndarray], least: list[np.ndarray]) -> pa.Array:
        """For each row (query, by codes or not, score) where it may be among a query's best; `least` has what is beaten so far.

        ids are in ascending order; `kinds`: the vectors, and what their codes stand for.
        """
        found = []
        for by_codes, (vectors, most) in enumerate(zip(kinds, (self.k, max(SHORTLIST, self.k)))):
            scores = self.queries @ vectors.T
            own = np.searchsorted(ids, self.ids)
            there = np.flatnonzero(own < len(ids))
            there = there[ids[own[there]] == self.ids[there]]
            scores[there, own[there]] = -np.inf
            best = best_columns(scores, most)
            some = np.take_along_axis(scores, best, axis=1)
            q, place = np.nonzero((some >= least[by_codes][:, None]) & (some > -np.inf))
            if best.shape[1] == most:
                np.maximum(least[by_codes], some[:, -1], out=least[by_codes])
            found.append((best[q, place], q, np.full(len(q), by_codes), some[q, place]))
        row, q, by_codes, score = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(row, kind="stable")
        columns = [pa.array(q[order].astype(np.int32)), pa.array(by_codes[order] == 1), pa.array(-score[order])]
        offsets = np.searchsorted(row[order], np.arange(len(ids) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=["query", "by_codes", "neg_score"]))

    def of(self, coded: DataFrame, index: Index) -> Index:
        """The index with as many lists to probe, and codes or none, as the queries' true neighbours want."""
        each = coded.select("list", "vec_id", F.explode("met").alias("m"))
        tops = F.array_sort(F.collect_list(F.struct("m.neg_score", "vec_id", "list")))
        most = F.when(F.col("by_codes"), max(SHORTLIST, self.k)).otherwise(self.k)
        tops = each.groupBy("m.query", "m.by_codes").agg(tops.alias("top")).select("query", "by_codes", F.slice("top", F.lit(1), most).alias("top"))
        best = {(r["query"], r["by_codes"]): r["top"] for r in tops.collect()}  # MEASURED queries at most
        place = np.argsort(np.argsort(-(self.queries @ index.centres.T), axis=1, kind="stable"), axis=1)  # list: place in the order
        places, held = [], []
        for q in range(len(self.ids)):
            short = {x["vec_id"] for x in best.get((q, True), ())}
            for x in best.get((q, False), ()):
                places.append(place[q, x["list"]])
                held.append(x["vec_id"] in short)
        if not held:
            return index
        return replace(index, probes=int(np.sort(places)[int(np.ceil(PROBED * len(places))) - 1]) + 1, coded=bool(np.mean(held) >= CODED))


@dataclass
class Shards:
    """Which shards hold a list's members: runs of lists, in one shard each or, if a list is large, in several."""

    run_of: np.ndarray  # list: its run
    starts: np.ndarray  # run: its first list
    first: np.ndarray  # run: its first shard
    pieces: np.ndarray  # run: its number of shards

    @staticmethod
    def of(sizes: np.ndarray, most: int) -> Shards:
        starts, pieces, held = [], [], 0
        for c, n in enumerate(sizes.tolist()):
            if not starts or held + n > most:
                starts.append(c)
                pieces.append(max(1, -(-n // most)))
                held = 0
            held += n
        run_of = np.searchsorted(starts, np.arange(len(sizes)), side="right") - 1
        return Shards(run_of, np.array(starts), np.r_[0, np.cumsum(pieces)[:-1]], np.array(pieces))

    @property
    def count(self) -> int:
        return int(self.first[-1] + self.pieces[-1])


CODED_ROWS = "vec_id long, list int, codes binary, met array<struct<query:int,by_codes:boolean,neg_score:double>>"
PROBING = "shard int, query_id long, lists array<int>, embedding array<double>"


def _probe_batches(batches: Iterator[pa.RecordBatch], index: Index, sizes: np.ndarray, shards: Shards, least: int) -> Iterator[pa.RecordBatch]:
    """A row for each query and shard that it probes, with the lists that it probes there."""
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            met = index.probed(matrix(part.column(1)), sizes, least) & (sizes > 0)
            query, run = np.nonzero(np.logical_or.reduceat(met, shards.starts, axis=1))
            ends = np.r_[shards.starts[1:], len(sizes)]
            lists = [np.flatnonzero(met[q, shards.starts[r] : ends[r]]) + shards.starts[r] for q, r in zip(query, run)]
            each = shards.pieces[run]
            again = np.repeat(np.arange(len(query)), each)
            piece = np.arange(len(again)) - np.repeat(np.cumsum(each) - each, each)
            offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
            probing = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, int), *lists]).astype(np.int32)))
            rows = pa.array(query[again])
            columns = [pa.array((shards.first[run[again]] + piece).astype(np.int32)), part.column(0).take(rows),
                       probing.take(pa.array(again)), part.column(1).take(rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "query_id", "lists", "embedding"])


def short_lists(index: Index, own: np.ndarray, ids: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, lists: list[np.ndarray], most: int) -> TopLists:
    """For each query the best of a shard's members in the lists that it probes, by distance tables."""
    order = np.argsort(ids)
    own, ids, codes = own[order], ids[order], codes[order]
    if index.coded:
        codes = np.ascontiguousarray(codes.T.astype(np.intp))
    here, place = np.unique(own, return_inverse=True)
    kind = np.float32 if index.coded else np.float64
    out = TopLists(len(query_ids), most, kind)
    alike = np.argsort([x[0] if len(x) else -1 for x in lists], kind="stable")  # queries of the same lists together
    for lo in range(0, len(query_ids), QUERIES_AT_ONCE):
        part = alike[lo : lo + QUERIES_AT_ONCE]
        met = np.stack([np.isin(here, lists[q]) for q in part], axis=1)
        rows = np.flatnonzero(met.any(axis=1)[place])
        tables = index.tables(queries[part]) if index.coded else ()
        base = np.where(met, index.centres[here] @ queries[part].T if index.coded else 0.0, -np.inf).astype(kind)
        itself = np.searchsorted(ids[rows], query_ids[part])
        best = TopLists(len(part), most, kind)
        step = np.empty((ROWS_AT_ONCE, len(part)), dtype=np.float32)
        for a, b in steps(len(rows), 4 * most, ROWS_AT_ONCE):
            some = rows[a:b]
            about = base[place[some]]
            if not index.coded:
                about += codes[some].astype(np.float64) @ queries[part].T
            for table, code in zip(tables, codes if index.coded else ()):
                about += np.take(table, code[some], axis=0, out=step[: len(some)], mode="clip")
            q = np.flatnonzero((itself >= a) & (itself < b))
            q = q[ids[rows[itself[q]]] == query_ids[part[q]]]
            about[itself[q] - a, q] = -np.inf
            best.add(about, ids[some])
        out.scores[part], out.ids[part] = best.scores, best.ids
    return out


EXACT = "query_id long, shard int, top array<struct<neg_score:double,vec_id:long>>"


def search(embeddings: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id `every` divides."""
    return by_dimension(embeddings, lambda rows, dim: _search(rows, dim, every, k, shard_rows), "double")


def sampled(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """The vectors that the index is fitted on, in the order of their ids, so that reruns agree."""
    wanted = min(SAMPLE_MOST, SAMPLE_BYTES // (8 * dim), max(SAMPLE_LEAST, LIST_SAMPLE * int(n**0.5)))
    share = F.lit(int(min(1.0, wanted / max(n, 1)) * (1 << 30)))
    taken = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < share).toArrow()
    order = np.argsort(taken["vec_id"].to_numpy())
    return matrix(taken["embedding"])[order] if len(order) else np.zeros((0, 0))


def measured(asked: DataFrame, dim: int, k: int) -> Measure:
    """MEASURED of the queries, those with the smallest hashes, so that reruns agree."""
    taken = asked.orderBy(F.xxhash64("vec_id", F.lit("measured")), "vec_id").limit(MEASURED).toArrow()
    queries = matrix(taken["embedding"]) if taken.num_rows else np.zeros((0, dim))
    return Measure(taken["vec_id"].to_numpy(), queries, k)


def _search(rows: DataFrame, dim: int, every: int, k: int, shard_rows: int) -> DataFrame:
    spark = rows.sparkSession
    rows = written(first_of_id(rows.filter(F.exists("embedding", lambda x: x != 0))), "searched")
    n = rows.count()
    sample = sampled(rows, n, dim)
    if not len(sample):
        sample = sampled(rows.limit(1), 1, dim)  # a few rows of which the hash took none
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(sample, n, k)
    # As many shards as keep all cores at work, more where they would be too large.
    most = max(1, min(shard_rows, max(1024, -(-n // (2 * spark.sparkContext.defaultParallelism)))))

    fitted, measure = index, measured(rows.filter(F.col("vec_id") % every == 0), dim, k)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [np.full(len(measure.ids), -np.inf) for _ in range(2)]
        for b in batches:
            if b.num_rows:
                b = b.take(pa.array(np.argsort(b.column(0).to_numpy())))
                vectors = matrix(b.column(1))
                own, codes = fitted.encode(vectors)
                met = measure.met(b.column(0).to_numpy(), [vectors, fitted.decode(own, codes)], least)
                columns = [b.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes]), met]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "list", "codes", "met"])

    coded = written(rows.mapInArrow(encode, CODED_ROWS), "codes")
    index = measure.of(coded, index)
    coded = coded.drop("met")
    code_type = np.dtype(np.uint8)
    if not index.coded:
        single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
        code_type = np.dtype(np.float32 if single else np.float64)

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    columns = [b.column(0), b.column(2), pa.array([v.tobytes() for v in matrix(b.column(1)).astype(code_type)])]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "list", "codes"])

        coded = rows.select("vec_id", "embedding").join(coded.select("vec_id", "list"), "vec_id").mapInArrow(plain, "vec_id long, list int, codes binary")
        coded = written(coded, "plain_codes")
    sizes = np.zeros(len(index.centres), dtype=np.int64)
    for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row a list
        sizes[r["list"]] = r["n"]
    shards, least = Shards.of(sizes, most), max(CANDIDATES, k + 1)
    place = spark.createDataFrame(
        [(c, int(shards.first[r]), int(shards.pieces[r])) for c, r in enumerate(shards.run_of)], "list int, first int, pieces int"
    )
    # A row a list, about the square root of the table's rows.
    placed = coded.join(F.broadcast(place), "list").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "pieces")).cast("int"))
    placed = written(placed.select("shard", "list", "vec_id", "codes"), "index")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _probe_batches(batches, index, sizes, shards, least)

    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("embedding", F.col("embedding").cast("array<double>"))
    probing = asked.mapInArrow(probe, PROBING)
    # A shard's codes travel once for each block of the queries that probe it, not of all queries; a row a shard.
    counted = probing.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(tile_rows(dim))).cast("int").alias("blocks"))
    blocks = written(counted, "blocks")
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block")
    probing = probing.join(F.broadcast(blocks), "shard").select("shard", block, "query_id", "lists", "embedding")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")

    score_type = pa.float32() if index.coded else pa.float64()
    lists_of = f"query_id long, shard int, top array<struct<neg_score:{'float' if index.coded else 'double'},vec_id:long>>"

    def shorten(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return TopLists(0, 1, np.float64).lists(np.zeros(0, np.int64), 0, score_type)
        codes = np.frombuffer(b"".join(left["codes"].to_pylist()), dtype=code_type).reshape(left.num_rows, -1)
        query_ids, lists = right["query_id"].to_numpy(), [x.values.to_numpy() for x in right["lists"]]
        found = short_lists(index, left["list"].to_numpy(), left["vec_id"].to_numpy(), codes, query_ids, matrix(right["embedding"]), lists, max(SHORTLIST, k))
        return found.lists(query_ids, key[0].as_py(), score_type)

    members = placed.join(F.broadcast(blocks), "shard").select("shard", every_block, "list", "vec_id", "codes")
    lists = members.groupBy("shard", "block").cogroup(probing.groupBy("shard", "block")).applyInArrow(shorten, lists_of)
    chosen = written(merged(lists, max(SHORTLIST, k), shards.count), "short_lists")
    return ranks(merged(reranked(rows, asked, chosen, k, most, tile_rows(dim)), k, max(1, -(-n // most))), -F.col("x.neg_score"))


def reranked(rows: DataFrame, asked: DataFrame, chosen: DataFrame, k: int, most: int, queries_at_once: int) -> DataFrame:
    """The k best of each query's chosen vectors, computed exactly from the original ones, as lists by shard.

    Vectors are dealt into shards by a hash of their id; a query travels once to each shard that holds some of its chosen.
    """
    parts = max(1, -(-rows.count() // most))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("shard")
    pairs = chosen.select("query_id", F.explode("top.vec_id").alias("vec_id")).select("query_id", shard, "vec_id")
    wanted = pairs.groupBy("query_id", "shard").agg(F.collect_list("vec_id").alias("wanted"))
    wanted = wanted.join(asked.withColumnRenamed("vec_id", "query_id"), "query_id")
    # At most as many requests a tile as a shard holds vectors, about; the vectors travel once for each tile of their shard.
    tiles = written(wanted.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(queries_at_once)).cast("int").alias("tiles")), "tiles")
    requests = wanted.join(F.broadcast(tiles), "shard")  # a row a shard
    requests = requests.select("shard", F.pmod(F.xxhash64("query_id"), "tiles").cast("int").alias("tile"), "query_id", "wanted", "embedding")
    held = rows.withColumn("shard", shard).join(F.broadcast(tiles), "shard")
    held = held.select("shard", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "vec_id", "embedding")

    def exact(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return TopLists(0, k, np.float64).lists(np.zeros(0, np.int64), 0, pa.float64())
        ids, vectors = left["vec_id"].to_numpy(), matrix(left["embedding"])
        order = np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        best = TopLists(right.num_rows, k, np.float64)
        for r, (names, query) in enumerate(zip(right["wanted"], matrix(right["embedding"]))):
            names = np.sort(names.values.to_numpy())
            scores = (vectors[np.searchsorted(ids, names)] * query).sum(axis=1)
            top = np.argsort(-scores, kind="stable")[:k]
            best.scores[r, : len(top)], best.ids[r, : len(top)] = scores[top], names[top]
        return best.lists(right["query_id"].to_numpy(), key[0].as_py(), pa.float64())

    return held.groupBy("shard", "tile").cogroup(requests.groupBy("shard", "tile")).applyInArrow(exact, EXACT)
