"""Token ids in seekable files: one independent zstandard frame for each document.

A file is a run of zstandard frames, then a skippable frame with the documents' ids and
lengths, then the seek table of zstandard's public seekable format (a skippable frame with each
data frame's compressed size, size and checksum, ended by a footer). Any zstandard decoder
reads the whole file; a reader that wants some documents reads the tail, seeks to their frames
and decompresses nothing else. A checksum is the low half of XXH64 over a frame's ids.

Ids are little-endian unsigned integers of 2 bytes, or of 4 where the vocabulary needs them.
Documents are cut into frames of `FRAME_TOKENS` ids, so only very long ones have several.

Files are written by tasks to the shared folder under names that no other attempt uses; only
files that a finished task reports are read. Defined cases: a null text is empty and has the
end id alone; a null doc_id comes first; repeated rows are written as often as they come; an
empty table gives no file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparrowline.llm.common import new_folder, pick, written

# Fixed values of the public zstandard formats.
SKIPPABLE_DOCS, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
HAS_CHECKSUMS = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
DOCUMENT = np.dtype([("doc_id", "<i8"), ("n_tokens", "<i8"), ("is_null", "u1")])

FRAME_TOKENS = 1 << 20
#: Bytes of text that a file is made from, about.
FILE_BYTES = 24 << 20
#: Tasks that files are read by; beyond, each reads several.
MOST_TASKS = 50_000
#: Bytes of pieces and ids that a worker remembers.
REMEMBERED = 192 << 20
#: Characters that are encoded, and bytes of ids that are handed on, at a time.
PORTION = 1 << 20

# Fixed value: how byte-level tokenizers cut a text into pieces before they merge bytes.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _latin_pieces() -> re.Pattern:
    """The same cuts for texts of Latin-1, by the faster `re`."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    letters, numbers = kinds["L"], kinds["N"]
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+")


LATIN_PIECES = _latin_pieces()
#: Separators that `re` alone takes for white space.
SEPARATORS = re.compile("[\x1c-\x1f]")


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids of whole texts by the tokenizers library, as bytes, each ended by the end id.

    A byte-level tokenizer cuts a text into pieces by a fixed pattern and encodes them apart from
    each other. So texts are cut by that pattern, each new piece is encoded once and its ids are
    remembered: the ids are those of the text encoded whole. Where a tokenizer works otherwise,
    or a text holds one of its special strings, the text is encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        self.by_pieces = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not said.get("normalizer")
            and not said["model"].get("dropout")
        )
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], dtype=self.kind).tobytes()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_pieces &= len(self.line) == 1

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind) for e in found]

    def _cut(self, text: str) -> list[str] | None:
        if not self.by_pieces or any(s in text for s in self.special):
            return None
        return (LATIN_PIECES if _is_latin(text) and not SEPARATORS.search(text) else PIECES).findall(text)

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces. A line feed is a piece of its own between any two others, so many go in one text."""
        blank = [p for p in pieces if p.isspace()]
        self._remember(blank, [i.tobytes() for i in self._ids(blank)])
        pieces = [p for p in pieces if not p.isspace()]
        groups = [pieces[i : i + 512] for i in range(0, len(pieces), 512)]
        width = self.kind.itemsize
        for group, ids in zip(groups, self._ids(["\n".join(g) for g in groups])):
            cuts = (np.flatnonzero(ids == self.line[0]) * width).tolist()
            if len(cuts) != len(group) - 1:
                raise ValueError("the tokenizer does not keep line feeds apart")
            data = ids.tobytes()
            self._remember(group, [data[a:b] for a, b in zip([0, *(c + width for c in cuts)], [*cuts, len(data)])])

    def _remember(self, pieces: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(pieces, ids))
        self.held += sum(map(len, pieces)) + sum(map(len, ids)) + 150 * len(pieces)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.held > REMEMBERED // 2:  # what is asked for again comes back from the older half
            self.known, self.old, self.held = {}, self.known, 0
        cut = [self._cut(t or "") for t in texts]
        pieces = list(set().union(*(c for c in cut if c)))
        near = dict(zip(pieces, map(self.known.get, pieces)))  # small enough to stay near the processor
        new = [p for p, ids in near.items() if ids is None]
        back = [p for p in new if p in self.old]
        self._remember(back, [self.old[p] for p in back])
        new = [p for p in new if p not in self.known]
        if new:
            self._learn(new)
        for p in (back, new):
            near.update(zip(p, map(self.known.get, p)))
        get = near.__getitem__
        whole = iter(self._ids([t or "" for t, c in zip(texts, cut) if c is None]))
        return [(next(whole).tobytes() if c is None else b"".join(map(get, c))) + self.end for c in cut]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """The worker's encoder; made once, with what it remembers."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Writer:
    """Writes one file: add() for each document in order, then close()."""

    def __init__(self, out, kind: np.dtype, level: int = 1):
        self.out, self.kind = out, kind
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        step = FRAME_TOKENS * self.kind.itemsize
        for at in range(0, len(ids), step):
            part = ids[at : at + step]
            packed = self.compressor.compress(part)
            self.out.write(packed)
            self.entries.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.documents.append((doc_id or 0, len(ids) // self.kind.itemsize, doc_id is None))

    def close(self) -> None:
        about = struct.pack("<BQ", self.kind.itemsize, len(self.documents))
        self.out.write(skippable(SKIPPABLE_DOCS, about + np.array(self.documents, dtype=DOCUMENT).tobytes()))
        table = np.array(self.entries, dtype=ENTRY).tobytes()
        footer = struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEKABLE)
        self.out.write(skippable(SKIPPABLE_SEEK, table + footer))
        self.out.close()


class Reader:
    """Reads a file's tail at once and frames only as they are asked for."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & HAS_CHECKSUMS:
            raise ValueError("the file does not end in a seek table with checksums")
        table = n * ENTRY.itemsize
        self.frames = np.frombuffer(self._at(size - 9 - table, table), dtype=ENTRY)
        self.offsets = np.r_[0, np.cumsum(self.frames["packed"], dtype=np.int64)]
        start = int(self.offsets[-1])
        content = self._at(start, size - 9 - table - 8 - start)[8:]
        width, count = struct.unpack_from("<BQ", content)
        self.kind = np.dtype(f"<u{width}")
        self.documents = np.frombuffer(content, dtype=DOCUMENT, count=count, offset=9)
        each = -(-self.documents["n_tokens"] // FRAME_TOKENS)
        self.first_frame = np.r_[0, np.cumsum(each, dtype=np.int64)]
        self.starts = np.r_[0, np.cumsum(self.documents["n_tokens"], dtype=np.int64)]
        self.decompressor = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at this place of the file."""
        parts = []
        for k in range(int(self.first_frame[place]), int(self.first_frame[place + 1])):
            packed = self._at(int(self.offsets[k]), int(self.frames["packed"][k]))
            part = self.decompressor.decompress(packed)
            if xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != self.frames["checksum"][k]:
                raise ValueError(f"frame {k} does not match its checksum")
            parts.append(part)
        return np.frombuffer(b"".join(parts), dtype=self.kind)

    def places(self, wanted: Iterable[int] | None = None) -> Iterator[int]:
        """Places of the documents with these ids, or of all."""
        if wanted is None:
            yield from range(len(self.documents))
        else:
            found = np.isin(self.documents["doc_id"], list(wanted)) & (self.documents["is_null"] == 0)
            yield from map(int, np.flatnonzero(found))


def _write_partition(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    code = encoder(tokenizer, end_id)
    number = TaskContext.get().partitionId()
    store, place = pafs.FileSystem.from_uri(folder)
    name = f"{number:07d}-{uuid.uuid4().hex}.tok.zst"
    out = None
    docs = tokens = 0
    for b in batches:
        if not b.num_rows:
            continue
        if out is None:
            store.create_dir(place, recursive=True)
            out = Writer(store.open_output_stream(f"{place}/{name}", compression=None), code.kind)
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.r_[0, np.searchsorted(sizes, np.arange(PORTION, int(sizes[-1]) + 1, PORTION)) + 1, b.num_rows])
        for lo, hi in zip(cuts, cuts[1:]):
            part = b.slice(lo, hi - lo)
            for doc_id, ids in zip(part.column(0).to_pylist(), code.encode(part.column(1).to_pylist())):
                out.add(doc_id, ids)
                docs, tokens = docs + 1, tokens + len(ids) // code.kind.itemsize
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"file": [number], "path": [f"{folder}/{name}"], "docs": [docs], "tokens": [tokens]})


def write(docs: DataFrame, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes documents(doc_id, text) in ascending doc_id order.

    Returns the manifest, a row a file: file, path, docs, tokens and start (ids in all files
    before it). Texts are shuffled once, into ranges of doc_id; ids never are.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    ranges = rows.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)
    folder = new_folder(spark, "tokens")

    def run(batches):
        return _write_partition(batches, folder, tokenizer, end_id)

    files = written(ranges.mapInArrow(run, "file long, path string, docs long, tokens long"), "manifest")
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read_files(batches: Iterator[pa.RecordBatch], wanted: list[int] | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            store, place = pafs.FileSystem.from_uri(path)
            with store.open_input_file(place) as source:
                reader = Reader(source, source.size())
                held: list[tuple] = []
                size = 0
                for k in reader.places(wanted):
                    d = reader.documents[k]
                    ids = reader.ids(k).astype("<u4").tobytes()
                    held.append((None if d["is_null"] else int(d["doc_id"]), start + int(reader.starts[k]), int(d["n_tokens"]), ids))
                    size += len(ids)
                    if size > PORTION:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["doc_id", "start", "n_tokens", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), kinds)], names=names)


def read(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers) of all documents or of
    those wanted, from the files."""

    def run(batches):
        return _read_files(batches, wanted)

    # A file a task: by the few bytes of the manifest's rows alone, Spark would put them all in one.
    files = manifest.select("path", "start").repartition(min(max(1, manifest.count()), MOST_TASKS))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
