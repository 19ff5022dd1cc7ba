"""Main text of web pages: a recurrent labeller reads a page's blocks in order and keeps the article's.

Each leaf block (see html_blocks) becomes two vectors: the hashed tags and names on its path, and its
hashed words with a few numbers on its shape. A bidirectional LSTM in numpy reads the whole sequence
of a page, so each block is judged by what stands before and after it. It is trained on the driver
from `PAGES` made pages (see page_layouts) with fixed seeds; nothing is learned from the table, so a
page has the same text in every table. Training takes some 15 seconds, once a process.

Pages never move: a task reads its pages, labels them in groups of like length, and writes their
texts. A page of more than `CHUNK` blocks is labelled by itself, in chunks that hand the state on, so
the memory it takes beside its text is some hundred bytes a block.

Defined cases. Null html is empty; a page without kept blocks has an empty text. Repeated pages are
labelled alike, each by itself; null ids and urls stay null; extra columns are left out, whatever
they are called; an empty table gives an empty result. No block is dropped but by its label.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.common import pick
from sparrowline.llm.html_blocks import Block, Paths, blocks_of
from sparrowline.llm.page_layouts import page

PATH_SIZE, WORD_SIZE = 256, 64
SHAPE_SIZE = 10
#: Made pages that the labeller learns from, passes over them, hidden numbers of each direction.
PAGES, EPOCHS, HIDDEN, BATCH = 4000, 6, 24, 64
#: Blocks that are labelled together; bytes whose words are hashed together; characters of pages read together.
CHUNK, HASHED_AT_ONCE, READ_AT_ONCE = 8192, 1 << 19, 4 << 20
#: What is left of a text's numbers where words are not to be read: the share of links.
WORDLESS = np.zeros(WORD_SIZE + SHAPE_SIZE, dtype=np.float32)
WORDLESS[WORD_SIZE + 2] = 1
RESULT = "page_id long, url string, text string, n_chars long"


def _buckets(token: str) -> tuple[int, int, int]:
    """Two places of a path's vector with a sign."""
    h = zlib.crc32(token.encode())
    return h % PATH_SIZE, (h >> 12) % PATH_SIZE, 1 - 2 * (h >> 31)


def path_vectors(paths: Paths) -> np.ndarray:
    """For each path the sum over its elements of hashed tags, pairs of tags, and names (whole and by their first letters)."""
    out = np.zeros((len(paths), PATH_SIZE), dtype=np.float32)
    for i in range(1, len(paths)):
        parent, tag = paths.parents[i], paths.tags[i]
        out[i] = out[parent]
        tokens = [f"tag {tag}", f"pair {paths.tags[parent]} {tag}"]
        for w in paths.words[i]:
            tokens += [f"name {w}", f"start {w[:4]}"]
        for token in tokens:
            a, b, sign = _buckets(token)
            out[i, a] += 1
            out[i, b] += sign
    return np.clip(out, -3, 3)


_COEFFICIENTS = (np.random.default_rng(5).integers(1, 2**31, 64) * 2 + 1).astype(np.int64)
_SPACE = ord(" ")
_SHAPES = {
    name: np.isin(np.arange(256), list(signs))
    for name, signs in (("digit", b"0123456789"), ("end", b".!?"), ("comma", b",;:"), ("upper", bytes(range(65, 91))), ("sign", b"|<>/@#&%$*_=+()[]{}\xc2"))
}


def _hashed(data: np.ndarray, sums: np.ndarray, block: np.ndarray) -> None:
    """Adds the words of bytes (folded to lower case) to the vector of the block each byte belongs to."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int64)
    solid = data != _SPACE
    first = solid & ~np.concatenate([[False], solid[:-1] & (block[1:] == block[:-1])])
    starts = np.flatnonzero(first)
    if not len(starts):
        return
    data, lower, solid, block = (x[starts[0] :] for x in (data, lower, solid, block))
    starts = starts - starts[0]
    inside = np.arange(len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    hashes = np.add.reduceat(np.where(solid, lower * _COEFFICIENTS[inside % 64], 0), starts)
    bucket = ((hashes * 0x9E3779B1) >> 15) % (2 * WORD_SIZE)
    np.add.at(sums, (block[starts], bucket % WORD_SIZE), np.where(bucket < WORD_SIZE, 1.0, -1.0))
    np.add.at(sums[:, WORD_SIZE], block[starts], 1)


def text_vectors(blocks: list[Block]) -> np.ndarray:
    """Hashed words of the whole texts, by their number, and the shape of each block."""
    n = len(blocks)
    sums, shapes = np.zeros((n, WORD_SIZE + 1)), np.zeros((n, len(_SHAPES)))
    sizes = np.zeros(n)
    at = 0
    while at < n:
        stop, size, data = at, 0, []
        while stop < n and (stop == at or size < HASHED_AT_ONCE):
            data.append(blocks[stop].text.encode("utf-8", "replace"))
            size += len(data[-1])
            stop += 1
        owner = np.repeat(np.arange(at, stop), [len(d) for d in data])
        joined = np.frombuffer(b"".join(data), dtype=np.uint8)
        sizes[at:stop] = [len(d) for d in data]
        for lo in range(0, len(joined), HASHED_AT_ONCE):  # a long text in pieces
            some, whose = joined[lo : lo + HASHED_AT_ONCE], owner[lo : lo + HASHED_AT_ONCE]
            _hashed(some, sums, whose)
            for k, table in enumerate(_SHAPES.values()):
                shapes[:, k] += np.bincount(whose[table[some]], minlength=n) if len(some) else 0
        at = stop
    words = sums[:, WORD_SIZE]
    linked = np.array([b.linked / max(1, len(b.text)) for b in blocks])
    ends = np.array([b.text[-1:] in ".!?…”\"" for b in blocks], dtype=float)
    per_word = shapes / np.maximum(1, words)[:, None]
    shape = np.column_stack([np.log1p(words) / 3, np.log1p(sizes) / 5, linked, ends, words <= 3, np.minimum(per_word, 1)])
    # A word repeated a thousand times says no more than one that is there a few times.
    hashed = np.clip(sums[:, :WORD_SIZE] / np.sqrt(np.maximum(1, words))[:, None], -2, 2)
    return np.hstack([hashed, shape]).astype(np.float32)


class Model(NamedTuple):
    """Weights by direction: of paths, of texts, of the state; then of the label. Gates: input, forget, output, candidate."""

    paths: np.ndarray
    texts: np.ndarray
    state: np.ndarray
    bias: np.ndarray
    label: np.ndarray
    threshold: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gates(z: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, ...]:
    h = z.shape[-1] // 4
    s, g = _sigmoid(z[..., : 3 * h]), np.tanh(z[..., 3 * h :])
    i, f, o = s[..., :h], s[..., h : 2 * h], s[..., 2 * h :]
    new = f * cell + i * g
    return i, f, o, g, new, np.tanh(new)


def _run(z: np.ndarray, state: np.ndarray, there: np.ndarray, kept: list | None = None) -> np.ndarray:
    """Hidden states [step, direction, page, hidden] of inputs z [step, direction, page, gates].

    In direction 1 the steps of z are already in reverse. A page that has ended (not there) stays as it is.
    """
    steps, _, pages, gates = z.shape
    h = c = np.zeros((2, pages, gates // 4), dtype=z.dtype)
    out = np.empty((steps, 2, pages, gates // 4), dtype=z.dtype)
    for t in range(steps):
        i, f, o, g, new, squashed = _gates(z[t] + h @ state, c)
        m = there[t][None, :, None]
        if kept is not None:
            kept.append((h, c, i, f, o, g, squashed, m))
        c, h = np.where(m, new, c), np.where(m, o * squashed, h)
        out[t] = h
    return out


def _padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places [step, page] of blocks that follow one another by page, forwards and backwards; -1 where a page has ended."""
    steps = np.arange(lengths.max())[:, None]
    starts = np.r_[0, np.cumsum(lengths)[:-1]][None, :]
    there = steps < lengths[None, :]
    return np.where(there, starts + steps, -1), np.where(there, starts + lengths[None, :] - 1 - steps, -1)


def _inputs(model: Model, by_path: np.ndarray, path: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """[direction, block, gates]; `by_path` is worked out once a path."""
    return by_path[:, path] + texts @ model.texts + model.bias[:, None]


def scores(model: Model, by_path: np.ndarray, pages: list[list[Block]]) -> np.ndarray:
    """The score of each block of some pages together; above zero is main text."""
    blocks = [b for p in pages for b in p]
    z = _inputs(model, by_path, np.array([b.path for b in blocks]), text_vectors(blocks))
    forth, back = _padded(np.array([len(p) for p in pages]))
    out = _run(np.stack([z[0][forth], z[1][back]], axis=1), model.state, forth >= 0)
    hidden = np.empty((len(blocks), 2 * model.state.shape[1]), dtype=np.float32)
    there, size = forth >= 0, model.state.shape[1]
    hidden[forth[there], :size] = out[:, 0][there]
    hidden[back[there], size:] = out[:, 1][there]
    return hidden @ model.label + model.threshold


def _long_scores(model: Model, by_path: np.ndarray, blocks: list[Block], chunk: int = CHUNK) -> np.ndarray:
    """The same for one long page: each direction chunk by chunk, the state handed on."""
    found = np.full(len(blocks), float(model.threshold), dtype=np.float64)
    size = model.state.shape[1]
    for direction in range(2):
        h, c = np.zeros(size, dtype=np.float32), np.zeros(size, dtype=np.float32)
        w, label = model.state[direction], model.label[direction * size : (direction + 1) * size]
        cuts = range(0, len(blocks), chunk)
        for lo in cuts if direction == 0 else reversed(cuts):
            some = blocks[lo : lo + chunk]
            z = _inputs(model, by_path, np.array([b.path for b in some]), text_vectors(some))[direction]
            for t in range(len(some)) if direction == 0 else range(len(some) - 1, -1, -1):
                _, _, o, _, c, squashed = _gates(z[t] + h @ w, c)
                h = o * squashed
                found[lo + t] += h @ label
    return found


def labels(model: Model, paths: Paths, pages: list[list[Block]], chunk: int = CHUNK) -> list[np.ndarray]:
    """For each page which of its blocks are main text; pages of like length are labelled together."""
    by_path = path_vectors(paths) @ model.paths
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
    group: list[int] = []

    def close() -> None:
        if group:
            found = scores(model, by_path, [pages[i] for i in group]) > 0
            for i, part in zip(group, np.split(found, np.cumsum([len(pages[i]) for i in group])[:-1])):
                out[i] = part
            group.clear()

    for i in sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i])):
        if len(pages[i]) > chunk:
            out[i] = _long_scores(model, by_path, pages[i], chunk) > 0
            continue
        if group and (len(group) + 1) * len(pages[i]) > chunk:
            close()
        group.append(i)
    close()
    return out


class _Trainer:
    """Adam on the cross-entropy of all labels of a batch, through time."""

    def __init__(self, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        text = WORD_SIZE + SHAPE_SIZE

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.normal(size=shape) * scale).astype(np.float32)

        bias = np.zeros((2, 4 * hidden), dtype=np.float32)
        bias[:, hidden : 2 * hidden] = 1
        self.model = Model(
            normal(2, PATH_SIZE, 4 * hidden, scale=0.08), normal(2, text, 4 * hidden, scale=0.1), normal(2, hidden, 4 * hidden, scale=0.15),
            bias, normal(2 * hidden, scale=0.2), np.zeros((), dtype=np.float32),
        )
        self.first = [np.zeros_like(w) for w in self.model]
        self.second = [np.zeros_like(w) for w in self.model]
        self.step = 0

    def learn(self, path: np.ndarray, text: np.ndarray, label: np.ndarray, lengths: np.ndarray, rate: float) -> float:
        m, size = self.model, self.model.state.shape[1]
        z = path @ m.paths + text @ m.texts + m.bias[:, None]
        forth, back = _padded(lengths)
        there, kept = forth >= 0, []
        out = _run(np.stack([z[0][forth], z[1][back]], axis=1), m.state, there, kept)
        hidden = np.empty((len(label), 2 * size), dtype=np.float32)
        hidden[forth[there], :size], hidden[back[there], size:] = out[:, 0][there], out[:, 1][there]
        p = _sigmoid(hidden @ m.label + m.threshold)
        wrong = (p - label).astype(np.float32) / len(label)
        d_hidden = wrong[:, None] * m.label[None]
        d_out = np.stack([np.where(there[..., None], d_hidden[forth, :size], 0), np.where(there[..., None], d_hidden[back, size:], 0)], axis=1)
        d_z = np.zeros(d_out.shape[:3] + (4 * size,), dtype=np.float32)
        d_h = d_c = np.zeros_like(d_out[0])
        d_state = np.zeros_like(m.state)
        for t in range(len(there) - 1, -1, -1):
            h, c, i, f, o, g, squashed, mask = kept[t]
            dh = d_h + d_out[t]
            dc = np.where(mask, dh * o * (1 - squashed**2) + d_c, 0)
            d = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), np.where(mask, dh, 0) * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=-1)
            d_z[t] = d
            d_state += h.transpose(0, 2, 1) @ d
            d_h = np.where(mask, d @ m.state.transpose(0, 2, 1), d_h)
            d_c = np.where(mask, dc * f, d_c)
        d_in = np.zeros((2, len(label), 4 * size), dtype=np.float32)
        d_in[0][forth[there]], d_in[1][back[there]] = d_z[:, 0][there], d_z[:, 1][there]
        self._update([path.T @ d_in, text.T @ d_in, d_state, d_in.sum(axis=1), hidden.T @ wrong, wrong.sum()], rate)
        return float(-np.mean(np.log(np.maximum(np.where(label > 0, p, 1 - p), 1e-9))))

    def _update(self, gradients: list[np.ndarray], rate: float) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in gradients))
        new = []
        for k, (w, g) in enumerate(zip(self.model, gradients)):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.99 * self.second[k] + 0.01 * g**2
            a, b = self.first[k] / (1 - 0.9**self.step), self.second[k] / (1 - 0.99**self.step)
            new.append((w - rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32))
        self.model = Model(*new)


@functools.lru_cache(maxsize=4)
def trained(pages: int = PAGES, epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = 11) -> Model:
    """The labeller, learned from made pages 0 to `pages`."""
    paths, sequences, marks = Paths(), [], []
    for s in range(pages):
        source, known = page(s)
        blocks = blocks_of(source, paths)
        if blocks:
            sequences.append(blocks)
            marks.append(np.array([label for label, _ in known], dtype=np.float32))
    by_path = path_vectors(paths)
    texts = [text_vectors(s) for s in sequences]
    trainer, rng = _Trainer(hidden, seed), np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(sequences))
        # Pages of like length make a batch; batches come in any order.
        order = order[np.argsort([len(sequences[i]) for i in order], kind="stable")]
        batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
        for b in rng.permutation(len(batches)):
            some = batches[b]
            path = by_path[[x.path for i in some for x in sequences[i]]]
            # Some path numbers are left out at random, so that no single name decides.
            path = path * (rng.random(path.shape) > 0.1)
            # One page in five is read without its words, one in ten without paths: each must do by itself.
            heard = [texts[i] * (1 if rng.random() > 0.2 else WORDLESS) for i in some]
            seen = np.repeat(rng.random(len(some)) > 0.1, [len(sequences[i]) for i in some])
            path = path * seen[:, None]
            trainer.learn(path.astype(np.float32), np.concatenate(heard).astype(np.float32), np.concatenate([marks[i] for i in some]), np.array([len(sequences[i]) for i in some]), 0.01 * (1 - epoch / epochs) + 0.001)
    return trainer.model


def main_texts(model: Model, pages: list[str], chunk: int = CHUNK) -> list[str]:
    paths = Paths()
    blocks = [blocks_of(p, paths) for p in pages]
    return ["\n\n".join(b.text for b, keep in zip(some, found) if keep) for some, found in zip(blocks, labels(model, paths, blocks, chunk))]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page."""
    weights = tuple(model or trained())
    rows = pick(pages, "page_id", "url", "html")
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*weights)
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch["html"]).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + READ_AT_ONCE, side="right")))
                part = batch.slice(lo, hi - lo)
                texts = main_texts(model, part["html"].to_pylist())
                yield pa.record_batch([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                lo = hi

    return rows.mapInArrow(run, RESULT)
