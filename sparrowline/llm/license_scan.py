"""License scan: a generalised suffix automaton of license wordings, run over whole texts.

All templates and phrases are token sequences in one automaton. A text's words are streamed
through it, which gives for each place the longest match that ends there (matching
statistics). Phrases are counted wherever the current match ends in one. Maximal matches of
several words are anchors; anchors of one template are chained in text order and template
order, and what the best chain covers of the template decides about its label.

Two words that never follow each other in a template cannot be inside a match, so only runs of
known neighbours go through the automaton, word by word; everything else is skipped in numpy.
The automaton depends on the templates alone and is small; texts are read in pieces, and its
state is carried over from one piece to the next.

Defined cases: a null text is empty and has no words; score is 0 then; repeated rows are scanned
each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparrowline.llm.common import pick
from sparrowline.llm.license_texts import NAMES, PHRASES, TEMPLATES

#: Words are made of 0-9, a-z and everything beyond ASCII; A-Z are lower-cased; all other bytes part words.
AS_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
PIECE = 1 << 20
PART = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

#: An anchor has this many words at least; a chain may leave out so many words between anchors.
LEAST_WORDS, MOST_BETWEEN = 3, 24
#: Share of a template that a chain covers to give its label.
COVERED = 0.6


def words_of(text: str) -> list[str]:
    return text.encode().translate(AS_WORDS).decode().split()


def place_of(words: list[str], inside: list[str]) -> tuple[int, int] | None:
    """Where words first stand together inside others: from, to; none if they do not."""
    return next(((i, i + len(words)) for i in range(len(inside)) if inside[i : i + len(words)] == words), None)


class Automaton:
    """Generalised suffix automaton of token sequences, with the ends of each template by state."""

    def __init__(self, templates: list[list[int]], phrases: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (template, place of the last word)
        for t, tokens in enumerate(templates):
            last = 0
            for place, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].append((t, place))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        # Of each state, the phrases that its words end in: (phrase, words).
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for p, tokens in enumerate(phrases):
            state = 0
            for token in tokens:
                state = self.next[state][token]
            self.phrases[state].append((p, len(tokens)))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.phrases[state] = self.phrases[state] + self.phrases[self.link[state]]

    def _new(self, length: int, link: int, follows: dict[int, int]) -> int:
        self.next.append(follows)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, token: int) -> int:
        """The state for the words of p and the token, made by cutting the one they lead to if need be."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, token)
        return state

    def step(self, state: int, matched: int, token: int) -> tuple[int, int]:
        """The longest suffix of the match and the token that is in a template."""
        while state and token not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if token in self.next[state]:
            return self.next[state][token], matched + 1
        return 0, 0


@dataclass
class Found:
    """What a text has shown so far."""

    words: int = 0
    base: int = 0
    first: int | None = None
    last: int | None = None
    base_labels: set[str] = field(default_factory=set)
    anchors: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)  # template: (text place, template place, words)


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES):
        self.labels = [label for label, _ in templates]
        self.phrase_labels = [label for label, _ in phrases]
        texts = [words_of(t) for _, t in templates]
        self.names = [
            [at for of, name in NAMES if of == label and (at := place_of(words_of(name), words))] for label, words in zip(self.labels, texts)
        ]
        base = [words_of(t) for _, t in phrases]
        self.ids: dict[bytes, int] = {}
        for w in (w for t in [*texts, *base] for w in t):
            self.ids.setdefault(w.encode(), len(self.ids) + 1)
        coded = [[self.ids[w.encode()] for w in t] for t in [*texts, *base]]
        self.sizes = [len(t) for t in texts]
        self.automaton = Automaton(coded, coded[len(texts) :])
        self.follows = np.zeros((len(self.ids) + 1, len(self.ids) + 1), dtype=bool)
        for t in coded:
            self.follows[t[:-1], t[1:]] = True

    def scan(self, text: bytes | None) -> Found:
        out = Found()
        state = matched = before = at = 0
        text = text or b""
        while at < len(text):
            end = len(text)
            if end - at > PIECE and (cut := PART.search(text, at + PIECE)):
                end = cut.start()
            words = text[at:end].translate(AS_WORDS).split()
            at = end
            if not words:
                continue
            ids = np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.int64, count=len(words))
            ids = np.r_[before, ids]  # the last word of the piece before
            state, matched = self._run(ids, out, state, matched)
            before = int(ids[-1])
            out.words += len(words)
        self._anchor(out, state, matched, out.words - 1)
        return out

    def _run(self, ids: np.ndarray, out: Found, state: int, matched: int) -> tuple[int, int]:
        """Streams words ids[1:]; the match so far ends in ids[0]. Returns the match that ends in the last."""
        meet = self.follows[ids[:-1], ids[1:]]
        edges = np.flatnonzero(np.diff(np.r_[False, meet, False].astype(np.int8)))
        done = 0
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):  # words lo..hi follow each other
            if lo or not matched:
                self._anchor(out, state, matched, out.words + done - 1)
                state, matched = self.automaton.step(0, 0, int(ids[lo]))
            for i in range(lo + 1, hi + 1):
                was, had = state, matched
                state, matched = self.automaton.step(state, matched, int(ids[i]))
                if matched <= had:
                    self._anchor(out, was, had, out.words + i - 2)
                for phrase, size in self.automaton.phrases[state]:
                    if matched >= size:
                        self._phrase(out, phrase, out.words + i - size)
            done = hi
        if done < len(ids) - 1:
            self._anchor(out, state, matched, out.words + done - 1)
            state, matched = self.automaton.step(0, 0, int(ids[-1]))
        return state, matched

    def _phrase(self, out: Found, phrase: int, start: int) -> None:
        out.base += 1
        out.first = start if out.first is None else min(out.first, start)
        out.last = start if out.last is None else max(out.last, start)
        out.base_labels.add(self.phrase_labels[phrase])

    def _anchor(self, out: Found, state: int, matched: int, last_word: int) -> None:
        if matched < LEAST_WORDS:
            return
        for t, place in self.automaton.ends[state]:
            if t < len(self.sizes):
                out.anchors.setdefault(t, []).append((last_word - matched + 1, place - matched + 1, matched))

    def covered(self, out: Found) -> dict[str, float]:
        """For each label the largest share of one of its templates that a chain covers."""
        best: dict[str, float] = dict.fromkeys(out.base_labels, 1.0)
        for t, anchors in out.anchors.items():
            if self.names[t] and not any(b <= lo and hi <= b + n for lo, hi in self.names[t] for _, b, n in anchors):
                continue
            share = chain(sorted(set(anchors)), self.sizes[t]) / self.sizes[t]
            best[self.labels[t]] = max(best.get(self.labels[t], 0.0), share)
        return best


def chain(anchors: list[tuple[int, int, int]], size: int) -> int:
    """Words of the template that the best chain of anchors covers.

    The next anchor of a chain starts later both in the text and in the template; words in
    common with the one before count once, and between the two at most MOST_BETWEEN words of
    the text are left out. So only anchors less than size + MOST_BETWEEN words back matter.
    """
    best: list[int] = []
    low = 0
    for k, (a, b, n) in enumerate(anchors):
        while anchors[low][0] < a - size - MOST_BETWEEN:
            low += 1
        most = n
        for j in range(low, k):
            x, y, m = anchors[j]
            if x < a and y < b and a - (x + m) <= MOST_BETWEEN:
                new = n - max(0, x + m - a, y + m - b)
                if new > 0:
                    most = max(most, best[j] + new)
        best.append(most)
    return max(best, default=0)


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    """The worker's scanner over the fixed templates, made once."""
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = scanner()
    for b in batches:
        rows = []
        for text in b.column(1):
            found = scan.scan(text.as_py())
            shares = scan.covered(found)
            labels = found.base_labels | {label for label, share in shares.items() if share >= COVERED}
            rows.append(
                (
                    found.words,
                    found.base,
                    found.first,
                    found.last,
                    ",".join(sorted(found.base_labels)),
                    ",".join(sorted(labels)),
                    min(1.0, max(shares.values(), default=0.0)),
                )
            )
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=COLUMNS)


COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each row.

    base_labels: of phrases; labels: these and those of templates that are covered by COVERED at
    least; score: the largest covered share of a template, 1 where there is a phrase.
    """
    rows = pick(docs, "doc_id", "text")
    rows = rows.select(rows["doc_id"].cast("long").alias("doc_id"), rows["text"].cast("binary").alias("text"))
    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInArrow(_scan_batches, kinds)
