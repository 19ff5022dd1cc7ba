"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded texts.

Folding: lower case, accents and compatibility forms removed, letters of other scripts that look
like Latin ones and digits or signs that stand for letters replaced, all else turned into one
space between words. Lexicon entries are whole words or beginnings of words; the longest one
counts at each word, and none inside an exception phrase. The sum of weights, divided by the
length, goes through a logistic curve.

Learning: entries and weights (log-odds of a document being toxic) come from the labels of the
training rows, whose crc32(doc_id) mod 5 is not 0, and from a short list of common insults that
counts as SEED_DOCS toxic documents. Entries must stand out by a likelihood-ratio test.
Exception phrases are pairs of words around an entry that clean documents use. A part of the
training rows is kept from the lexicon for fitting the curve. At most about LABELLED rows, taken by a
hash of their id, are learned from; scoring always covers all documents and whole texts. No
score uses labels, language, source or id.

Defined cases: a null or empty text has no words and gets the curve's value there; rows without
label or with a null one are scored, not learned from; of several labels of a document the
largest counts; repeated rows are scored each; without any training row all scores are 0; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparrowline.llm.common import pick, written
from sparrowline.llm.simhash import fingerprint
from sparrowline.llm.toxic_words import DIGITS, LOOKALIKES, SEEDS, SIGNS

#: Bound of the labelled rows that are learned from; it bounds the lexicon as well.
LABELLED = 20_000
SEED_DOCS = 4.0
#: An entry is in so many toxic documents, with so large a likelihood ratio and so large log-odds, at least.
LEAST_DOCS, LEAST_RATIO, LEAST_ODDS = 5, 30.0, 1.0
PREFIXES = range(4, 11)


class _Fold(dict):
    """What each code point becomes."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        plain = LOOKALIKES.get(c) or LOOKALIKES.get(c.lower()) or unicodedata.normalize("NFKD", c).lower()
        out = "".join(DIGITS.get(x, x if x.isalpha() else " ") for x in plain if not unicodedata.combining(x))
        self[point] = out if out or unicodedata.combining(c) else " "
        return self[point]


_fold = _Fold()
_sign = re.compile("(?<=\\w)[" + re.escape("".join(SIGNS)) + "](?=\\w)")


def folded(text: str | None) -> list[str]:
    """The folded words of a whole text."""
    text = text or ""
    if any(s in text for s in SIGNS):
        text = _sign.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(_fold).split()


@dataclass
class Lexicon:
    """Entries: (text, is a whole word, weight); exceptions: phrases of whole words."""

    entries: list[tuple[str, bool, float]]
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=list)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def automaton(self) -> ahocorasick.Automaton:
        found: dict[str, list] = defaultdict(list)
        for text, whole, weight in self.entries:
            found[f" {text}"].append((len(text) + 1, whole, weight))
        for text in self.exceptions:
            found[f" {text}"].append((len(text) + 1, True, None))
        a = ahocorasick.Automaton()
        for text, values in found.items():
            a.add_word(text, values)
        if len(a):
            a.make_automaton()
        return a


_automata: dict[str, ahocorasick.Automaton] = {}


def matches(lexicon: Lexicon, words: list[str]) -> list[tuple[int, float, str]]:
    """(place, weight, entry) of the entries that count, in the text of these words joined by spaces."""
    if lexicon.name not in _automata:
        _automata.clear()
        _automata[lexicon.name] = lexicon.automaton()
    automaton = _automata[lexicon.name]
    if not len(automaton) or not words:
        return []
    text = f" {' '.join(words)} "
    best: dict[int, tuple[int, bool, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, values in automaton.iter(text):
        ends_word = text[end + 1] == " "
        for size, whole, weight in values:
            start = end - size + 1
            if whole and not ends_word:
                continue
            if weight is None:
                spared.append((start, end))
            elif start not in best or (size, whole) > best[start][:2]:
                best[start] = (size, whole, weight)
    for start, end in spared:
        for k in [k for k in range(start, end) if k in best]:
            del best[k]
    return [(k, w, text[k + 1 : k + size]) for k, (size, _, w) in sorted(best.items())]


def features(lexicon: Lexicon, words: list[str]) -> tuple[float, float]:
    """Weights by word, and by the root of the number of words."""
    total, n = sum(w for _, w, _ in matches(lexicon, words)), len(words)
    return 10 * total / (n + 10), total / (n + 10) ** 0.5


def curve_value(curve: list[float], x: tuple[float, float]) -> float:
    z = curve[0] + curve[1] * x[0] + curve[2] * x[1]
    return 1 / (1 + float(np.exp(-np.clip(z, -40, 40))))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> list[float]:
    """Logistic regression with an intercept, by Newton's steps."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (y - p) - ridge * w
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + (ridge + 1e-9) * np.eye(len(w)), grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def is_held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _counted(batches: Iterator[pa.RecordBatch], terms_of) -> Iterator[pa.RecordBatch]:
    """Documents by term and label, summed up in the task before they are shuffled."""
    count: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for term in terms_of(folded(text)):
                count[term][toxic] += 1
    if count:
        terms, found = list(count), np.array(list(count.values()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms), pa.array(found[:, 1]), pa.array(found[:, 0])], names=["term", "toxic", "clean"]
        )


def _entries_of(words: Iterable[str]) -> set[str]:
    """`word ` for each word, and its beginnings."""
    words = set(words)
    return {w + " " for w in words if len(w) >= 3} | {w[:k] for w in words for k in PREFIXES if k < len(w)}


def _phrases_of(lexicon: Lexicon, words: list[str]) -> set[str]:
    """Pairs of neighbours of which one is where an entry counts."""
    at, starts = 0, {}
    for i, w in enumerate(words):
        starts[at] = i
        at += len(w) + 1
    hit = {starts[k] for k, _, _ in matches(lexicon, words)}
    return {f"{words[j]} {words[j + 1]}" for i in hit for j in (i - 1, i) if 0 <= j and j + 1 < len(words)}


def _sums(rows: DataFrame, terms_of) -> DataFrame:
    def run(batches):
        return _counted(batches, terms_of)

    found = rows.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """text, toxic: one of the rows(doc_id, text, toxic) with the same label and SimHash fingerprint.

    Copies and near-copies of a text would make all of its words stand out: one of them counts.
    """

    def run(batches):
        for b in batches:
            prints = [fingerprint(None if t is None else t.encode()) for t in b.column(1).to_pylist()]
            fp = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, fp], names=["doc_id", "text", "toxic", "fp"])

    kinds = rows.select(F.col("doc_id").cast("string"), "text", "toxic").mapInArrow(run, "doc_id string, text string, toxic int, fp long")
    first = kinds.groupBy("fp", "toxic").agg(F.min(F.struct("doc_id", F.xxhash64("text"), "text")).alias("first"))  # reruns take the same one
    return first.select("first.text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Lexicon:
    """The lexicon and its curve, from at most about `labelled` training rows."""
    known = (
        pick(labels, "doc_id", "toxic")
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    n = known.count()
    share = min(1.0, labelled / max(1, n))
    taken = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("taken")), F.lit(1 << 20)) < int(share * (1 << 20)))
    taken = taken.withColumn("for_curve", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(3)) == 0)
    sample = written(
        # `taken` has `labelled` rows of 13 bytes at most, about
        pick(docs, "doc_id", "text")
        .join(F.broadcast(taken), "doc_id")
        .select("doc_id", "text", "toxic", "for_curve"),
        "labelled",
    )
    for_words = written(distinct_texts(sample.filter(~F.col("for_curve"))), "distinct")
    sizes = {r.toxic: r.n for r in for_words.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon([], curve=[])

    t, c, both = F.col("toxic"), F.col("clean"), F.col("toxic") + F.col("clean")
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    ratio = 2 * (
        t * F.log(F.greatest(t, F.lit(0.5)) * (toxic + clean) / (both * toxic))
        + c * F.log(F.greatest(c, F.lit(0.5)) * (toxic + clean) / (both * clean))
    )
    stands_out = (
        _sums(for_words, _entries_of)
        .filter(t >= LEAST_DOCS)
        .withColumns({"odds": odds, "ratio": ratio})
        .filter((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= LEAST_RATIO))
        .collect()
    )
    entries = {r.term: r.odds for r in stands_out}
    for seed in SEEDS:
        term = folded(seed)[0] + " "
        entries.setdefault(term, float(np.log((SEED_DOCS + 0.5) / (toxic + 1)) - np.log(0.5 / (clean + 1))))
    lexicon = Lexicon([(e.rstrip(), e.endswith(" "), max(w, 0.0)) for e, w in sorted(entries.items())])

    spared = (
        _sums(for_words, lambda words: _phrases_of(lexicon, words))
        .withColumn("odds", odds)
        .filter((c >= LEAST_DOCS) & (F.col("odds") < 0))
        .collect()
    )
    lexicon = Lexicon(lexicon.entries, sorted(r.term for r in spared))

    def run(batches):
        for b in batches:
            x = np.array([features(lexicon, folded(s)) for s in b.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), b.column(1)], names=["x1", "x2", "toxic"])

    fit = sample.filter("for_curve").select("text", "toxic").mapInArrow(run, "x1 double, x2 double, toxic int").collect()
    fit.sort()  # the curve doesn't depend on the order in which rows arrive
    x, y = np.array([(r.x1, r.x2) for r in fit]).reshape(-1, 2), np.array([r.toxic for r in fit], dtype=float)
    lexicon.curve = fit_curve(x, y) if len(fit) else []
    return lexicon


def scores(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """`docs` as by position columns _0, _1, ..., with their score: see `score` and `filtered`."""
    at = docs.columns.index("text")
    fields = [StructField(f"_{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]

    def run(batches):
        for b in batches:
            if lexicon.curve:
                x = [curve_value(lexicon.curve, features(lexicon, folded(s.as_py()))) for s in b.column(at)]
            else:
                x = [0.0] * b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(x, pa.float64())], names=[*(f"_{i}" for i in range(b.num_columns)), "score"]
            )

    return docs.toDF(*[f"_{i}" for i in range(len(docs.columns))]).mapInArrow(
        run, StructType([*fields, StructField("score", DoubleType())])
    )


def score(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of `docs`."""
    lexicon = learn(docs, labels, labelled)
    found = scores(pick(docs, "doc_id", "text"), lexicon)
    return found.select(
        F.col("_0").alias("doc_id"),
        F.coalesce(is_held_out("_0"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def filtered(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """The rows of `docs` that are not predicted to be toxic."""
    found = scores(docs, learn(docs, labels, labelled)).filter("score < 0.5").drop("score")
    return found.toDF(*docs.columns)
