"""URL filter: rules by host and path, and a character language model where no rule fits.

Two smoothed variable-order Markov models of host and path, one of accepted and one of rejected
urls, are trained on all the distinct urls that rules decide, but for a fifth, taken by a hash. A url's score is
the difference of its log-likelihoods under them, divided by its length; it is blocked above the
threshold that separates the two classes best on all urls of that fifth, which the models have not seen.

Each character is predicted from up to ORDER characters before it. An order with n following
characters of t kinds trusts its own counts with n / (n + t) and the next lower order with the
rest (Witten-Bell), down to a uniform one.

The models are tables, as large as the corpus makes them, and never in one place. A url is taken apart into windows of
ORDER + 1 characters; windows are counted by class, and so are all their endings, of one to ORDER + 1 characters. The
probability of an ending is found from that of the ending one shorter, order by order, each a
join in which a row meets one row for each kind of character at most. Scores are the windows'
log ratios summed up by url. Frequent windows and urls are joined by broadcast (common.matched).

Defined cases: a null url or one without `://` has empty host and path, which no rule fits;
repeated rows are judged each; where rules decide no url of one class, all others are allowed; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparrowline.llm.common import matched, pick, written

ORDER = 5
KINDS = 1024  # characters that the uniform order spreads over
START, END = "\x02", "\x03"

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Rules are a short list, tried by length."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def windows_of(text: str) -> Counter[str]:
    """The windows that end in each of a text's characters and in its end."""
    padded = START * ORDER + text + END
    return Counter(padded[i - ORDER : i + 1] for i in range(ORDER, len(padded)))


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows_of(b: pa.RecordBatch, own: list[int], windows: list[str], times: list[int]) -> pa.RecordBatch:
        others = [b.column(k).take(pa.array(own, pa.int64())) for k in (0, 2, 3)]
        return pa.RecordBatch.from_arrays([*others, pa.array(windows, pa.string()), pa.array(times, pa.int64())], names=PIECES)

    for b in batches:
        own: list[int] = []
        windows: list[str] = []
        times: list[int] = []
        for row, text in enumerate(b.column(1)):
            found = windows_of(text.as_py())
            own += [row] * len(found)
            windows += found
            times += found.values()
            if len(own) > 65_536:
                yield rows_of(b, own, windows, times)
                own, windows, times = [], [], []
        yield rows_of(b, own, windows, times)


PIECES = ["id", "accepted", "rejected", "window", "times"]


def threshold(accepted: np.ndarray, rejected: np.ndarray) -> float:
    """The middle of the gap of the score, the one nearest to 0, where rejected and accepted are best apart: `best_cut` of two arrays."""
    if not len(accepted) or not len(rejected):
        return 0.0
    at = np.unique(np.r_[accepted, rejected])
    cuts = np.r_[at[0] - 1e-6, (at[:-1] + at[1:]) / 2, at[-1] + 1e-6]
    a, r = np.sort(accepted), np.sort(rejected)
    gain = np.searchsorted(a, cuts, "right") / len(a) - np.searchsorted(r, cuts, "right") / len(r)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(cuts[best[np.argmin(np.abs(cuts[best]))]])


def best_cut(scores: DataFrame) -> float:
    """The same of all rows of scores(blocked, score), however many.

    Scores are sorted by ranges; what stands before a range, and where the next one begins, are rows of ranges. Each range gives one cut.
    """
    counts = scores.groupBy("score").agg(F.count_if(F.col("blocked") == 0).alias("a"), F.count_if(F.col("blocked") == 1).alias("r"))
    ranged = written(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "score_ranges")
    ranges = ranged.groupBy("part").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.min("score").alias("first"), F.max("score").alias("last"))
    ranges = sorted(ranges.collect(), key=lambda x: x["first"])  # a row a range
    accepted, rejected = sum(x["a"] for x in ranges), sum(x["r"] for x in ranges)
    if not accepted or not rejected:
        return 0.0
    starts, a, r = [], 0, 0
    for x, later in zip(ranges, [*ranges[1:], None]):
        starts.append((x["part"], a, r, later["first"] if later else x["last"] + 2e-6))  # above all: a millionth beyond the last
        a, r = a + x["a"], r + x["r"]
    before = scores.sparkSession.createDataFrame(starts, "part int, a0 long, r0 long, next double")
    upto = W.partitionBy("part").orderBy("score").rowsBetween(W.unboundedPreceding, W.currentRow)
    after = F.coalesce(F.lead("score").over(W.partitionBy("part").orderBy("score")), F.col("next"))
    cuts = ranged.join(F.broadcast(before), "part").select(
        ((F.col("a0") + F.sum("a").over(upto)) / accepted - (F.col("r0") + F.sum("r").over(upto)) / rejected).alias("gain"),
        ((F.col("score") + after) / 2).alias("cut"),
    )
    below = scores.sparkSession.createDataFrame([(0.0, ranges[0]["first"] - 1e-6)], "gain double, cut double")  # below all
    cuts = written(cuts.unionByName(below), "cuts")
    most = cuts.agg(F.max("gain")).first()[0]
    return float(cuts.filter(F.col("gain") >= most - 1e-12).agg(F.min_by("cut", F.struct(F.abs("cut"), "cut"))).first()[0])


def endings(windows: DataFrame) -> DataFrame:
    """gram, n0, n1: how often accepted and rejected urls have each ending of the windows(window, n0, n1)."""
    sizes = F.sequence(F.lit(1), F.lit(ORDER + 1))
    grams = windows.select(F.explode(F.transform(sizes, lambda k: F.right(F.col("window"), k))).alias("gram"), "n0", "n1")
    return grams.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def probabilities(grams: DataFrame) -> DataFrame:
    """gram, p0, p1 for the grams of ORDER + 1 characters: of the last one after the others, in either class."""
    shorter = None
    for size in range(1, ORDER + 2):
        level = grams.filter(F.length("gram") == size).withColumn("context", F.substring("gram", 1, size - 1))
        ours = W.partitionBy("context")  # a row for each kind of character at most
        for c in "01":
            level = level.withColumns({f"s{c}": F.sum(f"n{c}").over(ours), f"t{c}": F.count_if(F.col(f"n{c}") > 0).over(ours)})
        if shorter is None:
            level = level.withColumns({"q0": F.lit(1 / KINDS), "q1": F.lit(1 / KINDS)})
        else:
            known = shorter.select(F.col("gram").alias("ending"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
            level = level.withColumn("ending", F.right(F.col("gram"), F.lit(size - 1))).join(known, "ending")
        for c in "01":
            n, s, t, q = (F.col(x + c) for x in "nstq")
            level = level.withColumn(f"p{c}", F.when(s > 0, (n + t * q) / (s + t)).otherwise(q))
        shorter = level.select("gram", "p0", "p1")
    return shorter


def scored(texts: DataFrame) -> DataFrame:
    """id, score of texts(id, text, accepted, rejected): by the windows' log ratios; the flags say what is learned from."""
    pieces = written(texts.mapInArrow(_window_batches, "id long, accepted int, rejected int, window string, times long"), "windows")
    windows = pieces.groupBy("window").agg(
        F.sum(F.col("times") * F.col("accepted")).alias("n0"), F.sum(F.col("times") * F.col("rejected")).alias("n1"), F.count("*").alias("rows")
    )
    windows = written(windows, "window_counts")
    likely = probabilities(written(endings(windows), "endings")).select(F.col("gram").alias("window"), F.log(F.col("p1") / F.col("p0")).alias("d"))
    ratios = written(windows.select("window", "rows").join(likely, "window"), "ratios")
    met = matched(pieces.select("id", "window", "times"), ratios, ["window"], "rows")
    # Sums differ in their last digits with the order of rows: rounded, reruns agree.
    return met.groupBy("id").agg(F.round(F.sum(F.col("times") * F.col("d")) / F.sum("times"), 12).alias("score"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the model; null where there is none): a row for each row."""
    urls = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path"))
    texts = urls.groupBy("text").agg(F.max((F.col("_rule.verdict") == "block").cast("int")).alias("blocked"), F.count("*").alias("rows"))
    kept = F.pmod(F.xxhash64("text", F.lit("kept")), F.lit(5)) == 0
    texts = texts.withColumns({"id": F.monotonically_increasing_id(), "kept": F.coalesce(kept & F.col("blocked").isNotNull(), F.lit(False))})
    texts = written(texts, "urls")
    sizes = {(r.blocked, r.kept): r.n for r in texts.groupBy("blocked", "kept").agg(F.count("*").alias("n")).collect()}
    if sizes.get((0, False)) and sizes.get((1, False)):
        learned = {c: F.when(F.col("blocked").eqNullSafe(F.lit(c)) & ~F.col("kept"), 1).otherwise(0) for c in (0, 1)}
        scores = texts.join(scored(texts.select("id", "text", learned[0].alias("accepted"), learned[1].alias("rejected"))), "id")
        scores = written(scores, "scores")
        limit = best_cut(scores.filter("kept").select("blocked", "score"))
    else:
        scores, limit = texts.withColumn("score", F.lit(None).cast("double")), 0.0
    own = F.when(F.col("score") > F.lit(limit), F.lit("block")).otherwise(F.lit("allow"))
    return matched(urls, scores.select("text", "rows", "score"), ["text"], "rows").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), "score"
    )
