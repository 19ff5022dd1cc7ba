"""Which list of a site's payloads holds its postings, and which value of theirs makes their links.

Payloads of a site are compared with the titles and links of that site only, and by indexes of their pieces: every join is on equal
keys, so a site with very many entries and links costs what they hold in common, not their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.functions import html as H
from sparrowline.functions import text as T
from sparrowline.sources.scratch import written

LEAST = 2
ID_LENGTH = (3, 64)


def entries(payloads: DataFrame) -> DataFrame:
    """site, request, path, size, index, key, value of payloads(site, request, body)."""
    return payloads.select("site", "request", F.explode(H.json_entries(F.col("body"))).alias("e")).select("site", "request", "e.*")


def _rarest(wanted: DataFrame, index: DataFrame, by: list[str]) -> DataFrame:
    """The wanted rows (site, `by`, keys) with the one of their keys that the fewest entries of index(site, key) have, as `key`.

    A row with a key that the index does not have at all can stand nowhere, and goes.
    """
    counts = index.groupBy("site", "key").agg(F.count("*").alias("_n"))
    each = wanted.select("site", *by, F.explode(F.array_distinct("keys")).alias("key")).join(counts, ["site", "key"], "left")
    least = each.groupBy("site", *by).agg(F.min_by("key", F.struct("_n", "key")).alias("key"), F.min(F.coalesce("_n", F.lit(0))).alias("_least"))
    return least.filter("_least > 0").drop("_least")


def _grams(text: Column, size: int = T.TITLE_INSIDE) -> Column:
    """All pieces of so many letters."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))


def list_of_titles(found: DataFrame, titles: DataFrame) -> DataFrame:
    """site, request, path, size, hits: the list of entries(...) that shows most of titles(site, title), at least
    LEAST and half of the shorter side; then the one whose size is nearest, then the first request and path.

    A title is shown by a value that equals it or, from six letters on, has it inside and is no more than twice as long. Equal ones
    are joined as they are. A title inside a value has all its pieces of six letters there: it is joined by the one that the
    fewest values have, and only what meets there is compared.
    """
    titles = titles.withColumn("title", T.squeezed(F.col("title"))).filter("title <> ''")
    n = titles.groupBy("site").agg(F.count("*").alias("titles"), F.max(F.length("title")).alias("longest"))
    distinct = written(titles.select("site", "title").distinct(), "titles")
    values = found.select("site", T.squeezed(F.col("value")).alias("said")).distinct().join(n.select("site", "longest"), "site")
    values = written(values.filter(F.length("said") <= 2 * F.col("longest")).drop("longest"), "values")
    equal = distinct.join(values, (distinct["site"] == values["site"]) & (F.col("title") == F.col("said"))).select(distinct["site"], "title", "said")
    index = values.filter(F.length("said") > T.TITLE_INSIDE).select("site", "said", F.explode(F.array_distinct(_grams(F.col("said")))).alias("key"))
    long = distinct.filter(F.length("title") >= T.TITLE_INSIDE).withColumn("keys", _grams(F.col("title")))
    inside = _rarest(long, index, ["title"]).join(index, ["site", "key"]).filter(T.same_title(F.col("title"), F.col("said"))).select("site", "title", "said")
    met = equal.unionByName(inside).distinct()
    shown = found.select("site", "request", "path", "size", T.squeezed(F.col("value")).alias("said")).distinct().join(met, ["site", "said"])
    hits = shown.groupBy("site", "request", "path", "size").agg(F.count_distinct("title").alias("hits")).join(n, "site")
    enough = (F.col("hits") >= LEAST) & (F.col("hits") * 2 >= F.least("titles", "size"))
    order = F.struct((-F.col("hits")).alias("h"), F.abs(F.col("size") - F.col("titles")).alias("d"), "request", "path")
    best = hits.filter(enough).groupBy("site").agg(F.min_by(F.struct("request", "path", "size", "hits"), order).alias("b"))
    return best.select("site", "b.*")


#: Signs that `_edged` puts in; addresses and ids do not have them.
EDGES = "\x01\x02\x03\x04"


def _edged(c: Column) -> Column:
    """The text with signs where a letter or digit, or none, begins and ends: one edged text holds another exactly if the plain
    one holds the other whole, with no letter or digit right before or after it."""
    runs = F.regexp_replace(F.translate(c, EDGES, ""), "([0-9A-Za-z]+)", "\x01$1\x02")
    return F.regexp_replace(F.regexp_replace(runs, "(?<!\x02)(?=[^0-9A-Za-z\x01\x02])", "\x03"), "(?<=[^0-9A-Za-z\x01-\x03])(?!\x01)", "\x04")


def _runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([0-9A-Za-z]+)"))


def id_and_template(found: DataFrame, links: DataFrame) -> DataFrame:
    """site, key, template: the key of entries(...) whose values stand whole in links(site, place, link), in another link for
    each entry, and the first such link with `{id}` for the value. Most entries count, then the longest value.

    A value that stands whole in a link has all its runs of letters and digits there: it is joined by the one that the fewest links
    have, and only what meets there is compared.
    """
    usable = found.filter(F.length("value").between(*ID_LENGTH) & F.regexp_like("value", F.lit(r"\d")))
    values = written(usable.select("site", "value").distinct(), "values")
    index = written(links.select("site", "link", "place", F.explode(F.array_distinct(_runs(F.col("link")))).alias("key")), "links")
    met = _rarest(values.withColumn("keys", _runs(F.col("value"))), index, ["value"]).join(index, ["site", "key"])
    met = met.filter(F.contains(_edged(F.col("link")), _edged(F.col("value"))))
    first = usable.join(met.groupBy("site", "value").agg(F.min_by("link", F.struct("place", "link")).alias("link")), ["site", "value"])
    first = first.select("site", "request", "path", "index", "key", "value", "link").distinct()
    sums = first.groupBy("site", "key").agg(
        F.count("*").alias("n"), F.count_distinct("link").alias("links"), F.min_by(F.struct("value", "link"), F.struct("request", "path", "index")).alias("one")
    )
    sums = sums.filter((F.col("n") >= LEAST) & (F.col("n") == F.col("links")))
    order = F.struct(F.col("n").alias("n"), F.length("one.value").alias("size"))
    best = sums.groupBy("site").agg(F.max_by(F.struct("key", "one"), order).alias("b"))
    edged, value = _edged(F.col("b.one.link")), _edged(F.col("b.one.value"))
    at = F.instr(edged, value)
    template = F.concat(F.substring(edged, F.lit(1), at - 1), F.lit("{id}"), F.substring(edged, at + F.length(value), F.length(edged)))
    return best.select("site", F.col("b.key").alias("key"), F.translate(template, EDGES, "").alias("template"))


def paths_by_value(leaves: DataFrame, wanted: DataFrame, dated: list[str], least: int = LEAST) -> DataFrame:
    """field, path, hits: the path of leaves(item, path, value) that holds wanted(item, field, value) for most items, `least` of
    them at least; then the shortest and first path. Fields in `dated` need the same day only, however it is written."""
    day = F.regexp_replace(F.regexp_extract("value", r"((?:19|20)\d{2}\D{0,3}\d{2}\D{0,3}\d{2})", 1), r"\D", "")
    same = F.when(F.col("field").isin(dated), day)
    asked = wanted.withColumn("_key", F.coalesce(F.nullif(same, F.lit("")), T.squeezed(F.col("value")))).filter("_key <> ''").select("item", "field", "_key")
    given = F.array(T.squeezed(F.col("value")), F.nullif(day, F.lit("")))
    found = leaves.select("item", "path", F.explode(F.array_distinct(F.array_compact(given))).alias("_key"))
    hits = found.join(asked, ["item", "_key"]).groupBy("field", "path").agg(F.count_distinct("item").alias("hits")).filter(F.col("hits") >= least)
    order = F.struct((-F.col("hits")).alias("h"), F.length("path").alias("l"), "path")
    return hits.groupBy("field").agg(F.min_by(F.struct("path", "hits"), order).alias("b")).select("field", "b.*")


def paths_by_name(leaves: DataFrame, hints: dict[str, list[str]], longer: dict[str, int]) -> DataFrame:
    """field, path: the path of leaves(path, value) whose last key has the earliest of a field's hints in it; then one that does
    not end in `en`, the least deep, the first. `longer`: fields whose value needs some length at least."""
    key = F.lower(F.element_at(F.split("path", r"\."), -1))
    known = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("rank"), F.lit(h).alias("hint"), F.lit(longer.get(f, 0)).alias("least")) for f, hs in hints.items() for i, h in enumerate(hs)])
    found = leaves.groupBy("path").agg(F.max(F.length("value")).alias("size")).select("path", "size", key.alias("key"), F.explode(known).alias("h")).select("*", "h.*")
    found = found.filter(F.contains("key", F.col("hint")) & (F.col("size") >= F.col("least")))
    order = F.struct("rank", F.endswith("key", F.lit("en")).alias("e"), F.size(F.split("path", r"\.")).alias("d"), "path")
    return found.groupBy("field").agg(F.min_by("path", order).alias("path"))
