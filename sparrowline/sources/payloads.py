"""Items and details out of JSON payloads, CSV programs, and cuts of paged lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparrowline.functions import text as T


def texts_at(payload: Column, path: str) -> Column:
    """Texts at a path such as `$.a[*].b`: an array, whether there is one value or many."""
    found = F.get_json_object(payload, path)
    many = F.from_json(found, "array<string>")
    one = F.when(found.isNotNull(), F.array(found))
    return F.coalesce(F.when(found.startswith("["), many), one, F.array().cast("array<string>"))


def joined_texts(payload: Column, paths: Sequence[str]) -> Column:
    """Texts of several paths, each once, with blank lines between."""
    every = F.flatten(F.array(*[texts_at(payload, p) for p in paths]))
    return F.array_join(F.array_distinct(F.filter(F.transform(every, T.stripped), lambda t: t != "")), "\n\n")


def list_outcome(payload: Column, path: str) -> Column:
    """items, empty, not_a_list or missing: what a payload holds at the list's path."""
    found = F.get_json_object(payload, path)
    size = F.json_array_length(found)
    return F.when(found.isNull(), "missing").when(size.isNull(), "not_a_list").when(size == 0, "empty").otherwise("items")


def list_items(df: DataFrame, payload: str, path: str, fields: Mapping[str, str]) -> DataFrame:
    """A row for each item of the list, with its place and its fields."""
    items = F.from_json(F.get_json_object(payload, path), "array<string>")
    rows = df.select("*", F.posexplode(items).alias("place", "_item"))
    return rows.withColumns({name: F.get_json_object("_item", p) for name, p in fields.items()}).drop("_item")


def detail(payload: Column, fields: Mapping[str, str], required: Sequence[str]) -> tuple[dict[str, Column], Column]:
    """Fields by path, and the names of required ones that are blank."""
    found = {name: F.get_json_object(payload, path) for name, path in fields.items()}
    blank = [F.when(T.stripped(F.coalesce(found[n], F.lit(""))) == "", F.lit(n)) for n in required]
    return found, F.array_compact(F.array(*blank))


def entry_id(parts: Mapping[str, Column]) -> Column:
    """`a=1&b=2` of parts that are all there, else null."""
    there = [T.filled(c) for c in parts.values()]
    whole = F.concat(*[x for name, c in zip(parts, there) for x in (F.lit(f"&{name}="), c)])
    return F.substring(whole, 2, 1 << 30)


def record(detail: Column, extra: Column, listed: Column) -> Column:
    """The detail's value, else the list's extra one, else the list's own."""
    return F.coalesce(*[T.filled(c) for c in (detail, extra, listed)])


def cut_pages(items: DataFrame, source: str, page: str, known: Column, has_more: Column, most: int) -> DataFrame:
    """Items of a paged list up to the page where reading stops: it says there is no more, all of its
    items are known (those are not taken either), or it is the last one allowed."""
    pages = items.groupBy(source, page).agg(F.bool_and(known).alias("_known"), F.bool_and(~has_more).alias("_last"))
    stop = F.min(F.when(F.col("_known"), F.col(page) - 1).when(F.col("_last"), F.col(page))).alias("_stop")
    stops = pages.groupBy(source).agg(stop)
    cut = items.join(stops, source).filter(F.col(page) <= F.least(F.coalesce("_stop", F.lit(most - 1)), F.lit(most - 1)))
    return cut.drop("_stop")


def rebased(items: DataFrame, source: str, page: str, index: str, name: str = "place") -> DataFrame:
    """Items of a paged list with their place over all its pages, from 0: their index in their page and the sizes of the pages before.

    A row for each source and page is summed up, no items.
    """
    sizes = items.groupBy(F.col(source).alias("_source"), F.col(page).alias("_page")).agg(F.count("*").alias("_size"))
    before = W.partitionBy("_source").orderBy("_page").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    found = items.join(sizes, items[source].eqNullSafe(sizes["_source"]) & items[page].eqNullSafe(sizes["_page"]))
    return found.withColumn(name, F.col("_before") + F.col(index)).drop("_source", "_page", "_before")


def first_wins(df: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): the first row of each key; others with the reason. A key's first is an aggregation, so no key's rows meet."""
    blank = T.stripped(F.coalesce(key, F.lit(""))) == ""
    first = df.filter(~blank).groupBy(key).agg(F.min(order).alias("_first"))
    judged = df.join(first, key, "left").withColumn("reason", F.when(blank, "no key").when(F.col(order) > F.col("_first"), "repeated"))
    judged = judged.select(*df.columns, "reason")
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def _decoded(cells: Column, encoding: str) -> Column:
    """Cells whose signs are bytes, an array of them, as what the bytes say in an encoding; null where they say nothing."""

    def one(row) -> list | None:
        try:
            return [None if c is None else c.encode("latin-1").decode(encoding) for c in row]
        except UnicodeDecodeError:
            return None

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(one)

    return F.pandas_udf(run, "array<string>")(cells)


def read_programs(spark: SparkSession, path: str, required: Sequence[str], key: str, encodings: Sequence[str] = ("utf-8",)) -> tuple[DataFrame, DataFrame]:
    """(programs, skipped) of CSV files with a header; a byte-order mark and spaces around names go.

    The first of `encodings` (Python's names, of those that write ASCII as it is) in which all bytes say something is taken; ValueError
    if there is none, or if a required column is missing. `row` is the order inside the files. Cells may hold line feeds, so a file is read
    by one task, many files by many; what is not UTF-8 is split as bytes and decoded in Arrow batches.
    """
    plain = list(encodings) == ["utf-8"]
    raw = spark.read.csv(path, header=True, multiLine=True, enforceSchema=False, escape='"', encoding="utf-8" if plain else "iso-8859-1")
    names = raw.columns
    if not plain:
        cells = raw.select(F.array(*[F.col(f"`{n}`") for n in names]).alias("cells"), F.monotonically_increasing_id().alias("row"))
        heads = [n.encode("latin-1") for n in names]
        for encoding in encodings:
            try:
                said = [h.decode(encoding) for h in heads]
            except UnicodeDecodeError:
                continue
            found = cells.select(_decoded(F.col("cells"), encoding).alias("cells"), "row")
            if found.filter("cells IS NULL").isEmpty():
                names, raw = said, found.select(*[F.get("cells", F.lit(i)).alias(str(i)) for i in range(len(names))], "row")
                break
        else:
            raise ValueError(f"{path} is in none of {encodings}")
    else:
        raw = raw.withColumn("row", F.monotonically_increasing_id())
    rows = raw.toDF(*[n.lstrip("\ufeff").strip() for n in names], "row")
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return first_wins(rows, key, "row")


def sections(groups: Mapping[str, Mapping[str, Column]]) -> Column:
    """A two-level map of texts without empty ones and without empty groups."""

    def one(fields: Mapping[str, Column]) -> Column:
        whole = F.create_map(*[x for name, c in fields.items() for x in (F.lit(name), T.stripped(c))])
        return F.map_filter(whole, lambda _, v: F.coalesce(v, F.lit("")) != "")

    whole = F.create_map(*[x for name, fields in groups.items() for x in (F.lit(name), one(fields))])
    return F.map_filter(whole, lambda _, m: F.size(m) > 0)


def checked_import(df: DataFrame, required: Mapping[str, str], version: int, our_version: int) -> DataFrame:
    """The frame if it can be imported; ValueError with the reason otherwise."""
    if version > our_version:
        raise ValueError(f"its version {version} is ahead of ours, {our_version}")
    kinds = dict(df.dtypes)
    for name, kind in required.items():
        if name not in kinds:
            raise ValueError(f"column {name} is missing")
        if kinds[name] != kind:
            raise ValueError(f"column {name} is {kinds[name]}, not {kind}")
    return df


# Fixed value: the largest import, in bytes.
MOST_BYTES = 64 << 20


def checked_files(spark: SparkSession, path: str, magic: bytes, most: int = MOST_BYTES) -> int:
    """The bytes of a file, or of all files of a folder, that may be imported; ValueError with the reason otherwise: nothing there,
    too large together, or one that does not begin as its kind does. Only sizes and first bytes are looked at."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        raise ValueError("there is no such file")
    found, size = files.listFiles(where, True), 0
    names = []
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith(("_", ".")):
            names.append(status.getPath())
            size += status.getLen()
    if not size:
        raise ValueError("it is empty")
    if size > most:
        raise ValueError(f"it has {size} bytes, more than {most}")
    for name in names:
        stream = files.open(name)
        try:
            head = bytes(stream.readNBytes(len(magic)))
        finally:
            stream.close()
        if head != magic:
            raise ValueError(f"{name.getName()} is of another kind")
    return size
