"""The shape of a model's answer: JSON with fields of its own, common ones and a list of postings.

    {"a": ..., "common": {"b": ...}, "postings": [{"c": ...}, ...]}

Names that nobody knows are an error, not guessed at; `..._evidence` beside a field is let pass. A field of postings that stands
among the common or top ones goes to every posting that has none of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.functions import text as T

COMMON, POSTINGS = "common", "postings"
FIELDS = "map<string,string>"


def _fields(json: Column) -> Column:
    """A JSON object's fields as texts, empty ones left out; an empty map where there is none."""
    found = F.from_json(json, FIELDS)
    kept = F.map_filter(found, lambda _, v: T.stripped(v) != "")
    return F.coalesce(F.transform_values(kept, lambda _, v: T.stripped(v)), F.create_map().cast(FIELDS))


def _keys(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))


def _unknown(json: Column, known: Sequence[str], where: Column) -> Column:
    """Names that are none of the known ones, with where they stand."""
    strange = F.filter(_keys(json), lambda k: ~k.isin(*known) & ~k.endswith("_evidence"))
    return F.transform(F.array_sort(strange), lambda k: F.concat(where, k))


def _chosen(fields: Column, names: Sequence[str]) -> Column:
    return F.map_filter(fields, lambda k, _: k.isin(*names))


def validated(df: DataFrame, answer: str, top: Sequence[str], common: Sequence[str], posting: Sequence[str]) -> DataFrame:
    """The rows with `error` (null where the answer is sound), `top`, `common` (maps) and `postings` (an array of maps).

    Errors: `unparsable` (no JSON object, or a part of the wrong kind) and `unknown_field: names`.
    """
    a = F.col(answer)
    inner, listed = F.get_json_object(a, f"$.{COMMON}"), F.get_json_object(a, f"$.{POSTINGS}")
    inner, listed = F.nullif(inner, F.lit("")), F.nullif(listed, F.lit(""))
    rows = F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))
    is_object = lambda c: F.coalesce(F.regexp_like(T.stripped(c), F.lit(r"(?s)^\{.*\}$")), F.lit(False)) & F.json_object_keys(c).isNotNull()
    sound = is_object(a) & (inner.isNull() | is_object(inner)) & (listed.isNull() | F.json_array_length(listed).isNotNull()) & F.forall(rows, is_object)
    df = df.withColumns({"_top": a, "_common": inner, "_rows": rows, "_sound": F.coalesce(sound, F.lit(False))})
    moved = [p for p in posting if p not in common]
    strange = F.concat(
        _unknown(F.col("_top"), [*top, COMMON, POSTINGS, *[m for m in moved if m not in top]], F.lit("")),
        _unknown(F.col("_common"), [*common, *moved], F.lit(f"{COMMON}.")),
        F.flatten(F.transform(F.col("_rows"), lambda r, i: _unknown(r, posting, F.concat(F.lit(f"{POSTINGS}["), i, F.lit("].")))))
    )
    error = F.when(~F.col("_sound"), "unparsable").when(F.size(strange) > 0, F.concat(F.lit("unknown_field: "), F.array_join(strange, ", ")))
    df = df.withColumns({"error": error, "_a": _fields(F.col("_top")), "_c": _fields(F.col("_common"))})
    fine = F.col("error").isNull()
    # Of a field that stands both among the common and the top ones the common one counts.
    astray = F.map_concat(F.map_filter(_chosen(F.col("_a"), [m for m in moved if m not in top]), lambda k, _: ~F.map_contains_key(F.col("_c"), k)), _chosen(F.col("_c"), moved))
    df = df.withColumn("_astray", astray)
    own = F.transform(F.col("_rows"), lambda r: _chosen(_fields(r), posting))
    own = F.when((F.size(own) == 0) & (F.size("_astray") > 0), F.array(F.create_map().cast(FIELDS))).otherwise(own)
    whole = F.transform(own, lambda p: F.map_concat(p, F.map_filter(F.col("_astray"), lambda k, _: ~F.map_contains_key(p, k))))
    df = df.withColumns({"top": F.when(fine, _chosen(F.col("_a"), top)), COMMON: F.when(fine, _chosen(F.col("_c"), common)), POSTINGS: F.when(fine, whole)})
    return df.drop("_top", "_common", "_rows", "_sound", "_a", "_c", "_astray")


UNKNOWN_LINE = -1
PIECES = "array<struct<line:int,text:string>>"
#: What a variant is by the first word of its schema; nothing else is a text.
PLAIN = ("STRING", "BIGINT", "BOOLEAN")


@dataclass(frozen=True)
class AnswerShape:
    """The names of an answer: single values at the top, copied pieces common to all postings, and what each posting has, of which
    `pieces` are copied. What a posting alone has may stand among the common or top ones: it is moved, not guessed at."""

    top: Sequence[str]
    common: Sequence[str]
    posting: Sequence[str]
    pieces: Sequence[str]

    @property
    def moved_texts(self) -> list[str]:
        return [n for n in self.posting if n not in self.pieces and n not in self.top]

    @property
    def moved_pieces(self) -> list[str]:
        return [n for n in self.pieces if n not in self.common]


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _raw(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _text_of(v: Column) -> Column:
    """A single value as text: numbers and truths as they are written, of a list its first that is not empty; null for what is no text."""

    def one(x: Column) -> Column:
        return F.when(_kind(x).isin(*PLAIN), T.stripped(_raw(x)))

    inner = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(_kind(x) == "OBJECT", F.try_variant_get(x, "$.text", "variant")).otherwise(x))
    said = F.filter(inner, lambda x: x.isNotNull() & (_kind(x) != "VOID") & ~((_kind(x) == "STRING") & (_raw(x) == "")))
    of_list = F.when(F.size(said) == 0, "").otherwise(one(F.get(said, F.lit(0))))
    return F.when(v.isNull() | (_kind(v) == "VOID"), "").when(_kind(v) == "ARRAY", of_list).otherwise(one(v))


def _pieces_of(v: Column) -> Column:
    """Copied pieces with the number of their line, which must be whole; a text without line has UNKNOWN_LINE. Null for what is no such list."""

    def one(x: Column) -> Column:
        line, text = F.try_variant_get(x, "$.line", "variant"), F.try_variant_get(x, "$.text", "variant")
        said = F.when(text.isNull() | (_kind(text) == "VOID"), "").when(_kind(text) == "STRING", _raw(text))
        whole = F.when((_kind(line) == "BIGINT") & said.isNotNull(), F.struct(_raw(line).try_cast("int").alias("line"), said.alias("text")))
        return F.when(_kind(x) == "STRING", F.struct(F.lit(UNKNOWN_LINE).alias("line"), _raw(x).alias("text"))).when(_kind(x) == "OBJECT", whole)

    found = F.transform(F.try_variant_get(v, "$", "array<variant>"), one)
    sound = F.when(F.forall(found, lambda p: p.isNotNull()), found)
    empty = v.isNull() | (_kind(v) == "VOID") | ((_kind(v) == "STRING") & (_raw(v) == ""))
    return F.when(empty, F.array().cast(PIECES)).when(_kind(v) == "ARRAY", sound)


VALUES = f"map<string,struct<text:string,pieces:{PIECES}>>"


def _read(v: Column) -> Column:
    """An object's values by name, each as a text and as pieces; empty for nothing, null for what is no object."""
    named = F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: F.struct(_text_of(x).alias("text"), _pieces_of(x).alias("pieces")))
    empty = v.isNull() | (_kind(v) == "VOID") | ((_kind(v) == "STRING") & (_raw(v) == ""))
    return F.when(empty, F.create_map().cast(VALUES)).when(_kind(v) == "OBJECT", named)


def parsed(df: DataFrame, answer: str, shape: AnswerShape) -> DataFrame:
    """The rows with `error` (null where the answer is sound), `top` (texts), `common` (pieces) and `postings` (an array of texts and pieces).

    An answer is parsed once. Errors: `unparsable: where` (no JSON, or a part of the wrong kind: a list that is none, a line that is no
    whole number, a text that is an object), and `unknown_field: names` (`..._evidence` is let pass). Names of postings that stand
    among the common or top ones go to every posting that has none of its own, the common ones before the top ones; without postings they
    make one. Empty values are left out. A key that stands twice makes an answer unparsable.
    """
    common, listed = (F.try_element_at("_top", F.lit(n)) for n in (COMMON, POSTINGS))
    rows = df.withColumn("_v", F.try_parse_json(answer)).withColumn("_top", F.try_variant_get("_v", "$", "map<string,variant>"))
    rows = rows.withColumns({"_c": common, "_l": listed})
    no_list = F.col("_l").isNull() | (_kind(F.col("_l")) == "VOID") | ((_kind(F.col("_l")) == "STRING") & (_raw(F.col("_l")) == ""))
    items = F.when(no_list, F.array().cast("array<variant>")).otherwise(F.try_variant_get("_l", "$", "array<variant>"))
    rows = rows.withColumns({"_a": _read(F.col("_v")), "_b": _read(F.col("_c")), "_p": F.transform(items, _read)})
    a, b, p = F.col("_a"), F.col("_b"), F.col("_p")

    def strange(values: Column, known: Sequence[str], where: Column) -> Column:
        names = F.filter(F.map_keys(values), lambda k: ~k.isin(*known) & ~k.endswith("_evidence"))
        return F.transform(F.array_sort(names), lambda k: F.concat(where, k))

    def broken(values: Column, texts: Sequence[str], pieces: Sequence[str], where: Column) -> Column:
        wrong = F.map_filter(values, lambda k, x: (k.isin(*texts) & x["text"].isNull()) | (k.isin(*pieces) & x["pieces"].isNull()))
        return F.transform(F.array_sort(F.map_keys(wrong)), lambda k: F.concat(where, k))

    texts = [n for n in shape.posting if n not in shape.pieces]
    own = [n for n in shape.posting if n in shape.pieces]
    at = lambda i: F.concat(F.lit(f"{POSTINGS}["), i, F.lit("]."))
    none = F.array().cast("array<string>")
    kinds = F.concat(
        F.when(a.isNull() | F.col("_v").isNull() | (_kind(F.col("_v")) != "OBJECT"), F.array(F.lit("answer"))).otherwise(none), F.when(b.isNull(), F.array(F.lit(COMMON))).otherwise(none),
        F.when(p.isNull(), F.array(F.lit(POSTINGS))).otherwise(none), F.array_compact(F.transform(F.coalesce(p, F.array().cast(f"array<{VALUES}>")), lambda x, i: F.when(x.isNull(), F.rtrim(F.replace(at(i), F.lit("."), F.lit("")))))),
    )
    wrong = F.concat(
        broken(a, [*shape.top, *shape.moved_texts], [], F.lit("")), broken(b, shape.moved_texts, [*shape.common, *shape.moved_pieces], F.lit(f"{COMMON}.")),
        F.flatten(F.transform(p, lambda x, i: broken(x, texts, own, at(i)))),
    )
    unknown = F.concat(
        strange(a, [*shape.top, COMMON, POSTINGS, *shape.moved_texts], F.lit("")), strange(b, [*shape.common, *shape.moved_texts, *shape.moved_pieces], F.lit(f"{COMMON}.")),
        F.flatten(F.transform(p, lambda x, i: strange(x, shape.posting, at(i)))),
    )
    rows = rows.withColumns({"_kinds": kinds, "_wrong": wrong, "_unknown": unknown})
    error = (
        F.when(F.size("_kinds") > 0, F.concat(F.lit("unparsable: "), F.array_join("_kinds", ", ")))
        .when(F.size("_unknown") > 0, F.concat(F.lit("unknown_field: "), F.array_join("_unknown", ", ")))
        .when(F.size("_wrong") > 0, F.concat(F.lit("unparsable: "), F.array_join("_wrong", ", ")))
    )
    rows = rows.withColumn("error", error)

    def texts_of(values: Column, names: Sequence[str]) -> Column:
        return F.transform_values(F.map_filter(values, lambda k, x: k.isin(*names) & (F.coalesce(x["text"], F.lit("")) != "")), lambda _, x: x["text"])

    def pieces_of(values: Column, names: Sequence[str]) -> Column:
        return F.transform_values(F.map_filter(values, lambda k, x: k.isin(*names) & (F.size(x["pieces"]) > 0)), lambda _, x: x["pieces"])

    def filled_up(mine: Column, more: Column) -> Column:
        return F.map_concat(mine, F.map_filter(more, lambda k, _: ~F.map_contains_key(mine, k)))

    rows = rows.withColumns({"_texts": filled_up(texts_of(b, shape.moved_texts), texts_of(a, shape.moved_texts)), "_pieces": pieces_of(b, shape.moved_pieces)})
    stray = (F.size("_texts") > 0) | (F.size("_pieces") > 0)
    each = F.when((F.size(p) == 0) & stray, F.array(F.create_map().cast(VALUES))).otherwise(p)
    whole = F.transform(each, lambda x: F.struct(filled_up(texts_of(x, texts), F.col("_texts")).alias("texts"), filled_up(pieces_of(x, own), F.col("_pieces")).alias("pieces")))
    fine = F.col("error").isNull()
    rows = rows.withColumns({"top": F.when(fine, texts_of(a, shape.top)), COMMON: F.when(fine, pieces_of(b, shape.common)), POSTINGS: F.when(fine, whole)})
    return rows.select(*df.columns, "error", "top", COMMON, POSTINGS)
