"""Changes to keyed state as pure functions: old state and changes in, new state out.

Each is one full or left join, or one aggregation over the union, on the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.functions.text import content_hash
from sparrowline.operators.relational import latest, numbered
from sparrowline.sources.scratch import written


def _aligned(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full join; columns o and n hold each side's row, null where it has none."""
    a = old.select(*keys, F.struct(*old.columns).alias("o"))
    b = new.select(*keys, F.struct(*new.columns).alias("n"))
    return a.join(b, list(keys), "full")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Insert or replace; of several changes to a key the one with the largest `order` counts."""
    new = latest(new, list(keys), order)
    every = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    return latest(every, list(keys), "_new").drop("_new").select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Inserts keys that are not there; the first of several counts."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in new.columns if c not in keys]), F.col(order)).alias("_r"))
    fresh = first.select(*keys, "_r.*").join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def record_attempts(old: DataFrame, tried: DataFrame, key: str) -> DataFrame:
    """State (key, remote_id, status, attempts, sent_at) after tries (key, remote_id, status, sent_at).

    A try adds one attempt; an id or time already known stays where the try brings none.
    """
    j = _aligned(old, tried, [key])
    was_tried = F.col("n").isNotNull()
    return j.select(
        key,
        F.coalesce("n.remote_id", "o.remote_id").alias("remote_id"),
        F.coalesce("n.status", "o.status").alias("status"),
        (F.coalesce("o.attempts", F.lit(0)) + was_tried.cast("int")).alias("attempts"),
        F.coalesce("n.sent_at", "o.sent_at").alias("sent_at"),
    )


def retarget(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Targets (key, content_hash, attempts, hidden): a changed hash starts anew and shows the row again."""
    j = _aligned(old, new, [key])
    changed = F.col("n").isNotNull() & ~F.col("n.content_hash").eqNullSafe(F.col("o.content_hash"))
    return j.select(
        key,
        F.coalesce("n.content_hash", "o.content_hash").alias("content_hash"),
        F.when(changed, 0).otherwise(F.coalesce("o.attempts", F.lit(0))).alias("attempts"),
        F.when(changed, F.lit(False)).otherwise(F.coalesce("o.hidden", F.lit(False))).alias("hidden"),
    )


def count_gate(old: DataFrame, caught: DataFrame, key: str) -> DataFrame:
    """Gate runs (key, reasons, attempts): a first catch keeps its reasons, later ones only count."""
    j = _aligned(old, caught, [key])
    return j.select(
        key,
        F.coalesce("o.reasons", "n.reasons").alias("reasons"),
        (F.coalesce("o.attempts", F.lit(0)) + F.col("n").isNotNull().cast("int")).alias("attempts"),
    )


def detect_changes(old: DataFrame, new: DataFrame, key: str, seen: str) -> DataFrame:
    """State (key, page_hash, attempts, error, last_seen) with a change column NEW, CHANGED, SAME or MISSING.

    A change clears error and attempts; the same page only touches when it was last seen.
    """
    j = _aligned(old, new, [key])
    there, was = F.col("n").isNotNull(), F.col("o").isNotNull()
    same = F.col("n.page_hash").eqNullSafe(F.col("o.page_hash"))
    change = F.when(~was, "NEW").when(~there, "MISSING").when(same, "SAME").otherwise("CHANGED")
    keeps = was & (~there | same)
    return j.select(
        key,
        F.coalesce("n.page_hash", "o.page_hash").alias("page_hash"),
        F.when(keeps, F.col("o.attempts")).otherwise(0).alias("attempts"),
        F.when(keeps, F.col("o.error")).alias("error"),
        F.when(there, F.lit(seen)).otherwise(F.col("o.last_seen")).alias("last_seen"),
        change.alias("change"),
    )


def replace_with_history(old: DataFrame, new: DataFrame, key: str, run_id: int) -> tuple[DataFrame, DataFrame]:
    """(state, history): rows whose hash changed are swapped, what they were goes to history."""
    j = _aligned(old, new, [key])
    changed = F.col("o").isNotNull() & F.col("n").isNotNull() & ~F.col("n.content_hash").eqNullSafe(F.col("o.content_hash"))
    now = j.select(F.when(F.col("o").isNull() | changed, F.col("n")).otherwise(F.col("o")).alias("r")).select("r.*")
    return now, j.filter(changed).select("o.*", F.lit(run_id).alias("run_id"))


def discard(parents: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str, reason: Column) -> tuple[dict, DataFrame, DataFrame]:
    """Deletes keys everywhere. Gives the tables left, the tombstones, and rows deleted by table."""
    tables = {"parents": parents, **children}
    left = {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}
    tombstones = parents.join(gone.select(key), key, "left_semi").withColumn("reason", reason)
    counts = None
    for name, t in tables.items():
        n = t.join(gone.select(key), key, "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("deleted"))
        counts = n if counts is None else counts.union(n)
    return left, tombstones, counts


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], named: str = "_b_") -> tuple[DataFrame, list[Column]]:
    """The second table under other names, and the conditions under which its keys are the first's, null being equal to null."""
    other = b.select(*[F.col(c).alias(f"{named}{c}") for c in b.columns])
    return other, [a[k].eqNullSafe(other[f"{named}{k}"]) for k in keys]


def import_rows(ours: DataFrame, theirs: DataFrame, natural: Sequence[str], row_id: str) -> tuple[DataFrame, DataFrame]:
    """Merges another database's rows: (rows after, their id -> our id).

    A row is known by its natural key, in which null equals null; of several rows of theirs with one key the first counts, and of
    ours the last. New rows get ids after ours in the order of theirs.
    """
    columns = [c for c in theirs.columns if c not in natural]
    first = theirs.groupBy(*natural).agg(F.min_by(F.struct(*columns), row_id).alias("_r")).select(*natural, "_r.*")
    mine, same = _same(first, ours.groupBy(*natural).agg(F.max(row_id).alias("_ours")), natural)
    known = first.join(mine, same, "left").select(*first.columns, F.col("_b__ours").alias("_ours"))
    known = written(known, "import")
    top = ours.agg(F.max(row_id)).first()[0] or 0
    fresh = numbered(known.filter("_ours IS NULL").drop("_ours"), [F.asc_nulls_last(c) for c in (row_id, *natural)], "_n")
    fresh = written(fresh.withColumn("_new", F.lit(top) + F.col("_n")), "import")
    rows = ours.unionByName(fresh.withColumn(row_id, F.col("_new")).select(*ours.columns))
    by_key = known.filter("_ours IS NOT NULL").select(*natural, F.col("_ours").alias("our_id")).unionByName(fresh.select(*natural, F.col("_new").alias("our_id")))
    found, same = _same(theirs, by_key, natural)
    return rows, theirs.join(found, same).select(F.col(row_id).alias("their_id"), F.col("_b_our_id").alias("our_id"))


def import_linked(
    ours: tuple[DataFrame, DataFrame], theirs: tuple[DataFrame, DataFrame], natural: tuple[Sequence[str], Sequence[str]], row_id: str, foreign: str, hashed: dict[str, Sequence[str]]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents, children, counts) of two databases of parents and children(foreign: a parent's id): see `import_all`."""
    entities = [Entity("parents", natural[0], row_id=row_id), Entity("children", [foreign, *natural[1]], {foreign: "parents"}, hashed, row_id=row_id)]
    found = import_all(entities, {"parents": ours[0], "children": ours[1]}, {"parents": theirs[0], "children": theirs[1]})
    return found.tables["parents"], found.tables["children"], found.counts


@dataclass(frozen=True)
class Entity:
    """A table of a database that is imported.

    `natural`: the columns that a row is known by, references among them. `foreign`: columns that hold an id of another entity, or
    of this one. `hashed`: columns that are computed anew from others, whatever the other database says.
    """

    name: str
    natural: Sequence[str]
    foreign: Mapping[str, str] = field(default_factory=dict)
    hashed: Mapping[str, Sequence[str]] = field(default_factory=dict)
    row_id: str = "id"


class Imported(NamedTuple):
    """The tables afterwards, rows added and known before by entity, and what is wrong with the import (entity, row, column, value, reason).

    Where anything is wrong nothing is imported: the tables are as they were, and nothing counts as added.
    """

    tables: dict[str, DataFrame]
    counts: DataFrame
    rejected: DataFrame


REJECTED = "entity string, row long, column string, value long, reason string"


def import_all(entities: Sequence[Entity], ours: Mapping[str, DataFrame], theirs: Mapping[str, DataFrame]) -> Imported:
    """Another database's rows among ours, entity by entity: an entity comes after those it refers to.

    References become our ids before rows are compared, so a row is found under our parent. A table that refers to itself goes in
    by levels: rows without parent, then those whose parent is in, until none is left. Rows that are known stay as ours are: an
    import never overwrites. A reference to a row that the import does not have rejects it as `broken_reference`, rows that hang
    on each other in a ring as `ring`; a null reference is none.
    """
    spark = next(iter(ours.values())).sparkSession
    ids: dict[str, DataFrame] = {}
    tables: dict[str, DataFrame] = {}
    counts: list[tuple[str, int, int]] = []
    rejected = spark.createDataFrame([], REJECTED)
    for e in entities:
        given = written(theirs[e.name], "import")
        for column, target in e.foreign.items():
            parents = given.select(F.col(e.row_id).alias("_p")) if target == e.name else ids[target].select(F.col("their_id").alias("_p"))
            broken = given.filter(F.col(column).isNotNull()).join(parents, F.col(column) == F.col("_p"), "left_anti")
            rejected = rejected.unionByName(_rejection(e, broken, column, "broken_reference"))
        moved = given.withColumn("_id", F.col(e.row_id))
        for column, target in e.foreign.items():
            if target != e.name:
                moved = _moved(moved, column, ids[target])
        own = [c for c, target in e.foreign.items() if target == e.name]
        rows, found, ring = _by_levels(e, own, ours[e.name], written(moved, "import"))
        if ring is not None:
            rejected = rejected.unionByName(_rejection(e, ring, own[0], "ring"))
        tables[e.name], ids[e.name] = rows, written(found, "import_ids")
        added = rows.count() - ours[e.name].count()
        counts.append((e.name, added, given.count() - added))
    rejected = written(rejected.distinct(), "rejected")
    if not rejected.isEmpty():
        tables, counts = dict(ours), [(name, 0, 0) for name, *_ in counts]
    return Imported(tables, spark.createDataFrame(counts, "entity string, added long, known long"), rejected)


def _rejection(e: Entity, rows: DataFrame, column: str, reason: str) -> DataFrame:
    return rows.select(F.lit(e.name).alias("entity"), F.col(e.row_id).cast("long").alias("row"), F.lit(column).alias("column"), F.col(column).cast("long").alias("value"), F.lit(reason).alias("reason"))


def _moved(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows with a reference as our id; null where there is none."""
    to = ids.select(F.col("their_id").alias("_their"), F.col("our_id").alias("_our"))
    return rows.join(to, F.col(column) == F.col("_their"), "left").withColumn(column, F.col("_our")).drop("_their", "_our")


def _by_levels(e: Entity, own: Sequence[str], ours: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows after, their id -> our id, rows in a ring or below one) of an entity whose other references are ours already."""
    rows, left = ours, given
    ids = given.select(F.col(e.row_id).alias("their_id"), F.col(e.row_id).alias("our_id")).limit(0)
    while True:
        ready = left
        for column in own:
            ready = ready.join(ids.select(F.col("their_id").alias("_p")), F.col(column) == F.col("_p"), "left_semi").unionByName(ready.filter(F.col(column).isNull()))
        ready = written(ready, "level")
        if ready.isEmpty():
            return rows, ids, None if left.isEmpty() else left
        level = ready
        for column in own:
            level = _moved(level, column, ids)
        level = level.withColumns({h: content_hash([F.col(c).cast("string") for c in covered]) for h, covered in e.hashed.items()})
        rows, found = import_rows(rows, level.drop("_id"), e.natural, e.row_id)
        rows, ids = written(rows, "level_rows"), written(ids.unionByName(found), "level_ids")
        left = written(left.join(ready.select(F.col(e.row_id)), e.row_id, "left_anti"), "level_left")
        if not own:
            return rows, ids, None


def rename_keys(c: Column, names: dict[str, str]) -> Column:
    """Keys of a map renamed where they are there."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(c, lambda k, _: F.coalesce(F.try_element_at(table, k), k))


def edit_formats(c: Column, dropped: str, added: Sequence[str]) -> Column:
    """A list of formats without those that match, and with those that are missing at its end."""
    return F.array_union(F.filter(c, lambda f: ~F.regexp_like(f, F.lit(dropped))), F.array(*[F.lit(a) for a in added]))


def close_orphans(status: Column) -> Column:
    """Runs that never ended count as timed out."""
    return F.coalesce(status, F.lit("timeout"))


def seeded(table: DataFrame, seed: DataFrame) -> DataFrame:
    """The table, or the seed's rows where it has none at all; rows that people changed are never mixed with a seed."""
    any_row = table.limit(1).agg(F.count("*").alias("_n"))  # one row
    fresh = seed.select(*table.columns).crossJoin(F.broadcast(any_row)).filter("_n = 0").drop("_n")
    return table.unionByName(fresh)


def rewrite(old: DataFrame, new: DataFrame, keys: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Rows written again in place: all columns but the `kept` ones come from `new`, new keys are added,
    and keys that `new` does not have stay as they are."""
    j = _aligned(old, new, keys)
    written = F.col("n").isNotNull()
    columns = [c for c in old.columns if c not in keys]
    values = [F.when(written & F.lit(c not in kept), F.col(f"n.{c}") if c in new.columns else F.lit(None)).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
    return j.select(*keys, *values)


def merge_rules(ours: DataFrame, theirs: DataFrame, readable: Column, renamed: dict[str, str | None]) -> tuple[DataFrame, DataFrame]:
    """(all rules, counts added and skipped) of rules(id, field_name, rule_type, rule_config_json, priority, ...).

    Two rules are the same if field, type, configuration and priority are; the first of several counts. Former field names become
    the present ones, and rules of a field that is gone (None), or that this version cannot read, are skipped.
    """
    same = ["field_name", "rule_type", "rule_config_json", "priority"]
    names = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair]) if renamed else F.create_map().cast("map<string,string>")
    field = F.when(F.map_contains_key(names, F.col("field_name")), F.try_element_at(names, F.col("field_name"))).otherwise(F.col("field_name"))
    fits = theirs.withColumn("field_name", field).filter("field_name IS NOT NULL").filter(readable)
    first = fits.groupBy(*same).agg(F.min_by(F.struct(*[c for c in theirs.columns if c not in same]), F.col("id")).alias("_r")).select(*same, "_r.*")
    fresh = first.join(ours.select(*same), same, "left_anti")
    added = numbered(fresh, [F.asc_nulls_last(c) for c in ("id", *same)], "_n").crossJoin(F.broadcast(ours.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))))
    added = added.withColumn("id", F.col("_last") + F.col("_n")).select(*ours.columns)
    counts = theirs.agg(F.count("*").alias("_all")).crossJoin(F.broadcast(added.agg(F.count("*").alias("added"))))
    return ours.unionByName(added), counts.select("added", (F.col("_all") - F.col("added")).alias("skipped"))


def renamed_inside(facts: DataFrame, names: DataFrame, column: str, parent: str) -> DataFrame:
    """The facts with a column's names changed by names(parent, old, new), each only inside its own parent."""
    mapped = facts.join(names.select(F.col("parent").alias(parent), F.col("old").alias(column), "new"), [parent, column], "left")
    return mapped.withColumn(column, F.coalesce("new", column)).select(*facts.columns)
