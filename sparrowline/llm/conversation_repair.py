"""Repair of conversation structure by the cheapest edits.

A conversation is its rows by turn. Edits turn the initials of its roles into `(s?(ua)+)?`:

    Keep      0   the row stays
    Rerole    2   the row becomes a user's or an assistant's
    Delete    3   the row goes; required for blank rows and for rows whose role and text came before
    Insert    2   an empty user or assistant row, anywhere

and a truncated row that is not deleted costs 1 more. The lattice has a node for each (row index,
grammar state); it is never built. Dijkstra's algorithm walks it with (cost, audit) as the key, where
the audit is the initials of the edits so far, and stops at the first end node popped whose state
accepts. In each state only one role can follow an edit, so an audit has one path; of two audits of
equal cost at one node neither begins with the other, which is why ties can be settled while walking.

Scale. Rows are sorted by range, so a conversation of any length spreads over as many tasks as its
rows need. A task walks each whole conversation of up to `SEGMENT` rows. A longer one, or one that
meets the edge of a range, is cut into segments: each gives, for every state it may be entered in
and left in, its cheapest edits. A segment's audits all end with the edit of its last row, so none
begins with another and the least whole audit is made of least parts; chaining the segments of a
conversation therefore needs 16 costs and 16 places a segment. The digest of a long conversation is
sequential by nature: one task takes it as a stream, a segment at a time. Equal rows are combined
before they move, and whether a text came before is found by keys of hashes, joined without
gathering a group.

Defined cases. A null role or text is one space; a null turn comes first and is one space in the
key of the damage; a null conversation is one by itself. Rows of one turn stand by role, then by the
SHA-256 of their text; equal rows are adjacent. Roles count by their first character, so `util` is
kept as a user's; an empty role fits nowhere. A conversation without rows (all dropped) has zeros,
an empty audit and the hash of the empty string. An empty table gives an empty result. Extra columns
are left out, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.common import matched, pick, written

#: Grammar states: nothing yet, after the system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = {START, ASSISTANT}
AFTER_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: What the one row that an edit may add in a state is, and the state after it.
ADDED = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
#: What a conversation that ends in a state still needs.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
BLANK = " \t\n\x0b\x0c\r"
#: Rows and bytes of text that a segment has at most, about.
SEGMENT, SEGMENT_BYTES = 512, 4 << 20


class Row(NamedTuple):
    role: str
    text: str
    #: Blank or met before: it must go.
    doomed: bool
    truncated: bool


def cheapest(rows: list[Row], entry: int = START, whole: bool = True) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) by the state the walk ends in.

    A whole conversation has one: the first accepting end node popped. A segment has one for each
    state it can be left in, without inserts after its last row: they belong to the next segment.
    """
    heap, popped, ends = [(0, "", 0, entry)], set(), {}
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in popped:
            continue
        popped.add((i, state))
        if i == len(rows):
            if not whole:
                ends[state] = cost, audit
                continue
            if state in ACCEPTING:
                return {state: (cost, audit)}
        after = ADDED[state][1]
        heappush(heap, (cost + INSERT, audit + "I", i, after))
        if i == len(rows):
            continue
        row = rows[i]
        heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
        if row.doomed:
            continue
        worse = TRUNCATED if row.truncated else 0
        heappush(heap, (cost + REROLE + worse, audit + "R", i + 1, after))
        kept = AFTER_KEPT.get((state, row.role[:1]))
        if kept is not None:
            heappush(heap, (cost + worse, audit + "K", i + 1, kept))
    return ends


def repaired(rows: Iterable[Row], entry: int, audit: str) -> Iterator[str]:
    """`role:text` of each row after the edits of an audit."""
    rows, state = iter(rows), entry
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            role, state = row.role, AFTER_KEPT[state, row.role[:1]]
        else:
            role, state = ADDED[state]
        yield f"{role}:{row.text if row else ''}"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after damage by crc32(`conv_id:turn`) % 20; a dropped row has no copies."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    return rows.withColumn("_kind", kind).select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


KEYS = ["conv_id", "there", "turn", "role", "digest"]
COMBINED = "conv_id long, there boolean, turn long, role string, digest binary, copies long, text string"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows as one, batch by batch, before they move."""
    for batch in batches:
        if batch.num_rows:
            found = pa.Table.from_batches([batch]).group_by(KEYS).aggregate([("copies", "sum"), ("text", "one")])
            yield from found.rename_columns([*KEYS, "copies", "text"]).combine_chunks().to_batches()


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """The rows in order, in ranges; before a row whose role and text came at an earlier turn stands a mark with its key.

    A conversation whose rows are all gone keeps one row that is not `there`.
    """
    there = F.col("copies") > 0
    rows = rows.select(
        "conv_id",
        there.alias("there"),
        F.when(there, F.col("turn")).alias("turn"),
        *[F.when(there, F.col(c)).otherwise("").alias(c) for c in ("role", "text")],
        "copies",
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    combined = rows.select(*KEYS, "copies", "text").mapInArrow(_combine, COMBINED)

    # Keys of hashes only: one row a conversation, role, text and turn.
    by = ["_conv", "role", "digest"]
    named = rows.filter("there").withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    keys = written(named.groupBy(*by, "conv_id", "turn").agg(F.count("*").alias("_rows")).drop("_rows"), "turns_of_texts")
    when = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    again = keys.groupBy(*by).agg(F.count("*").alias("_turns"), F.min(when).alias("_first")).filter("_turns > 1")
    marks = matched(keys, written(again, "texts_again"), by, "_turns").filter(when > F.col("_first"))
    marks = marks.select("conv_id", F.lit(True).alias("there"), "turn", "role", "digest", F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("text"))

    order = [F.asc_nulls_first(c) for c in KEYS]
    return combined.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, "copies")


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "array<struct<role:string,text:string,doomed:boolean,truncated:boolean>>"
PIECES = (
    f"conv_id long, whole boolean, part int, seq long, {COUNTS}, first_turn long, last_turn long, turns long, first_role string, last_role string,"
    f" costs array<long>, audits array<string>, places array<int>, rows {ROWS}"
)


def _places(audits: list[str | None]) -> list[int]:
    """For each entry the order of its four audits."""
    out = [0] * 16
    for entry in range(4):
        some = sorted((a, i) for i, a in enumerate(audits[4 * entry : 4 * entry + 4]) if a is not None)
        for place, (_, i) in enumerate(some):
            out[4 * entry + i] = place
    return out


class _Piece:
    """Rows of a conversation that stand together, with what is counted over them."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.size = conv_id, [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, turn, role: str, text: str, again: bool) -> None:
        seen = text.strip(BLANK)
        blank, truncated = not seen, bool(seen) and seen[-1] not in ".!?"
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += truncated and not again
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        initial = role[:1]
        if self.first_role is None:
            self.first_role = initial
        else:
            self.illegal += self.last_role + initial not in LEGAL
        self.last_role = initial
        doomed = blank or again
        self.rows.append(Row(role, "" if doomed else text, doomed, truncated))
        self.size += len(self.rows[-1].text)

    def _counted(self) -> dict:
        return {k: getattr(self, k) for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns", "first_role", "last_role")}

    def finished(self) -> dict:
        """The result for a whole conversation."""
        [(cost, audit)] = cheapest(self.rows).values()
        text = "\n".join(repaired(self.rows, START, audit))
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return self._counted() | {"whole": True, "gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}

    def segment(self, part: int, seq: int) -> dict:
        costs, audits = [None] * 16, [None] * 16
        for entry in range(4):
            for leave, (cost, audit) in cheapest(self.rows, entry, whole=False).items():
                costs[4 * entry + leave], audits[4 * entry + leave] = cost, audit
        rows = [r._asdict() for r in self.rows]
        return self._counted() | {"whole": False, "part": part, "seq": seq, "costs": costs, "audits": audits, "places": _places(audits), "rows": rows}


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Results of the whole conversations of a range, and segments of those that are long or meet its edges."""
    part, seq, out, held = TaskContext.get().partitionId(), 0, [], 0
    now, cut, marked = None, True, None

    def close(last: bool) -> None:
        nonlocal seq, held
        if cut or last:
            out.append(now.segment(part, seq))
            seq, held = seq + 1, held + now.size
        else:
            out.append(now.finished())

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_id", "there", "turn", "role", "digest", "copies", "text")]
        for conv_id, there, turn, role, digest, copies, text in zip(*columns):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    close(False)
                    cut = False  # only the first conversation can have begun in the range before
                now = _Piece(conv_id)
            if not there:
                continue
            if not copies:
                marked = (conv_id, turn, role, digest)
                continue
            key = (conv_id, turn, role, digest)
            again, marked = marked == key, key
            for copy in range(copies):
                if len(now.rows) >= most or now.size >= SEGMENT_BYTES:
                    cut = True
                    close(False)
                    now = _Piece(conv_id)
                now.add(turn, role, text, again or copy > 0)
                if len(out) >= 1000 or held >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
    if now is not None:
        close(True)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


PATHS = "conv_id long, part int, seq long, entry int, leave int, tail string, cost long"


def chained(segments: Iterable[tuple[list[int | None], list[int]]]) -> tuple[list[tuple[int, int]], str, int]:
    """For each segment (costs, places of audits) the states it is entered and left in, then the tail and the whole cost.

    `best` has, by state, the least cost so far and the place of its audit among the states'. Audits
    that lead to different states never begin with one another, so places are enough to compare them.
    """
    best, back = {START: (0, 0)}, []
    for costs, places in segments:
        found = {}
        for entry, (cost, place) in best.items():
            for leave in range(4):
                w = costs[4 * entry + leave]
                if w is not None and (leave not in found or (cost + w, place) < found[leave][:2]):
                    found[leave] = cost + w, place, places[4 * entry + leave], entry
        ordered = sorted((place, last, leave) for leave, (_, place, last, _) in found.items())
        best = {leave: (found[leave][0], i) for i, (_, _, leave) in enumerate(ordered)}
        back.append(bytes(found[leave][3] if leave in found else 0 for leave in range(4)))
    cost, _, state = min((cost + INSERT * len(TAIL[s]), place, s) for s, (cost, place) in best.items())
    steps, leave = [], state
    for entries in reversed(back):
        steps.append((entries[leave], leave))
        leave = entries[leave]
    return steps[::-1], TAIL[state], cost


def _chain(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments arrive in order; a conversation's are chained when its last one has come."""

    def close() -> pa.RecordBatch:
        steps, tail, cost = chained(summaries)
        rows = [{"conv_id": now, "part": p, "seq": q, "entry": a, "leave": b, "tail": "", "cost": 0} for (p, q), (a, b) in zip(at, steps)]
        rows[-1] |= {"tail": tail, "cost": cost}
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    now, at, summaries = None, [], []
    for batch in batches:
        for r in batch.to_pylist():
            if at and r["conv_id"] != now:
                yield close()
                at, summaries = [], []
            now = r["conv_id"]
            at.append((r["part"], r["seq"]))
            summaries.append((r["costs"], r["places"]))
    if at:
        yield close()


class _Whole:
    """A conversation put together from its segments, as they pass."""

    def __init__(self, conv_id):
        self.conv_id, self.digest, self.audit, self.lines = conv_id, hashlib.sha256(), [], 0
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.cost = self.turns = 0
        self.first_turn = self.last_turn = self.last_role = None

    def _write(self, lines: Iterable[str]) -> None:
        for line in lines:
            self.digest.update(b"\n" * (self.lines > 0) + line.encode())
            self.lines += 1

    def add(self, path: dict, piece: dict) -> None:
        for k in self.n:
            self.n[k] += piece[k]
        if piece["first_role"] is not None:
            self.n["illegal"] += self.last_role is not None and self.last_role + piece["first_role"] not in LEGAL
            self.last_role = piece["last_role"]
        if piece["turns"]:
            self.turns += piece["turns"] - (piece["first_turn"] == self.last_turn)
            self.first_turn = piece["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = piece["last_turn"]
        audit = piece["audits"][4 * path["entry"] + path["leave"]]
        self._write(repaired([Row(**r) for r in piece["rows"]], path["entry"], audit))
        self._write(repaired([], path["leave"], path["tail"]))
        self.audit += [audit, path["tail"]]
        self.cost += path["cost"]

    def row(self) -> dict:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return self.n | {"conv_id": self.conv_id, "gaps": gaps, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _assemble(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each segment comes after the row with its path; a conversation is hashed as it passes."""
    now, path = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if now is None or now.conv_id != r["conv_id"]:
                if now is not None:
                    yield pa.RecordBatch.from_pylist([now.row()], schema=schema)
                now = _Whole(r["conv_id"])
            if r["rows"] is None:
                path = r
            else:
                now.add(path, r)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], schema=schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id and what was found and done, a row a conversation, for rows(conv_id, turn, role, text, copies).

    `copies` is how often a row stands there; a row with none only says that there is such a conversation.
    """
    spark = rows.sparkSession
    result = f"conv_id long, {COUNTS}"
    pieces_schema, paths_schema, result_schema = (_arrow(spark, d) for d in (PIECES, PATHS, result))
    pieces = written(_sorted_rows(rows).mapInArrow(lambda b: _pieces(b, pieces_schema, segment), PIECES), "conversation_pieces")
    names = [c.name for c in result_schema]
    whole = pieces.filter("whole").select(*names)

    parts = pieces.filter("NOT whole")
    by = [F.asc_nulls_first("conv_id"), "part", "seq"]
    summaries = parts.select("conv_id", "part", "seq", "costs", "places").repartition("conv_id").sortWithinPartitions(*by)
    paths = written(summaries.mapInArrow(lambda b: _chain(b, paths_schema), PATHS), "conversation_paths")
    both = paths.unionByName(parts.drop("whole", "gaps", "cost", "audit", "repaired_sha256", "costs", "places"), allowMissingColumns=True)
    # Of two rows of a segment the path, which has no rows, comes first.
    ordered = both.repartition("conv_id").sortWithinPartitions(*by, F.col("rows").isNotNull())
    return whole.unionByName(ordered.mapInArrow(lambda b: _assemble(b, result_schema), result))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """What `repair` finds in conversations after the damage of `damaged`; every original conversation has a row."""
    return repair(damaged(conversations))
