from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from sparrowline.llm.conversation_repair import Row, chained, cheapest, repair, repair_damaged, repaired, _places

KIND = "conv_id long, turn long, role string, text string, CONV_ID int, copies string"
LEGAL = {"su", "ua", "au"}


def all_walks(rows):
    """Every edit of every row, with up to two inserts anywhere: the least (cost, audit, lines) whose roles are legal."""
    options = [["K", "R", "D"] if not r.doomed else ["D"] for r in rows]
    best = None
    for edits in product(*options):
        for inserts in product(range(3), repeat=len(rows) + 1):
            cost, audit, lines, initials = 0, "", [], ""

            def add(role, text):
                nonlocal initials
                lines.append(f"{role}:{text}")
                initials += role[:1] or "-"

            def needed():
                return "assistant" if initials.endswith("u") else "user"

            for i, n in enumerate(inserts):
                for _ in range(n):
                    cost, audit = cost + 2, audit + "I"
                    add(needed(), "")
                if i == len(rows):
                    break
                row, edit = rows[i], edits[i]
                audit += edit
                cost += {"K": 0, "R": 2, "D": 3}[edit] + (row.truncated and edit != "D")
                if edit != "D":
                    add(row.role if edit == "K" else needed(), row.text)
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def some_rows(rng, n):
    return [Row(rng.choice(["user", "assistant", "system", "util", ""]), f"t{i}", rng.random() < 0.2, rng.random() < 0.3) for i in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_the_walk_is_the_least_of_all_edits(seed):
    rng = random.Random(seed)
    rows = some_rows(rng, rng.randrange(5))
    [(cost, audit)] = cheapest(rows).values()
    assert (cost, audit, list(repaired(rows, 0, audit))) == all_walks(rows)


@pytest.mark.parametrize("seed", range(60))
def test_chained_segments_are_the_whole_walk(seed):
    rng = random.Random(seed)
    rows = some_rows(rng, rng.randrange(1, 60))
    [(cost, audit)] = cheapest(rows).values()
    cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(6)))
    segments = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    found = []
    for part in segments:
        costs, audits = [None] * 16, [None] * 16
        for entry in range(4):
            for leave, (c, a) in cheapest(part, entry, whole=False).items():
                costs[4 * entry + leave], audits[4 * entry + leave] = c, a
        found.append((costs, audits))
    steps, tail, total = chained([(c, _places(a)) for c, a in found])
    assert (total, "".join(f[1][4 * a + b] for f, (a, b) in zip(found, steps)) + tail) == (cost, audit)


def plain(rows):
    """The whole task over plain rows, one conversation after the other."""
    out = []
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            after += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults, checked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in after:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            checked.append(Row(role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a.role[:1] + b.role[:1] not in LEGAL for a, b in zip(checked, checked[1:]))
        turns = [t for t, *_ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        [(cost, audit)] = cheapest(checked).values()
        digest = hashlib.sha256("\n".join(repaired(checked, 0, audit)).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def made(rng):
    roles, texts = ["system", "user", "assistant", "user", "assistant", None, ""], ["Yes.", "No", " \n", None, "Why?", "é\x0b", "… ", "x!\t"]
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts + [f"text {t}."] * 20)) for c in [*range(60), None] for t in range(rng.randrange(9))]
    rows += [(77, t, "user" if t % 2 else "assistant", f"long {t}." if t % 5 else "the same.") for t in range(900)]  # one long conversation
    rows += [(78, None, "user", "equal rows.")] * 400 + rows[:5]
    return rows


@pytest.mark.parametrize("segment", [7, 512])
def test_repair_is_brute_force(spark, segment):
    from sparrowline.llm.conversation_repair import damaged

    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        rows = made(random.Random(3))
        frame = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND).repartition(5)
        found = repair(damaged(frame), segment=segment)
        assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_an_empty_table_and_a_very_long_text(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert repair_damaged(spark.createDataFrame([], kind)).collect() == []
    long = [(5, 1, "user", "word. " * 700_000 + "end?"), (5, 2, "assistant", "fine" * 900_000)]
    assert [tuple(r) for r in repair_damaged(spark.createDataFrame(long, kind)).collect()] == plain(long)
