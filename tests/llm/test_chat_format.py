from __future__ import annotations

import hashlib
import subprocess
import sys

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowline.llm import chat_format as C

TEXT = st.text(alphabet=st.sampled_from(list("ab\\<[]/>|é漢🙂 \n")) | st.characters(exclude_categories=["Cs"]), max_size=30)
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "a\n[b\\", "", None])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXT | st.none()), min_size=1, max_size=8))
def test_every_text_is_read_back(turns):
    roles, texts = zip(*turns)
    out, starts, lo, hi = C.assemble(pa.array(roles, pa.string()), pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    data = out.tobytes()
    assert starts[0] == 0 and starts[-1] == len(data)
    found = list(C.turns_of(data))
    assert [(r.decode(), t.decode()) for r, t, _, _ in found] == [(r or "", t or "") for r, t in turns]
    assert [(a, b) for _, _, a, b in found] == list(zip(lo.tolist(), hi.tolist()))
    for mark in (b"[INST]", b"</s>", b"<<SYS>>"):
        assert data.count(mark) == sum(h.count(mark) + t.count(mark) for h, t in (C._marks(r or "") for r in roles))


def plain(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    out = {}
    for conv, turns in by.items():
        turns = [(r[1], t[1]) for _, r, t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said),
                     hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.fixture
def as_dealt(spark):
    """Keeps Spark from joining small partitions."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_conversations_in_many_parts(spark, as_dealt):
    rows = [(c, t, ("user", "assistant")[t % 2], f"[{c}] <{t}> é" * (t % 5)) for c in range(5) for t in range(6)]
    rows += [(9, t, ("user", "assistant", None)[t % 3], f"turn {t} " * 40) for t in range(3000)]  # most rows in one
    rows += [(None, 0, "assistant", None), (6, None, "user", "x"), (6, None, "user", "x"), (6, 1, "assistant", "long \\" * 200000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, TURN int")
    parts = C.format_chats(df)
    assert parts.filter("conv_id = 9").count() > 1
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(parts).collect()}
    assert found == plain(rows)
    assert C.digests(C.format_chats(df.limit(0))).count() == 0


def test_slices_do_not_show(monkeypatch):
    texts = pa.array([b"", b"a<b[c\\\\", None, b"", b"[" * 30, b"plain text", b""], pa.large_binary())
    roles = pa.array(["user", "assistant", "system", "odd [x", None, "user", "assistant"])
    want = C.assemble(roles, texts)
    for size in (1, 2, 3, 7, 29):
        monkeypatch.setattr(C, "SLICE", size)
        assert all((a == b).all() for a, b in zip(C.assemble(roles, texts), want))


def test_a_text_of_100_megabytes_takes_few_times_its_size():
    code = """
import resource, pyarrow as pa
from sparrowline.llm.chat_format import assemble
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
out = assemble(pa.array(["user"]), pa.array([b"words [of] a long text, " * (100 * 2**20 // 24)], pa.large_binary()))[0]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, len(out) // 2**20)
"""
    taken, size = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert size > 100 and taken < 600
