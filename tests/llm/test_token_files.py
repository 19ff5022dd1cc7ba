from __future__ import annotations

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparrowline.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def plain(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \t\n 　\x85\x1c'sab1é½²ªß\xad\xa0漢,.!🙂ll<|>")), max_size=40), max_size=4))
def test_pieces_give_the_ids_of_the_whole_text(texts):
    code = T.encoder(PATH, 2)
    for text, ids in zip(texts, code.encode(texts)):
        assert np.frombuffer(ids, dtype=code.kind).tolist() == plain(text)


def test_special_strings_and_spaces_at_ends():
    texts = ["a <|endoftext|> b", " a", "a ", "  a  b ", " ", "", None, "I'm  we'll \n x", "x" * 5000]
    for text, ids in zip(texts, T.encoder(PATH, 2).encode(texts)):
        assert np.frombuffer(ids, dtype="<u2").tolist() == plain(text)


def test_file_is_zstandard_and_reads_only_what_is_asked_for(monkeypatch):
    monkeypatch.setattr(T, "FRAME_TOKENS", 4)
    out = io.BytesIO()
    out.close = lambda: None
    w = T.Writer(out, np.dtype("<u2"))
    docs = [(3, [1, 2]), (None, [2]), (9, list(range(11))), (2**40, [7, 2])]
    for doc_id, ids in docs:
        w.add(doc_id, np.array(ids, dtype="<u2").tobytes())
    w.close()
    data = out.getvalue()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(whole, dtype="<u2").tolist() == [i for _, ids in docs for i in ids]
    r = T.Reader(io.BytesIO(data), len(data))
    assert [r.ids(k).tolist() for k in r.places()] == [ids for _, ids in docs]
    assert [r.ids(k).tolist() for k in r.places([9, 2**40, 5])] == [docs[2][1], docs[3][1]]
    broken = bytearray(data)
    at = int(r.offsets[1]) - 3
    broken[at] ^= 1
    r = T.Reader(io.BytesIO(bytes(broken)), len(data))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        r.ids(0)
    assert r.ids(3).tolist() == [7, 2]


def test_round_trip_in_order(spark):
    rows = [(i * 7 % 50, f"text number {i} " * (i % 9)) for i in range(50)] + [(None, "no id"), (7, None), (7, ""), (60, "long " * 30000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, DOC_ID string")
    found = T.read(T.write(docs, PATH, 2, file_bytes=20000)).orderBy("start").collect()
    assert len(found) == len(rows)
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in found:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    want = sorted((zlib.crc32(np.array(plain(t), dtype="<u4").tobytes()), i or 0) for i, t in rows)
    assert sorted((zlib.crc32(r.ids), r.doc_id or 0) for r in found) == want
    some = T.read(T.write(docs, PATH, 2), wanted=[7, 13]).collect()
    assert sorted(r.doc_id for r in some) == [7, 7, 7, 13]
    assert T.read(T.write(docs.limit(0), PATH, 2)).count() == 0
