"""Byte-level BPE: ids and digests as the library gives them for whole texts, and exact round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tables import empty, odd, odd_rows

from marlstone.llm import byte_bpe as q

PATH = public_tokenizers.path(q.RANKS)


@pytest.fixture(scope="module")
def enc():
    with open(PATH, "rb") as file:
        return q.encoding(file.read())


def test_odd_rows(spark, enc):
    found = q.encode_documents(odd(spark), PATH)
    assert found.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    wanted = []
    for r in odd_rows():
        ids = enc.encode_ordinary(r[1] or "")
        wanted.append((r[0], ids, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))
    content = q.decode_documents(found, PATH).collect()
    assert sorted(repr((r["doc_id"], bytes(r["content"]))) for r in content) == sorted(repr((r[0], (r[1] or "").encode())) for r in odd_rows())


def test_empty(spark):
    assert q.encode_documents(empty(spark), PATH).collect() == []


def test_rank_file_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q, "MOST_RANK_BYTES", 10)
    (tmp_path / "ranks").write_bytes(b"x" * 11)
    with pytest.raises(ValueError):
        q.read_ranks(spark, str(tmp_path / "ranks"))


@given(st.text(alphabet=st.sampled_from("ab1 '\n\t.sé漢😀  　\x1c"), max_size=60), st.integers(1, 12))
def test_pieces_do_not_change_the_ids(text, piece):
    with open(PATH, "rb") as file:
        enc = q.encoding(file.read())
    assert "".join(q.pieces(text, piece)) == text
    ids = q.encode(enc, text, piece)
    assert ids.tolist() == enc.encode_ordinary(text)
    assert b"".join(q.decode(enc, ids, 3)) == text.encode()
