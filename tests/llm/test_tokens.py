"""op4 and op8 against the tokenizers library on whole texts, op8's files, round trips."""

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loanroll.llm import bpe, token_files
from loanroll.session import scratch_dir

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


TOK = Tokenizer.from_file(BYTE)
PIECES = token_files.PieceIds(TOK)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("source", ["weird_docs", "docs"])
def test_bpe_is_the_library_s(request, source):
    df = request.getfixturevalue(source)
    tok = Tokenizer.from_file(WORD)
    expected = []
    for r in df.select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.digests(bpe.encode(df, WORD), WORD).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_bpe_decode(weird_docs):
    tok = Tokenizer.from_file(WORD)
    encoded = bpe.encode(weird_docs, WORD)
    ids = {r.doc_id: r.ids for r in encoded.collect() if r.doc_id == 8}
    assert {r.text for r in bpe.decode(encoded.where("doc_id = 8"), WORD).collect()} == {tok.decode(ids[8], skip_special_tokens=False)}


def test_bpe_of_nothing(no_docs):
    assert bpe.digests(bpe.encode(no_docs, WORD), WORD).count() == 0


@pytest.mark.parametrize("source", ["weird_docs", "docs"])
def test_token_files(spark, request, source):
    df = request.getfixturevalue(source)
    tok = Tokenizer.from_file(BYTE)
    path = scratch_dir(spark, "test-orc")
    token_files.write_token_files(df, path, BYTE)
    rows = token_files.file_index(token_files.read_token_files(spark, path)).collect()
    expected = {}
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    at = 0
    for r in sorted(rows, key=lambda r: r.start):  # starts are the running sum in ascending id order
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids)


def test_token_files_hold_indexes_and_prune(spark, docs):
    path = scratch_dir(spark, "test-orc")
    token_files.write_token_files(docs, path, BYTE)
    some = token_files.read_token_files(spark, path, [3, 77, 10 ** 9])
    assert {r.doc_id for r in some.collect()} == {3, 77}
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan


def test_token_files_of_nothing(spark, no_docs):
    path = scratch_dir(spark, "test-orc")
    token_files.write_token_files(no_docs, path, BYTE)
    assert token_files.file_index(token_files.read_token_files(spark, path)).count() == 0


def test_generations_forget_and_learn_again(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    tok = Tokenizer.from_file(BYTE)
    pieces = token_files.PieceIds(tok)
    texts = ["alpha beta gamma delta\n\nepsilon", "beta zeta  eta", "alpha\ttheta beta", ""] * 3
    for i in range(0, len(texts), 2):
        for t, x in zip(texts[i:i + 2], pieces.encode(pa.array(texts[i:i + 2], pa.large_string())), strict=True):
            assert x.tolist() == tok.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t\u2003\xa0\x1c", *"ab,'s1é漢", "<|endoftext|>"]), max_size=30).map("".join), min_size=1, max_size=5))
def test_pieces_are_the_library_s(texts):
    tok = TOK
    for t, x in zip(texts, token_files.PieceIds(tok).encode(pa.array(texts, pa.large_string())), strict=True):
        assert x.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_each_pre_token_is_encoded_once(monkeypatch):
    """Words that differ only by the signs around them share their ids."""
    pieces, learned = token_files.PieceIds(TOK), []
    by_model = pieces._by_model
    monkeypatch.setattr(pieces, "_by_model", lambda new: learned.extend(new) or by_model(new))
    texts = [f"go ({w}) {w}, {w}. {w}'s\n{w} {w}%%%" for w in ("alpha", "ñandú", "слово", "gamma")] * 2
    for t in texts:
        got, = pieces.encode(pa.array([t], pa.large_string()))
        assert got.tolist() == TOK.encode(t, add_special_tokens=False).ids
    assert len(learned) == len(set(learned)) < 2 * 4 + 12  # a word with and without a space, and the signs


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t\r", *"aZſɏÀ×÷µªΑωΪЀҁ҂²٣5_'.-~", "'s", "'ll", "e\u0301", "\0", "漢", "🙂", "\x85", "\x0b"]), max_size=30).map("".join),
                min_size=1, max_size=5))
def test_pre_tokens_are_the_library_s(texts):
    for t, x in zip(texts, PIECES.encode(pa.array(texts, pa.large_string())), strict=True):
        assert x.tolist() == TOK.encode(t, add_special_tokens=False).ids, t


def test_files_with_another_pre_tokenizer_are_the_library_s():
    spec = json.loads(TOK.to_str())
    spec["pre_tokenizer"]["use_regex"] = False
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, spec["pre_tokenizer"]]}
    pieces = token_files.PieceIds(Tokenizer.from_str(json.dumps(spec)))
    assert not pieces.cuts_plainly
    sizes, flat = pieces._of(pa.array(["abc123", " x"], pa.large_string()))
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [pieces._library_s("abc123"), pieces._library_s(" x")]
