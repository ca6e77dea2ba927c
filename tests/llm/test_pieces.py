"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from loanroll.llm import dictionary, piece_merges, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return piece_merges.Model.load(PATH)


def encoded(encoder, text):
    return [i for w in piece_merges.words_of(text.encode()) for i in encoder.word(piece_merges.word_text(w))]


def test_random_texts(library, model):
    encoder, decoder, rng = piece_merges.Encoder(model), piece_merges.Decoder(model), random.Random(3)
    some = ["a", "b", "e", "t", "h", " ", "  ", "▁", "\n", "é", "漢", "𝄞", "ñ", "①", "the", "ción", "\t", "xxx", "1", "0", "\r", "ing", " " * 17,
            "<s>", "</s>", "<0x0A>", "<unk>", "\x00"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(8000)]
    texts += ["".join(rng.choice(model.pieces) for _ in range(rng.randint(1, 6))) for _ in range(8000)]
    texts += [x * 40_000 for x in ("x", "ab", " ", "\n", "漢字", "①", " \n", " x")]
    for t in texts:
        ids = encoded(encoder, t)
        assert ids == library.encode(t), t[:80]
        assert decoder.text(np.array(ids, np.int64)) == library.decode(ids), t[:80]


def test_decoding_any_ids(library, model):
    decoder, rng = piece_merges.Decoder(model), random.Random(4)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 6))]
        assert decoder.text(np.array(ids, np.int64)) == library.decode(ids)


def test_backtracking_without_single_word_cuts(model):
    """A failed position makes the encoder go back over pieces that fitted before."""
    made = piece_merges.Model(["<u>", "a", "b", "c", "ab", "bc", "abc", "cc", "bcc"], [0, -9, -9, -9, -3, -2, -4, -1, -5], "upppppppp")
    encoder = piece_merges.Encoder(made)
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        assert encoder.run(text) == encoder.merge(text), text


def test_weird_documents(spark, weird_docs, library):
    got = piece_merges.encode(weird_docs, PATH).collect()
    expected = [(r.doc_id, library.encode(r.text or "")) for r in weird_docs.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=str) == sorted(expected, key=str)
    texts = piece_merges.decode(piece_merges.encode(weird_docs, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in texts), key=str) == sorted(((i, library.decode(x)) for i, x in expected), key=str)


@pytest.mark.parametrize("distinct", [500_000, 50])
def test_query_against_the_library(spark, library, monkeypatch, distinct):
    monkeypatch.setattr(dictionary, "CHUNK_DISTINCT", distinct)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r) for r in queries.op13_piece_merges(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "")
        assert got[r.doc_id] == (r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_no_documents(spark, no_docs):
    assert piece_merges.digests(piece_merges.encode(no_docs, PATH), PATH).count() == 0
