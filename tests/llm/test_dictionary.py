"""The distinct-word table where the corpus is larger than a group of chunks."""

import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import WEIRD
from sentencepiece import SentencePieceProcessor
from test_documents import plain_tree
from tokenizers import Tokenizer

from loanroll.llm import bpe, dictionary, piece_merges, suffix_tree


@pytest.fixture
def small_groups(monkeypatch):
    """Groups of some 20 KB of text, chunks of some 300 words."""
    for name, value in (("GROUP_BYTES", 20_000), ("GROUP_BUCKETS", 3), ("CHUNK_WORDS", 300), ("CHUNK_DISTINCT", 200), ("BUCKET_BYTES", 4_000)):
        monkeypatch.setattr(dictionary, name, value)


def test_ids_through_merged_lists(docs, weird_docs, small_groups):
    every = docs.select("doc_id", "text").unionByName(weird_docs.select("doc_id", "text"))
    rows = [(r.doc_id, r.text or "") for r in every.collect()]
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = sorted(((r.doc_id, list(r.ids)) for r in bpe.encode(every, path).collect()), key=str)
    assert got == sorted(((i, tok.encode(t, add_special_tokens=False).ids) for i, t in rows), key=str)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    got = sorted(((r.doc_id, list(r.ids)) for r in piece_merges.encode(every, path).collect()), key=str)
    assert got == sorted(((i, library.encode(t)) for i, t in rows), key=str)
    assert dictionary.split(every, dictionary.words_as_is).layout.groups > 3


def test_counts_through_merged_lists(docs, small_groups, monkeypatch):
    monkeypatch.setattr(suffix_tree, "UNIT_WORDS", 300)
    model = suffix_tree.fit(docs)
    expected, kept = plain_tree([(r.doc_id, r.text) for r in docs.collect()])
    assert [suffix_tree.tree_level(model.grown, d).select("context").distinct().count() for d in (1, 2, 3)] == [kept[d] for d in (1, 2, 3)]
    got = sorted((r.doc_id, r.score) for r in suffix_tree.score(model).collect())
    assert all(a == b and abs(x - y) < 1e-6 * abs(y) for (a, x), (b, y) in zip(got, sorted(expected), strict=True))


def test_merged_lists_of_nothing(no_docs, small_groups):
    assert bpe.encode(no_docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_layout_of_100_tb():
    """What is dealt stays bounded at any size: rows are no single words, and Spark's limits are kept."""
    for size in (0, 1 << 20, 16 << 30, 1 << 40, 100 << 40, 1 << 50):
        layout = dictionary.Layout.of(size)
        assert layout.files <= 100_000 and layout.buckets <= dictionary.GROUP_BUCKETS
        assert dictionary.CHUNK_DISTINCT / layout.buckets > 900  # words of a chunk in one row
        assert size / max(layout.all_buckets, 1) <= 2 * dictionary.BUCKET_BYTES  # text per bucket of the whole corpus
        in_list = dictionary.GROUP_BYTES / layout.buckets / 200  # a distinct word for each 200 bytes of a group, as on the given tables
        assert layout.groups == 1 or size > 100 << 40 or in_list / layout.groups > 20  # merged words in one row
        assert layout.groups <= 70_000


def test_files_with_a_decoder_are_refused():
    with pytest.raises(ValueError, match="decoder"):
        bpe.piece_table(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_of_arrow_texts():
    for cut, plain in ((dictionary.words_as_is, lambda t: t.split()), (dictionary.words_lower, lambda t: t.lower().split())):
        for texts in (WEIRD, [], [None], ["", " \x0b"], [" a", "b ", "\x1ca\xa0B  İ\n"]):
            lengths, words = cut(pa.array(texts, pa.string()))
            own = [plain((t or "").encode()) for t in texts]
            assert lengths.tolist() == [len(w) for w in own]
            assert [w.encode() for w in words.to_pylist()] == [w for x in own for w in x]


@pytest.mark.parametrize("words", [lambda w: pa.array(w, pa.large_string()), lambda w: [x.encode() for x in w]])
def test_counts_of_a_chunk(monkeypatch, words):
    """Counted once for the whole chunk: a count for each text would be as long as the chunk's word list."""
    calls, bincount = [], np.bincount
    monkeypatch.setattr(dictionary.np, "bincount", lambda *a, **k: calls.append(a) or bincount(*a, **k))
    texts, chunk = [[f"w{i % 7}", f"x{i}", "w0"] for i in range(50)], dictionary._Chunk(0)
    for a in range(0, 50, 20):
        own = texts[a:a + 20]
        chunk.add(list(range(a, a + len(own))), [i % 3 > 0 for i in range(a, a + len(own))], [3] * len(own), words([w for t in own for w in t]))
    rows = list(chunk.rows(4))
    expected = Counter(w for i, t in enumerate(texts) if i % 3 for w in t)
    got = {w.decode(): int(n) for r in rows[1:] for w, n in zip(dictionary.unpack(r["words"]).split(b"\n"), dictionary.unpack_wide(r["counts"]), strict=True)}
    assert got == {w: expected[w] for t in texts for w in t}
    assert rows[0]["doc_ids"] == list(range(50)) and rows[0]["lengths"] == [3] * 50
    assert len(calls) == 2


def test_wide_numbers_packed():
    for x in ([], [0], [255, 256, 3], [1 << 63, 5, (1 << 64) - 1]):
        assert dictionary.unpack_wide(dictionary.pack_wide(np.array(x, np.uint64))).tolist() == x


def test_a_context_is_hashed_once(monkeypatch):
    """Tokens that follow the same symbols share one hash, in each depth."""
    hashed, mix = [], suffix_tree._mix
    monkeypatch.setattr(suffix_tree, "_mix", lambda x: hashed.append(len(x)) or mix(x))
    lengths, at = np.full(200, 10), np.tile(np.arange(5), 400)
    words = np.arange(2, 7).astype(np.uint64), np.full(5, 400), at
    walk = suffix_tree.Walk(1, 2, 4, 200, 0, 2200.0, 0.1)
    asked, = walk.go(walk.start(words, lengths), np.ones(2200, bool), {})
    assert len(asked["contexts"]) == 5 and sorted(asked["contexts"].tolist()) == asked["contexts"].tolist()
    assert asked["totals"].tolist() == [400] * 5 and int(asked["counts"].sum()) == 2000
    assert sum(hashed) == 5


def test_short_contexts_are_spelled():
    """Contexts of one and two symbols come back as the hashes of their symbols, whatever the order, and take less room than these."""
    rng = np.random.default_rng(3)
    wide = [(1 << 64) - 2, 0, 5]
    for first, second in (([], []), ([0], [0]), ([7, 7, 2, 7], [9, 1, 0, 5]), (wide, wide[::-1])):
        x = np.array([first, second], np.uint64).T
        for d in (1, 2):
            keys = suffix_tree._hashed(x[:, e] for e in range(d - 1, -1, -1))
            assert suffix_tree.unpack_contexts(suffix_tree.pack_contexts(keys, x[:, :d]), d).tolist() == keys.tolist()
    keys = np.sort(suffix_tree._mix(np.arange(50, dtype=np.uint64)))
    assert suffix_tree.unpack_contexts(suffix_tree.pack_contexts(keys, np.zeros((50, 0), np.uint64)), 3).tolist() == keys.tolist()

    lengths, at = np.full(2000, 10), np.minimum(rng.zipf(1.3, 20000) - 1, 2999)
    counts = np.bincount(at, minlength=3000)
    walk = suffix_tree.Walk(2, 2, 4, 2000, 0, 22000.0, 0.1)
    words = np.arange(2, 3002).astype(np.uint64), counts, at
    one, = walk.go(walk.start(words, lengths), np.ones(22000, bool), {})
    told = {1: ([dictionary.pack_wide(one["counts"])], [dictionary.pack_numbers(np.ones(len(one["contexts"]), np.float32).view(np.uint32))])}
    two, = walk.go(walk.start(words, lengths), np.ones(22000, bool), told)
    for d, asked in ((1, one), (2, two)):
        bucket = walk.bucket(asked["contexts"]).astype(int)
        assert len(bucket) > 300 and (np.diff(bucket) >= 0).all() and len(set(asked["contexts"].tolist())) == len(bucket)
        for b in range(4):
            keys, spelled = asked["contexts"][bucket == b], asked["spelled"][bucket == b]
            packed = suffix_tree.pack_contexts(keys, spelled)
            assert suffix_tree.unpack_contexts(packed, d).tolist() == keys.tolist()
            assert len(packed) < 0.7 * len(dictionary.pack_wide(np.diff(np.sort(keys), prepend=np.uint64(0))))


def test_questions_go_before_answers_are_dealt(spark, docs, monkeypatch):
    """When a depth's answers are dealt, the shuffle of its questions is off the disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles() -> set[str]:
        every = files.getAllFiles()
        return {n for n in (every.apply(i).getName() for i in range(every.size())) if n.startswith("shuffle_") and n.endswith(".data")}

    suffix_tree.release_shuffles(spark)
    others, left, bucketed = shuffles(), [], dictionary.bucketed

    def watched(df, buckets, key="chunk"):
        end = time.time() + 3  # Spark deletes a little later
        while (now := shuffles() - others) and time.time() < end:
            time.sleep(0.1)
        left.append((key, len(now)))
        return bucketed(df, buckets, key)

    monkeypatch.setattr(dictionary, "bucketed", watched)
    suffix_tree.fit(docs)
    assert [key for key, _ in left] == ["chunk", "unit", "unit", "unit", "unit"]
    assert [n for _, n in left[2:]] == [0, 0, 0]
