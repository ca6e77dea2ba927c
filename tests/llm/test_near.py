"""op6 against brute force, and op7 against a search for every window."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from loanroll.llm import decontaminate, simhash


def plain_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fingerprints, radius):
    parent = {f: f for f in fingerprints}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    all_of = sorted(parent)
    for i, f in enumerate(all_of):
        for g in all_of[i + 1:]:
            if (f ^ g).bit_count() <= radius:
                a, b = find(f), find(g)
                parent[max(a, b)] = min(a, b)
    return {f: find(f) for f in all_of}


@pytest.mark.parametrize("source", ["weird_docs", "docs"])
def test_simhash_is_brute_force(request, source):
    df = request.getfixturevalue(source)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]
    root = plain_components({f for _, f in rows}, 4)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    expected = [(i, f"{f:016x}", least.get(root[f])) for i, f in rows]
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == sorted(expected, key=str)


def test_segments_follow_the_number_of_fingerprints():
    assert [simhash.segment_count(n, 4) for n in (0, 1, 236_000, 14_000_000, 10 ** 10)] == [6, 6, 6, 7, 9]


@pytest.mark.parametrize("tile,segments", [(8, None), (4096, None), (4096, 7), (8, 9)])
def test_links_connect_crowded_buckets(spark, tile, segments):
    """Many fingerprints around few centres: buckets of all sizes, also cut into tiles, give the right components."""
    rng = np.random.default_rng(5)
    values = set()
    for _ in range(12):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            values.add(centre ^ sum(1 << int(b) for b in flips))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.near_links(spark.createDataFrame(signed, "fingerprint bigint"), 4, tile, segments).collect()
    unsigned = [(a % (1 << 64), b % (1 << 64)) for a, b in links]
    assert all((a ^ b).bit_count() <= 4 for a, b in unsigned)
    got = {v: v for v in values}

    def find(f):
        while got[f] != f:
            f = got[f]
        return f

    for a, b in unsigned:
        a, b = find(a), find(b)
        got[max(a, b)] = min(a, b)
    assert {v: find(v) for v in values} == plain_components(values, 4)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)], "a bigint, b bigint")
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert roots == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


def test_keep_one_keeps_columns_and_one_of_each(weird_docs):
    kept = simhash.keep_one(weird_docs)
    assert kept.columns == weird_docs.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in weird_docs.select("doc_id", "text").collect()]
    root = plain_components({f for _, f in rows}, 4)
    first = {}
    for i, f in rows:
        first[root[f]] = min((i is None, i or 0), first.get(root[f], (True, 1 << 60)))
    assert len(ids) == len(first)
    assert ids.count((False, 5)) <= 1


def test_nothing_to_compare(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(text, windows):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, items = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if (w := tuple(words[i:i + size])) in windows:
                hit.update(range(i, i + size))
                items |= windows[w]
    return words, hit, items


def plain_windows(items, window):
    out = {}
    for i, text in items:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            out.setdefault(tuple(w[k:k + window]), set()).add("" if i is None else str(i))
    return out


ITEMS = [(1, "The of and"), (2, "one two three four five"), (10, "same id other text line line line line line line line line line"),
         (None, "漢字 𝄞"), (3, None), (4, " .,; "), (2, "é Å"), (5, "the of and the of and the of and the of and the")]


@pytest.mark.parametrize("block_words", [2_000_000, 6])
@pytest.mark.parametrize("shard_words", [1 << 20, 40])
def test_fm_index_finds_every_window(spark, weird_docs, monkeypatch, block_words, shard_words):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    texts = weird_docs.where("length(text) < 6000 or text is null")  # small shards make very long texts slow
    got = decontaminate.digests(decontaminate.find_benchmark_spans(texts, items, block_words=block_words)).collect()
    windows = plain_windows(ITEMS, 10)
    expected = []
    for r in texts.select("doc_id", "text").collect():
        words, hit, found = plain_hits(r.text, windows)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected.append((r.doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_fm_index_on_the_tables(spark, docs):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    windows = plain_windows([tuple(r) for r in benchmark.select("item_id", "text").collect()], 10)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.digests(decontaminate.find_benchmark_spans(docs, benchmark)).collect()}
    expected = {}
    for r in docs.collect():
        words, hit, found = plain_hits(r.text, windows)
        expected[r.doc_id] = (len(words), len(hit), len(found))
    assert got == expected


def test_suffix_order_and_index():
    rng = np.random.default_rng(1)
    for sigma, n in ((2, 1), (2, 50), (3, 300), (7, 1000)):
        s = np.concatenate([rng.integers(1, sigma, n), [0]])
        order = decontaminate.suffix_order(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        index = decontaminate.FMIndex(s, sigma)
        text = s.tolist()
        for size in (1, 2, 4):
            for a in range(0, max(1, n - size), 7):
                p = np.array([text[a:a + size]])
                lo, hi = index.search(p, np.array([p.shape[1]]))
                found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
                assert found == [i for i in range(len(text)) if text[i:i + size] == text[a:a + size]]


@pytest.mark.parametrize("shard_words", [60, 1 << 20])
def test_many_short_documents_in_a_shard(monkeypatch, shard_words):
    """Matches near the beginning of short documents, whose steps back meet separators."""
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
    rng = np.random.default_rng(7)
    item = [b"w%d" % i for i in range(12)]
    q = decontaminate.query_set([("a", b" ".join(item)), ("b", b"x y")], 10)
    two = [b"o o " + b" ".join(item[:10]), b"o " + b" ".join(item[:10])]
    code = lambda t: np.array([q["vocabulary"].get(w, 1) for w in decontaminate.words_of(t)], np.int32)
    spans, _ = decontaminate.find([code(t) for t in two], q)
    assert [s.tolist() for s in spans] == [[2, 12], [1, 11]]
    windows = plain_windows([("a", b" ".join(item).decode()), ("b", "x y")], 10)
    for _ in range(40):
        texts = []
        for _ in range(12):
            words = [(b"o", b"w1", b"x", b"y")[k] for k in rng.integers(0, 4, rng.integers(0, 15))]
            at = rng.integers(0, len(words) + 1)
            texts.append(b" ".join(words[:at] + item[:rng.integers(0, 13)] + words[at:]))
        spans, found = decontaminate.find([code(t) for t in texts], q)
        for t, s, f in zip(texts, spans, found, strict=True):
            _, hit, items = plain_hits(t.decode(), windows)
            assert {k for a, b in s.reshape(-1, 2) for k in range(a, b)} == hit and f == sorted(items)


def test_fm_index_on_ten_thousand_documents(spark):
    """Every document of the largest table, in shards of two sizes, against brute force; all spans can be cut out."""
    base = "/root/testdata/sf0.1"
    benchmark = spark.read.parquet(f"{base}/benchmark.parquet")
    windows = plain_windows([tuple(r) for r in benchmark.select("item_id", "text").collect()], 10)
    (q,) = decontaminate.query_blocks(benchmark, "item_id", "text", 10, 2_000_000)
    texts = [r.text or "" for r in spark.read.parquet(f"{base}/documents.parquet").select("text").toLocalIterator()]
    expected = [plain_hits(t, windows) for t in texts]
    ids = [np.array([q["vocabulary"].get(w, 1) for w in decontaminate.words_of(t.encode())], np.int32) for t in texts]
    for step in (500, len(texts)):
        for k in range(0, len(texts), step):
            spans, found = decontaminate.find(ids[k:k + step], q)
            for t, s, f, (_, hit, items) in zip(texts[k:k + step], spans, found, expected[k:k + step], strict=True):
                assert {i for a, b in s.reshape(-1, 2) for i in range(a, b)} == hit and set(f) == items
                assert hit or decontaminate.without_spans(t, s) == t
                if hit:
                    left = decontaminate.words_of(decontaminate.without_spans(t, s).encode())
                    assert len(left) == len(decontaminate.words_of(t.encode())) - len(hit)


def test_removal_leaves_clean_texts_alone(spark, weird_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    before = {(r.doc_id, r.text) for r in weird_docs.collect()}
    out = decontaminate.remove_spans(weird_docs, items)
    assert out.columns == weird_docs.columns
    after = out.collect()
    assert len(after) == weird_docs.count()
    windows = plain_windows(ITEMS, 10)
    for r in after:
        assert not plain_hits(r.text, windows)[1] or (r.doc_id, r.text) not in before
    clean = {(i, t) for i, t in before if not plain_hits(t, windows)[1]}
    assert clean <= {(r.doc_id, r.text) for r in after}
    assert decontaminate.without_spans("A b, c d! E", np.array([1, 3])) == "A  d! E"


def test_no_documents_or_items(spark, no_docs, weird_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.find_benchmark_spans(no_docs, items).count() == 0
    none = decontaminate.digests(decontaminate.find_benchmark_spans(weird_docs, items.limit(0)))
    assert none.count() == weird_docs.count() and not none.where("contaminated").count()
