"""Ranked search against scoring every document in plain Python."""

import math
import re

import numpy as np
import pytest

from loanroll.llm import queries, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def plain_search(docs, items, k=10):
    cut = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in cut), sum(len(w) for _, w in cut)
    df, counts = {}, []
    for i, w in cut:
        tf = {}
        for x in w:
            tf[x] = tf.get(x, 0) + 1
        for x in tf:
            df[x] = df.get(x, 0) + 1
        counts.append((i, len(w), tf))
    out = []
    for item, text in items:
        found = []
        for i, n, tf in counts:
            m = 100 - 90 + 90 * n * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                        for t in set(terms(text)) if t in tf)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(*args, **options):
    return sorted(map(tuple, ranked_search.search(*args, **options).collect()), key=str)


ITEMS = [(1, "The of and"), (2, "one two THREE three"), (2, "é 漢字 𝄞"), (None, "x y z line"), (3, None), (4, " .,; "), (5, "nowhere"), (6, "a" * 3000)]


@pytest.mark.parametrize("block_words", [20_000, 3])
@pytest.mark.parametrize("block_docs", [64, 2])
def test_weird_documents(spark, weird_docs, monkeypatch, block_words, block_docs):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block_docs)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = [tuple(r) for r in weird_docs.select("doc_id", "text").collect()]
    assert found(weird_docs, items, block_words=block_words) == plain_search(docs, ITEMS)


def test_query_on_the_table(spark):
    base = "/root/testdata/sf0.01"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{base}/{t}.parquet").select(i, "text").collect()]
                   for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(map(tuple, queries.op11_geometric_blocks(spark, base).collect()), key=str) == plain_search(docs, items)


@pytest.mark.parametrize("cells", [12_000_000, 4000])
def test_ties_copies_and_small_shards(spark, monkeypatch, cells):
    """A third of the rows are copies of one text; equal scores go by id, wherever a shard ends."""
    monkeypatch.setattr(ranked_search, "SHARD_CELLS", cells)
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 8)
    rng = np.random.default_rng(2)
    rows = [(int(i), "alpha beta gamma") for i in rng.permutation(300)]
    rows += [(1000 + i, " ".join(f"w{k}" for k in rng.integers(0, 40, rng.integers(0, 30)))) for i in range(600)] + [(5, "alpha"), (5, "alpha")]
    items = [(i, " ".join(f"w{k}" for k in rng.integers(0, 40, 6))) for i in range(30)] + [(99, "gamma beta"), (98, "alpha w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(docs, spark.createDataFrame(items, "item_id bigint, text string")) == plain_search(rows, items)


def test_blocks_are_skipped_by_their_bounds():
    """Most documents of a shard need no scoring, and the best are the best."""
    rng = np.random.default_rng(3)
    n, v = 3000, 60
    topic = rng.integers(0, 12, n)
    postings = [(d, t, int(rng.integers(1, 6))) for d in range(n) for t in np.unique(np.concatenate([topic[d] * 5 + rng.integers(0, 5, 6), rng.integers(0, v, 3)]))]
    rows, terms_, tf = (np.array(x, np.int64) for x in zip(*postings, strict=True))
    size = np.bincount(rows, tf, n).astype(np.int64)
    weights = np.array([ranked_search.weight(n, int(x)) for x in np.bincount(terms_, minlength=v)], np.int64)
    cells = ranked_search.impacts(tf, size[rows], n, int(size.sum()))
    shard = ranked_search.Shard(np.arange(n), np.ones(n, bool), rows, terms_, cells, weights)
    asked = [np.array(q) for q in ([0, 1, 2], [5, 6, 7, 8, 9], [10, 30, 50], [59])]
    asked = [q[np.lexsort((q, -weights[q]))] for q in asked]
    together = ranked_search._together(asked, v)
    for q in asked[:3]:
        best = ranked_search.Best(10)
        scored = shard.search(q, best, together)
        score = shard.cells[:, q].astype(np.int64) @ weights[q]
        by = np.lexsort((np.arange(n), -score))[:10]
        assert best.doc.tolist() == by.tolist() and best.score.tolist() == score[by].tolist()
        assert scored < 0.6 * np.count_nonzero(score)
    for own in shard.blocks.values():
        for a, b, summary in zip(own.begins, own.ends, own.summary, strict=True):
            assert (shard.cells[np.ix_(own.docs[a:b], own.coordinates)].max(axis=0) == summary).all()


def test_nothing_to_search(spark, no_docs, weird_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert found(no_docs, items) == [] and found(weird_docs, items.limit(0)) == []
