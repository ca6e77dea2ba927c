"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest

from loanroll.llm import merkle, queries


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    return joined(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def plain_levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([joined(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def plain_path(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 8 * 8
        out.append((nodes[first:i], nodes[i + 1:first + 8]))
        i //= 8
    return out


def plain_manifest(rows):
    by, out = {}, []
    for r in rows:
        by.setdefault(r.lang, []).append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for g in names:
        by[g] = sorted(((r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text), r) for r in by[g]), key=lambda x: x[:3])
    trees = {g: plain_levels([x[2] for x in by[g]]) for g in names}
    top = plain_levels([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(by[g]):
            steps, node = plain_path(trees[g], i) + plain_path(top, k), leaf
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None:
                node = plain_leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
            for a, b in steps:
                node = joined(*a, node, *b)
            out.append((r.doc_id, leaf, trees[g][-1][0], top[-1][0], joined(*(x for a, b in steps for x in a + b)), node, node == top[-1][0]))
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, merkle.digests(merkle.manifest(docs, changed=merkle.tampered())).collect()), key=str)


def test_query_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, queries.op12_merkle(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == plain_manifest(docs.collect()) and 0 < sum(r[-1] for r in got) < len(got)


def test_weird_documents(weird_docs):
    assert found(weird_docs) == plain_manifest(weird_docs.collect())


@pytest.mark.parametrize("sizes", [[1], [8], [9, 1], [64, 65, 7], [513, 2], [1000, 72, 73], list(range(1, 80))])
def test_many_rounds_with_ragged_ends(spark, monkeypatch, sizes):
    """Blocks of 8 leaves, so that most levels come from the exchange."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = [(i, f"Text {i}", None if g == 1 else f"l{g}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(docs) == plain_manifest(docs.collect())


def test_one_row_a_third_of_the_time(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    rows = [(7, "Same", "en", "s", 4)] * 700 + [(i, f"Other {i}", "en", "s", 5) for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(docs) == plain_manifest(docs.collect())


def test_no_documents(no_docs):
    assert found(no_docs) == []
