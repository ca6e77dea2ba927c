"""Exact ranked search with geometrically blocked posting lists.

1. Each task writes, per document, its length and the frequencies of the terms
   that the stated queries hold; lengths and document frequencies are summed
   from that table.
2. Each task takes the written documents in shards and builds a posting list
   per term. A list is cut into blocks of similar documents: documents are
   projected to a few dimensions, some documents of the list serve as centres,
   and each document joins the nearest one. A block's summary is the
   coordinatewise maximum of its documents' impacts.
3. A query goes through the lists of its terms by falling weight. The sum of a
   block's summary over the terms of this list and the later ones bounds the
   score of each of its documents not met before: documents that hold an
   earlier term have been scored, or lie in blocks that were bounded with it.
   A block is skipped only if its bound is under the k-th best score so far;
   all others are scored in full. The same bound of a whole list ends a query.
4. The best k of each task are merged, first by query and a salt, then by query.

Clustering decides only how much is skipped; results are those of scoring every
document. Queries are dealt into blocks of about ``block_words`` words, each
broadcast and searched in a pass of its own. A shard is bounded in cells
(documents times terms), whatever the size of the vocabulary. Documents are
never shuffled, so a hot source makes no hot task.

Weights and scores: see ``weight`` and ``impacts``; integers of 64 bits.

Defined results: null and empty texts hold no terms, and neither they nor
queries without terms are in the result; a query with fewer documents of a
score above 0 returns all of these; equal scores go by ascending id, null
first; repeated documents are ranked one by one, repeated query ids each have
ranks of their own; empty tables give no rows. Ids of documents are cast to
bigint: one that is no number fails the query under ANSI rules. Only the id
and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, list_column, list_slices, returns_memory, staged, texts_as_bytes
from .decontaminate import words_of

#: Documents of a block on average, and cells (documents times terms) of a shard at most.
BLOCK_DOCS, SHARD_CELLS = 32, 12_000_000
#: Dimensions in which documents are compared.
DIMENSIONS = 16
#: Groups by which the tasks' results of one query are merged first.
SALTS = 64
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each occurrence count gives, without the term's weight: below 1,000,000."""
    m = 10 + (90 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def query_blocks(queries: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple]]:
    """Lists of (id, terms) of about ``block_words`` words, over all queries that hold a term."""
    terms = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_TERM), F.lit(0))
    rows = queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.size(terms).cast("bigint").alias("n")).where("n > 0")
    blocks = -(-(rows.agg(F.sum("n")).first()[0] or 0) // block_words)
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()  # one block, bounded
        yield [(r.id, sorted(set(words_of(r.text.encode())))) for r in own]


def forward_index(docs: DataFrame, vocabulary: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, n (terms with repeats), terms (numbers in the vocabulary) and tfs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(vocabulary.value)}.get
        for b in batches:
            terms, tfs, sizes = [], [], []
            for text in texts_as_bytes(b.column("text")):
                words = words_of(text)
                found = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
                own, n = np.unique(found[found >= 0], return_counts=True)
                terms.append(own)
                tfs.append(n)
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), list_column(terms, pa.int32()), list_column(tfs, pa.int32())],
                                             ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(returns_memory(run), "doc_id bigint, n bigint, terms array<int>, tfs array<int>"), "forward-index")


class Blocks:
    """One posting list in blocks: documents, where each block begins, and the summaries of the coordinates asked for."""

    def __init__(self, docs: np.ndarray, near: np.ndarray, cells: np.ndarray, coordinates: np.ndarray):
        centres = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // BLOCK_DOCS)).astype(np.int64)]
        nearest = np.argmax(near[docs] @ near[centres].T, axis=1) if len(centres) > 1 else np.zeros(len(docs), np.int64)
        by = np.argsort(nearest, kind="stable")
        self.docs = docs[by]
        self.begins = np.flatnonzero(np.diff(nearest[by], prepend=-1))
        self.ends = np.append(self.begins[1:], len(docs))
        self.coordinates = coordinates
        self.summary = np.maximum.reduceat(cells[np.ix_(self.docs, coordinates)], self.begins, axis=0)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.summary[:, np.searchsorted(self.coordinates, terms)].astype(np.int64) @ weights


class Best:
    """The best k documents so far: by falling score, then by id, null first."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.some = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A document of a smaller score is none of the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, some: np.ndarray) -> None:
        on = score >= self.least
        if on.any():
            score, doc, some = (np.concatenate(x) for x in ((self.score, score[on]), (self.doc, doc[on]), (self.some, some[on])))
            by = np.lexsort((doc, some, -score))[:self.k]
            self.score, self.doc, self.some = score[by], doc[by], some[by]


class Shard:
    """The blocked index of some documents, searched by all queries of a block."""

    def __init__(self, ids: np.ndarray, some: np.ndarray, rows: np.ndarray, terms: np.ndarray, cells: np.ndarray, weights: np.ndarray):
        """``rows``, ``terms``: document and term of each posting; ``cells``: its impact without the weight."""
        self.ids, self.some, self.weights = ids, some, weights
        self.cells = np.zeros((len(ids), len(weights)), np.int32)
        self.cells[rows, terms] = cells
        by = np.argsort(terms, kind="stable")
        edges = np.searchsorted(terms[by], np.arange(len(weights) + 1))
        self.lists = [rows[by[a:b]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.most = self.cells.max(axis=0, initial=0).astype(np.int64) * weights
        # signs drawn by term number: the same projection in every task
        signs = np.random.default_rng(len(weights)).choice(np.array([-1, 1], np.float32), (len(weights), DIMENSIONS))
        self.near = np.zeros((len(ids), DIMENSIONS), np.float32)
        np.add.at(self.near, rows, signs[terms] * (cells * weights[terms]).astype(np.float32)[:, None])
        self.near /= np.maximum(np.linalg.norm(self.near, axis=1, keepdims=True), 1e-9)
        self.blocks: dict[int, Blocks] = {}

    def search(self, terms: np.ndarray, best: Best, together: list[np.ndarray]) -> int:
        """Adds a query's documents to ``best``. ``terms`` by falling weight; ``together[t]``: the terms that share a query with t.

        Returns how many documents were scored.
        """
        weights = self.weights[terms]
        rest = np.cumsum(self.most[terms][::-1])[::-1]
        fresh, scored = np.ones(len(self.ids), bool), 0
        for k, t in enumerate(terms.tolist()):
            if rest[k] < best.least:
                break
            if not len(self.lists[t]):
                continue
            if t not in self.blocks:
                self.blocks[t] = Blocks(self.lists[t], self.near, self.cells, together[t])
            own = self.blocks[t]
            bound = own.bounds(terms[k:], weights[k:])
            order, at, step = np.argsort(-bound, kind="stable"), 0, 2
            while at < len(order) and bound[order[at]] >= best.least:
                some = order[at:at + step]
                some = some[bound[some] >= best.least]
                docs = np.concatenate([own.docs[own.begins[b]:own.ends[b]] for b in some])
                docs = docs[fresh[docs]]
                fresh[docs] = False
                scored += len(docs)
                best.add(self.cells[np.ix_(docs, terms)].astype(np.int64) @ weights, self.ids[docs], self.some[docs])
                at, step = at + step, step * 2
        return scored


def _together(queries: list[np.ndarray], n_terms: int) -> list[np.ndarray]:
    found: list[list[np.ndarray]] = [[] for _ in range(n_terms)]
    for q in queries:
        for t in q.tolist():
            found[t].append(q)
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in found]


def _searched(index: DataFrame, query: Broadcast, k: int) -> DataFrame:
    """(query, doc_id, score): the best of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries, n_docs, n_terms = query.value
        best, together = [Best(k) for _ in queries], _together(queries, len(weights))
        most = max(BLOCK_DOCS, SHARD_CELLS // max(len(weights), 1))
        ids, some, sizes, terms, cells, held = [], [], [], [], [], 0

        def search() -> None:
            nonlocal held
            rows = np.repeat(np.arange(held), np.concatenate(sizes))
            shard = Shard(np.concatenate(ids), np.concatenate(some), rows, np.concatenate(terms), np.concatenate(cells), weights)
            for q, b in zip(queries, best, strict=True):
                shard.search(q, b, together)
            for x in (ids, some, sizes, terms, cells):
                x.clear()
            held = 0

        for whole in batches:
            for a in range(0, whole.num_rows, most):
                b = whole.slice(a, most)
                if held and held + b.num_rows > most:
                    search()
                own = list(list_slices(b.column("terms")))
                size = np.array([len(x) for x in own])
                tf = np.concatenate([*list_slices(b.column("tfs")), np.zeros(0, np.int32)]).astype(np.int64)
                n = np.repeat(b.column("n").to_numpy(), size)
                ids.append(b.column("doc_id").fill_null(0).to_numpy())
                some.append(b.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
                sizes.append(size)
                terms.append(np.concatenate([*own, np.zeros(0, np.int32)]).astype(np.int64))
                cells.append(impacts(tf, n, n_docs, n_terms))
                held += b.num_rows
        if held:
            search()
        part = TaskContext.get().partitionId()
        for i, b in enumerate(best):
            if len(b.score):
                size = len(b.score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * size, pa.int32()), pa.array([part % SALTS] * size, pa.int32()), pa.array(b.doc, mask=~b.some), pa.array(b.score)],
                    ["query", "salt", "doc_id", "score"])

    return index.where("size(terms) > 0").mapInArrow(returns_memory(run), "query int, salt int, doc_id bigint, score bigint")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           query_id_col: str = "item_id", query_text_col: str = "text", block_words: int = 20_000) -> DataFrame:
    """The best k documents of every query: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = queries.schema[query_id_col].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id bigint, score bigint"
    found = []
    for block in query_blocks(queries, query_id_col, query_text_col, block_words):
        vocabulary = sorted({t for _, terms in block for t in terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        index = forward_index(docs, spark.sparkContext.broadcast(vocabulary), id_col, text_col)
        n_docs, n_terms = index.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        dfs = np.zeros(len(vocabulary), np.int64)
        for t, df in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the block's terms at most
            dfs[t] = df
        weights = np.array([weight(n_docs, int(df)) for df in dfs], np.int64)
        numbered = [np.array([number[t] for t in terms], np.int64) for _, terms in block]
        numbered = [q[np.lexsort((q, -weights[q]))] for q in numbered]
        best = _searched(index, spark.sparkContext.broadcast((weights, numbered, n_docs, n_terms)), k)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
        for key in (["query", "salt"], ["query"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], f"query int, item_id {kind}")  # one block of queries
        found.append(staged(best.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
