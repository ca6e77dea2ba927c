"""Benchmark decontamination with an FM-index per shard of the training texts.

A task gathers whole documents into shards of about ``SHARD_WORDS`` words. A
shard's words become one sequence of symbols (words that no benchmark item
holds share one symbol, a separator ends each document), of which it builds the
suffix order, the Burrows-Wheeler transform as a wavelet matrix and a sample of
the suffix positions. All windows of the benchmark are searched backwards at
once with the matrix's ranks, occurrences are located by walking to the next
sampled position, and the spans found in a document are merged.

The benchmark is the stated query set: it is dealt into blocks of about
``block_words`` words, each broadcast and matched in a pass of its own against
all documents, so that what is broadcast has that bound; what a pass found is
written before the next one begins. Documents are never
shuffled, so a hot source makes no hot task; a text longer than a shard is cut
into pieces that overlap by a window less one word.

Defined results: null and empty texts have no words and no hits; a null item
id counts as the empty string; repeated documents and items are all kept
(items with one id count once); empty tables give no rows or no hits. Only the
id and text columns are read, extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, list_column, returns_memory, staged, texts_as_bytes

SHARD_WORDS = 1 << 20
#: Distance between sampled suffix positions.
SAMPLE = 16
#: Words are runs of characters outside \x00-\x2F, \x3A-\x60 and \x7B-\x7F, after lower-casing A-Z.
_BREAKS = bytes(32 if x <= 0x2F or 0x3A <= x <= 0x60 or 0x7B <= x <= 0x7F else x for x in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SEPARATOR, OTHER = 0, 1


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_BREAKS).split()


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffix array of ``s`` (fewer than 2**21 symbols and positions) by prefix tripling.

    Each round orders by three times as many symbols; only suffixes that share
    their rank with another take part in it.
    """
    n = len(s)
    rank = np.zeros(n, np.int64)
    padded = np.zeros(n + 2, np.int64)
    padded[:n] = s + 1
    key = padded[:n] << 42 | padded[1:n + 1] << 21 | padded[2:n + 2]
    order = np.argsort(key)
    first = np.ones(n, bool)
    sorted_key = key[order]
    first[1:] = sorted_key[1:] != sorted_key[:-1]
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = starts
    reach = 3
    while True:
        last = np.ones(n, bool)
        last[:-1] = first[1:]
        slots = np.flatnonzero(~(first & last))  # places in the order that share a rank with a neighbour
        if not len(slots) or reach >= n:
            return order
        where = order[slots]
        after = lambda d: np.where(where + d < n, rank[np.minimum(where + d, n - 1)] + 1, 0)  # noqa: E731, B023
        key = rank[where] << 42 | after(reach) << 21 | after(2 * reach)
        by = np.argsort(key)
        where, key = where[by], key[by]
        order[slots] = where  # equal ranks lie together, so the subset stays inside its slots
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        first[slots] = new
        rank[where] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        reach *= 3


class FMIndex:
    """Backward search and locating over one shard.

    The shard is closed by an end of its own, smaller than every symbol and
    found nowhere else: without it the row before the first suffix would hold
    one of many equal separators, and steps back through those would be off by
    one. Symbols are thus one higher inside than outside.
    """

    def __init__(self, s: np.ndarray, sigma: int):
        s, sigma = np.append(s + 1, 0), sigma + 1
        n = len(s)
        order = suffix_order(s)
        x = s[order - 1].astype(np.int32)  # the transform: what stands before each suffix
        self.n = n
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])[:sigma]
        self.bits = range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1)
        self.ones, self.zeros = [], []
        for bit in self.bits:
            b = (x >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(b, dtype=np.int32)]).astype(np.int32))
            b = b.astype(bool)
            self.zeros.append(n - int(self.ones[-1][-1]))
            x = np.concatenate([x[~b], x[b]])
        self.origin = self._follow(np.arange(sigma), np.zeros(sigma, np.int64))
        sampled = order % SAMPLE == 0
        self.sampled, self.nth, self.positions = sampled, np.cumsum(sampled) - 1, order[sampled]

    def _follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, ones, zeros in zip(self.bits, self.ones, self.zeros, strict=True):
            r = ones[i]
            i = np.where((symbol >> bit) & 1, zeros + r, i - r)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before place i of the transform."""
        return self._follow(symbol, i) - self.origin[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 place of each pattern (rows, padded on the left) in the suffix order."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1]):
            on = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(on):
                break
            c = patterns[on, -1 - step] + 1
            lo[on] = self.before[c] + self.rank(c, lo[on])
            hi[on] = self.before[c] + self.rank(c, hi[on])
        return lo, hi

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order: steps back through the text until a sampled one."""
        out, steps = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        left, at = np.arange(len(place)), place.astype(np.int64)
        while len(left):
            there = self.sampled[at]
            out[left[there]] = self.positions[self.nth[at[there]]] + steps[left[there]]
            left, at = left[~there], at[~there]
            steps[left] += 1
            i, symbol = at, np.zeros(len(at), np.int64)
            for ones, zeros in zip(self.ones, self.zeros, strict=True):
                r = ones[i]
                one = ones[i + 1] - r
                symbol = symbol << 1 | one
                i = np.where(one, zeros + r, i - r)
            at = self.before[symbol] + i - self.origin[symbol]
        return out


def query_set(items: list[tuple[str, bytes]], window: int) -> dict:
    """The distinct windows of a block of items, as symbols, with the items that hold them."""
    vocabulary: dict[bytes, int] = {}
    holders: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for item, text in items:
        w = [vocabulary.setdefault(x, len(vocabulary) + 2) for x in words_of(text)]
        for i in range(max(1, len(w) - window + 1) if w else 0):
            holders[tuple(w[i:i + window])].add(item)
    patterns = np.zeros((len(holders), window), np.int64)
    for row, p in zip(patterns, holders, strict=True):
        row[window - len(p):] = p
    return {"vocabulary": vocabulary, "patterns": patterns, "lengths": np.array([len(p) for p in holders], np.int64),
            "items": [sorted(x) for x in holders.values()], "window": window}


def query_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[dict]:
    """Query sets of about ``block_words`` words over all items, one at a time.

    Items are cut into pieces of at most a block (neighbours share a window
    less one word, so that no window is lost) and dealt into blocks by hash.
    """
    size = max(block_words, 2 * window)
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_WORD.pattern), F.lit(0))
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("words"))
    n = F.size("words")
    starts = F.when(n > size, F.sequence(F.lit(1), n - window + 1, F.lit(size - window + 1))).otherwise(F.array(F.lit(1)))
    pieces = items.where(n > 0).select("item", F.explode(starts).alias("start"), "words")
    pieces = pieces.select("item", F.array_join(F.slice("words", F.col("start"), size), " ").alias("text"))
    total = items.agg(F.sum(n.cast("bigint"))).first()[0] or 0
    blocks = -(-total // size) or 1
    for block in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield query_set([(r.item, r.text.encode()) for r in own.collect()], window)  # one block, bounded


def _shards(lengths: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces (document, first word, end word) of about SHARD_WORDS words together, all words covered."""
    shard, size = [], 0
    for d, n in enumerate(lengths):
        start = 0
        while start < n:
            end = min(n, start + SHARD_WORDS)
            if shard and size + end - start > SHARD_WORDS:
                yield shard
                shard, size = [], 0
            shard.append((d, start, end))
            size += end - start + 1
            start = n if end == n else end - window + 1
    if shard:
        yield shard


def find(ids: list[np.ndarray], q: dict) -> tuple[list[np.ndarray], list[list[str]]]:
    """Per document: merged word spans (start, end, start, end, ...) and the sorted items found."""
    doc, start, end, window = [], [], [], []
    for shard in _shards([len(x) for x in ids], q["window"]):
        parts, begins, at = [], [], 0
        for d, a, b in shard:
            parts += (ids[d][a:b], np.zeros(1, np.int32))
            begins.append(at)
            at += b - a + 1
        s = np.concatenate(parts).astype(np.int64)
        index = FMIndex(s, len(q["vocabulary"]) + 2)
        lo, hi = index.search(q["patterns"], q["lengths"])
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        which = np.repeat(found, count)
        places = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[found], count)
        position = index.locate(places)
        piece = np.searchsorted(np.array(begins), position, "right") - 1
        shift = np.array([a for _, a, _ in shard])[piece] - np.array(begins)[piece]
        doc.append(np.array([d for d, _, _ in shard])[piece])
        start.append(position + shift)
        end.append(position + shift + q["lengths"][which])
        window.append(which)
    spans, items = [np.zeros(0, np.int32) for _ in ids], [[] for _ in ids]
    if not doc or not sum(map(len, doc)):
        return spans, items
    doc, start, end, window = (np.concatenate(x) for x in (doc, start, end, window))
    by = np.lexsort((start, doc))
    doc, start, end, window = doc[by], start[by], end[by], window[by]
    edges = np.flatnonzero(np.diff(doc)) + 1
    for a, b in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(doc)]]), strict=True):
        s, reach = start[a:b], np.maximum.accumulate(end[a:b])
        new = np.concatenate([[True], s[1:] > reach[:-1]])
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [b - a - 1]])
        spans[doc[a]] = np.stack([s[new], reach[last]], 1).astype(np.int32).ravel()
        items[doc[a]] = sorted({i for w in np.unique(window[a:b]) for i in q["items"][w]})
    return spans, items


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of two lists of word spans."""
    if not len(a) or not len(b):
        return a if len(a) else b
    s = np.concatenate([a.reshape(-1, 2), b.reshape(-1, 2)])
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
    return np.stack([s[new, 0], reach[last]], 1).ravel().astype(np.int32)


def without_spans(text: str, spans: np.ndarray) -> str:
    """The text without the characters from each span's first word to its last."""
    if not len(spans):
        return text
    lower = text  # A-Z are word characters here, as they are after lower-casing
    words = [m.span() for m in _WORD.finditer(lower)]
    out, at = [], 0
    for a, b in np.asarray(spans).reshape(-1, 2):
        out.append(text[at:words[a][0]])
        at = words[b - 1][1]
    return "".join([*out, text[at:]])


def _pass(query: Broadcast, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over all documents: adds one block's spans and items to ``spans`` and ``items``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = query.value
        look, held, size = q["vocabulary"].get, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            spans, items = find([i for _, ids in held for i in ids], q)
            at = 0
            for b, ids in held:
                s, t, k = spans[at:at + len(ids)], items[at:at + len(ids)], len(ids)
                at += k
                old_s, old_t = b.column("spans").to_pylist(), b.column("items").to_pylist()
                s = [_merge(np.array(x, np.int32), y) for x, y in zip(old_s, s, strict=True)]
                t = [sorted({*x, *y}) if x else y for x, y in zip(old_t, t, strict=True)]
                made = {"spans": list_column(s, pa.int32()), "items": pa.array(t, pa.list_(pa.string())),
                        "n_words": pa.array([len(x) for x in ids], pa.int64())}
                yield pa.RecordBatch.from_arrays([made.get(n, b.column(n) if n in b.schema.names else None) for n in names], names)
            held.clear()

        for b in batches:
            ids = [np.fromiter(map(look, w, repeat(OTHER)), np.int32, len(w))
                   for w in map(words_of, texts_as_bytes(b.column("text")))]
            held.append((b, ids))
            size += sum(map(len, ids))
            if size >= SHARD_WORDS // 2:
                yield from out()
                size = 0
        if held:
            yield from out()
    return run


def _passes(docs: DataFrame, blocks: Iterator[dict]) -> DataFrame:
    """All blocks against all documents, one block at a time: what one pass found is written before the next one begins."""
    spark, first = docs.sparkSession, True
    for q in blocks:
        if not first:
            docs = staged(docs, "benchmark-pass")
        sent = spark.sparkContext.broadcast(q)
        docs, first = docs.mapInArrow(returns_memory(_pass(sent, docs.columns)), docs.schema), False
    return docs


def find_benchmark_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
                         block_words: int = 2_000_000, keep_text: bool = False) -> DataFrame:
    """Per document: id, n_words, spans (flat list of word spans that benchmark windows cover), items found.

    ``keep_text`` adds the text column (as ``text``).
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *_nothing_found())
    found = _passes(rows, query_blocks(benchmark, item_col, item_text_col, window, block_words))
    return found if keep_text else found.drop("text")


def _nothing_found() -> list[Column]:
    return [F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<int>").alias("spans"),
            F.array().cast("array<string>").alias("items")]


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with every benchmark span cut out of their texts; all rows and columns stay, clean texts as they are."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    carried = docs.toDF(*(f"c{i}" for i in range(len(names)))).select("*", F.col(f"c{at}").alias("text"), *_nothing_found())
    window, block = options.get("window", 10), options.get("block_words", 2_000_000)
    carried = _passes(carried, query_blocks(benchmark, options.get("item_col", "item_id"), options.get("item_text_col", "text"), window, block))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, spans = b.column("text").to_pylist(), b.column("spans").to_pylist()
            texts = [x if not s else without_spans(x, np.array(s)) for x, s in zip(own, spans, strict=True)]
            columns = [pa.array(texts, b.schema.field("text").type) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(names))])

    out = carried.mapInArrow(returns_memory(cut), carried.select(*(f"c{i}" for i in range(len(names)))).schema)
    return out.toDF(*names)


def digests(found: DataFrame) -> DataFrame:
    """The query's columns from found spans and items."""
    covered = F.aggregate(F.sequence(F.lit(1), F.size("spans"), F.lit(2)),
                          F.lit(0).cast("bigint"), lambda a, i: a + F.element_at("spans", i + 1) - F.element_at("spans", i))
    n_hit = F.when(F.size("spans") > 0, covered).otherwise(F.lit(0).cast("bigint"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
