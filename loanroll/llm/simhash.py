"""SimHash near-duplicates with pivot distance tables.

A fingerprint's distances to ``PIVOTS`` fixed reference fingerprints are
computed once. For two fingerprints within ``radius`` bits every coordinate
differs by ``radius`` at most (triangle inequality), so pairs with a larger
coordinate difference are discarded and the survivors verified bit by bit.

Which pairs are compared at all: the 64 bits are cut into ``k`` segments;
fingerprints within ``radius`` bits agree in at least ``k - radius`` of them, so
the rows are dealt by each choice of that many segments and compared inside
those buckets only, without loss. ``k`` follows the number of fingerprints, so
that random ones share few buckets at any size; every ``k`` gives the same
components. A bucket gives at most one link per fingerprint (a spanning
forest of its near pairs, never all pairs). A bucket over ``tile`` distinct
fingerprints is cut into blocks, and each pair of blocks is a bucket of its
own, so no task holds more than two blocks. Equal fingerprints are one row
from the start, so copies cost nothing.

Components are found by alternating large and small stars; each round is
written to the shared folder.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; a text of fewer words than a shingle is one shingle;
repeated rows belong to one component and are all returned; null ids are
returned, and a component's id is its smallest id that is not null; an empty
table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, returns_memory, staged, texts_as_bytes

SEED = 42
#: Reference fingerprints: XXH64 of the numbers from zero.
PIVOTS = np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(24)], np.uint64)
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of a text's word shingles (A-Z lower-cased, words between ASCII white space)."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    spans = zip(starts[:n].tolist(), (ends[shingle - 1:] - 1).tolist(), strict=True)
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):  # bounded memory for very long texts
        ones += np.unpackbits(h[i:i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id and fingerprint (bigint: the same 64 bits), plus columns to keep."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts_as_bytes(b.column("text"))], np.uint64)
            at = b.schema.get_field_index("text")
            columns = [pa.array(fp.view(np.int64)) if i == at else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, ["fingerprint" if i == at else n for i, n in enumerate(b.schema.names)])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    schema = rows.withColumn("text", F.lit(0).cast("bigint")).withColumnRenamed("text", "fingerprint").schema
    return rows.mapInArrow(returns_memory(run), schema)


def segment_count(n: int, radius: int) -> int:
    """The fewest segments whose keys (``k - radius`` of them) have about as many bits as there are fingerprints to tell apart."""
    k = radius + 2
    while k < 16 and 64 * (k - radius) / k < math.log2(max(n, 2)) - 1:
        k += 1
    return k


def _segments(k: int) -> list[int]:
    """Bit masks that cut 64 bits into k segments."""
    edges = [64 * i // k for i in range(k + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def _near_in_group(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within ``radius`` bits among distinct fingerprints."""
    table = np.bitwise_count(f[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    by = np.argsort(table[:, 0], kind="stable")  # the first coordinate bounds the stretch to look at
    f, table = f[by], table[by]
    ends = np.searchsorted(table[:, 0], table[:, 0] + radius, "right")
    component, left, right = np.arange(len(f)), [], []
    for i in range(len(f) - 1):
        j = np.arange(i + 1, ends[i])
        j = j[component[j] != component[i]]  # linked already: a further link changes no component
        for p in range(1, len(PIVOTS)):
            if not len(j):
                break
            j = j[np.abs(table[j, p] - table[i, p]) <= radius]
        j = j[np.bitwise_count(f[j] ^ f[i]) <= radius]
        if len(j):
            roots, one = np.unique(component[j], return_index=True)
            left.append(np.full(len(roots), f[i], np.uint64))
            right.append(f[j[one]])
            component[np.isin(component, roots)] = component[i]
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _near_small(f: np.ndarray, group: np.ndarray, size: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs among groups of at most ``size`` rows that lie together, compared by shifts over the whole batch."""
    left, right = [], []
    table = np.bitwise_count(f[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    for d in range(1, size):
        i = np.flatnonzero(group[d:] == group[:-d])
        i = i[np.abs(table[i] - table[i + d]).max(1, initial=0) <= radius]
        i = i[np.bitwise_count(f[i] ^ f[i + d]) <= radius]
        left.append(f[i])
        right.append(f[i + d])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


SMALL = 6


def _links(radius: int):
    """Links inside buckets of a stream that is sorted by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            """rows: whole buckets as columns (bucket numbers ..., fingerprint)."""
            f = rows[:, -1].copy().view(np.uint64)
            new = np.concatenate([[True], (rows[1:, :-1] != rows[:-1, :-1]).any(1)])
            group = np.cumsum(new) - 1
            sizes = np.bincount(group)
            few = (sizes > 1)[group] & (sizes <= SMALL)[group]
            left, right = _near_small(f[few], group[few], SMALL, radius)
            parts = [(left, right)]
            begins = np.flatnonzero(new)
            for g in np.flatnonzero(sizes > SMALL):
                parts.append(_near_in_group(f[begins[g]:begins[g] + sizes[g]], radius))
            a, b = (np.concatenate([p[k] for p in parts]).view(np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            if not len(rows):
                continue
            held.append(rows)
            if (rows[-1, :-1] != held[0][0, :-1]).any():  # a bucket has ended: all but the last one can go
                rows = np.concatenate(held)
                same = (rows[:, :-1] == rows[-1, :-1]).all(1)
                cut = len(rows) - int(np.argmin(same[::-1]))
                held = [rows[cut:]]
                yield solve(rows[:cut])
        if held:
            yield solve(np.concatenate(held))
    return run


def near_links(distinct: DataFrame, radius: int, tile: int = 4096, segments: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect every pair within ``radius`` bits."""
    k = segments or segment_count(distinct.count(), radius)
    keys = []
    for c, chosen in enumerate(combinations(_segments(k), k - radius)):
        mask = sum(chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(c).alias("c"), F.col("fingerprint").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")))
    rows = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("k")).select("k.c", "k.bits", "fingerprint")
    hot = rows.groupBy("c", "bits").count().where(F.col("count") > tile)
    hot = staged(hot.select("c", "bits", F.ceil(2 * F.col("count") / tile).alias("blocks")), "simhash-hot")
    whole = rows.join(hot, ["c", "bits"], "left_anti").select("c", "bits", F.lit(0).alias("i"), F.lit(0).alias("j"), "fingerprint")
    cut = rows.join(hot, ["c", "bits"]).withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    tiles = cut.select("c", "bits", "own", "fingerprint", other).select(
        "c", "bits", F.least("own", "other").cast("int").alias("i"), F.greatest("own", "other").cast("int").alias("j"), "fingerprint")
    dealt = (whole.unionByName(tiles) if hot.head(1) else whole).repartition("c", "bits", "i", "j")
    ordered = dealt.sortWithinPartitions("c", "bits", "i", "j")
    return ordered.mapInArrow(returns_memory(_links(radius)), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars: (node, root) for every linked node but the roots."""
    now = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "stars")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = staged(stars, "stars")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark


def classes(marked: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, component_id) for a table of (doc_id, fingerprint): the smallest id of the fingerprint's component."""
    distinct = staged(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(near_links(distinct.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    rooted = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.select("fingerprint", "root").join(least, "root").select("fingerprint", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable)."""
    marked = staged(fingerprints(docs, shingle, id_col, text_col), "simhash")
    out = marked.join(classes(marked, radius), "fingerprint")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: that of the smallest id (nulls last), one row of repeated ones.

    Ids may repeat, so rows are numbered; the numbered table is written first to keep its numbers.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    plain = staged(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
    order = (f"c{names.index(id_col)}", f"c{names.index(text_col)}")
    marked = staged(fingerprints(plain, shingle, *order, keep=("row",)), "simhash")
    # rows in the order of (null id last, id, row), written as one number per distinct fingerprint's first row
    first = marked.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    first = staged(first, "first-rows")
    roots = components(near_links(first.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    rooted = first.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return plain.join(kept, "row", "left_semi").drop("row").toDF(*names)
