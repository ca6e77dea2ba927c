"""A probabilistic suffix tree over words: training by Spark aggregates, scoring of whole texts.

Symbols are the words that occur at least ``min_count`` times in the training
texts, one symbol for all other words, and the end of a text. The root predicts
symbols by their training counts; a word under the common symbol has its own
smoothed share of that symbol, so the root alone is the smoothed unigram model
over all words of the corpus.

Contexts of one, two, ... ``depth`` symbols are kept if they occur at least
``min_count`` times and their next-symbol distribution diverges from that of
their longest proper suffix by at least ``min_divergence`` bits. A context's
distribution is its counts less a discount, plus the mass so freed times its
suffix's distribution; followers seen once have only the latter.

Words, contexts and followers are kept by absolute counts, so the tree grows
with the corpus; it is never collected or broadcast. Depth by depth, each unit
of texts asks about its distinct contexts (dealt by 64-bit hashes, short ones
spelled as their symbols, which take less room) with their followers, how often it has them, and what their suffixes make of them.
The task that a context is dealt to sums the followers over all units, decides
whether the context is kept, writes it as a part of the tree, and tells the
units the followers' counts and the share that the context leaves to its
suffix. An n-gram can occur twice only if both of its parts do, and only those
are asked about.

A token is scored by the longest kept suffix of the symbols before it.

Defined results: a null, empty or blank text is its end alone; a null document
id is not held out; repeated documents are learned from and scored as often as
they occur; an empty table gives no rows; without training rows every word has
the smoothed share of an unknown one. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanroll.session import scratch_dir

from . import dictionary
from .common import bounded_batches, release_shuffles, remove, returns_memory, staged, staged_at

OTHER, END, FIRST = 0, 1, 2  # symbols: all other words, the end, then frequent words
SMOOTHING = 0.1
DISCOUNT = 0.5

#: A unit's distinct symbols and their counts (64-bit numbers), and each word's place among them.
CODED_SCHEMA = ("doc_ids array<bigint>, null_ids array<boolean>, lengths array<int>, known array<int>, "
                "base array<double>, rest array<double>, symbols binary, counts binary, places binary")
#: Words of the texts that ask together, beyond the document that passes the limit.
UNIT_WORDS = 1_000_000
#: Contexts of so many symbols at most are asked about as their symbols, longer ones as their hashes.
SPELLED = 2
ASKED_SCHEMA = "unit bigint, bucket int, contexts binary, totals binary, sizes binary, followers binary, counts binary, p binary"
#: Rows of the kind ``tree`` are kept contexts, their shares left, and their followers with counts.
TOLD_SCHEMA = "kind string, unit bigint, bucket int, told binary, shares binary, contexts binary, sizes binary, followers binary"


def held_out(doc_id: Column) -> Column:
    """Whether a document is not learned from: crc32 of its id as text leaves remainder 0 modulo 10."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _sequences(lengths: np.ndarray, words: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with an end after each text, and each token's place in its text."""
    sizes = lengths + 1
    ends = np.cumsum(sizes) - 1
    full = np.full(len(words) + len(lengths), end, np.int64)
    inner = np.ones(len(full), bool)
    inner[ends] = False
    full[inner] = words
    return full, np.arange(len(full)) - np.repeat(ends - lengths, sizes)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list, np.ndarray, tuple[np.ndarray, ...]]]:
    for b in batches:
        cols = [b.column(n).to_pylist() for n in ("doc_ids", "null_ids", "lengths", "symbols", "counts", "places")]
        for i, (ids, nulls, lengths, symbols, counts, places) in enumerate(zip(*cols, strict=True)):
            ids = [None if n else x for x, n in zip(ids, nulls, strict=True)]
            yield b, i, ids, np.array(lengths, np.int64), (
                dictionary.unpack_wide(symbols), dictionary.unpack_wide(counts).astype(np.int64), dictionary.unpack_numbers(places))


@dataclass(frozen=True)
class Grown:
    """A tree kept as tables: for each depth what units were told, and the kept contexts (see ``tree_level``)."""

    told: dict[int, DataFrame]
    tree: dict[int, DataFrame]
    walk: Walk


@dataclass(frozen=True)
class Model:
    """A fitted tree with the coded texts it was counted from."""

    coded: DataFrame
    symbols: int
    train_tokens: int
    vocabulary: int
    grown: Grown


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_divergence: float = 0.05, min_count: int = 2) -> Model:
    """Count, choose and smooth the tree of the training documents (those not held out)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    least = max(2, min_count)
    parts = dictionary.split(docs, dictionary.words_lower, id_col, text_col, ~held_out(F.col(id_col)), UNIT_WORDS)

    # all training tokens: words and ends
    each = parts.docs.select(F.explode(F.arrays_zip("doc_ids", "null_ids", "lengths")).alias("d"))
    learned = F.when(F.col("d.null_ids"), F.lit(True)).otherwise(~held_out(F.col("d.doc_ids")))
    n_ends, n_words = each.where(learned).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("d.lengths").cast("bigint")), F.lit(0))).first()
    n_all = n_words + n_ends

    def answer(_bucket: int, words: list[bytes], counts: np.ndarray):
        often = sorted(np.flatnonzero(counts >= least).tolist(), key=lambda i: words[i])
        rank = np.zeros(len(words), np.uint64)
        rank[often] = np.arange(1, len(often) + 1)
        row = {"distinct": int((counts > 0).sum()), "n_often": len(often), "mass": int(counts[often].sum())}
        flat = np.stack([counts.astype(np.uint64), rank], 1).view(np.uint32)  # both as two 32-bit numbers
        return [row], lambda own: (dictionary.pack_numbers(np.full(len(own), 4)), dictionary.pack_numbers(flat[own].ravel()))

    answers, answers_path = staged_at(dictionary.solved(parts, answer, "distinct bigint, n_often bigint, mass bigint"), "counts")
    told = answers.where("chunk < 0").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("distinct", "n_often", "mass")))
    distinct, n_often, often_words = told.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("distinct", "n_often", "mass"))).first()
    vocabulary, symbols = distinct + (n_ends > 0), FIRST + n_often
    # ranks begin at 1 in each bucket: a symbol is the rank after those of the buckets before
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    shifts = staged(told.select("bucket", (F.coalesce(F.sum("n_often").over(before), F.lit(0)) + FIRST - 1).alias("shift")), "shifts")
    mass = n_all + SMOOTHING * (vocabulary + 1)
    rest = max(mass - n_ends - often_words - SMOOTHING * (symbols - 1), SMOOTHING)  # an unseen word keeps its share without training texts, too
    values = answers.where("chunk >= 0").select("chunk", "bucket", "places", "sizes", "values")
    coded = _coded(parts, dictionary.passed_on(parts, _shifted(values, shifts)), n_ends, mass, rest)
    held = F.transform(F.arrays_zip("doc_ids", "null_ids"), lambda d: ~d["null_ids"] & held_out(d["doc_ids"]))
    unit = coded.withColumns({"held": held, "unit": F.monotonically_increasing_id()})
    walk = Walk(depth, least, parts.buckets, n_ends, n_words - often_words, mass, rest)
    coded, _ = dictionary.bucketed(unit, parts.layout.files, "unit")
    for path in (parts.path, answers_path):  # the words are coded: their lists can go
        remove(spark, path)
    del unit, values, answers, told, each
    release_shuffles(spark)
    return Model(coded, symbols, n_all, vocabulary, _grow(coded, walk, parts.layout.files, min_divergence))


def _shifted(values: DataFrame, shifts: DataFrame) -> DataFrame:
    """The answers with symbols for ranks."""
    names = values.columns
    joined = values.join(shifts, "bucket")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for by, packed in zip(b.column("shift").to_pylist(), b.column("values").to_pylist(), strict=True):
                pairs = dictionary.unpack_numbers(packed).copy().view(np.uint64).reshape(-1, 2)
                pairs[:, 1] = np.where(pairs[:, 1] > 0, pairs[:, 1] + np.uint64(by), np.uint64(OTHER))
                made.append(dictionary.pack_numbers(pairs.ravel().view(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()) if n == "values" else b.column(n) for n in names], names)

    return joined.mapInArrow(shift, values.schema)


def _coded(parts: dictionary.Split, answers: DataFrame, n_ends: int, mass: float, rest: float) -> DataFrame:
    """Texts as symbols, with each text's base score, known words, and the shares of its other words within OTHER."""
    log_mass, log_rest = np.log10(mass), np.log10(rest)

    def use(doc_ids: list[int | None], lengths: np.ndarray, places: np.ndarray, _sizes: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
        pairs = np.ascontiguousarray(flat).view(np.uint64).reshape(-1, 2)
        counts, symbol = pairs[:, 0].astype(np.int64), pairs[:, 1]
        own_log = np.log10(counts + SMOOTHING)
        base = own_log - log_mass
        other = np.where(symbol == OTHER, own_log - log_rest, 0.0)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        total = lambda x: _sums(x[places] if len(places) else np.zeros(0), begins, ends)
        end_base = np.log10(n_ends + SMOOTHING) - log_mass
        row = {"doc_ids": [d or 0 for d in doc_ids], "null_ids": [d is None for d in doc_ids], "lengths": lengths.tolist(),
               "known": (total((counts > 0).astype(float)).round().astype(int) + (n_ends > 0)).tolist()}
        b, r = total(base) + end_base, total(other)
        own = symbol[places] if len(places) else np.zeros(0, np.uint64)
        kinds, first, at = np.unique(own, return_index=True, return_inverse=True)
        order = np.argsort(-np.bincount(at, minlength=len(kinds)), kind="stable")  # frequent ones first: small numbers pack better
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        own_counts = counts[places[first[order]]].astype(np.uint64) if len(places) else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array([row["doc_ids"]], pa.list_(pa.int64())), pa.array([row["null_ids"]], pa.list_(pa.bool_())),
             pa.array([row["lengths"]], pa.list_(pa.int32())), pa.array([row["known"]], pa.list_(pa.int32())),
             pa.array([b.tolist()], pa.list_(pa.float64())), pa.array([r.tolist()], pa.list_(pa.float64())), pa.array([dictionary.pack_wide(kinds[order])], pa.binary()),
             pa.array([dictionary.pack_wide(own_counts)], pa.binary()), pa.array([dictionary.pack_numbers(number[at])], pa.binary())],
            ["doc_ids", "null_ids", "lengths", "known", "base", "rest", "symbols", "counts", "places"])

    return dictionary.by_chunk(parts, answers, use, CODED_SCHEMA)


def _sums(x: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of x over each text (pairwise inside a text, so that long texts lose no digits)."""
    return np.array([x[a:b].sum() for a, b in zip(begins, ends, strict=True)])


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes, the first place of each, and each key's number among them.

    Keys are sorted with their places in the lowest bits; runs of keys that agree in all other bits but not
    in these are sorted anew.
    """
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    packed = keys >> bits << bits
    top = packed | np.arange(n, dtype=np.uint64)
    top.sort()
    order = (top & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    found = keys[order]
    new = np.ones(n, bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    begins_run = np.ones(n, bool)
    begins_run[1:] = top[1:] >> bits != top[:-1] >> bits
    mixed = np.flatnonzero(new & ~begins_run)
    if len(mixed):
        run = np.cumsum(begins_run)
        at = np.flatnonzero(np.isin(run, run[mixed]))
        order[at] = order[at][np.lexsort((order[at], keys[order[at]], run[at]))]
        found = keys[order]
        np.not_equal(found[1:], found[:-1], out=new[1:])
    begins = np.flatnonzero(new)
    at = np.empty(n, np.int64)
    at[order] = np.cumsum(new) - 1
    return found[begins], order[begins], at


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit numbers to 64-bit numbers, every bit depending on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Walk:
    """How a unit's tokens go down a grown tree, as far as what was told reaches."""

    depth: int
    least: int
    buckets: int
    n_ends: int
    n_other: int
    mass: float
    rest: float

    @property
    def tasks(self) -> int:
        """Of a shuffle by bucket: a task takes its buckets one after the other."""
        return min(self.buckets, dictionary.MOST_BUCKETS)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        """Ranges of keys."""
        kind = np.uint16 if self.buckets <= 1 << 16 else np.int64  # the former are sorted faster
        return (((keys >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(kind)

    def _contexts(self, full: np.ndarray, reach: np.ndarray, gram: np.ndarray, grams: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the d symbols before tokens, of which ``gram`` (below ``grams``) is a number, with one of the tokens
        after each, and each token's place among them. Only distinct ones are hashed and sorted.

        They are in the order of their buckets, and there in that of their hashes or, if they are spelled in more than one
        symbol, in that of their numbers: those of the same first symbol together, the second ones ascending.
        """
        after = np.full(grams, -1, np.int64)
        after[gram] = reach
        used = np.flatnonzero(after >= 0)
        after = after[used]
        key = _hashed(full[after - e] for e in range(1, d + 1))
        order = np.argsort(self.bucket(key), kind="stable") if 1 < d <= SPELLED else np.argsort(key)
        number = np.empty(grams, np.int64)
        number[used[order]] = np.arange(len(used))
        return key[order], after[order], number[gram]

    def start(self, words: tuple[np.ndarray, ...], lengths: np.ndarray) -> Tokens:
        kinds, counts, at = words
        n = len(kinds)
        count = np.append(np.where(kinds == OTHER, self.n_other, counts), self.n_ends)
        share = np.append(np.where(kinds == OTHER, self.rest, counts + SMOOTHING), self.n_ends + SMOOTHING) / self.mass
        local, place = _sequences(lengths, at, n)
        return Tokens(np.append(kinds, np.uint64(END)), local, place, count[local], share[local])

    def go(self, t: Tokens, train: np.ndarray, told: dict[int, tuple[list[bytes], list[bytes]]]) -> Iterator[dict[str, np.ndarray]]:
        """Changes ``t.p`` to the probabilities of the depths that are told, and yields what is to be asked about the next one.

        ``above`` is the count of the n-gram that ends at a token, of as many symbols as the contexts have.
        """
        n, above = len(t.local), t.count
        full, gram, grams = t.symbols[t.local], t.local, len(t.symbols)  # ``gram`` numbers the n-grams that ``above`` counts
        order = np.argsort(t.symbols)  # followers of a context ascend: their differences pack well
        by_symbol, rank = t.symbols[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        for d in range(1, self.depth + 1):
            total = np.zeros(n, np.int64)
            total[1:] = above[:-1]  # a context is the n-gram that ends before the token
            reach = np.flatnonzero((t.place >= d) & (total >= self.least))
            contexts, tokens, at = self._contexts(full, reach, gram[reach - 1], grams, d)
            some = np.arange(len(reach)) if d == 1 else np.flatnonzero(above[reach] >= 2)
            rows = reach[some]
            context, follower, pair = _pairs(at[some], rank[t.local[rows]], len(contexts), len(t.symbols))
            if d not in told:
                one = np.zeros(len(context), np.int64)
                one[pair] = rows  # any token of each pair: what its suffix makes of it is the same everywhere
                spelled = np.stack([full[tokens - e] for e in range(d, 0, -1)], 1) if d <= SPELLED else np.zeros((len(contexts), 0), np.uint64)
                yield {"contexts": contexts, "spelled": spelled, "totals": total[tokens].astype(np.uint64), "sizes": np.bincount(context, minlength=len(contexts)),
                       "followers": by_symbol[follower], "counts": np.bincount(pair[train[rows]], minlength=len(context)).astype(np.uint64),
                       "p": t.p[one].astype(np.float32)}
                return
            counts, shares = (np.concatenate([f(x) for x in parts]) if parts else np.zeros(0, np.uint32)
                              for f, parts in zip((dictionary.unpack_wide, dictionary.unpack_numbers), told[d], strict=True))
            above = np.zeros(n, np.int64)
            above[rows] = counts.astype(np.int64)[pair]
            gram, grams = np.zeros(n, np.int64), len(context)
            gram[rows] = pair
            free = shares.view(np.float32)[at].astype(float)
            kept = ~np.isnan(free)
            r = reach[kept]
            t.p[r] = np.where(above[r] > 0, (above[r] - DISCOUNT) / total[r], 0) + free[kept] * t.p[r]


@dataclass
class Tokens:
    """A unit's tokens: their symbols (``symbols[local]``), places in their texts, training counts and probabilities so far."""

    symbols: np.ndarray
    local: np.ndarray
    place: np.ndarray
    count: np.ndarray
    p: np.ndarray


def _hashed(symbols: Iterable[np.ndarray]) -> np.ndarray:
    """Hashes of contexts, from their symbols, the last one first."""
    key = np.uint64(0)
    for x in symbols:
        key = _mix(key + (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return key


def _pairs(context: np.ndarray, follower: np.ndarray, n_contexts: int, n_followers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of their contexts, and each row's pair. Sorted as one number with the row where it fits."""
    n = len(context)
    bits = [max(1, int(x).bit_length()) for x in (n_contexts, n_followers, n)]
    if not n:
        return (np.zeros(0, np.int64),) * 3
    if sum(bits) <= 64:
        one = (context.astype(np.uint64) << np.uint64(bits[1] + bits[2])) | (follower.astype(np.uint64) << np.uint64(bits[2])) | np.arange(n, dtype=np.uint64)
        one.sort()
        order = (one & np.uint64((1 << bits[2]) - 1)).astype(np.int64)
    else:
        order = np.lexsort((follower, context))
    c, f = context[order], follower[order]
    new = np.ones(n, bool)
    new[1:] = (c[1:] != c[:-1]) | (f[1:] != f[:-1])
    pair = np.empty(n, np.int64)
    pair[order] = np.cumsum(new) - 1
    return c[new], f[new], pair


def _walked(coded: DataFrame, told: dict[int, DataFrame], use, schema: str) -> DataFrame:
    """``use(batch, row, ids, lengths, words, told)`` for each unit, with what it was told about each depth."""
    rows, depths = coded, sorted(told)
    for d in depths:  # rows per unit and bucket, bounded by its words; all tables lie in files by unit
        parts = told[d].groupBy("unit").agg(F.collect_list(F.struct("bucket", "told", "shares")).alias(f"got{d}"))
        rows = rows.join(parts, "unit", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, ids, lengths, words in _decoded(x.slice(k, 1) for x in batches for k in range(x.num_rows)):
            by: dict[int, tuple[list[bytes], list[bytes]]] = {}
            for d in depths:
                got = sorted(b.column(f"got{d}")[i].as_py() or [], key=lambda g: g["bucket"])
                by[d] = [g["told"] for g in got], [g["shares"] for g in got]
            yield from use(b, i, ids, lengths, words, by)

    return rows.mapInArrow(returns_memory(run), schema)


def _grow(coded: DataFrame, walk: Walk, files: int, min_divergence: float) -> Grown:
    """Ask and tell depth by depth. What is told is written in files by unit, as the texts are, so that it is dealt once."""
    spark, told, tree = coded.sparkSession, {}, {}

    def ask(b, i, ids, lengths, words, got) -> Iterator[pa.RecordBatch]:
        unit = b.column("unit")[i].as_py()
        train = np.repeat(~np.array(b.column("held").to_pylist()[i], bool), lengths + 1)
        for made in walk.go(walk.start(words, lengths), train, got):
            bucket = walk.bucket(made["contexts"])
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            ends = np.cumsum(made["sizes"])
            inner = ends[cuts - 1] if len(cuts) else cuts
            parts = {c: np.split(made[c], cuts if c in ("contexts", "spelled", "totals", "sizes") else inner) for c in made}
            for k, contexts in enumerate(parts["contexts"]):
                if len(contexts):
                    yield _row(ASKED_SCHEMA, unit=unit, bucket=int(walk.bucket(contexts[:1])[0]),
                               contexts=pack_contexts(contexts, parts["spelled"][k]), totals=dictionary.pack_wide(parts["totals"][k]),
                               sizes=dictionary.pack_numbers(parts["sizes"][k]), followers=pack_ascending(parts["followers"][k], parts["sizes"][k]),
                               counts=dictionary.pack_wide(parts["counts"][k]), p=dictionary.pack_numbers(parts["p"][k].view(np.uint32)))

    for d in range(1, walk.depth + 1):
        asked = _walked(coded, told, ask, ASKED_SCHEMA).repartition(walk.tasks, "bucket").sortWithinPartitions("bucket", "unit")
        decided = asked.select("bucket", *(c for c in asked.columns if c != "bucket")).mapInArrow(
            dictionary._in_turn(1, _decided(d, min_divergence)), TOLD_SCHEMA)
        path = scratch_dir(spark, "decided")
        decided.write.option("compression", "zstd").partitionBy("kind").parquet(path)
        del asked, decided
        release_shuffles(spark)  # the questions, before the answers are dealt
        rows = spark.read.schema(TOLD_SCHEMA).parquet(path)
        answers = rows.where("kind = 'told'").select("unit", "bucket", "told", "shares")
        told = told | {d: dictionary.bucketed(answers.repartition(files, "unit"), files, "unit")[0]}
        tree[d] = rows.where("kind = 'tree'").select("contexts", "sizes", "shares", "followers", "told")
        del answers
        remove(spark, f"{path}/kind=told")
        release_shuffles(spark)
    return Grown(told, tree, walk)


def pack_ascending(x: np.ndarray, sizes: np.ndarray) -> bytes:
    """64-bit numbers that ascend inside runs of the given sizes, as differences."""
    d = np.diff(x, prepend=np.uint64(0))
    begins = (np.cumsum(sizes) - sizes)[sizes > 0]
    d[begins] = x[begins]
    return dictionary.pack_wide(d)


def unpack_ascending(packed: bytes, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(dictionary.unpack_wide(packed), dtype=np.uint64)  # may wrap around: differences of it don't
    begins = (np.cumsum(sizes) - sizes)[sizes > 0]
    before = np.where(begins > 0, total[begins - 1], np.uint64(0)) if len(begins) else begins.astype(np.uint64)
    return total - np.repeat(before, sizes[sizes > 0])


def pack_contexts(keys: np.ndarray, spelled: np.ndarray) -> bytes:
    """Contexts of one bucket as their symbols, one row each, or, where these are left out, as ascending hashes.

    A first symbol that is that of the context before is 0 (others are one more), and a second one a difference then.
    """
    if not spelled.shape[1]:
        return dictionary.pack_wide(np.diff(keys, prepend=np.uint64(0)))
    first = spelled[:, 0]
    new = np.ones(len(first), bool)
    new[1:] = first[1:] != first[:-1]
    later = [np.where(new, x, np.diff(x, prepend=np.uint64(0))) for x in spelled.T[1:]]
    return dictionary.pack_wide(np.concatenate([np.where(new, first + np.uint64(1), np.uint64(0)), *later]))


def unpack_contexts(packed: bytes, depth: int) -> np.ndarray:
    """The hashes of contexts of ``depth`` symbols."""
    if depth > SPELLED:
        return np.cumsum(dictionary.unpack_wide(packed), dtype=np.uint64)
    first, *later = dictionary.unpack_wide(packed).reshape(depth, -1)
    begins = np.flatnonzero(first)
    sizes = np.diff(np.append(begins, len(first)))
    columns = [np.repeat(first[begins] - np.uint64(1), sizes)]
    for x in later:
        total = np.cumsum(x, dtype=np.uint64)  # may wrap around: differences of it don't
        columns.append(total - np.repeat(total[begins] - x[begins], sizes))
    return _hashed(reversed(columns))


def _row(schema: str, **values) -> pa.RecordBatch:
    return dictionary._record(schema, [values])


def _decided(depth: int, min_divergence: float):
    """For the units' questions about contexts of one length and bucket: the answers, and the part of the tree that its contexts are."""
    def solve(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        bucket, = key
        units = [r[0] for r in rows]
        contexts = [unpack_contexts(r[1], depth) for r in rows]
        each = [dictionary.unpack_numbers(r[3]).astype(np.int64) for r in rows]
        sizes = np.concatenate(each)
        follower = np.concatenate([unpack_ascending(r[4], own) for r, own in zip(rows, each, strict=True)])
        counts = np.concatenate([dictionary.unpack_wide(r[5]) for r in rows])
        p = np.concatenate([dictionary.unpack_numbers(r[6]) for r in rows]).view(np.float32)
        every = np.concatenate(contexts)
        known, one, at = distinct(every)
        total = np.concatenate([dictionary.unpack_wide(r[2]) for r in rows])[one].astype(float)
        entry = np.repeat(np.arange(len(every)), sizes)
        _, first, pair = distinct(_mix(every[entry] ^ _mix(follower + np.uint64(1 << 40))))
        n = _summed(pair, counts.astype(np.int64), len(first))
        n[n < 2] = 0
        listed = np.flatnonzero(n > 0)
        of, q = at[entry[first[listed]]], p[first[listed]].astype(float)
        summed = lambda x: np.bincount(of, x, len(known))
        explicit = (n[listed].astype(float) - DISCOUNT) / total[of]
        free = np.maximum(1 - summed(explicit), 1e-30)
        here = explicit + free[of] * q
        # followers that are not listed have the free share of the suffix's probability, so they add (rest) log2(free)
        divergence = summed(here * np.log2(here / q)) + free * np.maximum(1 - summed(q), 0) * np.log2(free)
        kept = (np.bincount(of, minlength=len(known)) > 0) & (divergence >= min_divergence)
        shares = np.where(kept, free, np.nan).astype(np.float32)
        out, at_first = n[pair], 0
        ends = np.cumsum(sizes)
        for unit, own in zip(units, contexts, strict=True):
            last = at_first + len(own)
            a, b = (ends[at_first - 1] if at_first else 0), ends[last - 1]
            yield _row(TOLD_SCHEMA, kind="told", unit=unit, bucket=bucket, told=dictionary.pack_wide(out[a:b]),
                       shares=dictionary.pack_numbers(shares[at[at_first:last]].view(np.uint32)))
            at_first = last
        in_tree = kept[of]
        by = listed[in_tree][np.argsort(of[in_tree], kind="stable")]
        yield _row(TOLD_SCHEMA, kind="tree", bucket=bucket, contexts=dictionary.pack_wide(np.diff(known[kept], prepend=np.uint64(0))),
                   shares=dictionary.pack_numbers(shares[kept].view(np.uint32)), sizes=dictionary.pack_numbers(np.bincount(of, minlength=len(known))[kept]),
                   followers=dictionary.pack_wide(follower[first[by]]), told=dictionary.pack_wide(n[by]))

    return solve


def _summed(at: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit counts by number, exact: doubles hold sums of the lower and of the upper 32 bits."""
    low = np.bincount(at, counts & 0xFFFFFFFF, n).astype(np.uint64)
    high = np.bincount(at, counts >> 32, n).astype(np.uint64)
    return low + (high << np.uint64(32))


def tree_level(grown: Grown, depth: int) -> DataFrame:
    """(context, free, follower, n) of the kept contexts of one depth, by hash and symbol."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                contexts = np.cumsum(dictionary.unpack_wide(row["contexts"]), dtype=np.uint64).view(np.int64)
                sizes, free = dictionary.unpack_numbers(row["sizes"]), dictionary.unpack_numbers(row["shares"]).view(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(contexts, sizes)), pa.array(np.repeat(free, sizes)), pa.array(dictionary.unpack_wide(row["followers"]).astype(np.int64)),
                     pa.array(dictionary.unpack_wide(row["told"]).astype(np.int64))], ["context", "free", "follower", "n"])

    return grown.tree[depth].mapInArrow(run, "context bigint, free float, follower bigint, n bigint")


def score(model: Model) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = model.coded.sparkSession
    bounded_batches(spark)
    schema = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"

    def scored(b: pa.RecordBatch, i: int, ids: list, lengths: np.ndarray, logs: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(lengths + 1)
        scores = _sums(logs, ends - lengths - 1, ends) + np.array(b.column("rest")[i].as_py())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(lengths + 1), pa.array(b.column("known")[i].as_py(), pa.int64()),
             pa.array(b.column("base")[i].as_py(), pa.float64()), pa.array(scores)],
            ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    walk = model.grown.walk

    def use(b, i, ids, lengths, words, got) -> Iterator[pa.RecordBatch]:
        tokens = walk.start(words, lengths)
        if list(walk.go(tokens, np.zeros(len(tokens.p), bool), got)):
            raise ValueError("the tree is not told in full")
        yield scored(b, i, ids, lengths, np.log10(tokens.p))

    return _with_totals(_walked(model.coded, model.grown.told, use, schema), model)


def _with_totals(rows: DataFrame, model: Model) -> DataFrame:
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                       F.lit(model.train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
