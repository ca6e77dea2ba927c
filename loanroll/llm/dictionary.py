"""The distinct-word table of a corpus, and its values brought back to every word by position.

1. ``split``: each task cuts its documents into words and writes, per chunk of
   documents, the words' places in the chunk's own list of distinct words (a
   ``docs`` row) and that list, dealt into buckets by the words' hash
   (``words`` rows). The table is written once to the shared folder, bucketed
   by chunk, so that the documents need no shuffle later.
2. ``by_word``: the lists of one bucket meet in one task, which sees each
   distinct word of the corpus once, with its total count, and answers every
   chunk in the order of its list.
3. ``by_chunk``: a chunk's row and its answers are joined; values are put in
   place by position.

A word that is frequent everywhere is one entry per chunk, so no key is hot;
a chunk is bounded by words and distinct words, a bucket by the number of
buckets, which follows the measured size of the texts.

A chunk's list is dealt into ``GROUP_BUCKETS`` buckets at most, however large
the corpus is: beyond ``GROUP_BYTES`` of text the chunks form groups, the lists
of a group's chunks are merged bucket by bucket, and only the merged lists,
which are as much longer, are dealt into the many buckets that the whole corpus
needs (``by_word`` does both steps, and the way back). So no row ever holds
less than some dozen words, and no task more than a bucket of one group.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanroll.session import scratch_dir

from .common import bounded_batches, ranges, returns_memory, staged, texts_as_bytes

#: Bytes of text whose distinct words are numbered together.
GATHERED = 8 << 20
#: Words of a chunk at most, beyond the document that passes the limit, and distinct words, beyond the texts numbered together.
CHUNK_WORDS, CHUNK_DISTINCT = 4_000_000, 500_000
#: Bytes of text per bucket of the written table.
CHUNK_BYTES = 16 << 20
#: Bytes of text per bucket of the word table.
BUCKET_BYTES = 32 << 20
#: Bytes of text per group of chunks, and the buckets of its word lists at most.
GROUP_BYTES, GROUP_BUCKETS = 16 << 30, 520
#: Buckets of a written table, and tasks of a shuffle, at most (Spark allows 100,000 buckets).
MOST_BUCKETS = 65_536
_SLICE_WORDS = 250_000
DATABASE = "loanroll_scratch"

SPLIT_SCHEMA = ("kind string, chunk bigint, bucket int, doc_ids array<bigint>, null_ids array<boolean>, "
                "lengths array<int>, docs array<int>, slices array<binary>, places binary, words binary, counts binary")
ANSWER_SCHEMA = "chunk bigint, bucket int, places binary, sizes binary, values binary"


def pack(x: np.ndarray | bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def unpack(b: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(b)
    return raw if kind is None else np.frombuffer(raw, kind)


def pack_numbers(x: np.ndarray) -> bytes:
    """32-bit numbers, their bytes of equal weight together: most high bytes are zero."""
    return pack(np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T))


def unpack_numbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def pack_wide(x: np.ndarray) -> bytes:
    """64-bit numbers, their bytes of equal weight together."""
    x = np.ascontiguousarray(x).view(np.uint64)
    planes, size = np.zeros((8, len(x)), np.uint8), int(x.max()).bit_length() if len(x) else 0
    for k in range(-(-size // 8)):  # the others are zero
        planes[k] = x.view(np.uint8)[k::8]
    return pack(planes)


def unpack_wide(b: bytes) -> np.ndarray:
    planes = unpack(b, np.uint8).reshape(8, -1)
    x = planes[0].astype(np.uint64)
    for k in range(1, 8):
        if planes[k].any():
            x |= planes[k].astype(np.uint64) << np.uint64(8 * k)
    return x


class _Numbered(dict):
    """Numbers words in the order in which they are first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _strings(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts.cast(pa.large_string()), "")


def words_as_is(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words between ASCII white space: their number in each text (a null counts as the empty text), and all of them."""
    words = pc.ascii_split_whitespace(_strings(texts))
    lengths, flat = pc.list_value_length(words).to_numpy().astype(np.int64), words.flatten()
    empty = pc.equal(flat, "")  # white space at the edges of a text
    ends = np.cumsum(lengths)
    dropped = np.concatenate([[0], np.cumsum(empty.to_numpy(zero_copy_only=False))])
    return lengths - (dropped[ends] - dropped[ends - lengths]), flat.filter(pc.invert(empty))


def words_lower(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words between ASCII white space, A-Z lower-cased."""
    return words_as_is(pc.ascii_lower(_strings(texts)))


def words_by(cut: Callable[[bytes], list[bytes]]) -> Words:
    """The words of texts that ``cut`` makes of each one's bytes."""
    def to_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        words = [cut(t) for t in texts_as_bytes(texts)]
        return np.fromiter(map(len, words), np.int64, len(words)), list(chain.from_iterable(words))
    return to_words


Words = Callable[[pa.Array], tuple[np.ndarray, pa.Array | list[bytes]]]


def _record(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(),
             "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
             "array<boolean>": pa.list_(pa.bool_()), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


@dataclass
class _Chunk:
    number: int
    slice_words: int = _SLICE_WORDS
    words: _Numbered = field(default_factory=_Numbered)
    n: int = 0
    ids: list[int | None] = field(default_factory=list)
    counted: list[bool] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    places: list[np.ndarray] = field(default_factory=list)

    def add(self, ids: list[int | None], counted: list[bool], lengths: list[int], words: pa.Array | list[bytes]) -> None:
        """Texts and all their words. An Arrow column is numbered by its distinct words."""
        if isinstance(words, list):
            places = np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words))
        else:
            found = words.dictionary_encode()
            own = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
            places = np.fromiter(map(self.words.__getitem__, own), np.uint32, len(own))[found.indices.to_numpy()]
        self.ids += ids
        self.counted += counted
        self.lengths += lengths
        self.places.append(places)
        self.n += len(places)

    def rows(self, buckets: int) -> Iterator[dict]:
        """The chunk's documents, and its words by bucket. Words are numbered anew by frequency: small numbers pack better."""
        lengths, places = self.lengths, np.concatenate(self.places)
        words, self.words, self.places = list(self.words), _Numbered(), []  # what is done with is let go
        order = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        yield self._documents(lengths, number[places])
        counts = np.bincount(places[np.repeat(np.array(self.counted, bool), lengths)], minlength=len(words))
        del places
        bucket = (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets)[order]
        by = np.argsort(bucket, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
            if len(own):
                yield {"kind": "words", "chunk": self.number, "bucket": int(bucket[own[0]]), "places": pack_numbers(np.diff(own, prepend=0)),
                       "words": pack(b"\n".join(words[i] for i in order[own].tolist()), 6), "counts": pack_wide(counts[order[own]].astype(np.uint64))}

    def _documents(self, lengths: list[int], places: np.ndarray) -> dict:
        """The documents' row, the places in slices of about ``slice_words`` words."""
        ids = self.ids
        slices, docs, first, size, at = [], [], 0, 0, 0
        for i, n in enumerate(lengths, 1):
            size += n
            if size >= self.slice_words or i == len(lengths):
                slices.append(pack_numbers(places[at:at + size]))
                docs.append(i - first)
                first, at, size = i, at + size, 0
        return {"kind": "docs", "chunk": self.number, "bucket": -1, "doc_ids": [d or 0 for d in ids],
                "null_ids": [d is None for d in ids], "lengths": lengths, "docs": docs, "slices": slices}


@dataclass(frozen=True)
class Layout:
    """How the words of a corpus are dealt: follows its bytes alone."""

    groups: int
    buckets: int
    files: int

    @staticmethod
    def of(size: int) -> Layout:
        groups = max(1, -(-size // GROUP_BYTES))
        buckets = size // BUCKET_BYTES + 8 if groups == 1 else GROUP_BUCKETS
        return Layout(groups, min(buckets, GROUP_BUCKETS), min(size // CHUNK_BYTES + 8, MOST_BUCKETS))

    @property
    def all_buckets(self) -> int:
        """Buckets of the whole corpus: each group bucket is cut into as many as there are groups."""
        return self.buckets * self.groups


@dataclass(frozen=True)
class Split:
    docs: DataFrame
    words: DataFrame
    layout: Layout
    path: str

    @property
    def buckets(self) -> int:
        return self.layout.all_buckets


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Neighbouring batches together, up to GATHERED bytes and the batch that passes them."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= GATHERED:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def split(docs: DataFrame, to_words: Words, id_col: str = "doc_id", text_col: str = "text",
          counted=None, slice_words: int = _SLICE_WORDS) -> Split:
    """Write chunks of word places and their word lists; ``counted`` (a condition) says whose words are counted."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    layout = Layout.of(size)
    buckets = layout.buckets
    mark = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), mark.alias("counted"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(TaskContext.get().partitionId() << 32, slice_words)
        for b in _gathered(batches):
            ids, on = b.column("doc_id").to_pylist(), b.column("counted").to_pylist()
            lengths, words = to_words(b.column("text").combine_chunks())
            ends, first = np.cumsum(lengths), 0
            while first < len(ids):  # up to the document that passes the limit of words
                before = int(ends[first] - lengths[first])
                last = min(int(np.searchsorted(ends, before + CHUNK_WORDS - chunk.n)) + 1, len(ids))
                chunk.add(ids[first:last], on[first:last], lengths[first:last].tolist(), words[before:int(ends[last - 1])])
                first = last
                if chunk.n >= CHUNK_WORDS or len(chunk.words) >= CHUNK_DISTINCT:
                    yield from (_record(SPLIT_SCHEMA, [r]) for r in chunk.rows(buckets))
                    chunk = _Chunk(chunk.number + 1, slice_words)
        if chunk.ids:
            yield from (_record(SPLIT_SCHEMA, [r]) for r in chunk.rows(buckets))

    table, path = bucketed(rows.mapInArrow(returns_memory(run), SPLIT_SCHEMA), layout.files)
    return Split(table.where("kind = 'docs'"), table.where("kind = 'words'"), layout, path)


def bucketed(df: DataFrame, buckets: int, key: str = "chunk") -> tuple[DataFrame, str]:
    """Written to the shared scratch folder in files by ``key``, with that folder.

    Spark keeps what it knows of the files' buckets in its catalog, in a
    database of this module's own; the entry is dropped once the table is
    opened, the files stay.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "words")
    base = path.rsplit("/", 1)[0].replace("'", "\\'")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{base}/database'")  # nothing is stored in it
    name = f"{DATABASE}.words_" + path.rsplit("-", 1)[1]
    writer = df.write.format("parquet").option("path", path).option("compression", "uncompressed")  # rows are packed already
    writer.bucketBy(buckets, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table, path


def _in_turn(key: int, solve: Callable[[tuple, list[tuple]], Iterator[pa.RecordBatch]]) -> Callable:
    """``solve(key, rows)`` for each run of rows with the same first ``key`` columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if rows and row[:key] != now:
                    yield from solve(now, rows)
                    rows = []
                now = row[:key]
                rows.append(row[key:])
        if rows:
            yield from solve(now, rows)
    return returns_memory(run)


def _merged(packed: list[tuple[bytes, bytes]]) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """Distinct words of several lists, their total counts, and each list as numbers of the distinct words."""
    numbers = _Numbered()
    lists = [np.fromiter(map(numbers.__getitem__, unpack(words).split(b"\n")), np.int64) for words, _ in packed]
    counts = np.zeros(len(numbers), np.int64)
    for own, (_, n) in zip(lists, packed, strict=True):
        counts[own] += unpack_wide(n).astype(np.int64)
    return list(numbers), counts, lists


Answer = Callable[[int, list[bytes], np.ndarray], tuple[list[dict], Callable]]


def by_word(parts: Split, answer: Answer) -> DataFrame:
    """Answers to every chunk."""
    return passed_on(parts, solved(parts, answer))


def solved(parts: Split, answer: Answer, extra_schema: str = "") -> DataFrame:
    """Answers to every list. ``answer(bucket, words, counts)`` gets each distinct word of a bucket once and returns
    further rows (columns of ``extra_schema``, ``chunk`` being -1) and a function from word numbers to (sizes, values) as bytes."""
    schema = ANSWER_SCHEMA + (", " + extra_schema if extra_schema else "")

    def solve(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        bucket, = key
        words, counts, lists = _merged([(words, n) for _, _, words, n in rows])
        extra, values_of = answer(bucket, words, counts)
        if extra:
            yield _record(schema, [{"chunk": -1, "bucket": bucket} | r for r in extra])
        for own, (chunk, places, _, _) in zip(lists, rows, strict=True):
            sizes, values = values_of(own)
            yield _record(schema, [{"chunk": chunk, "bucket": bucket, "places": places, "sizes": sizes, "values": values}])

    layout, words = parts.layout, parts.words.select("bucket", "chunk", "places", "words", "counts")
    if layout.groups == 1:
        dealt = words.repartition(layout.buckets, "bucket")
        return dealt.sortWithinPartitions("bucket", "chunk").mapInArrow(_in_turn(1, solve), schema)
    merged = staged(_dealt_merged(_in_groups(parts), layout), "merged-words")
    dealt = merged.select("bucket", "chunk", "places", "words", "counts").repartition(min(layout.all_buckets, MOST_BUCKETS), "bucket")
    return dealt.sortWithinPartitions("bucket", "chunk").mapInArrow(_in_turn(1, solve), schema)


def passed_on(parts: Split, answers: DataFrame) -> DataFrame:
    """The answers to chunks, from those to lists: they are the same where no lists were merged."""
    answers = answers.where("chunk >= 0").select(*(f.split(" ")[0] for f in ANSWER_SCHEMA.split(", ")))
    if parts.layout.groups == 1:
        return answers
    return _answered(_in_groups(parts), staged(answers, "merged-answers"), parts.layout)


def _in_groups(parts: Split) -> DataFrame:
    words = parts.words.select("bucket", "chunk", "places", "words", "counts")
    return words.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(parts.layout.groups)))


def _list_id(group: int, bucket: int, layout: Layout) -> int:
    return group * layout.buckets + bucket


def _dealt_merged(in_groups: DataFrame, layout: Layout) -> DataFrame:
    """One list per group and bucket, dealt into the corpus' buckets; rows as those of chunks, ``chunk`` being the list's id."""
    schema = "chunk bigint, bucket int, places binary, words binary, counts binary"

    def merge(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        group, bucket = key
        words, counts, _ = _merged([(words, n) for _, _, words, n in rows])
        fine = (np.fromiter(map(zlib.adler32, words), np.uint32, len(words)) ^ np.fromiter(map(len, words), np.uint32, len(words)) * np.uint32(2654435761)) % layout.groups
        by = np.argsort(fine, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(fine[by])) + 1):
            yield _record(schema, [{"chunk": _list_id(group, bucket, layout), "bucket": bucket * layout.groups + int(fine[own[0]]),
                                    "places": pack_numbers(np.diff(own, prepend=0)), "words": pack(b"\n".join(words[i] for i in own.tolist()), 6),
                                    "counts": pack_wide(counts[own].astype(np.uint64))}])

    rows = in_groups.select("group", "bucket", "chunk", "places", "words", "counts")
    dealt = rows.repartition(min(layout.all_buckets, MOST_BUCKETS), "group", "bucket").sortWithinPartitions("group", "bucket", "chunk")
    return dealt.mapInArrow(_in_turn(2, merge), schema)


def _answered(in_groups: DataFrame, answers: DataFrame, layout: Layout) -> DataFrame:
    """The answers to the merged lists, passed on to the chunks that the lists were merged from."""
    def pass_on(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        group, bucket = key
        chunks = [r for r in rows if r[0] is not None]
        sizes, flat = assembled([{"places": p, "sizes": s, "values": v} for chunk, p, _, _, s, v in rows if chunk is None])
        _, _, lists = _merged([(words, n) for _, _, words, n, _, _ in chunks])  # the order of the merged list
        begins = np.cumsum(sizes.astype(np.int64)) - sizes
        for own, (chunk, places, *_) in zip(lists, chunks, strict=True):
            yield _record(ANSWER_SCHEMA, [{"chunk": chunk, "bucket": bucket, "places": places, "sizes": pack_numbers(sizes[own]),
                                           "values": pack_numbers(flat[ranges(begins[own], sizes[own])])}])

    asked = in_groups.select("group", "bucket", "chunk", "places", "words", "counts", *(F.lit(None).cast("binary").alias(c) for c in ("sizes", "values")))
    told = answers.select(
        F.expr(f"chunk div {layout.buckets}").alias("group"), F.expr(f"cast(chunk % {layout.buckets} as int)").alias("bucket"),
        F.lit(None).cast("bigint").alias("chunk"), "places", *(F.lit(None).cast("binary").alias(c) for c in ("words", "counts")), "sizes", "values")
    dealt = asked.unionByName(told).repartition(min(layout.all_buckets, MOST_BUCKETS), "group", "bucket")
    return dealt.sortWithinPartitions("group", "bucket", F.col("chunk").asc_nulls_first()).mapInArrow(_in_turn(2, pass_on), ANSWER_SCHEMA)


def assembled(got: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a whole list, from the buckets' answers."""
    if not got:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    place = np.concatenate([np.cumsum(unpack_numbers(g["places"]).astype(np.int64)) for g in got])
    sizes = np.concatenate([unpack_numbers(g["sizes"]) for g in got])
    flat = np.concatenate([unpack_numbers(g["values"]) for g in got])
    order = np.argsort(place, kind="stable")
    begins = np.cumsum(sizes.astype(np.int64)) - sizes
    return sizes[order], flat[ranges(begins[order], sizes[order])]


def by_chunk(parts: Split, answers: DataFrame, use: Callable[[list[int | None], np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch],
             schema: str) -> DataFrame:
    """``use(doc_ids, lengths, places, sizes, values)`` for each slice of documents. The last two hold, for the chunk's
    whole word list, the answers in order of place: sizes and the joined values (32-bit numbers, packed by ``pack_numbers``)."""
    bounded_batches(parts.docs.sparkSession)
    answer = F.collect_list(F.struct("places", "sizes", "values")).alias("answers")  # one row per bucket that the chunk's words lie in
    answers = answers.where("chunk >= 0").groupBy("chunk").agg(answer)
    rows = parts.docs.select("chunk", "doc_ids", "null_ids", "lengths", "docs", "slices").join(answers, "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ready, first = assembled(row["answers"] or []), 0
                for n, packed in zip(row["docs"], row["slices"], strict=True):
                    own = slice(first, first + n)
                    doc_ids = [None if null else x for x, null in zip(row["doc_ids"][own], row["null_ids"][own], strict=True)]
                    yield use(doc_ids, np.array(row["lengths"][own], np.int64), unpack_numbers(packed), *ready)
                    first += n

    return rows.mapInArrow(returns_memory(run), schema)
