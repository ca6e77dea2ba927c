"""Token-id files: ORC with run-length coded ids, row indexes and Bloom filters on the document id.

``write_token_files`` range-partitions documents by id, encodes each whole text
and writes one ORC file per range. ORC stores the id lists as integer
run-length streams, keeps statistics per stripe and per ``row_index_stride``
rows, and a Bloom filter on ``doc_id``; Spark splits the files by stripes when
it reads them, and a filter on ``doc_id`` is pushed to those indexes.

Defined results: a null or empty text is the end id alone; a null document id
is kept and sorts first; rows with equal ids are all kept, in the order of
their texts' hash; an empty table gives an empty readable folder. Columns of
the input other than id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, list_column, list_slices, load_tokenizer, ranges, returns_memory, staged, tokenizer_source
from .dictionary import _Numbered

FILE_SCHEMA = "doc_id bigint, row bigint, ids array<int>"

#: Unicode White_Space, as the tokenizer's pattern has it. Fixed values.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RE2_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The pre-tokenizer's pattern never joins characters across these pieces, so their ids can be joined.
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A cut before a space falls between pieces, unless the space stands inside a run of white space.
INNER_SPACE = f"[{_RE2_SPACE}] (?:[{_RE2_SPACE}]|\\z)"
#: Characters on which ``PRE_TOKENS`` is the pre-tokenizer's own pattern: ASCII, and Latin, Greek and Cyrillic letters that
#: every version of Unicode in use calls letters. Fixed values.
_LETTERS = (("A", "Z"), ("a", "z"), ("\xc0", "\xd6"), ("\xd8", "\xf6"), ("\xf8", "\u024f"), ("\u0391", "\u03a1"), ("\u03a3", "\u03ce"), ("\u0400", "\u0481"))
LETTER = "".join(f"{a}-{b}" for a, b in _LETTERS)
_BLANK, _SIGN = "\t\n\r ", r"!-/:-@\[-`{-~"
_RE2_PLAIN = rf"^[{_BLANK}0-9{_SIGN}{LETTER}]*\z"
#: What the pre-tokenizer makes of plain pieces that end with a zero character each.
PRE_TOKENS = re.compile(rf" ?[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[{_SIGN}]+|\0|[{_BLANK}]+(?![^{_BLANK}\0])|[{_BLANK}]+")
#: Pre-tokens (and pieces that are not plain) that a worker remembers, beyond those of the texts that pass the limit.
REMEMBERED = 500_000
#: Bytes of text whose distinct pieces are looked up together.
GATHERED = 16 << 20


class PieceIds:
    """Ids of whole texts. Each distinct piece between spaces is cut into pre-tokens, each distinct pre-token is encoded
    by the library's model once while it is remembered. Pieces with characters beyond the plain ones, and all pieces of
    files with another pre-tokenizer, are encoded by the library as they are."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = tokenizer
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        cut = tokenizer.pre_tokenizer
        self.cuts_plainly = tokenizer.normalizer is None and isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space
        # bytes as the library writes them
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        plain = [*map(chr, range(128)), *(chr(c) for a, b in _LETTERS[2:] for c in range(ord(a), ord(b) + 1))]
        self.spelled = {ord(c): spell(c)[0][0] for c in plain}
        self._forget()

    def _forget(self) -> None:
        """Number 0 is the end of a piece, which has no ids."""
        self.numbers = _Numbered()
        self.numbers["\0"] = 0
        self.sizes, self.begins, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _library_s(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _numbered(self, found: list[str], encode: Callable[[list[str]], list[list[int]]]) -> np.ndarray:
        """Each one's number; ``encode`` gives the ids of those not seen before."""
        before = len(self.numbers)
        at = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        new = list(islice(self.numbers, before, None))
        if new:
            ids = encode(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        return at

    def _by_model(self, pre_tokens: list[str]) -> list[list[int]]:
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(x)] for x in "\0".join(pre_tokens).translate(self.spelled).split(self.spelled[0])]

    def _by_library(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([x[2:] for x in pieces], add_special_tokens=False)]

    def _of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and joined ids of pieces."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        if self.cuts_plainly:
            plain = pc.match_substring_regex(pieces, _RE2_PLAIN)
        else:
            plain = pa.array(np.zeros(len(pieces), bool))
        n = pc.sum(plain, min_count=0).as_py()
        pre = self._numbered(PRE_TOKENS.findall("\0".join([*_strings(pieces.filter(plain)), ""])), self._by_model) if n else np.zeros(0, np.int64)
        if n == len(pieces):
            at = pre
        else:  # the others are one number each, in their places; marked, as one may be the zero character
            others = self._numbered(["\0\0" + x for x in _strings(pieces.filter(pc.invert(plain)))], self._by_library)
            ends = np.flatnonzero(pre == 0)
            counts = np.full(len(pieces), 2)
            counts[plain.to_numpy(zero_copy_only=False)] = np.diff(ends, prepend=-1)
            is_pre = np.repeat(plain.to_numpy(zero_copy_only=False), counts)
            at = np.zeros(len(is_pre), np.int64)
            at[is_pre] = pre
            at[np.flatnonzero(~is_pre)[::2]] = others
        sizes = self.sizes[at]
        flat = self.flat[ranges(self.begins[at], sizes)]
        return np.diff(np.cumsum(sizes)[at == 0], prepend=0), flat

    def _odd(self, texts: list[str]) -> list[np.ndarray]:
        """Texts with special strings, which cut them first, or with spaces inside runs of white space."""
        special = [any(x in t for x in self.special) for t in texts]
        pieces = [[] if own else PIECES.findall(t) for t, own in zip(texts, special, strict=True)]
        sizes, flat = self._of(pa.array(list(chain.from_iterable(pieces)), pa.large_string()))
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))]
        return [np.array(self._library_s(t), np.uint32) if own else x for t, own, x in zip(texts, special, np.split(flat, ends[:-1]), strict=True)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """32-bit ids of each text (no nulls)."""
        odd = pc.match_substring_regex(texts, INNER_SPACE)
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        rest = iter(self._odd(texts.filter(odd).to_pylist()) if pc.any(odd).as_py() else ())
        plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        codes = plain.flatten().dictionary_encode()
        at, lengths = codes.indices.to_numpy(), pc.list_value_length(plain).to_numpy()
        begins = np.cumsum(lengths) - lengths  # every text has a first piece, which no space precedes
        firsts = np.unique(at[begins])
        words = codes.dictionary
        after_space = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar(" ", pa.large_string()))
        sizes, flat = self._of(pa.concat_arrays([after_space, words.take(pa.array(firsts))]))
        # a piece that never follows a space costs an encoding, no more
        at = at.astype(np.int64)
        at[begins] = len(words) + np.searchsorted(firsts, at[begins])
        starts, each = np.cumsum(sizes) - sizes, sizes[at]
        ids, ends = flat[ranges(starts[at], each)], np.cumsum(each)[np.cumsum(lengths) - 1] if len(at) else np.zeros(0, np.int64)
        fast = iter(np.split(ids, ends[:-1]) if len(ends) else ())
        return [next(rest) if o else next(fast) for o in odd.to_pylist()]


def _strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()


_WORKER: dict[int, PieceIds] = {}


def _encoder(source: Broadcast, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(source)
        if id(tokenizer) not in _WORKER:
            _WORKER.clear()
            _WORKER[id(tokenizer)] = PieceIds(tokenizer)
        pieces, row, end = _WORKER[id(tokenizer)], 0, np.array([end_id], np.uint32)
        for doc_ids, texts in _gathered(batches):
            ids = [np.concatenate([x, end]).astype(np.int32) for x in pieces.encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(np.arange(row, row + len(ids)), pa.int64()), list_column(ids, pa.int32())], ["doc_id", "row", "ids"])
            row += len(ids)
    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts (null: empty) of neighbouring batches together, up to GATHERED bytes and the batch that passes them."""
    held, size = [], 0

    def out() -> tuple[pa.Array, pa.Array]:
        whole = pa.Table.from_batches(held).combine_chunks()
        texts = pc.fill_null(whole.column("text").cast(pa.large_string()), "").combine_chunks()
        return whole.column("doc_id").combine_chunks(), texts

    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= GATHERED:
            yield out()
            held, size = [], 0
    if size or held:
        yield out()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = 0, row_index_stride: int = 1000, stripe_bytes: int = 16 << 20) -> None:
    """Encode whole texts and write them as ORC files in ascending id order (one range of ids per file).

    The range key ends with the text's hash and the row's number, so that rows
    which share an id can be dealt to several files.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = tokenizer_source(spark, tokenizer)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange("doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n").drop("h", "n")
    (ranged.mapInArrow(returns_memory(_encoder(source, end_id)), FILE_SCHEMA).write
     .option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id")
     .option("orc.row.index.stride", str(row_index_stride)).option("orc.stripe.size", str(stripe_bytes)).orc(path))


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows (doc_id, row, ids, file); a list of ids prunes stripes and row groups by index and Bloom filter."""
    df = spark.read.schema(FILE_SCHEMA).orc(path)
    if doc_ids is not None:
        df = df.where(F.col("doc_id").isin(doc_ids))
    return df.select("doc_id", "row", "ids", F.col("_metadata.file_name").alias("file"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = list(list_slices(b.column("ids")))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("file"), b.column("row"), pa.array([len(x) for x in ids], pa.int64()),
             pa.array([zlib.crc32(np.ascontiguousarray(x, "<i4")) for x in ids], pa.int64())],
            ["doc_id", "file", "row", "n_tokens", "ids_crc32"])


def file_index(tokens: DataFrame) -> DataFrame:
    """Per document of read files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The files are read once, into a table of one short row per document.
    Starts are sums inside a file plus the sum of the files before it; file
    numbers ascend with the ranges. Only one row per file meets in one task.
    """
    bounded_batches(tokens.sparkSession)
    per_doc = tokens.mapInArrow(_digest, "doc_id bigint, file string, row bigint, n_tokens bigint, ids_crc32 bigint")
    per_doc = staged(per_doc, "token-index")
    inside = W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    rows = per_doc.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    files = per_doc.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    order = W.orderBy(part, "file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    return (rows.join(files, "file")
            .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))
