"""BPE encoding and decoding through a distinct-word table.

White space never joins characters into one token (the tokenizer drops it), so
a text is cut at ASCII white space, each distinct word of the corpus is encoded
once (``dictionary``), and the ids are joined back by position. Decoding joins
ids with the tokenizer's id-to-piece table: the table is as large as the
vocabulary whatever the data, so it is broadcast and looked up by id (a join of
exploded ids would shuffle every token to put a text's pieces together again).
Files with a decoder of their own are refused.

Defined results: a null, empty or blank text has no ids and decodes to the
empty string; a null document id is kept, an id that is no number fails the
query under ANSI rules as any cast does; repeated documents are all encoded;
an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dictionary
from .common import bounded_batches, list_column, list_slices, load_tokenizer, ranges, returns_memory, tokenizer_source


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and ids (array<int>) as the tokenizer gives them for the whole text."""
    spark = docs.sparkSession
    source = tokenizer_source(spark, tokenizer)
    parts = dictionary.split(docs, dictionary.words_as_is, id_col, text_col)

    def answer(_bucket: int, words: list[bytes], _counts: np.ndarray):
        tok, ids = load_tokenizer(source), []
        for i in range(0, len(words), 10_000):
            block = [w.decode() for w in words[i:i + 10_000]]
            ids += [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(block, add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], np.uint32)
        flat = np.concatenate(ids)
        begins = np.cumsum(sizes.astype(np.int64)) - sizes

        def values_of(own: np.ndarray) -> tuple[bytes, bytes]:
            return dictionary.pack_numbers(sizes[own]), dictionary.pack_numbers(flat[ranges(begins[own], sizes[own])])
        return [], values_of

    def use(doc_ids: list[int | None], lengths: np.ndarray, places: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
        begins = np.cumsum(sizes.astype(np.int64)) - sizes
        each = sizes[places].astype(np.int64)
        ids = flat[ranges(begins[places], each)].astype(np.int32)
        per_word = np.concatenate([[0], np.cumsum(each)])
        offsets = np.concatenate([[0], per_word[np.cumsum(lengths)]]).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), column], ["doc_id", "ids"])

    return dictionary.by_chunk(parts, dictionary.by_word(parts, answer), use, "doc_id bigint, ids array<int>")


def piece_table(tokenizer: str) -> list[str]:
    """The piece of each id, from the tokenizer file alone."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    if tok.decoder is not None:
        raise ValueError("the file has a decoder: pieces joined by spaces are not what it makes of ids")
    return [tok.id_to_token(i) for i in range(tok.get_vocab_size(with_added_tokens=True))]


def decoded_texts(ids: list[np.ndarray], pieces: list[str]) -> list[str]:
    """Pieces joined by one space: what a tokenizer file without a decoder makes of ids."""
    return [" ".join(map(pieces.__getitem__, x.tolist())) for x in ids]


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Per encoded document: doc_id and text."""
    bounded_batches(encoded.sparkSession)
    pieces = encoded.sparkSession.sparkContext.broadcast(piece_table(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = decoded_texts(list(list_slices(b.column("ids"))), pieces.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.large_string()).cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(returns_memory(run), "doc_id bigint, text string")


def digests(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and the digest of the text decoded from the ids."""
    bounded_batches(encoded.sparkSession)
    pieces = encoded.sparkSession.sparkContext.broadcast(piece_table(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = [str(i) for i in range(len(pieces.value))]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            ids = list(list_slices(b.column("ids")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([digest(" ".join(map(numbers.__getitem__, x.tolist()))) for x in ids]),
                 pa.array([digest(t) for t in decoded_texts(ids, pieces.value)])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(
        returns_memory(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
