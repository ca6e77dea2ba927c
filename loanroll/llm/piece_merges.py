"""SentencePiece (merge type) encoding by backtracking, and decoding.

A text's encoding is the one sequence of pieces in which every two neighbours
are what merging their joined characters gives. An Aho-Corasick automaton finds
the longest piece at each position; the encoder takes the longest piece that
fits the piece before it, falls back on the piece's longest prefix that is a
piece, and where none fits marks the position in a bitfield as failed, drops
the last piece and goes on with a shorter one. Whether two pieces may be
neighbours is found by merging their characters anew, and remembered.

Characters that are no piece merge with nothing; they become byte pieces.
Spaces stand only at the beginning of pieces, so a text is cut before spaces
and around line ends, each distinct word of the corpus is encoded once
(``dictionary``) and the ids are joined back by position.

The model file must merge (BPE), keep white space, add a space in front and
have byte pieces; ``Model`` checks that and raises ``ValueError`` otherwise.

Defined results: a null or empty text has no ids and decodes to the empty
string; a null document id is kept, an id that is no number fails the query
under ANSI rules as any cast does; repeated documents are all encoded; an empty
table gives no rows. Only the id and text columns are read. Decoding takes any
ids of the model; bytes that are no UTF-8 become U+FFFD each, control pieces
nothing.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from . import dictionary
from .common import bounded_batches, list_column, list_slices, ranges, returns_memory

SPACE = "▁"
#: A byte that no UTF-8 text holds stands for a line end inside words, as word lists are joined by line ends.
LINE_END = b"\xff"
_WORDS = re.compile(rb"\xff+| *[^ \xff]+| +")
#: Neighbour checks that a worker remembers at most.
REMEMBERED = 2_000_000


@dataclass(frozen=True)
class Model:
    """Pieces of a model file. ``kinds``: ``p`` ordinary, ``b`` byte, ``c`` control, ``u`` unknown."""

    pieces: list[str]
    scores: list[float]
    kinds: str

    @staticmethod
    def load(path: str) -> Model:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        kinds = "".join("c" if sp.is_control(i) else "u" if sp.is_unknown(i) else "b" if sp.is_byte(i) else "x" if sp.is_unused(i) else "p" for i in n)
        model = Model([sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n], kinds)
        own = [p for p, k in zip(model.pieces, kinds, strict=True) if k == "p"]
        single = {p for p in own if len(p) == 1}
        probe = "  ﬁ ①\tÅ　 b "
        if "x" in kinds or kinds.count("b") != 256 or any(SPACE in p.lstrip(SPACE) or not single.issuperset(p) for p in own):
            raise ValueError("the model must have byte pieces, spaces only in front, and every character of a piece as a piece")
        if sp.normalize(probe) != (" " + probe).replace(" ", SPACE):
            raise ValueError("the model must keep texts as they are but for a space in front")
        return model


class Encoder:
    """Encodes words (in which SPACE stands for a space)."""

    def __init__(self, model: Model):
        self.id = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == "p"}
        self.scores, self.pieces = model.scores, model.pieces
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == "b"}
        self.known = {p for p in self.id if len(p) == 1}
        self.unknown = re.compile("([^" + re.escape("".join(sorted(self.known))) + "])")
        self.size = [len(p) for p in model.pieces]
        self.fits: dict[int, bool] = {}
        # a piece that its own characters don't merge to never comes out
        usable = {p: i for p, i in self.id.items() if self.merge(p) == [i]}
        self.shorter = [-1] * len(model.pieces)
        self.automaton = ahocorasick.Automaton()
        for p, i in usable.items():
            self.automaton.add_word(p, (i, len(p)))
            self.shorter[i] = next((usable[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in usable), -1)
        self.automaton.make_automaton()
        self.usable = usable

    def merge(self, text: str) -> list[int]:
        """Neighbours are joined, those first that make the piece of the highest score, the leftmost of equal ones."""
        parts, ids, scores = list(text), self.id, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ids[p] for p in parts]

    def neighbours(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            known = self.fits[key] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return known

    def run(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces."""
        if text in self.usable:
            return [self.usable[text]]
        longest = [-1] * len(text)
        for end, (i, size) in self.automaton.iter(text):
            longest[end - size + 1] = i  # ends ascend, so the longest stays
        failed = bytearray(len(text) // 8 + 1)
        out: list[int] = []
        at, token, size, shorter, neighbours, n = 0, longest[0], self.size, self.shorter, self.neighbours, len(text)
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + size[token]
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or neighbours(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:  # nothing fits here: the last piece must be shorter
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= size[token]

    def word(self, text: str) -> list[int]:
        if self.known.issuperset(text):
            return self.run(text)
        out: list[int] = []
        for k, part in enumerate(self.unknown.split(text)):
            if k % 2:
                out += [self.byte[b] for b in part.encode()]
            elif part:
                out += self.run(part)
        return out


def words_of(text: bytes) -> list[bytes]:
    """The text with a space in front, cut where no piece can reach across; none for the empty text."""
    if not text:
        return []
    return _WORDS.findall(b" " + text.replace(SPACE.encode(), b" ").replace(b"\n", LINE_END))


def word_text(word: bytes) -> str:
    return word.replace(LINE_END, b"\n").decode().replace(" ", SPACE)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(source: Broadcast) -> Encoder:
    """The worker's own encoder, built once per Python worker."""
    key = hash((source.value.kinds, len(source.value.pieces), source.value.pieces[-1], sum(source.value.scores)))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(source.value)
    return _ENCODERS[key]


def _source(spark: SparkSession, path: str) -> Broadcast:
    """The model's pieces: about a MB whatever the data."""
    return spark.sparkContext.broadcast(Model.load(path))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and ids (array<int>) as the library gives them for the whole text."""
    source = _source(docs.sparkSession, model)
    parts = dictionary.split(docs, dictionary.words_by(words_of), id_col, text_col)

    def answer(_bucket: int, words: list[bytes], _counts: np.ndarray):
        word, ids = _encoder(source).word, []
        for w in words:
            ids.append(np.array(word(word_text(w)), np.uint32))
        sizes = np.array([len(x) for x in ids], np.uint32)
        flat = np.concatenate(ids)
        begins = np.cumsum(sizes.astype(np.int64)) - sizes

        def values_of(own: np.ndarray) -> tuple[bytes, bytes]:
            return dictionary.pack_numbers(sizes[own]), dictionary.pack_numbers(flat[ranges(begins[own], sizes[own])])
        return [], values_of

    def use(doc_ids: list[int | None], lengths: np.ndarray, places: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
        begins = np.cumsum(sizes.astype(np.int64)) - sizes
        each = sizes[places].astype(np.int64)
        ids = flat[ranges(begins[places], each)]
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(lengths)])]
        column = list_column([ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), column], ["doc_id", "ids"])

    return dictionary.by_chunk(parts, dictionary.by_word(parts, answer), use, "doc_id bigint, ids array<int>")


def _each(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


class Decoder:
    """Texts of ids."""

    def __init__(self, model: Model):
        codecs.register_error("each_byte", _each)
        kinds = {"p": lambda p: p.replace(SPACE, " ").encode(), "b": lambda p: bytes([int(p[3:5], 16)]), "c": lambda p: b"",
                 "u": lambda p: " ⁇ ".encode()}
        self.bytes = [kinds[k](p) for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.marked = np.array([k == "p" and p.startswith(SPACE) for p, k in zip(model.pieces, model.kinds, strict=True)])
        self.silent = np.array([k == "c" for k in model.kinds])

    def text(self, ids: np.ndarray) -> str:
        """The pieces' texts joined, without the space that was set in front."""
        silent = self.silent[ids]
        heard = ids[~silent]
        runs = np.split(ids, np.flatnonzero(silent)) if silent.any() else [ids]  # no character reaches across a control piece
        out = "".join(b"".join(map(self.bytes.__getitem__, x.tolist())).decode("utf-8", "each_byte") for x in runs)
        return out[1:] if len(heard) and self.marked[heard[0]] else out


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Per encoded document: doc_id and text. The pieces are broadcast: as many as the model has, whatever the data."""
    bounded_batches(encoded.sparkSession)
    source = _source(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(source.value)
        for b in batches:
            texts = [d.text(x) for x in list_slices(b.column("ids"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(returns_memory(run), "doc_id bigint, text string")


def digests(encoded: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and the digest of the text decoded from the ids."""
    bounded_batches(encoded.sparkSession)
    source = _source(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, numbers = Decoder(source.value), [str(i) for i in range(len(source.value.pieces))]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            ids = list(list_slices(b.column("ids")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([digest(",".join(map(numbers.__getitem__, x.tolist()))) for x in ids], pa.string()),
                 pa.array([digest(d.text(x)) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(returns_memory(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
