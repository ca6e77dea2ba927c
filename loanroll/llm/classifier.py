"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text is reduced to a vector of transformed statistics (lengths on a log
scale, shares by arcsine square root). A class is a Gaussian whose covariance
is shrunk towards the pooled covariance and that towards its diagonal; the
score is the logistic function of the difference of the classes' Mahalanobis
log densities, computed from Cholesky factors that are cached in the model.

Fitting sums counts, vectors and outer products over all labelled training
rows in the workers; the driver gets one row per class and matrix entry
whatever the number of rows. Labels are only read for fitting.

Defined results: null, empty and blank texts are scored like any other (all
statistics zero); labels that are null are not learned from; a document that
is labelled more than once counts once per label row; with rows of one class
only the score is that class (1.0 or 0.0), with none 0.5; repeated documents
are all scored; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, list_column, list_slices, returns_memory, staged, texts_as_bytes

STATISTICS = ("log_words", "log_word_length", "upper", "digits", "symbols", "stops", "exclaims", "other_marks", "space",
              "non_ascii", "distinct_words", "short_words", "wordless", "repeated_lines", "log_line_length")

_BYTE_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&|<>", "stops": b".,;:",
                 "exclaims": b"!?", "other_marks": b"\"'()+-/=@[\\]^_`{}~", "space": b" \t\n\r\x0b\x0c"}
_CLASS_ROWS = np.zeros((len(_BYTE_CLASSES) + 1, 256))
for _i, _chars in enumerate(_BYTE_CLASSES.values()):
    _CLASS_ROWS[_i, list(_chars)] = 1
_CLASS_ROWS[-1, 128:] = 1
_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + bytes(range(128, 256))


def statistics(text: bytes) -> np.ndarray:
    """The vector of a text; every entry is finite and of order one."""
    out = np.zeros(len(STATISTICS))
    words = text.split()
    if not words:
        return out
    n = len(words)
    counts = np.zeros(256, np.int64)
    for i in range(0, len(text), 1 << 20):
        counts += np.bincount(np.frombuffer(text[i:i + (1 << 20)], np.uint8), minlength=256)
    shares = _CLASS_ROWS @ counts / len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[0] = np.log1p(n)
    out[1] = np.log((len(text) - (_CLASS_ROWS[6] @ counts)) / n)
    out[2:10] = np.arcsin(np.sqrt(shares))
    out[10] = np.arcsin(np.sqrt(len(set(words)) / n)) + 0.1 * np.log1p(n)
    out[11] = np.arcsin(np.sqrt(sum(len(w) <= 3 for w in words) / n))
    out[12] = np.arcsin(np.sqrt(sum(not w.strip(_MARKS) for w in words) / n))
    out[13] = np.arcsin(np.sqrt(1 - len(set(lines)) / len(lines)))
    out[14] = np.log1p(len(text) / len(lines)) / 2
    return out


_MARKS = bytes(x for x in range(128) if x not in _LETTERS)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns to keep, and ``x`` (array of the statistics)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in texts_as_bytes(b.column("text"))]
            at = b.schema.get_field_index("text")
            columns = [list_column(x, pa.float64()) if i == at else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, ["x" if i == at else n for i, n in enumerate(b.schema.names)])

    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    schema = rows.withColumn("text", F.array(F.lit(0.0))).withColumnRenamed("text", "x").schema
    return rows.mapInArrow(returns_memory(run), schema)


@dataclass(frozen=True)
class Model:
    """Class priors and means with inverse Cholesky factors and log determinants; or a constant."""

    means: tuple[np.ndarray, ...] = ()
    whiten: tuple[np.ndarray, ...] = ()
    offsets: tuple[float, ...] = ()
    constant: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.constant)
        log_density = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.means, self.whiten, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, total = len(STATISTICS), {}
    for b in batches:
        label = b.column("label").to_numpy(zero_copy_only=False)
        x = np.array(list(list_slices(b.column("x")))).reshape(-1, p)
        for c in (0, 1):
            own = x[label == c]
            s = total.setdefault(c, np.zeros(1 + p + p * p))
            s += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    for c, s in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([c] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()), pa.array(s)],
                                         ["label", "entry", "value"])


def fit(labelled: DataFrame, to_pooled: float = 0.8, to_diagonal: float = 0.3, floor: float = 1e-3) -> Model:
    """The model from rows (x, label 0 or 1); other labels are ignored."""
    p = len(STATISTICS)
    rows = labelled.where(F.col("label").isin(0, 1)).select("x", F.col("label").cast("int").alias("label"))
    bounded_batches(labelled.sparkSession)
    entries = rows.mapInArrow(_sums, "label int, entry int, value double").groupBy("label", "entry").agg(F.sum("value").alias("value"))
    total = np.zeros((2, 1 + p + p * p))
    for label, entry, value in entries.collect():  # 2 * (1 + p + p * p) rows at most
        total[label, entry] = value
    n = total[:, 0]
    if not n.all():
        return Model(constant=0.5 if not n.any() else float(n[1] > 0))
    means = total[:, 1:1 + p] / n[:, None]
    scatter = total[:, 1 + p:].reshape(2, p, p) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / n.sum()
    whiten, offsets = [], []
    for c in (0, 1):
        s = (1 - to_pooled) * scatter[c] / n[c] + to_pooled * pooled
        s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + floor * np.eye(p)
        factor = np.linalg.cholesky((s + s.T) / 2)
        whiten.append(np.linalg.inv(factor))
        offsets.append(float(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum()))
    return Model(tuple(means), tuple(whiten), tuple(offsets))


def score(described: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The described documents with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold) in place of ``x``."""
    bounded_batches(described.sparkSession)
    names = [c for c in described.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(np.array(list(list_slices(b.column("x")))).reshape(-1, len(STATISTICS)))
            columns = [*(b.column(n) for n in names), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted"])

    schema = described.select(*names, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return described.mapInArrow(returns_memory(run), schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is not learned from: crc32 of its id as text leaves remainder 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(described: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, label) of the labelled documents that may be learned from."""
    known = labels.where("quality is not null").select(F.col("doc_id"), F.col("quality").cast("int").alias("label"))
    return described.where(~held_out(F.col("doc_id"))).select("doc_id", "x").join(known, "doc_id").select("x", "label")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Fit on the training rows and score every document: doc_id, held_out, score, predicted."""
    described = staged(document_statistics(docs), "statistics")
    model = fit(training_rows(described, labels))
    return score(described.withColumn("held_out", held_out(F.col("doc_id"))), model, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns.

    The statistics are computed for fitting and again while filtering: a second
    reading of the texts instead of a shuffle of them.
    """
    bounded_batches(docs.sparkSession)
    model = fit(training_rows(document_statistics(docs), labels))
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in texts_as_bytes(b.column(at))]).reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(model.scores(x) >= threshold))

    return plain.mapInArrow(returns_memory(run), plain.schema).toDF(*names)
