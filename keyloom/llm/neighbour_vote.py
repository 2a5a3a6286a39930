"""Quality classifier: nearest labelled neighbours in a latent semantic space vote.

Terms of a document are trigrams of character classes (lower and upper case, digits, bytes
beyond ASCII, blanks, kinds of punctuation), two counts of repeated words, and the words themselves,
A-Z lower-cased and hashed. Their square-rooted shares, weighted by inverse document frequency in
the labelled sample, are projected on its leading singular vectors. A document's score is the mean
label of its ``NEIGHBOURS`` nearest labelled documents, weighted by similarity; cosines with all
of them are exact, block by block.

Only the labelled sample is bounded: at most ``SAMPLE`` documents, half of each label, those of
the smallest hashed ids. Its latent vectors (a few MB by that bound) are broadcast; documents are
scored where they lie, whole and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workers import kept

SAMPLE = 4096
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 4
THRESHOLD = 0.3
BLOCK = 512

# Character classes by byte; what is not named is class 11.
CLASSES = 12
_NAMED = (
    (0, b"abcdefghijklmnopqrstuvwxyz"),
    (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (2, b"0123456789"),
    (3, bytes(range(128, 256))),
    (4, b" \t"),
    (5, b"\n\r\x0b\x0c"),
    (6, b"."),
    (7, b","),
    (8, b"!?"),
    (9, b"|"),
    (10, b"#$%&*<>"),
)
FORMS = CLASSES**3 + 2
WORDS = 2048  # cells that words are hashed to
TERMS = FORMS + WORDS
REPEAT_WEIGHT = 4
# Share of the words in a document's terms; the rest are classes and repeats.
WORD_SHARE = 0.3


def class_table() -> np.ndarray:
    table = np.full(256, CLASSES - 1, np.int32)
    for number, chars in _NAMED:
        table[list(chars)] = number
    return table


def terms(texts: list[bytes]) -> np.ndarray:
    """Square-rooted term shares, a row per text; an empty text is a row of zeros."""
    table, out = class_table(), np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        c = table[np.frombuffer(text, np.uint8)]
        if len(c) > 2:
            row[: CLASSES**3] = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        words = text.split()
        row[FORMS - 2] = REPEAT_WEIGHT * sum(map(eq, words, words[1:]))
        row[FORMS - 1] = len(words) - len(set(words))
        total = row.sum()
        if total:
            row /= total / (1 - WORD_SHARE)
        if words:
            cells = np.frombuffer(b"".join(map(xxhash.xxh64_digest, text.lower().split())), ">u8") % WORDS
            row[FORMS:] = np.bincount(cells.astype(np.int64), minlength=WORDS) * (WORD_SHARE / len(words))
    return np.sqrt(out, out)


class Model(NamedTuple):
    weight: np.ndarray  # per term
    mean: np.ndarray
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # unit latent vectors of the labelled documents
    labels: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weight - self.mean) @ self.axes
        return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-12)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), 0.5)
        cosine = self.latent(x) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        # ties at the last place go to the earlier labelled document
        near = np.argsort(-cosine, axis=1, kind="stable")[:, :k] if k == cosine.shape[1] else _nearest(cosine, k)
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** SHARPNESS
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-cosine, k - 1, axis=1)[:, :k]


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    dimensions: int = DIMENSIONS,
) -> Model:
    """Learn from at most ``sample`` labelled documents outside the held-out fifth.

    Labels other than 0 and 1 are passed over; of several labels of an id the smaller counts.
    Without any labelled document every score is 0.5.
    """
    known = (
        labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("l_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("l_id"))
        .groupBy("l_id").agg(F.min("label").alias("label"))
    )
    order = F.xxhash64("l_id")
    chosen = known.filter("label = 0").orderBy(order, "l_id").limit(sample // 2).unionByName(
        known.filter("label = 1").orderBy(order, "l_id").limit(sample // 2)
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))  # at most ``sample`` ids
    picked = picked.select("l_id", "label", "text").dropDuplicates(["l_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = terms(list(raw_texts(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("l_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["l_id", "label", "x"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    got = picked.mapInArrow(run, f"l_id {id_type}, label int, x binary").toArrow().sort_by("l_id")  # bounded by ``sample``
    x = np.empty((len(got), TERMS), np.float32)
    for row, raw in zip(x, got.column("x"), strict=True):
        row[:] = np.frombuffer(raw.as_buffer(), np.float32)
    y = np.array(got.column("label").to_pylist(), np.float64)
    del got
    if not len(y):
        zero = np.zeros(TERMS, np.float32)
        return Model(zero, zero, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y)
    weight = np.log(1 + len(y) / np.maximum(np.count_nonzero(x, axis=0), 1)).astype(np.float32)
    x *= weight
    mean = x.mean(0)
    x -= mean
    axes = leading(x, min(dimensions, len(y)))
    z = x @ axes
    vectors = z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-12)
    return Model(weight, mean, axes, vectors, y)


def leading(z: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    width = min(dimensions + 16, *z.shape)
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(z.shape[1], width)))[0].astype(z.dtype)
    for _ in range(8):
        basis = np.linalg.qr((z.T @ (z @ basis)).astype(np.float64))[0].astype(z.dtype)
    inner = (z @ basis).astype(np.float64)
    _, turn = np.linalg.eigh(inner.T @ inner)
    return (basis @ turn[:, ::-1][:, :dimensions]).astype(np.float32)


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score`` (0 to 1, higher: label 1 likelier).

    Null and empty texts are scored like any other: they have no terms. Repeated rows score
    alike. An input column named ``score`` must not be among ``keep``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(model))
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        model = Model(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = model.scores(terms(list(raw_texts(part.column(part.num_columns - 1)))))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(found, pa.float64())], names=[*part.schema.names[:-1], "score"]
                )

    return chosen.mapInArrow(run, types + "score double")
