"""Quality of documents by votes of their nearest labelled neighbours in a latent space.

Terms are hashed words, word shapes and pairs of shapes. A bounded sample of labelled rows
is weighted by inverse document frequency and reduced by a truncated singular value
decomposition; its vectors, whose number is a parameter, are broadcast, and every document
is compared with all of them in blocks.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import by_text, keeps_columns, map_batches

#: Hashed word terms and shape terms, weight of the word part, latent dimensions, labelled
#: rows of each class that are fitted at most, and neighbours that vote.
WORDS, SHAPES, WORD_WEIGHT, DIMENSIONS, PER_CLASS, NEIGHBOURS = 3072, 1024, 0.4, 64, 1500, 15
#: Power of the similarity by which a vote counts, and documents of a block.
SHARPNESS, BLOCK = 8, 256

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))
_SHAPE = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 else 48 if 48 <= b <= 57 else 117 if b >= 128 else b for b in range(256)
)
#: Continuation bytes and the lead byte of Latin-1 letters say nothing of a shape.
_NO_SHAPE = bytes([*range(0x80, 0xC0), 0xC3])


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, tokens), np.int64, len(tokens))


def term_vector(text: str | None) -> np.ndarray:
    """Damped term counts of a text, the word part and the shape part of fixed length each."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(WORDS + SHAPES, np.float32)
    words = _hashes(raw.translate(_FOLD).split())
    signs = np.frombuffer(raw.translate(_SHAPE, _NO_SHAPE), np.uint8)
    if len(signs):  # a run of like characters is one sign
        signs = signs[np.concatenate([[True], signs[1:] != signs[:-1]])]
    shapes = _hashes(signs.tobytes().split())
    # a word that follows itself is a shape of its own
    twice = np.full(int((words[1:] == words[:-1]).sum()), 7, np.int64)
    pairs = shapes[:-1] * 31 + shapes[1:]
    out[:WORDS] = np.log1p(np.bincount(words % WORDS, minlength=WORDS))
    out[WORDS:] = np.log1p(np.bincount(np.concatenate([shapes, pairs, twice]) % SHAPES, minlength=SHAPES))
    return out


def _sparse(vector: np.ndarray) -> bytes:
    """The places and values of a term vector that are not 0."""
    at = np.flatnonzero(vector).astype("<u2")
    return at.tobytes() + vector[at].astype("<f4").tobytes()


def _dense(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), WORDS + SHAPES), np.float32)
    for vector, raw in zip(out, rows):
        n = len(raw) // 6
        vector[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return out


@dataclass
class Neighbours:
    """Term weights, latent axes, and the labelled vectors with their labels."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, terms: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero where there are no terms."""
        return _unit(_weighted(terms, self.weight) @ self.axes)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Share of the votes for label 1; 0 where a document has no terms to compare."""
        near = self.latent(terms) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.clip(np.take_along_axis(near, top, 1), 0, 1).astype(np.float64) ** SHARPNESS
        total = votes.sum(1)
        return np.where(total > 0, (votes * self.labels[top]).sum(1) / np.maximum(total, 1e-300), 0.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _weighted(terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
    terms = terms * weight
    terms[:, :WORDS] = WORD_WEIGHT * _unit(terms[:, :WORDS])
    terms[:, WORDS:] = _unit(terms[:, WORDS:])
    return terms


def fit(terms: np.ndarray, labels: np.ndarray) -> Neighbours:
    """Latent semantic axes of the sample by a randomised range search with a fixed seed."""
    weight = (np.log((1 + len(terms)) / (1 + (terms > 0).sum(0))) + 1).astype(np.float32)
    x = _weighted(terms, weight)
    basis = np.random.default_rng(7).standard_normal((x.shape[1], min(DIMENSIONS + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ vt.T)[:, :DIMENSIONS].astype(np.float32)
    return Neighbours(weight, axes, _unit(x @ axes), labels.astype(np.float64))


def _fold(doc_id):
    return F.crc32(doc_id.cast("string")) % 3


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Neighbours | None:
    """Fit on at most per_class labelled rows of each class outside the held-out fold.

    Which rows: those whose ids have the least hashes, so the choice depends on nothing else.
    One task fits them, 2 * per_class sparse vectors; the driver gets the model, some MB. None
    without labelled rows that have a document.
    """
    rows = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).dropna()
    rows = rows.where(_fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = None
    for label in (0, 1):
        some = rows.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")

    def run(columns):
        vectors = [term_vector(t) for t in columns[2]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array([_sparse(v) for v in vectors], pa.binary())],
            names=["doc_id", "quality", "terms"],
        )

    def fit_all(batches):
        sample = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        if sample:
            model = fit(_dense([t for _, _, t in sample]), np.array([q for _, q, _ in sample]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    vectors = by_text(found, ["doc_id", "quality", "text"], "doc_id long, quality int, terms binary", run)
    sample = vectors.groupBy("doc_id").agg(F.min(F.struct("quality", "terms")).alias("r")).select("doc_id", "r.quality", "r.terms")
    model = map_batches(sample.repartition(1), fit_all, "model binary").first()
    return pickle.loads(model[0]) if model else None


_SCORED = "doc_id long, score double"


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text).

    Null, empty and termless texts score 0; without any labelled document all score 0.
    Repeated rows and null ids (never held out) come back as given; an empty table gives
    none. labels(doc_id, quality): rows with nulls are left out, of repeated ids the greater
    label counts. Other columns are not read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, per_class))

    def run(columns):
        ids, texts = columns
        scores = np.zeros(len(texts))
        for a in range(0, len(texts) if model.value else 0, BLOCK):
            scores[a : a + BLOCK] = model.value.scores(np.stack([term_vector(t) for t in texts[a : a + BLOCK]]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores)], names=["doc_id", "score"])

    scored = by_text(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], _SCORED, run)
    return scored.select(
        "doc_id",
        F.coalesce(_fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@keeps_columns
def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier accepts, with all their columns.

    Null, empty and termless texts score 0 and go. Where no labelled row has a document there
    is no classifier, and all rows stay. Repeated rows and null ids are judged as given; an
    empty table gives none.
    """
    spark = docs.sparkSession
    if (found := train(docs, labels)) is None:
        return docs
    model = spark.sparkContext.broadcast(found)
    text_at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                terms = np.stack([term_vector(t) for t in part.column(text_at).to_pylist()])
                yield part.filter(pa.array(model.value.scores(terms) >= 0.5))

    return map_batches(docs, run, docs.schema)
