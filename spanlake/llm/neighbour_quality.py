"""Quality by nearest-neighbour voting in a latent semantic space.

Term counts of a bounded labelled sample are weighted (square root of the count, inverse document frequency, unit
length) and reduced by a singular value decomposition.  The sample's vectors are broadcast, their size being fixed by
the sample's bound; every document is folded into the same space and compared with all of them in exact blocked cosine
products, and the labels of its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import WordRows, bounded_sample, filter_texts, fold, labels_of, map_texts, raw

#: Hashed terms: the first part for a word's form, the second for its letters.
FORMS, LETTERS = 1024, 1024
#: After the words' terms: repeats of the word before, words seen before, repeated lines.
REPEATS = 3
TERMS = FORMS + LETTERS + REPEATS
DIMENSIONS, NEIGHBOURS = 48, 15
#: Rounds of the subspace iteration, axes beyond DIMENSIONS that it carries, rows of a block of the sample.
ROUNDS, SPARE, SAMPLE_BLOCK = 12, 16, 256
#: The labelled sample: at most so many documents of each label, hashed by doc_id.
PER_LABEL = 1500
#: Forms tell more of quality than letters do; the power sharpens similarity.
FORM_WEIGHT, SHARPNESS = 3.0, 4

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_terms(word: bytes) -> list[int]:
    """The two terms of a word: its form (case, digits, the marks around it) and its hashed letters."""
    text = word.decode("utf-8", "replace")
    core = text.strip(_MARKS)
    at = text.find(core) if core else len(text)
    case = "-" if not core else "9" if core.isdigit() else "X" if core.isupper() and len(core) > 1 else "x" if core.islower() else "Xx" if core.istitle() else "?"
    form = f"{text[:at][:4]}|{case}|{text[at + len(core) :][:4]}"
    return [zlib.crc32(form.encode()) % FORMS, FORMS + zlib.crc32(core.lower().encode()) % LETTERS]


def _counts(rows: WordRows, text: bytes | None) -> np.ndarray:
    """Counts of a whole text's terms; the last REPEATS count what single words do not show: repeats of the word before,
    words seen before (only of a text that says every word three times or more), repeated lines."""
    text = text or b""
    words = text.split()
    out = np.zeros(TERMS, np.float32)
    if words:
        at = rows.rows(words)
        out[:] = np.bincount(rows.block[at].ravel(), minlength=TERMS)
        again = int((at[1:] == at[:-1]).sum())
        lines = [x for x in (y.strip() for y in text.split(b"\n")) if x]
        seen = len(set(words))
        out[-REPEATS:] = (again, len(words) - seen if len(words) > 3 * seen else 0, len(lines) - len(set(lines)))
    return out


@dataclass
class Model:
    weights: np.ndarray  # of each term: inverse document frequency times the weight of its part
    axes: np.ndarray  # TERMS x dimensions
    vectors: np.ndarray  # dimensions x sample, unit length
    votes: np.ndarray  # sample x 2: the vote of each neighbour (label 0 or 1) by its label's true share
    prior: float  # of a document that resembles nothing
    cut: float = 0.5

    def vectors_of(self, counts: np.ndarray) -> np.ndarray:
        x = (np.sqrt(counts) * self.weights) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Of label 1, from 0 to 1, for a block of documents."""
        n = self.vectors.shape[1]
        if not n:
            return np.full(len(counts), self.prior)
        alike = self.vectors_of(counts) @ self.vectors
        k = min(NEIGHBOURS, n)
        near = np.argpartition(alike, n - k, axis=1)[:, n - k :]
        w = np.clip(np.take_along_axis(alike, near, axis=1), 0, None) ** SHARPNESS
        for_1, for_0 = (w * self.votes[near, 1]).sum(1), (w * self.votes[near, 0]).sum(1)
        total = for_0 + for_1
        return np.where(total > 1e-9, for_1 / np.maximum(total, 1e-9), self.prior)


def scorer(model: Model):
    """A function of a block of UTF-8 texts: their scores."""
    rows = WordRows(2, word_terms, np.int32)

    def score(texts: list[bytes | None]) -> np.ndarray:
        return np.clip(model.scores(np.stack([_counts(rows, t) for t in texts])).astype(np.float64), 0, 1) if texts else np.zeros(0)

    return score


def packer():
    """A function of a UTF-8 text: the places of the counts that are not 0, and the counts, as little-endian float32."""
    rows = WordRows(2, word_terms, np.int32)

    def pack(text: bytes) -> bytes:
        counts = _counts(rows, text)
        there = np.flatnonzero(counts)
        return np.concatenate([there, counts[there]]).astype("<f4").tobytes()

    return pack


def unpacked(packed: bytes) -> np.ndarray:
    there, counts = np.frombuffer(packed, "<f4").reshape(2, -1)
    out = np.zeros(TERMS, np.float32)
    out[there.astype(np.int64)] = counts
    return out


def _blocks(sample: list[tuple[int, bytes, int]]) -> Iterator[np.ndarray]:
    """The counts of the sample's rows, SAMPLE_BLOCK rows at a time: the driver never holds all of them unpacked."""
    for at in range(0, len(sample), SAMPLE_BLOCK):
        yield np.stack([unpacked(packed) for _, packed, _ in sample[at : at + SAMPLE_BLOCK]])


def _unit(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * weights
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _axes(sample: list[tuple[int, bytes, int]], weights: np.ndarray, seed: int = 5) -> np.ndarray:
    """The first DIMENSIONS right singular vectors of the sample's weighted rows, by subspace iteration with SPARE more
    axes than wanted: each round multiplies the axes by the rows and back, a block at a time."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(TERMS, DIMENSIONS + SPARE)).astype(np.float32))[0]
    for _ in range(ROUNDS):
        grown = np.zeros_like(q)
        for counts in _blocks(sample):
            x = _unit(counts, weights)
            grown += x.T @ (x @ q)
        q = np.linalg.qr(grown)[0]
    within = np.zeros((q.shape[1], q.shape[1]))
    for counts in _blocks(sample):
        y = (_unit(counts, weights) @ q).astype(np.float64)
        within += y.T @ y
    values, vectors = np.linalg.eigh(within)
    return (q @ vectors[:, np.argsort(values)[::-1][:DIMENSIONS]]).astype(np.float32)


def fit(sample: list[tuple[int, bytes, int]], share_of_1: float) -> Model:
    """Builds the space and the voters from (doc_id, packed counts, label) rows; ``share_of_1`` is the labels' share in the corpus."""
    y = np.array([label for *_, label in sample], np.int64)
    part = np.ones(TERMS, np.float32)
    part[:FORMS] = part[-REPEATS:] = FORM_WEIGHT
    having = sum(((counts > 0).sum(0) for counts in _blocks(sample)), np.zeros(TERMS, np.int64))
    weights = part * np.log((1 + len(sample)) / (1 + having)).astype(np.float32)
    votes = np.zeros((len(sample), 2), np.float32)
    for label, share in ((0, 1 - share_of_1), (1, share_of_1)):
        votes[y == label, label] = share / max(1, (y == label).sum()) * len(sample)
    model = Model(weights, _axes(sample, weights), np.zeros((DIMENSIONS, 0), np.float32), votes, share_of_1)
    if sample:
        model.vectors = np.ascontiguousarray(np.concatenate([model.vectors_of(counts) for counts in _blocks(sample)]).T)
    return model


def train(docs: DataFrame, labels: DataFrame, kept_out: int = 1, parts: int = 3, per_label: int = PER_LABEL) -> Model:
    """Learns from the whole texts of at most ``per_label`` documents of each label outside the held-out fold, chosen by
    the hash of doc_id."""
    known = labels_of(labels, "quality").where((fold(F.col("doc_id"), parts) != kept_out) & F.col("label").isin(0, 1))
    shares = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    there = docs.where("doc_id is not null").select("doc_id").distinct()
    sample = bounded_sample(docs, known.join(there, "doc_id", "left_semi"), per_label, packer)
    return fit(sample, shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for each row: the score is the weighted share of label 1 among the nearest neighbours.

    Null and empty texts resemble nothing and get the labels' share; with no labels at all that is 0.5.  Texts of any
    length are read whole.  Repeated rows are scored each for itself; labels, lang, source, doc_id and any other column,
    whatever its name, play no part.  An empty table gives no row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = score(raw(batch, "text"))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, ["doc_id", "text"], "doc_id long, score double, predicted int", make)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(shared.value)
        return lambda texts: score(texts) >= 0.5

    return filter_texts(docs, make)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    said = classify(docs, train(docs, labels))
    return said.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
