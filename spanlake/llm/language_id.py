"""Language of a text: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of the hashed character n-grams of its words.  As mean and softmax layer are
linear, embedding times layer is multiplied out once after training, and a word's share of the logits is kept in a
bounded table: scoring whole texts is then a look-up and a sum.  The temperature and the limit of rejection come from
training rows held back from the descent.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import WordRows, bounded_sample, filter_texts, fold, map_texts, raw

BUCKETS, WIDTH = 1 << 15, 16
#: The labelled sample: at most so many documents of each language, hashed by doc_id.
PER_LANGUAGE = 600
#: Rejection may cost at most this share of the rightly predicted calibration documents.
LOST = 0.002
#: Words of a training part, parts of a document (longer parts, if that is too few for all words), passes, first step.
PART, PARTS, PASSES, STEP = 40, 5, 2, 4.0

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
_letters = regex.compile(r"\p{L}+").findall


def grams(run: str) -> list[int]:
    """Buckets of the n-grams (2 to 4 characters, with marked ends) of a run of letters."""
    run = f"<{run}>"
    if run.isascii():
        marked, n = run.encode(), len(run)
        return [zlib.crc32(marked[i : i + size]) % BUCKETS for size in (2, 3, 4) for i in range(n - size + 1)]
    return [zlib.crc32(run[i : i + size].encode()) % BUCKETS for size in (2, 3, 4) for i in range(len(run) - size + 1)]


def letter_runs(word: bytes) -> list[str]:
    core = word.strip(_MARKS)
    if core.isalpha():  # of bytes: ASCII letters alone
        return [core.lower().decode()]
    return _letters(word.decode("utf-8", "replace").lower())


def subwords(word: bytes) -> list[int]:
    """Buckets of all n-grams of a word's runs of letters."""
    return [g for run in letter_runs(word) for g in grams(run)]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: the embedding of each bucket times the layer
    bias: np.ndarray
    temperature: float
    least: float  # rejects below this score

    def logits(self):
        """A function of one UTF-8 text (or None): the logits before temperature, or None if no letter is in it."""
        k = len(self.languages)
        table = np.concatenate([self.table, np.ones((BUCKETS, 1))], 1)  # the last column counts n-grams
        runs = WordRows(k + 1, lambda run: np.add.reduce(table[grams(run)]))

        def row(word: bytes) -> np.ndarray:  # a word with other marks or case around it has the same runs
            own = letter_runs(word)
            if len(own) == 1:
                at = runs[own[0]]  # first, as it may replace the block
                return runs.block[at]
            at = [runs[run] for run in own]
            return runs.block[at].sum(0) if at else np.zeros(k + 1)

        rows = WordRows(k + 1, row)

        def logits(text: bytes | None) -> np.ndarray | None:
            runs.trim()
            at = rows.rows((text or b"").split())
            sums = rows.block[at].sum(0, dtype=np.float64)
            return sums[:k] / sums[k] + self.bias if k and sums[k] else None

        return logits

    def scorer(self):
        """A function of one UTF-8 text (or None): (language or 'und', score).

        Its table stays with the model, so later tasks of a worker find the words that earlier ones met."""
        if not hasattr(self, "_logits"):
            self._logits = self.logits()
        logits = self._logits

        def score(text: bytes | None) -> tuple[str, float]:
            x = logits(text)
            if x is None:
                return "und", 0.0
            best = int(x.argmax())
            return self.languages[best], float(1 / np.exp((x - x[best]) / self.temperature).sum())

        return score


def training_parts(text: bytes) -> bytes:
    """A whole text as at most PARTS training parts, each the counts of its n-grams, packed; every word is in one part.

    Parts follow each other as (length of what is compressed, compressed): the buckets as little-endian uint16 and then
    the counts as uint32.  The driver keeps them so and opens one at a time."""
    words = text.split()
    wide = max(PART, -(-len(words) // PARTS))
    out = []
    for at in range(0, len(words), wide):
        ids = [g for w in words[at : at + wide] for g in subwords(w)]
        if ids:
            own, many = np.unique(np.array(ids, np.uint32), return_counts=True)
            part = zlib.compress(own.astype("<u2").tobytes() + many.astype("<u4").tobytes(), 1)
            out += [len(part).to_bytes(4, "little"), part]
    return b"".join(out)


def cut_parts(packed: bytes) -> list[bytes]:
    """The compressed parts of a text."""
    at, out = 0, []
    while at < len(packed):
        n = int.from_bytes(packed[at : at + 4], "little")
        out.append(packed[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def opened(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a part."""
    plain = zlib.decompress(part)
    n = len(plain) // 6
    return np.frombuffer(plain, "<u2", n), np.frombuffer(plain, "<u4", n, 2 * n)


def fit(sample: list[tuple[int, bytes, str]], lost: float = LOST, seed: int = 7) -> Model:
    """Trains on (doc_id, ``training_parts`` of the text, language) rows; every fifth is held back for calibration.  No rows: a
    model without languages."""
    languages = sorted({x[2] for x in sample})
    k = len(languages)
    if not k:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    train, held = [], []
    for i, (_, packed, language) in enumerate(sample):
        own, y = cut_parts(packed), languages.index(language)
        if i % 5 == 0:
            held.append((own, y))
        else:
            train += [(part, y) for part in own]
    embed = rng.normal(0, 0.3, (BUCKETS, WIDTH))
    layer, bias = np.zeros((WIDTH, k)), np.zeros(k)
    steps, done = max(1, PASSES * len(train)), 0
    for _ in range(PASSES):
        for i in rng.permutation(len(train)):
            part, y = train[i]
            ids, many = opened(part)
            share = (many / many.sum())[:, None]
            step = STEP * (1 - done / steps)
            done += 1
            x = (embed[ids] * share).sum(0)
            p = x @ layer + bias
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= 0.1 * step * np.outer(x, p)
            bias -= 0.01 * step * p
            embed[ids] -= step * back * share
    return calibrated(Model(languages, embed @ layer, bias, 1.0, 0.0), held, lost)


def calibrated(model: Model, held: list[tuple[list[bytes], int]], lost: float) -> Model:
    """Temperature of least loss on the held-back rows, then the highest limit that costs at most ``lost`` of the right ones."""
    known = []
    for packed, y in held:
        if own := [opened(part) for part in packed]:
            known.append((sum(many @ model.table[ids] for ids, many in own) / sum(many.sum() for _, many in own) + model.bias, y))
    if not known:
        return model
    x, y = np.stack([a for a, _ in known]), np.array([b for _, b in known])

    def chances(t: float) -> np.ndarray:
        p = np.exp((x - x.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    model.temperature = min((0.25, 0.5, 1.0, 2.0, 4.0, 8.0), key=lambda t: -np.log(np.maximum(chances(t)[np.arange(len(y)), y], 1e-9)).sum())
    p = chances(model.temperature)
    right = np.sort(p.max(1)[p.argmax(1) == y])
    model.least = min(0.5, float(right[int(lost * len(right))])) if len(right) else 0.0
    return model


def train(docs: DataFrame, kept_out: int = 2, parts: int = 4, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from whole texts and non-null lang of at most ``per_language`` documents of each language outside the
    held-out fold, chosen by the hash of doc_id; an id that stands with several languages counts for the last by name."""
    rows = docs.where((fold(F.col("doc_id"), parts) != kept_out) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    labelled = rows.groupBy("doc_id").agg(F.max("lang").alias("label"))
    return fit(bounded_sample(docs, labelled, per_language, lambda: training_parts))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row.

    A null text, or one without a letter, is 'und' with score 0 and rejected; so is a text that scores below the model's
    limit, but it keeps the likeliest language.  Of equally likely languages the first in order of name is taken.
    Texts of any length are read whole.  Repeated rows are scored each for itself; lang, source, doc_id and any other
    column, whatever its name, play no part.  An empty table gives no row; a model that learned nothing says 'und'."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score, least = shared.value.scorer(), shared.value.least

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            said = [score(t) for t in raw(batch, "text")]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([p for _, p in said], pa.float64()), pa.array([x == "und" or p < least for x, p in said])],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, ["doc_id", "text"], "doc_id long, lang_pred string, score double, rejected boolean", make)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``identify`` does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score, least = shared.value.scorer(), shared.value.least

        def keep(texts: list[bytes | None]) -> np.ndarray:
            said = [score(t) for t in texts]
            return np.array([x != "und" and p >= least for x, p in said], bool)

        return keep

    return filter_texts(docs, make)


def predictions(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, lang_pred, score, rejected."""
    said = identify(docs, train(docs))
    return said.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
