"""Toxicity by weak supervision.

Many voters fire or abstain on a document: lexicons of insults and of courtesy in four languages and patterns (an insult
addressed to somebody, shouting, masked letters, rows of exclamation marks, licence lines), all given beforehand, and
words and word beginnings of either polarity taken from a bounded labelled sample by a test of significance.  A
generative model of two latent classes estimates by expectation maximisation how often each voter fires in either class,
which gives its accuracy, and how voters correlate within a class; correlated voters count less.  A linear classifier on
hashed words, word beginnings and patterns learns from the posterior labels and generalises to words that no voter
knows.  Its scale is calibrated on labelled rows that it did not learn from.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_sample, fold, labels_of, map_texts, raw

#: Insults of a general lexicon by language; each word is a voter for toxic.
INSULTS = {
    "en": "clown disgusting dumb filthy idiot loser moron pathetic scum stupid trash vermin worthless".split(),
    "de": "abschaum drecksack dumm dummkopf ekelhaft erbärmlich idiot trottel versager wertlos widerlich".split(),
    "es": "asqueroso basura escoria estúpido idiota imbécil inútil patético payaso".split(),
    "fr": "abruti crétin dégoûtant imbécile minable ordure pathétique stupide".split(),
}
#: Words of courtesy; each is a voter for clean.
COURTESY = {
    "en": "please regards sincerely thanks".split(),
    "de": "bitte danke freundlich grüße".split(),
    "es": "gracias saludos".split(),
    "fr": "cordialement merci".split(),
}
#: Words that address somebody.
ADDRESS = frozenset("you your du dein dich ihr tú tu eres usted vous toi".split())

#: Patterns, each a voter: an address followed by an insult within four words, a tenth of ten words or more in capitals,
#: letters masked inside a word, rows of exclamation marks; and a licence line, which votes for clean.
PATTERNS = ADDRESSED, SHOUTING, MASKED, BANGS, LICENCE = range(5)
BUCKETS = 1 << 20
PLACES = BUCKETS + len(PATTERNS)
BEGINNINGS = (4, 5, 6)
#: The labelled sample: at most so many documents of each label, hashed by doc_id.
PER_LABEL = 3000
#: Mined voters are words that differ between the labels by so many standard deviations and by this factor; the classifier
#: uses features that differ between the posterior classes by so many, for toxic and for clean.
SIGNIFICANT, FACTOR = 2.3, 8
ALIKE = 0.5
USED_TOXIC, USED_CLEAN = 4.5, 8.0
ROUNDS, SETTLE = 30, 5

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_masked = re.compile(rb"[A-Za-z]+[*#$]+[A-Za-z]+").fullmatch
_licence = re.compile(rb"(?i)licen[cs]ed under|all rights reserved").search
_INSULTS = frozenset(w for own in INSULTS.values() for w in own)


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself in lower case without marks, and its beginnings."""
    text = word.decode("utf-8", "replace").strip(_MARKS).lower()
    if not text:
        return ()
    return (zlib.crc32(b"w" + text.encode()) % BUCKETS, *[zlib.crc32(b"b" + text[:k].encode()) % BUCKETS for k in BEGINNINGS if len(text) > k])


def patterns(text: bytes, words: list[bytes], distinct: set[bytes]) -> list[int]:
    """The patterns that hold in a whole text."""
    out = []
    low = {w: w.decode("utf-8", "replace").strip(_MARKS).lower() for w in distinct}
    insults, address = {w for w, x in low.items() if x in _INSULTS}, {w for w, x in low.items() if x in ADDRESS}
    if insults and address:
        last = -9
        for i, w in enumerate(words):
            if w in address:
                last = i
            elif w in insults and i - last <= 4:
                out.append(ADDRESSED)
                break
    letters = [w for w in words if w.isalpha() and len(w) > 2]
    if len(letters) >= 10 and 10 * sum(map(bytes.isupper, letters)) >= len(letters):
        out.append(SHOUTING)
    if any(map(_masked, distinct)):
        out.append(MASKED)
    if b"!!" in text:
        out.append(BANGS)
    if _licence(text):
        out.append(LICENCE)
    return out


class Features(dict):
    """Word to its features that ``wanted`` has (all, if None); bounded."""

    def __init__(self, wanted: np.ndarray | None = None, most: int = 500_000):
        super().__init__()
        self.wanted, self.most = wanted, most
        self.patterns = wanted is None or wanted[BUCKETS:].any()

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = word_features(word)
        if self.wanted is not None:
            found = tuple(f for f in found if self.wanted[f])
        if len(self) < self.most:
            self[word] = found
        return found

    def of(self, text: bytes | None) -> np.ndarray:
        """The distinct features of a whole text, in rising order; patterns come last."""
        words = (text or b"").split()
        distinct = set(words)
        out: set[int] = set()
        for found in map(self.__getitem__, distinct):
            if found:
                out.update(found)
        if self.patterns:
            held = (BUCKETS + p for p in patterns(text or b"", words, distinct))
            out.update(held if self.wanted is None else (f for f in held if self.wanted[f]))
        return np.array(sorted(out), np.int64)


def label_model(fires: np.ndarray, prior: float, start: np.ndarray, toxic: np.ndarray | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of ``fires`` (rows x voters: 1 fires, 0 abstains), the firing rates in class 0 and
    1, and the voters' correlations within the classes.

    ``toxic`` tells which voters vote for class 1 (all, if None; the others vote for class 0).  The class share stays at
    ``prior``.  Correlations are estimated in the first round and every SETTLE rounds from what the class rates leave
    unexplained; a voter that fires together with voters of its polarity that it is correlated with counts by 1 / (1 + the
    sum of those correlations), and a silent one by the root of the same over all voters."""
    n, m = fires.shape
    fires = fires.astype(np.float32)
    toxic = np.ones(m, bool) if toxic is None else toxic
    post = np.clip(start.astype(float), 0.02, 0.98)
    rate_0 = rate_1 = np.zeros(m)
    rho = held = np.zeros((m, m), np.float32)
    for k in range(rounds if n and m else 0):
        s = post.sum()
        rate_1 = (post.astype(np.float32) @ fires + np.where(toxic, 0.05, 0.001)) / (s + 1)
        rate_0 = ((1 - post).astype(np.float32) @ fires + np.where(toxic, 0.001, 0.05)) / (n - s + 1)
        rate_0, rate_1 = np.where(toxic, np.minimum(rate_0, rate_1 * 0.9), rate_0), np.where(toxic, rate_1, np.minimum(rate_1, rate_0 * 0.9))
        on, off = np.log(rate_1 / rate_0), np.where(toxic, np.log((1 - rate_1) / (1 - rate_0)), 0)
        if k % SETTLE == 0:
            rest = fires - (post[:, None] * rate_1 + (1 - post)[:, None] * rate_0).astype(np.float32)
            cov = rest.T @ rest / n
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            rho = np.clip(cov / sd[:, None] / sd, -1, 1)
            held = np.where((rho > 0.1) & (toxic[:, None] == toxic), rho, 0).astype(np.float32)
            np.fill_diagonal(held, 0)
        evidence = (fires * on / (1 + fires @ held)).sum(1) + (1 - fires) @ (off / np.sqrt(1 + held.sum(1)))
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
    return post, rate_0, rate_1, rho


def accuracies(rate_0: np.ndarray, rate_1: np.ndarray, prior: float, toxic: np.ndarray) -> np.ndarray:
    """How often each voter is right where it does not abstain."""
    one, zero = prior * rate_1, (1 - prior) * rate_0
    return np.where(toxic, one, zero) / np.maximum(one + zero, 1e-12)


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(PLACES, np.float32))
    bias: float = -2.0
    scale: float = 1.0
    shift: float = 0.0

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.flatnonzero(self.weights)
        return at, self.weights[at] * self.scale, self.bias * self.scale + self.shift


def significance(in_1: np.ndarray, in_0: np.ndarray, n_1: float, n_0: float) -> np.ndarray:
    """By how many standard deviations each feature is oftener in class 1 (less than 0: in class 0), by likelihood ratio."""
    seen = in_0 + in_1 + 1e-9
    gain = [x * np.log(np.maximum(x, 1e-9) / (seen * n / (n_0 + n_1))) for x, n in ((in_0, n_0), (in_1, n_1))]
    return np.sqrt(np.maximum(2 * (gain[0] + gain[1]), 0)) * np.sign(in_1 / n_1 - in_0 / n_0)


def given() -> tuple[np.ndarray, np.ndarray]:
    """Features of the voters that are known beforehand, and which of them vote for toxic."""
    words = [(f, toxic) for toxic, by in ((True, INSULTS), (False, COURTESY)) for own in by.values() for w in own for f in word_features(w.encode())[:1]]
    both = dict(words + [(BUCKETS + p, p != LICENCE) for p in PATTERNS])
    return np.array(list(both), np.int64), np.array(list(both.values()), bool)


def mine(docs: list[np.ndarray], y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(voters, toxic): the features of each voter and whether it votes for toxic.

    First the given ones, then every feature that differs significantly between the labels, of either polarity.  Mined
    features that fire on the same rows, or on at least ALIKE of the rows where either does, are one voter, so copies of a
    document do not vote with each of their words.  A voter with several features fires if any of them is there."""
    n = np.bincount(y, minlength=2)
    by = [np.bincount(np.concatenate([docs[i] for i in np.flatnonzero(y == label)]), minlength=PLACES).astype(float) for label in (0, 1)]
    z = significance(by[1], by[0], n[1], n[0])
    p, q = (by[1] + 0.5) / (n[1] + 1), (by[0] + 0.5) / (n[0] + 1)
    fixed, toxic = given()
    good = np.flatnonzero((z > SIGNIFICANT) & (p > FACTOR * q) | (z < -SIGNIFICANT) & (q > FACTOR * p))
    good = np.setdiff1d(good, fixed)
    wanted = np.zeros(PLACES, bool)
    wanted[good] = True
    marks = np.random.default_rng(1).integers(0, 2**63, len(docs), dtype=np.uint64)
    same = np.zeros(PLACES, np.uint64)
    for i, d in enumerate(docs):
        same[d[wanted[d]]] += marks[i]
    _, first, group = np.unique(same[good], return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    merged = np.split(good[order], np.cumsum(np.bincount(group))[:-1]) if len(good) else []
    order = np.argsort(-np.abs(z[good[first]]), kind="stable")
    merged, up = [merged[j] for j in order], z[good[first]][order] > 0
    fires = votes(docs, merged)
    both = fires.T @ fires
    size = np.diag(both)
    kept: list[int] = []
    for j in range(len(merged)):
        alike = [k for k in np.array(kept, np.int64)[both[j, kept] >= ALIKE * (size[j] + size[kept] - both[j, kept])] if up[k] == up[j]] if kept else []
        if alike:
            merged[alike[0]] = np.concatenate([merged[alike[0]], merged[j]])
        else:
            kept.append(j)
    return [np.array([f]) for f in fixed] + [merged[j] for j in kept], np.concatenate([toxic, up[kept]])


def votes(docs: list[np.ndarray], voters: list[np.ndarray]) -> np.ndarray:
    """rows x voters: 1 where a voter fires."""
    place = np.full(PLACES, -1)
    for j, own in enumerate(voters):
        place[own] = j
    out = np.zeros((len(docs), len(voters)), np.float32)
    for i, d in enumerate(docs):
        hit = place[d]
        out[i, hit[hit >= 0]] = 1
    return out


def packer():
    """A function of a UTF-8 text: its features as little-endian uint32."""
    table = Features()
    return lambda text: table.of(text).astype("<u4").tobytes()


def fit(sample: list[tuple[int, bytes, int]], share_of_1: float, seed: int = 5) -> Model:
    """Voters, label model, classifier and calibration from (doc_id, packed features, label) rows.  Without both labels: a
    model that says the same low score of everything."""
    y = np.array([x[2] for x in sample], np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return Model()
    docs = [np.frombuffer(packed, "<u4").astype(np.int64) for _, packed, _ in sample]
    held = np.arange(len(docs)) % 4 == 0
    if not ((y == 1) & held).any() or not ((y == 1) & ~held).any() or not ((y == 0) & ~held).any():
        held[:] = False
    learn = np.flatnonzero(~held)
    voters, toxic = mine([docs[i] for i in learn], y[learn])
    fires = votes([docs[i] for i in learn], voters)
    used = fires.any(0)
    own_share = float(np.clip((y[learn] == 1).mean(), 0.05, 0.95))
    post, *_ = label_model(fires[:, used], own_share, fires[:, toxic].any(1), toxic[used])

    # features that differ between the posterior classes beyond chance
    soft = np.zeros(PLACES), np.zeros(PLACES)
    for i, p in zip(learn, post):
        soft[1][docs[i]] += p
        soft[0][docs[i]] += 1 - p
    z = significance(soft[1], soft[0], post.sum() + 1e-9, (1 - post).sum() + 1e-9)
    wanted = (z > USED_TOXIC) | (z < -USED_CLEAN)
    used = [d[wanted[d]] for d in docs]

    rng = np.random.default_rng(seed)
    w, b = np.zeros(PLACES), float(np.log(own_share / (1 - own_share)))
    steps = np.full(PLACES, 1e-6)
    for _ in range(15):
        for k in rng.permutation(len(learn)):
            d = used[learn[k]]
            g = 1 / (1 + np.exp(-np.clip(b + w[d].sum(), -30, 30))) - post[k]
            steps[d] += g * g
            w[d] -= 0.3 * (g / np.sqrt(steps[d] + 1e-3) + 0.0003 * w[d])
            b -= 0.02 * g
    model = Model(w.astype(np.float32), b)

    # logistic calibration on rows held back, each label weighted by its share in the corpus
    rows = np.flatnonzero(held) if held.any() else learn
    x, t = np.array([b + w[used[i]].sum() for i in rows]), y[rows]
    share = np.where(t == 1, share_of_1 / max(1, (t == 1).sum()), (1 - share_of_1) / max(1, (t == 0).sum()))
    scale, shift = 1.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(scale * x + shift, -30, 30)))
        g = share * (p - t)
        scale, shift = max(0.2, scale - 0.5 * float((g * x).sum())), shift - 2.0 * float(g.sum())
    model.scale, model.shift = scale, shift
    return model


def train(docs: DataFrame, labels: DataFrame, kept_out: int = 0, parts: int = 5, per_label: int = PER_LABEL) -> Model:
    """Learns from the whole texts of at most ``per_label`` documents of each label outside the held-out fold, chosen by
    the hash of doc_id."""
    known = labels_of(labels, "toxic").where((fold(F.col("doc_id"), parts) != kept_out) & F.col("label").isin(0, 1))
    shares = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    there = docs.where("doc_id is not null").select("doc_id").distinct()
    sample = bounded_sample(docs, known.join(there, "doc_id", "left_semi"), per_label, packer)
    return fit(sample, shares.get(1, 0) / max(1, sum(shares.values())))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for each row.

    Null and empty texts have no feature and get the score of the bias; texts of any length are read whole.  Repeated rows
    are scored each for itself; labels, lang, source, doc_id and any other column, whatever its name, play no part.  An
    empty table gives no row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.compact())

    def make():
        at, values, bias = shared.value
        weights = np.zeros(PLACES)
        weights[at] = values
        table = Features(weights != 0)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([bias + weights[table.of(t)].sum() for t in raw(batch, "text")])
            p = 1 / (1 + np.exp(-np.clip(x, -40, 40)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, ["doc_id", "text"], "doc_id long, score double, predicted int", make)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    said = score(docs, train(docs, labels))
    return said.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
