"""Quality rules by an isolation forest on rule statistics.

The statistics of a text (words, symbols, repeated lines and word windows, case) are counted on whole texts.  A forest
of random axis splits is grown on every document labelled good: each row goes to some of the trees, at least to one, so
the trees part the labelled rows among them and leave none out.  Documents that the forest isolates by short paths are
unlike any good one.  The limit is calibrated on every labelled row; a good one is scored there by the trees that it did
not grow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import WHITE, durable, labels_of, map_texts, raw

SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_upper", "n_letters")
RATES = ("x0", "x1", "x2", "x3", "x4", "x5")
#: A tree gets about SUBSAMPLE good rows, or more if there are more than TREES * SUBSAMPLE of them.  Its splits end at
#: the depth that parts SUBSAMPLE rows; a leaf knows how many of its tree's rows it holds.
TREES, SUBSAMPLE = 120, 256
#: The limit may cost at most this share of the good rows.
LOST = 0.005
#: Scores are counted in so many parts of their range before those of a part are ranked.
PARTS = 65536


def counts(text: bytes | None) -> tuple[int, int, int, int, int, int, int]:
    """BASE and then upper-case and all letters (ASCII and Latin-1 as UTF-8) of a whole text."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0, 0
    inner = text.translate(None, WHITE)
    chars = len(inner) - len(inner.translate(None, _FIRST))
    lines = [x for x in text.split(b"\n") if x.translate(None, WHITE)]
    repeated = 0
    if n >= 4:
        first: dict[bytes, int] = {}
        ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n)
        wide = len(first)
        if wide < 2_000_000:
            windows = (ids[:-2] * wide + ids[1:-1]) * wide + ids[2:]
        else:  # the product would overflow: number the pairs first
            pairs = np.unique(ids[:-1] * wide + ids[1:], return_inverse=True)[1]
            windows = pairs[:-1] * wide + ids[2:]
        _, at, many = np.unique(windows, return_inverse=True, return_counts=True)
        hit = many[at] > 1
        if hit.any():
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : k + len(hit)] |= hit
            repeated = int(cover.sum())
    upper = len(inner) - len(inner.translate(None, _UPPER))
    letters = upper + len(inner) - len(inner.translate(None, _LOWER))
    return n, chars, len(inner) - len(inner.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, upper, letters


#: Bytes that begin a code point; ASCII letters by case.
_FIRST = bytes(b for b in range(256) if b & 0xC0 != 0x80)
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def statistics(c: np.ndarray) -> np.ndarray:
    """The rates that the forest splits on, from rows of ``counts``."""
    c = c.astype(np.float64)
    n, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), c[:, 3]
    return np.stack([c[:, 1] / n, c[:, 2] / n, lines / n * 20, c[:, 4] / n, c[:, 5] / np.maximum(c[:, 6], 1), 1 - c[:, 6] / chars], 1)


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes; -1 in a leaf
    split: np.ndarray
    depth: np.ndarray  # at a leaf: its depth and the mean further depth of what it holds
    levels: int
    norm: float
    lot: np.ndarray  # trees x nodes: the feature of the node if it is split
    share: int  # trees that a good row grows, the next ones from its first
    limit: float = 1.0  # an anomaly scores above it

    def scores(self, x: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """2 ** (-mean path / usual path), from 0 to 1; near 1 for what is isolated at once.

        For rows that grew the forest, ``first`` has their first trees; the trees that a row grew are left out."""
        trees = len(self.feature)
        if not trees:
            return np.zeros(len(x))
        total, asked, rows = np.zeros(len(x)), np.zeros(len(x), np.int64), np.arange(len(x))
        for t, (feature, split, depth) in enumerate(zip(self.feature, self.split, self.depth)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.levels):
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            foreign = True if first is None else (first < 0) | ((t - first) % trees >= self.share)
            total += np.where(foreign, depth[node], 0.0)
            asked += foreign
        return 2.0 ** (-total / np.maximum(asked, 1) / self.norm)

    def reached(self, x: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Tree * nodes + node and the value that the node would be split by, for each row in each of its trees where it
        comes to a node of the level."""
        trees, nodes = self.feature.shape
        keys, values, rows = [], [], np.arange(len(x))
        for k in range(self.share):
            tree, node = (first + k) % trees, np.zeros(len(x), np.int64)
            for _ in range(level):
                f = self.feature[tree, node]
                right = x[rows, np.maximum(f, 0)] >= self.split[tree, node]
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            there = node >= 2**level - 1
            keys.append((tree * nodes + node)[there])
            values.append(x[rows, self.lot[tree, node]][there])
        return np.concatenate(keys), np.concatenate(values)


def _usual(n: np.ndarray | float) -> np.ndarray:
    """The mean path of a search that fails in a binary tree of n points."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n, 3)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m))


def grow_by_levels(n: int, spread: np.ndarray, ranges, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> Forest:
    """Random splits: a feature by lot, a value by lot over a range a little wider than the node's, but not below 0.

    ``n`` good rows differ by ``spread`` in each rate.  ``ranges`` takes the forest as grown so far and a level and returns,
    for the nodes of the level that rows come to, tree * nodes + node, the number of rows, and the least and the largest
    value of the node's feature; so the rows may lie anywhere.  All lots are drawn beforehand: the order of rows is
    nothing to the forest.  A row grows at most half of the trees, the others can judge it.

    No rate is negative, so a split below 0 would part nothing; where good rows are all 0 it would be every other split,
    and what has that rate would be isolated half as often."""
    levels = max(1, int(np.ceil(np.log2(max(min(subsample, n), 2)))))
    shape = trees, 2 ** (levels + 1) - 1
    feature, split, depth = np.full(shape, -1, np.int8), np.zeros(shape), np.zeros(shape)
    rng = np.random.default_rng(seed)
    lot, place = rng.integers(len(spread), size=shape).astype(np.int8), rng.random(shape)
    if not n:
        return Forest(feature[:0], split[:0], depth[:0], levels, 1.0, lot[:0], 1)
    share = max(1, min(trees // 2, -(-trees * subsample // n)))
    forest = Forest(feature, split, depth, levels, float(_usual(max(n * share / trees, 2))), lot, share)
    margin = 0.05 * (spread + 0.02)[lot]
    for level in range(levels + 1):
        own = slice(2**level - 1, 2 ** (level + 1) - 1)
        many, low, high = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        keys, *found = ranges(forest, level)
        for to, values in zip((many, low, high), found):
            to.flat[keys] = values
        there = feature[:, (np.arange(own.start, own.stop) - 1) // 2] >= 0 if level else np.ones((trees, 1), bool)
        parted = there & (many[:, own] >= 2) & (level < levels)
        depth[:, own] = np.where(there & ~parted, level + _usual(many[:, own]), 0.0)
        feature[:, own] = np.where(parted, lot[:, own], -1)
        low, high = np.maximum(low - margin, 0.0), high + margin
        split[:, own] = np.where(parted, (low + place * (high - low))[:, own], 0.0)
        if not parted.any():
            break
    return forest


def grow(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11, first: np.ndarray | None = None) -> Forest:
    """The forest of good rows that lie in memory; without ``first``, rows take their first trees in turn."""
    first = np.arange(len(x)) % trees if first is None else first

    def ranges(forest: Forest, level: int):
        keys, values = forest.reached(x, first, level)
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        found, at, many = np.unique(keys, return_index=True, return_counts=True)
        return found, many, values[at], values[at + many - 1]

    return grow_by_levels(len(x), np.ptp(x, axis=0) if len(x) else np.zeros(len(RATES)), ranges, trees, subsample, seed)


def failed(c: np.ndarray) -> np.ndarray:
    """The base rules: under 50 words, or over half of the words in repeated windows."""
    return (c[:, 0] < 50) | (100 * c[:, 4] > 50 * c[:, 0])


def _failed() -> Column:
    """``failed`` as a column."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each row; texts of any length are counted whole, null texts have zero counts."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            c = np.array([counts(t) for t in raw(batch, "text")], np.int64).reshape(-1, len(COUNTS))
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(v)) for v in c.T]], ["doc_id", *COUNTS])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, ["doc_id", "text"], f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}", make)


def _matrix(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in names], 1)


def rated(rows: DataFrame, labels: DataFrame, trees: int = TREES) -> DataFrame:
    """first, label and RATES of each row of ``counted`` that has a quality label and passes the base rules.

    ``first`` is the row's first tree, by the hash of doc_id.  Only counts are joined, never texts."""
    known = labels_of(labels, "quality").where(F.col("label").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    first = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("tree")), F.lit(trees)).alias("first")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = statistics(_matrix(batch, COUNTS))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(v)) for v in x.T]], ["first", "label", *RATES])

        return step

    used = rows.where(~_failed()).join(known, "doc_id").select(first, F.col("label").cast("long").alias("label"), *COUNTS)
    return map_texts(used, ["first", "label", *COUNTS], f"first long, label long, {', '.join(f'{c} double' for c in RATES)}", make)


def _with_forest(rows: DataFrame, forest: Forest, columns: list[str], schema: str, step) -> tuple[DataFrame, object]:
    """Maps batches by step(forest, batch); also the broadcast forest."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def make():
        forest = shared.value
        return lambda batch: step(forest, batch)

    return map_texts(rows, columns, schema, make), shared


def _ranges(good: DataFrame):
    """The ``ranges`` of ``grow_by_levels`` over rows of ``rated``: at most one row for each node comes to the driver."""

    def ranges(forest: Forest, level: int):
        def step(forest: Forest, batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, values = forest.reached(_matrix(batch, RATES), batch.column(0).to_numpy(), level)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], ["key", "value"])

        rows, shared = _with_forest(good, forest, ["first", *RATES], "key long, value double", step)
        found = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).toArrow()
        shared.unpersist()
        return [found.column(i).to_numpy() for i in range(4)]

    return ranges


def limit_of(scored: DataFrame, lost: float = LOST) -> float:
    """The score of a row of ``scored`` (score, label) that has the greatest balanced accuracy as a limit, among those that
    at most ``lost`` of the good rows lie above; of equal ones the least.

    Every row counts.  The driver sees one row for each of PARTS parts of the scores' range; equal scores are one row and
    are ranked within their part.  Without good rows it is 1."""
    each = durable(scored.groupBy("score").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).withColumn("part", F.floor(F.col("score") * PARTS).cast("long")))
    sums = sorted(((r.part, r.good, r.bad) for r in each.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()), reverse=True)
    n_good, n_bad = sum(g for _, g, _ in sums), sum(b for _, _, b in sums)
    above, good, bad = [], 0, 0
    for part, g, b in sums:
        if good > lost * n_good:
            break
        above.append((part, good, bad))
        good, bad = good + g, bad + b
    if not n_good:
        return 1.0
    higher = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    good, bad = [F.col(f"{c}_above") + F.coalesce(F.sum(c).over(higher), F.lit(0)) for c in ("good", "bad")]
    tries = each.join(F.broadcast(each.sparkSession.createDataFrame(above, "part long, good_above long, bad_above long")), "part").select("score", good.alias("good"), bad.alias("bad"))
    gain = F.col("bad") / max(n_bad, 1) - F.col("good") / n_good
    return tries.where(F.col("good") <= lost * n_good).orderBy(gain.desc(), "score").first().score


def train_counted(rows: DataFrame, labels: DataFrame, lost: float = LOST) -> Forest:
    """Grows on every row of ``counted`` that is labelled good and passes the base rules, and takes the limit over these and
    every one labelled bad.  Without good rows nothing is an anomaly."""
    known = durable(rated(rows, labels))
    good = known.where("label = 1")
    ends = good.agg(F.count("*").alias("n"), *[F.max(c) - F.min(c) for c in RATES]).first()
    forest = grow_by_levels(ends.n, np.array([v or 0.0 for v in ends[1:]]), _ranges(good))
    if not ends.n:
        return forest

    def step(forest: Forest, batch: pa.RecordBatch) -> pa.RecordBatch:
        first, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        odd = forest.scores(_matrix(batch, RATES), np.where(label == 1, first, -1))
        return pa.RecordBatch.from_arrays([pa.array(odd), batch.column(1)], ["score", "label"])

    scored, shared = _with_forest(known, forest, ["first", "label", *RATES], "score double, label long", step)
    forest.limit = limit_of(scored, lost)
    shared.unpersist()
    return forest


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    """Learns from the whole texts of all documents that have a quality label.  Repeated rows each count."""
    return train_counted(durable(counted(docs.where("doc_id is not null and text is not null"))), labels)


def judge_counted(rows: DataFrame, forest: Forest) -> DataFrame:
    """``judge`` for rows of ``counted``."""

    def step(forest: Forest, batch: pa.RecordBatch) -> pa.RecordBatch:
        c = _matrix(batch, COUNTS)
        odd, low = forest.scores(statistics(c)), failed(c)
        arrays = [*[batch.column(i) for i in range(1 + len(BASE))], pa.array(low), pa.array(~low & (odd <= forest.limit)), pa.array(odd)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *BASE, "base_failed", "kept", "anomaly"])

    return _with_forest(rows, forest, ["doc_id", *COUNTS], f"doc_id long, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean, anomaly double", step)[0]


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly for each row.

    Null and empty texts have zero counts and fail the base rules; texts of any length are counted whole.  Repeated rows
    are judged each for itself; columns beside doc_id and text, whatever their names, are ignored.  An empty table gives
    no row."""
    return judge_counted(counted(docs), forest)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows.  Texts are read once: their counts, some 70 bytes a row, are written in the shared folder."""
    rows = durable(counted(docs))
    return judge_counted(rows, train_counted(rows, labels))
