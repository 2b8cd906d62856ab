"""Near duplicates by b-bit MinHash.

Each text's set of word shingles is hashed to 128 minima.  Bands of four whole minima find candidates; the low bits of
all minima, packed into eight words, estimate the similarity of a candidate by bit counts, corrected for chance
collisions; what may reach the threshold is confirmed on the full sets.

Equal sets collapse first, so copies cost one representative.  In a bucket every member is then compared with the
bucket's first member only, which is linear in its size.  Where that leaves a bucket in more than one component, the
members of different components are compared with each other in blocks of bounded size, by bit counts and then on full
sets, and only the links that join components come out: no link between different sets is given up for a bucket's size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import durable, map_texts, raw, small, without

WORDS = 5
BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
#: Similarity as a fraction, in whole numbers.
OVER, UNDER = 75, 100
#: A pair is confirmed on full sets if its estimate is at most so far below the threshold (over four standard errors).
MARGIN = 0.19
#: Members of a bucket that one task compares with each other.
BLOCK = 512

_rng = np.random.default_rng(20_240_229)
_TIMES = (_rng.integers(0, 2**32, MINIMA, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_PLUS = _rng.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)[:, None]
_ODD = _rng.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


def shingles(text: bytes | None, table: WordHashes, words: int = WORDS) -> np.ndarray:
    """The set of a whole UTF-8 text as sorted 64-bit hashes; of fewer words the whole sequence is the only one."""
    found = (text or b"").lower().split()  # bytes.lower() changes A-Z alone
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, found), np.uint64, len(found))
    wide = min(words, len(h))
    n = len(h) - wide + 1
    out = np.full(n, wide, np.uint64)
    for k in range(wide):
        out += h[k : k + n] * _ODD[k]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(own: np.ndarray) -> np.ndarray:
    """128 minima of a set that is not empty; long sets in blocks, so memory stays small."""
    x, least = own.astype(np.uint32), np.full(MINIMA, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[at : at + 2048] * _TIMES + _PLUS).min(1), out=least)
    return least


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, sixteen to a word."""
    low = (least.astype(np.uint64) & np.uint64(2**BITS - 1)).reshape(-1, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)


def prints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), bands (array of long), bits (array of long); of an empty set the last three are null."""

    def make():
        table = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for text in raw(batch, "text"):
                own = shingles(text, table, words)
                row = [len(own), None, None, None]
                if len(own):
                    least = minima(own)
                    bands = [xxhash.xxh3_64_intdigest(b.tobytes(), seed=i) - 2**63 for i, b in enumerate(least.reshape(BANDS, ROWS))]
                    row[1:] = _digest(own.tobytes()), bands, packed_bits(least).view(np.int64).tolist()
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], ["doc_id", "n_shingles", "digest", "bands", "bits"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, ["doc_id", "text"], "doc_id long, n_shingles long, digest string, bands array<long>, bits array<long>", make)


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity from packed bits: of the minima that differ, one in sixteen agrees by chance."""
    differ = F.lit(0)
    for i in range(MINIMA // 16):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0**-BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for all rows of a block against all of another."""
    differ = np.zeros((len(a), len(b)), np.uint16)
    for i in range(a.shape[1]):
        x = a[:, i, None] ^ b[None, :, i]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differ += np.bitwise_count(x & np.uint64(0x1111111111111111))
    chance = 2.0**-BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


def _digest(own: bytes) -> str:
    return hashlib.blake2b(own, digest_size=16).hexdigest()


def full_sets(docs: DataFrame, texts_of: DataFrame, digests: DataFrame, words: int) -> DataFrame:
    """(digest, own): the full set behind each of ``digests``, as packed 64-bit hashes.

    ``texts_of`` names a document for each digest.  Only those texts are read again: their ids are broadcast if they are
    proven to be few, else joined by a shuffle.  A text whose set has another digest (its doc_id stands twice) is left out."""
    wanted = small(texts_of.join(digests, "digest", "left_semi"))

    def make():
        table = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [shingles(t, table, words).tobytes() for t in raw(batch, "text")]
            right = [_digest(x) == d for x, d in zip(own, batch.column(0).to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["digest", "own"]).filter(pa.array(right, pa.bool_()))

        return step

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(texts.join(wanted, "doc_id"), ["digest", "text"], "digest string, own binary", make)


def confirmed(docs: DataFrame, texts_of: DataFrame, pairs: DataFrame, words: int, over: int, under: int) -> DataFrame:
    """The pairs (a, b: nodes; da, db: digests of their sets) that reach the threshold on full sets."""
    sides = pairs.select(F.col("da").alias("digest")).union(pairs.select(F.col("db").alias("digest"))).distinct()
    sets = full_sets(docs, texts_of, sides, words)

    def both():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(under * common >= over * (len(x) + len(y) - common))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return step

    joined = pairs.join(sets.select(F.col("digest").alias("da"), F.col("own").alias("x")), "da").join(sets.select(F.col("digest").alias("db"), F.col("own").alias("y")), "db")
    return map_texts(joined, ["a", "b", "x", "y"], "a long, b long", both)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b) reaches, by alternating large and small stars.

    Each round is two aggregations and two joins on the node; rounds grow with the logarithm of a component's width.
    Minima are summed up before each shuffle.  The rows of a hub, 16 bytes each, meet its minimum in a join whose skewed
    side adaptive execution splits.  No link ever comes to the driver."""
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = durable(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())


def common(own: list[np.ndarray], left: np.ndarray, right: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of own[left[x]] and own[right[y]] for (x, y) in ``pairs``.

    Few pairs are intersected one by one; many at once, as products of 0/1 rows over 4,096 shingles at a time."""
    if len(pairs[0]) <= 2000:
        return np.array([len(np.intersect1d(own[left[x]], own[right[y]], assume_unique=True)) for x, y in zip(*pairs)], np.int64)
    _, column, many = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = np.cumsum(many > 1) - 1
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    keep = many[column] > 1
    row, column = row[keep], shared[column[keep]]
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        ones = np.zeros((len(own), 4096), np.float32)
        ones[row[a:b], column[a:b] - at] = 1
        total += ones[left] @ ones[right].T
    return np.rint(total[pairs]).astype(np.int64)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return np.ascontiguousarray(pa.compute.list_flatten(column.combine_chunks()).to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _in_blocks(members: DataFrame, least: float, over: int, under: int) -> DataFrame:
    """Links (a, b) between different components of a bucket, as many as it takes to join them.

    ``members`` has band, key, n (members of the bucket), node, component, bands, bits, own (the full set).  A bucket is
    dealt into blocks of about BLOCK members and each pair of blocks is a group of its own, so no task holds more than
    two blocks.  A pair is looked at in the first band that it has in common; bit counts say which pairs may reach the
    threshold, and those are decided on the full sets.  What comes out is at most a tree over the members."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = own.withColumn("p", F.explode(F.array_distinct(pair))).select("band", "key", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "node", "component", "bands", "bits", "own")

    def run(group: pa.Table) -> pa.Table:
        i, j, band = (group.column(c)[0].as_py() for c in ("i", "j", "band"))
        block, node, component = (group.column(c).to_numpy() for c in ("block", "node", "component"))
        bits, bands = _rows(group.column("bits")).view(np.uint64), _rows(group.column("bands"))
        own = [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        alike = _estimates(bits[left], bits[right])
        may = (alike >= least) & (component[left][:, None] != component[right][None, :])
        for k in range(band):
            may &= bands[left, k][:, None] != bands[right, k][None, :]
        pairs = np.nonzero(may)
        size = np.array([len(x) for x in own], np.int64)
        both = common(own, left, right, pairs)
        good = under * both >= over * (size[left[pairs[0]]] + size[right[pairs[1]]] - both)
        root = {int(c): int(c) for c in component}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for x, y in zip(left[pairs[0][good]].tolist(), right[pairs[1][good]].tolist()):
            p, q = find(int(component[x])), find(int(component[y]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return dealt.groupBy("band", "key", "i", "j").applyInArrow(run, "a long, b long")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the document with the smallest doc_id, of
    repeated rows of one doc_id one, and every row without doc_id."""
    out = without(docs, groups(docs).where("not kept"))
    again = durable(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return out
    return without(out, again).unionByName(out.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def groups(docs: DataFrame, words: int = WORDS, over: int = OVER, under: int = UNDER) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row of ``docs``.

    Documents are linked if under * |common shingles| >= over * |all shingles|; component_id is the smallest doc_id
    that can be reached.  Null and empty texts have an empty set and are linked with nothing; rows that share a doc_id
    are one document for linking; a row without doc_id is linked with nothing, has no component_id and is kept.
    """
    every = durable(prints(docs, words))
    known = every.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one class, and its smallest doc_id is its node
    classes = durable(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("bits").alias("bits")))
    text_of = classes.select("digest", F.col("node").alias("doc_id"))

    keys = classes.select("node", "digest", F.posexplode("bands").alias("band", "key"))
    sized = keys.groupBy("band", "key").agg(F.min(F.struct("node", "digest")).alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = durable(keys.join(sized, ["band", "key"]).select("band", "key", "n", "node", "digest", F.col("first.node").alias("a"), F.col("first.digest").alias("da")))
    least = over / under - MARGIN
    bits = classes.select("digest", "bits")

    def likely(pairs: DataFrame) -> DataFrame:
        x = bits.select(F.col("digest").alias("da"), F.col("bits").alias("x"))
        y = bits.select(F.col("digest").alias("db"), F.col("bits").alias("y"))
        return durable(pairs.join(x, "da").join(y, "db").where(estimate(F.col("x"), F.col("y")) >= least).select("a", "b", "da", "db"))

    stars = likely(buckets.where("digest <> da").select("a", F.col("node").alias("b"), "da", F.col("digest").alias("db")).distinct())
    same = known.join(classes.select("digest", "node"), "digest").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    # a doc_id with several texts is one document: its classes are linked through it
    twice = known.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    own = same.join(twice.select(F.col("doc_id").alias("a")), "a", "left_semi")
    links = durable(confirmed(docs, text_of, stars, words, over, under).union(own))
    found = durable(components(links))

    placed = buckets.join(found.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.where("n > 2").groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band", "key")
    rest = durable(placed.join(split, ["band", "key"], "left_semi").select("band", "key", "n", "node", "digest", "component"))
    if not rest.isEmpty():
        sets = full_sets(docs, text_of, rest.select("digest").distinct(), words)
        held = sets.join(classes.select("digest", "bands", "bits"), "digest")
        more = durable(_in_blocks(rest.join(held, "digest"), least, over, under))
        if not more.isEmpty():
            found = durable(components(links.union(more)))

    node_digest = classes.select("node", "digest")
    member = known.select("doc_id", "digest").distinct().join(node_digest, "digest").groupBy("doc_id").agg(F.min("node").alias("node"))
    named = member.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("c"))
    out = every.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("c", "doc_id"), "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
