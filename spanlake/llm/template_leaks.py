"""Benchmark decontamination by template canonicalisation.

Words lose case and surrounding marks; numbers, units after numbers, and names become typed placeholders.  Windows of
template words are hashed and joined with the windows of the benchmark items, so an item matches in spite of other
numbers and names.  The values behind the placeholders must then stand for each other consistently: one value of the
item for one value of the document throughout a match, and the other way round.

A window with too many placeholders says too little by itself.  It is searched for in two other ways: longer, until it has
enough fixed words, to the right and to the left; and by its words as they stand, which finds verbatim copies.  An item
without any other window is also searched for as a whole, its words of marks alone included: 'What is 12 + 5 - 3 * 7 ?' is
found with other numbers, as its signs are fixed words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import durable, map_texts, raw, without

WINDOW = 8
#: Items of fewer template words say too little as templates: they are searched for by all their words as they stand.
LEAST_WORDS = 5
#: A window with a larger share of placeholders is dense: it is made longer, and is searched for by its words as they stand.
MOST_SLOTS = 3 / 8
#: Dense windows are made longer up to so many words; where that is too few, only the words as they stand are left.
LONGEST = 64
#: A document leaks an item if at least this share of the item's windows is found consistently: of the plain ones, of
#: these and the ones made longer, or of all.
LEAST_SHARE = 0.4
#: Or if it has so many windows of the item in a row, however long the item is: 32 words as one passage.
LEAST_RUN = 25
#: A whole item is a template of its own if it has so many words, those of marks alone included, at least half of them
#: fixed, and so many of these with letters; up to LONGEST words.
WHOLE_WORDS, WHOLE_FIXED = 5, 2
#: Bits of the filter that documents' windows pass before the join, as a power of two: it has BITS_EACH bits for each window
#: of the benchmark, 32 MB at most.
LEAST_BITS, MOST_BITS, BITS_EACH = 22, 28, 32
#: Item windows that may be broadcast for the join, some 30 MB; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000

#: Words that are a unit when they follow a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet mile miles mg g kg t ton tons ounce ounces pound pounds ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees mph kmh kb mb gb tb".split()
)

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_number = re.compile(r"[+-]?\d[\d.,:/]*[a-z%°]{0,3}").fullmatch
WORD, NUMBER, UNIT, NAME = range(4)
_NAMES = ("", "<number>", "<unit>", "<name>")
_odd = np.random.default_rng(99).integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)
PLAIN, LONGER, EXACT, WHOLE = range(4)
_BASE = int(_odd[5]) & ~7 | 5
_BACK = pow(_BASE, -1, 1 << 64)
_SALTS = np.random.default_rng(98).integers(0, 2**63, 5, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SLOT_HASHES = np.array([0, *[xxhash.xxh3_64_intdigest(n) for n in _NAMES[1:]]], np.uint64)


class Words(dict):
    """Raw word to (hash of its lower-case core, or of its marks if it has none, flags): 1 number, 2 may be a unit, 4 written like a name, 8 ends a sentence, 16 has no core."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        text = word.decode("utf-8", "replace")
        core = text.strip(_MARKS)
        low = core.lower()
        flags = bool(_number(low)) + 2 * (low in UNITS) + 4 * (len(core) > 1 and core[0].isupper() and core[1:].islower()) + 8 * (text[len(text.rstrip("\"')]}")) - 1 :][:1] in (".", "!", "?", ":")) + 16 * (not core)
        out = xxhash.xxh3_64_intdigest(low or text), flags
        if len(self) < 500_000:
            self[word] = out
        return out


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of spans of any lengths, from sums of a polynomial."""
    n = len(values)
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            powers = np.full(2 * n, base, np.uint64)
            powers[0] = 1
            _powers[i] = np.cumprod(powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers[0][:n], out=sums[1:])
    out = (sums[ends] - sums[starts]) * _powers[1][starts] + _SALTS[salt]
    out = (out ^ (out >> np.uint64(32))) * _odd[0]
    return out ^ (out >> np.uint64(29))


@dataclass
class Template:
    hashes: np.ndarray  # of each template word
    kinds: np.ndarray  # WORD, NUMBER, UNIT or NAME
    values: np.ndarray  # hash of what stands there
    raw: np.ndarray  # the same with the words of marks alone
    there: np.ndarray  # which of these are template words

    def marked(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and kinds with the words of marks alone, which are fixed words."""
        hashes, kinds = self.raw.copy(), np.full(len(self.raw), WORD)
        hashes[self.there], kinds[self.there] = self.hashes, self.kinds
        return hashes, kinds

    def windows(self, size: int) -> np.ndarray:
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out += self.hashes[k : k + n] * _odd[k]
            out ^= out >> np.uint64(31)
        return out

    def dense(self, size: int) -> np.ndarray:
        """Places of the windows with too many placeholders."""
        slots = np.concatenate([[0], np.cumsum(self.kinds != WORD)])
        return np.flatnonzero(slots[size:] - slots[:-size] > MOST_SLOTS * size)

    def longer(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places, starts, ends, hashes) of dense windows of WINDOW words made longer to the right, and to the left, until they have as many fixed words as a plain one."""
        places = self.dense(WINDOW) if len(self.kinds) >= WINDOW else ()
        if not len(places):
            return []
        need = WINDOW - int(MOST_SLOTS * WINDOW)
        words = np.flatnonzero(self.kinds == WORD)
        before = np.concatenate([[0], np.cumsum(self.kinds == WORD)])
        out = []
        for way in range(2):
            nth = before[places + WINDOW] - need if way else before[places] + need - 1
            own = places[(nth >= 0) & (nth < len(words))]
            edge = words[nth[(nth >= 0) & (nth < len(words))]]
            starts, ends = (edge, own + WINDOW) if way else (own, edge + 1)
            fits = ends - starts <= LONGEST
            own, starts, ends = own[fits], starts[fits], ends[fits]
            if len(own):
                out.append((own, starts, ends, _spans(self.hashes, starts, ends, way)))
        return out

    def exact(self, size: int, places: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the words as they stand, for all windows or those at ``places``."""
        places = np.arange(max(0, len(self.values) - size + 1)) if places is None else places
        return _spans(self.values, places, places + size, 2)

    def whole(self, size: int) -> np.ndarray:
        """Hashes of all windows of the words as they stand, with those of marks alone."""
        places = np.arange(max(0, len(self.raw) - size + 1))
        return _spans(self.raw, places, places + size, 3)

    def wide(self, size: int) -> np.ndarray:
        """Hashes of all template windows with the words of marks alone."""
        places = np.arange(max(0, len(self.raw) - size + 1))
        return _spans(self.marked()[0], places, places + size, 4)


def template(text: bytes | None, table: Words) -> Template:
    """Canonical form of a whole text.  A name is a word with a capital and small letters that begins no sentence."""
    found = [table[w] for w in (text or b"").split()]
    values = np.fromiter((x[0] for x in found), np.uint64, len(found))
    flags = np.fromiter((x[1] for x in found), np.int64, len(found))
    there = (flags & 16) == 0
    ends = np.concatenate([[True], (flags[:-1] & 8) > 0]) if len(flags) else np.zeros(0, bool)
    number = (flags & 1) > 0
    every = values
    values, number, ends, flags = values[there], number[there], ends[there], flags[there]
    after = np.concatenate([[False], number[:-1]]) if len(flags) else np.zeros(0, bool)
    kinds = np.where(number, NUMBER, np.where(((flags & 2) > 0) & after, UNIT, np.where(((flags & 4) > 0) & ~ends, NAME, WORD)))
    return Template(np.where(kinds == WORD, values, _SLOT_HASHES[kinds]), kinds, values, every, there)


class Filter:
    """Which hashes may be among those that it was made of: two bits for each, no misses."""

    def __init__(self, hashes: np.ndarray):
        self.power = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * max(1, len(hashes)) - 1).bit_length()))
        bits = np.zeros(1 << self.power, bool)
        for at in self._places(hashes.view(np.uint64)):
            bits[at] = True
        self.bits = np.packbits(bits, bitorder="little")

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.power) - 1)
        return (hashes & mask).astype(np.int64), (hashes >> np.uint64(64 - self.power)).astype(np.int64)

    def may(self, hashes: np.ndarray) -> np.ndarray:
        one, two = self._places(hashes)
        there = (self.bits[one >> 3] >> (one & 7).astype(np.uint8) & 1).astype(bool)
        at = np.flatnonzero(there)
        there[at] = (self.bits[two[at] >> 3] >> (two[at] & 7).astype(np.uint8) & 1).astype(bool)
        return there


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def item_windows(items: DataFrame) -> DataFrame:
    """hash, size, item_id, at, way, n, kinds, slots: one to three rows for each window of each item.

    ``way`` is PLAIN, LONGER or EXACT, and n[way] counts the item's windows that have a row of this way or a smaller one;
    the last is all windows.  Items shorter than WINDOW are one window of their own length; those shorter than LEAST_WORDS
    are one EXACT window of all their words, with those of marks alone, and have minus its length as size.  An item without
    PLAIN windows has a row of way WHOLE and of that size too, if it says enough.  Null and empty items have none."""

    def make():
        table = Words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(8)]
            for key, text in zip(batch.column(0).to_pylist(), raw(batch, "text")):
                t = template(text, table)
                size = min(WINDOW, len(t.hashes))
                dense = t.dense(size) if size else np.zeros(0, np.int64)
                if size < LEAST_WORDS or len(dense) == len(t.hashes) - size + 1:
                    marked, n = t.marked()[1], [0, 0, 1 if size < LEAST_WORDS else len(dense)]
                    letters = int((t.kinds == WORD).sum())
                    if WHOLE_WORDS <= len(marked) <= LONGEST and 2 * int((marked == WORD).sum()) >= len(marked) and letters >= WHOLE_FIXED:
                        for column, value in zip(out, (int(_signed(t.wide(len(marked)))[0]), -len(marked), key, 0, WHOLE, n, marked.tolist(), _signed(t.raw).tolist())):
                            column.append(value)
                if size < LEAST_WORDS:
                    if len(t.raw):
                        for column, value in zip(out, (int(_signed(t.whole(len(t.raw)))[0]), -len(t.raw), key, 0, EXACT, [0, 0, 1], [], [])):
                            column.append(value)
                    continue
                hashes = _signed(t.windows(size)).tolist()
                rows = [(hashes[k], k, PLAIN, k, k + size) for k in sorted(set(range(len(hashes))) - set(dense.tolist()))]
                for places, starts, ends, own in t.longer():
                    rows += zip(_signed(own).tolist(), places.tolist(), [LONGER] * len(own), starts.tolist(), ends.tolist())
                rows += [(h, k, EXACT, k, k + size) for h, k in zip(_signed(t.exact(size, dense)).tolist(), dense.tolist())]
                n = [len({r[1] for r in rows if r[2] <= way}) for way in (PLAIN, LONGER, EXACT)]
                for h, k, way, a, z in rows:
                    for column, value in zip(out, (h, z - a, key, k, way, n, t.kinds[a:z].tolist(), _signed(t.values[a:z]).tolist())):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int8(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["hash", "size", "item_id", "at", "way", "n", "kinds", "slots"])

        return step

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, ["item_id", "text"], "hash long, size int, item_id long, at int, way tinyint, n array<int>, kinds array<tinyint>, slots array<long>", make)


def consistent(matches: list[tuple[int, int, list[int], list[int], list[int]]]) -> tuple[set[int], bool]:
    """Windows of an item that are found with consistent slots, and whether all their slots have the item's own values.

    ``matches`` has (place in the item, place in the document, kinds, item's values, document's values).  Matches on one
    diagonal are one reading; of all readings the one with the most consistent windows is taken first, and others add
    their windows if they agree with it."""
    by: dict[int, list] = {}
    for m in matches:
        by.setdefault(m[1] - m[0], []).append(m)
    there: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    found: set[int] = set()
    for _, own in sorted(by.items(), key=lambda x: (-len({m[0] for m in x[1]}), x[0])):
        for at, _, kinds, ours, theirs in sorted(own, key=lambda m: m[:2]):
            new_there, new_back = {}, {}
            for kind, x, y in zip(kinds, ours, theirs):
                if kind != WORD:
                    if there.get((kind, x), new_there.get((kind, x), y)) != y or back.get((kind, y), new_back.get((kind, y), x)) != x:
                        break
                    new_there[kind, x], new_back[kind, y] = y, x
            else:
                there |= new_there
                back |= new_back
                found.add(at)
    return found, all(x == y for (_, x), y in there.items())


def longest_run(matches: list[tuple[int, int, list[int], list[int], list[int]]], least: int) -> int:
    """Most windows in a row, on one diagonal, that are consistent among themselves; 0 if no row has ``least`` windows."""
    by: dict[int, list] = {}
    for m in matches:
        by.setdefault(m[1] - m[0], []).append(m)

    def rows(places: set[int]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in sorted(places):
            if out and out[-1][-1] == at - 1:
                out[-1].append(at)
            else:
                out.append([at])
        return [x for x in out if len(x) >= least]

    most = 0
    for own in by.values():
        for row in rows({m[0] for m in own}):
            found, _ = consistent([m for m in own if row[0] <= m[0] <= row[-1]])
            most = max([most, *map(len, rows(found))])
    return most


def leaks(docs: DataFrame, items: DataFrame, least_share: float = LEAST_SHARE, least_run: int = LEAST_RUN) -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_found, share, same_values: the documents that carry an item.

    The share is the largest of those of the plain windows, of these and the longer ones, and of all; of ties the last.
    A passage of ``least_run`` windows of the item in a row is enough whatever the share.
    Whole texts are searched.  Null and empty texts carry nothing, and rows without doc_id or item_id cannot be named
    and are left out; rows that share a doc_id are one document, and so are rows that share an item_id; of ties every item
    is returned; other columns, whatever their names, are ignored.  Empty tables give no row.
    """
    known = durable(item_windows(items.where("item_id is not null")))
    ways = {(r.way, r.size) for r in known.select("way", "size").distinct().collect()}
    sizes, exact = [sorted(n for w, n in ways if w == way and n > 0) for way in (PLAIN, EXACT)]
    whole, wide = [sorted(-n for w, n in ways if w == way and n < 0) for way in (EXACT, WHOLE)]
    longer = any(w == LONGER for w, _ in ways)
    hashes = known.select("hash").distinct().toArrow().column("hash").to_numpy()
    filtered = Filter(hashes)
    shared = docs.sparkSession.sparkContext.broadcast(filtered)
    if len(hashes) <= BROADCAST_WINDOWS and known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)

    def make():
        table, may = Words(), shared.value.may

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(5)]
            for key, text in zip(batch.column(0).to_pylist(), raw(batch, "text")):
                t = template(text, table)
                own = [(None, None, None, t.windows(size), size) for size in sizes] + [(None, None, None, t.exact(size), size) for size in exact]
                for places, starts, ends, hashes, size in own + [(*x, None) for x in t.longer()] if longer else own:
                    for i in np.flatnonzero(may(hashes)).tolist():
                        q, a, z = (i, i, i + size) if size else (int(places[i]), int(starts[i]), int(ends[i]))
                        for column, value in zip(out, (key, q, z - a, int(hashes[i : i + 1].view(np.int64)[0]), _signed(t.values[a:z]).tolist())):
                            column.append(value)
                for size in whole:
                    hashes = np.unique(t.whole(size))  # one place in a text is enough
                    for h in _signed(hashes[may(hashes)]).tolist():
                        for column, value in zip(out, (key, 0, -size, h, [])):
                            column.append(value)
                for size in wide:
                    hashes = t.wide(size)
                    for i in np.flatnonzero(may(hashes)).tolist():
                        for column, value in zip(out, (key, i, -size, int(hashes[i : i + 1].view(np.int64)[0]), _signed(t.raw[i : i + size]).tolist())):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "q", "size", "hash", "theirs"])

        return step

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = map_texts(rows, ["doc_id", "text"], "doc_id long, q int, size int, hash long, theirs array<long>", make)
    joined = found.join(known, ["hash", "size"]).select("doc_id", "item_id", "n", "at", "way", "q", "kinds", "slots", "theirs")

    def decide(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_pylist() for c in ("at", "q", "kinds", "slots", "theirs")]
        matches, ways, wanted = list(zip(*columns)), group.column("way").to_pylist(), group.column("n")[0].as_py()
        places, same, n = set(), False, 0
        single = [consistent([m]) for m, w in zip(matches, ways) if w == WHOLE]
        single = [alike for found, alike in single if found]
        matches, ways = [m for m, w in zip(matches, ways) if w != WHOLE], [w for w in ways if w != WHOLE]
        for way, many in enumerate(wanted):
            if many and (way == PLAIN or many > wanted[way - 1] or way in ways):
                found, alike = consistent([m for m, w in zip(matches, ways) if w <= way])
                if not n or len(found) * n >= len(places) * many:
                    places, same, n = found, alike, many
        if single and (len(places) < wanted[-1] or not same):  # the whole item, with these values or others
            places, same, n = set(range(wanted[-1])), any(single), wanted[-1]
        if not places or len(places) < least_share * n and not longest_run(matches, least_run):
            return group.slice(0, 0).select(["doc_id", "item_id"]).append_column("n_windows", pa.array([], pa.int64())).append_column("n_found", pa.array([], pa.int64())).append_column("share", pa.array([], pa.float64())).append_column("same_values", pa.array([], pa.bool_()))
        return pa.table({"doc_id": group.column("doc_id")[:1], "item_id": group.column("item_id")[:1], "n_windows": pa.array([n], pa.int64()), "n_found": pa.array([len(places)], pa.int64()), "share": [len(places) / n], "same_values": [same]})

    return joined.groupBy("doc_id", "item_id").applyInArrow(decide, "doc_id long, item_id long, n_windows long, n_found long, share double, same_values boolean")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that carry a benchmark item; all their columns, and rows without doc_id, stay."""
    return without(docs, leaks(docs, items))
