"""Spans over texts: fixed windows in closed form, and boundary-aware windows."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grids of lengths and overlaps in per cent, and the triggers of oversized units.
FIXED_GRID = tuple((n, p) for n in (1000, 2000, 4000) for p in (0, 10, 20))
OVERSIZED_GRID = tuple((m, n, p) for m in ("exact", "boundary_aware") for n in (1000, 2000) for p in (0, 10))
TRIGGERS = (2000, 4000, 8000)


#: What ``str.isspace`` holds for a space.
_SPACE = re.compile(r"[\s\x1c-\x1f]")


def check(length: int, overlap: int) -> None:
    if type(length) is not int or type(overlap) is not int or length < 1 or not 0 <= overlap < length:
        raise ValueError("length and overlap must be whole numbers with 0 <= overlap < length")


def window_count(n: Column, length: int, overlap: int) -> Column:
    return F.when(n > 0, 1 + F.greatest(F.lit(0), F.ceil((n - length) / (length - overlap)))).otherwise(0).cast("int")


def _cut(text: Column, length: int, stride: int) -> Column:
    """The texts of all windows, in one pass: at each stride the next ``length`` code points are looked at.  What begins
    after the first window that reaches the end is left to the caller to drop."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{length}}})).{{1,{stride}}}"), F.lit(1))


def fixed_windows(texts: DataFrame, length: int, overlap: int, keep_text: bool = True) -> DataFrame:
    """Adds ordinal (from 1), start, end and text to each row of (doc_id, text and more); no row for an empty text.

    Time is linear in the text: all windows of a text are cut in one pass."""
    check(length, overlap)
    n, stride = F.length("text"), length - overlap
    count = window_count(n, length, overlap)
    if keep_text:
        cut = F.slice(_cut(F.col("text"), length, stride), F.lit(1), count)
        rows = texts.where(n > 0).select("*", n.alias("_n"), F.posexplode(cut).alias("_k", "_t"))
    else:
        rows = texts.select("*", n.alias("_n"), F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))).alias("_k"))
    rows = rows.withColumns({"ordinal": F.col("_k") + 1, "start": F.col("_k") * stride, "end": F.least(F.col("_k") * stride + length, F.col("_n"))})
    return rows.withColumn("text", F.col("_t")).drop("_n", "_k", "_t") if keep_text else rows.drop("_n", "_k", "text")


def span_windows(spans: DataFrame, length: int, overlap: int) -> DataFrame:
    """Replaces start and end of each row of (start, end and more) by the fixed windows inside, with ordinal; no text is read."""
    check(length, overlap)
    count = window_count(F.col("end") - F.col("start"), length, overlap)
    rows = spans.select("*", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))).alias("_k"))
    start = F.col("start") + F.col("_k") * (length - overlap)
    return rows.withColumns({"ordinal": F.col("_k") + 1, "start": start, "end": F.least(start + length, F.col("end"))}).drop("_k")


def fixed_grid(texts: DataFrame, grid: tuple[tuple[int, int], ...] = FIXED_GRID, keep_text: bool = False) -> DataFrame:
    """All configurations at once, in one scan: configuration, doc_id, ordinal, start, end and, if wanted, text.

    A text's windows are cut in one pass for each configuration, one configuration in memory at a time."""
    for n, p in grid:
        check(n, n * p // 100)
    configs = F.array(*[F.struct(F.lit(f"fixed-{n}-{p}").alias("configuration"), F.lit(n).alias("length"), F.lit(n * p // 100).alias("overlap")) for n, p in grid])
    n, stride = F.length("text"), F.col("c.length") - F.col("c.overlap")
    rows = texts.where(n > 0).select("doc_id", *(["text"] if keep_text else []), n.alias("_n"), F.explode(configs).alias("c"))
    count = (1 + F.greatest(F.lit(0), F.ceil((F.col("_n") - F.col("c.length")) / stride))).cast("int")
    if keep_text:
        cut = F.lit(None).cast("array<string>")
        for length, p in grid:
            cut = F.when(F.col("c.configuration") == f"fixed-{length}-{p}", _cut(F.col("text"), length, length - length * p // 100)).otherwise(cut)
        rows = rows.select("doc_id", "_n", "c", F.posexplode(F.slice(cut, F.lit(1), count)).alias("_k", "text"))
    else:
        rows = rows.select("doc_id", "_n", "c", F.explode(F.sequence(F.lit(0), count - 1)).alias("_k"))
    start = (F.col("_k") * stride).cast("int")
    return rows.select("doc_id", F.col("c.configuration").alias("configuration"), (F.col("_k") + 1).alias("ordinal"), start.alias("start"), F.least(start + F.col("c.length"), F.col("_n")).alias("end"), *(["text"] if keep_text else []))


#: Why a window ends where it does, and why the next one starts where it does.
ENDS = LAST, AT_PARAGRAPH, AT_SPACE, CUT = "parent_end", "paragraph_boundary", "whitespace_inside_paragraph", "exact_no_available_boundary"
STARTS = BY_PARAGRAPH, BY_SPACE, REDUCED, WITHOUT = "paragraph_overlap", "whitespace_overlap", "overlap_reduced_to_zero", "no_overlap"


class _Places:
    """Sorted places of a text, asked for the last one in (over, upto] and the first one in [least, below)."""

    def __init__(self, places: list[int]):
        self.places = places

    def last(self, over: int, upto: int) -> int | None:
        i = bisect_right(self.places, upto) - 1
        return self.places[i] if i >= 0 and self.places[i] > over else None

    def first(self, least: int, below: int) -> int | None:
        i = bisect_left(self.places, least)
        return self.places[i] if i < len(self.places) and self.places[i] < below else None


def aware(text: str, paragraphs: list[tuple[int, int]], target: int, overlap: int) -> list[tuple[int, int, str, str | None]]:
    """(start, end, why it ends there, why the next starts where it does) of one text.

    Two rules, each a list of what is tried in turn.  A window ends at the last paragraph edge it reaches beyond the one
    before, else after the last white space there, else at the exact length.  The next one starts at the first paragraph
    edge within the overlap, else, where a paragraph longer than a window is cut, after the first white space of that
    paragraph there, else where the window ended."""
    check(target, overlap)
    size = len(text)
    flat = [x for span in paragraphs for x in span]
    if flat != sorted(flat) or any(a == b for a, b in paragraphs) or flat and not 0 <= flat[0] <= flat[-1] <= size:
        raise ValueError("paragraph spans must be ordered, disjoint and inside the text")
    edges = _Places(sorted({0, size, *flat}))
    spaces = _Places([m.end() for m in _SPACE.finditer(text)])
    long = [(a, b) for a, b in paragraphs if b - a > target]
    begins = [a for a, _ in long]

    def end_of(start: int, before: int) -> tuple[int, str]:
        limit = start + target
        if limit >= size:
            return size, LAST
        tried = ((edges.last(before, limit), AT_PARAGRAPH), (spaces.last(before, limit), AT_SPACE), (limit, CUT))
        return next((place, why) for place, why in tried if place is not None)

    def start_after(start: int, end: int) -> tuple[int, str]:
        if not overlap:
            at = edges.first(max(start + 1, end), end)
            return (end, WITHOUT) if at is None else (at, BY_PARAGRAPH)
        least = max(start + 1, end - overlap)
        own = bisect_left(begins, end) - 1
        inside = own >= 0 and end < long[own][1]
        space = spaces.first(max(least, long[own][0] + 1), end) if inside else None
        tried = ((edges.first(least, end), BY_PARAGRAPH), (space, BY_SPACE), (end, REDUCED))
        return next((place, why) for place, why in tried if place is not None)

    out, start, end = [], 0, 0
    while end < size:
        end, why = end_of(start, end)
        after, how = (size, None) if why == LAST else start_after(start, end)
        out.append((start, end, why, how))
        start = after
    return out


def aware_grid(texts: DataFrame, settings: tuple[tuple[str, int, int], ...]) -> DataFrame:
    """The key columns, setting, ordinal, start, end, end_reason, next_start_reason for rows (keys, text, paragraphs
    array<struct<a, b>>) and each (setting, target, overlap).

    The next start depends on the chosen end, so this is a map over Arrow batches; rows stay where they are and are read
    once for all settings."""
    for _, target, overlap in settings:
        check(target, overlap)
    keys = [c for c in texts.columns if c not in ("text", "paragraphs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("paragraphs").to_pylist())):
                marks = [(s["a"], s["b"]) for s in spans or []]
                for name, target, overlap in settings:
                    rows = [(name, n, *row) for n, row in enumerate(aware(text or "", marks, target, overlap), 1)]
                    if rows:
                        own = [batch.column(k).take(pa.array([i] * len(rows))) for k in keys]
                        made = [pa.array(c, kind) for c, kind in zip(zip(*rows), _AWARE.types)]
                        yield pa.RecordBatch.from_arrays(own + made, keys + _AWARE.names)

    schema = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, "text", "paragraphs").mapInArrow(run, f"{schema}, setting string, ordinal int, start int, end int, end_reason string, next_start_reason string")


def aware_windows(texts: DataFrame, target: int, overlap: int) -> DataFrame:
    """doc_id, ordinal, start, end, end_reason, next_start_reason for rows (doc_id, text, paragraphs)."""
    return aware_grid(texts.select("doc_id", "text", "paragraphs"), (("", target, overlap),)).drop("setting")


def oversized_children(units: DataFrame, texts: DataFrame, least: int = TRIGGERS[0]) -> DataFrame:
    """setting, method, target, overlap, doc_id, unit, ordinal, start, end, end_reason of the units above ``least``
    characters, by all eight settings; exact ones have no reason.  Offsets are the document's."""
    own = units.where(F.col("end") - F.col("start") > least).select("doc_id", "unit", "start", "end")
    rows = cut_units(own, texts)
    names = {(m, n, p): f"{m}-{n}-{p}" for m, n, p in OVERSIZED_GRID}
    tuned = tuple((name, n, n * p // 100) for (m, n, p), name in names.items() if m == "boundary_aware")
    parts = [aware_grid(paragraph_spans(rows), tuned).drop("next_start_reason")]
    for (m, n, p), name in names.items():
        if m == "exact":
            parts.append(span_windows(own.withColumn("base", F.lit(0)), n, n * p // 100).withColumns({"setting": F.lit(name), "end_reason": F.lit(None).cast("string")}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    config = F.split("setting", "-")
    target = config[1].cast("int")
    return out.select("setting", config[0].alias("method"), target.alias("target"), F.floor(target * config[2].cast("int") / 100).cast("int").alias("overlap"), "doc_id", "unit", "ordinal", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"), "end_reason")


def cut_units(units: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, unit, base, text of units(doc_id, unit, start, end): each text meets its units once, as one row, and is cut
    in one pass."""
    listed = units.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("unit").cast("long").alias("unit"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("units"))
    rows = texts.select("doc_id", "text").join(listed, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                cut = [[u["unit"] for u in own], [u["start"] for u in own], [(text or "")[u["start"] : u["end"]] for u in own]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(own))), *[pa.array(c, k) for c, k in zip(cut, (pa.int64(), pa.int32(), pa.string()))]], ["doc_id", "unit", "base", "text"])

    return rows.select("doc_id", "text", "units").mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, unit long, base int, text string")


_AWARE = pa.schema([("setting", pa.string()), ("ordinal", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("end_reason", pa.string()), ("next_start_reason", pa.string())])


def paragraph_spans(docs: DataFrame) -> DataFrame:
    """Adds the spans of the lines, each with its newline, to (keys, text); empty ones are left out.  Linear in the text."""
    keys = [c for c in docs.columns if c != "text"]
    spans = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            lines = pc.split_pattern(texts, "\n")
            flat, many = lines.flatten(), np.diff(lines.offsets.to_numpy())
            sizes = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            if len(flat):
                sizes[(np.cumsum(many) - 1)[many > 0]] -= 1  # the last line has no newline
            ends = np.cumsum(sizes)
            base = np.repeat(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(many)[:-1]])] if len(many) else [], many).astype(np.int64)
            there = sizes > 0
            kept = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(many)])].astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array((x - base)[there].astype(np.int32)) for x in (ends - sizes, ends)], names=["a", "b"])
            made = pa.ListArray.from_arrays(pa.array(kept), pairs).cast(spans)
            made = pc.if_else(texts.is_null(), pa.scalar(None, spans), made)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], texts, made], [*keys, "text", "paragraphs"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{schema}, text string, paragraphs array<struct<a:int,b:int>>")
