"""Documents as ordered blocks, lossless views with their segments, and the map from spans back to blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def line_blocks(docs: DataFrame) -> DataFrame:
    """blocks(doc_id, position, raw_text, start, end): a block for each line of a text, with its place in the view.

    A map over Arrow batches: lines are split and their lengths summed for a whole batch at once, so the time is linear in
    the lines of a document, nothing is shuffled, and a row carries only its own line.  Null texts have no block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pc.split_pattern(batch.column(1), "\n")
            flat, many = lines.flatten(), np.diff(lines.offsets.to_numpy())
            if not len(flat):
                continue
            sizes = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(many)[:-1]])
            before = np.concatenate([[0], np.cumsum(sizes + 1)])
            starts = before[:-1] - np.repeat(before[np.minimum(first, len(flat) - 1)], many)
            own = batch.column(0).take(pa.array(np.repeat(np.arange(len(many)), many)))
            columns = [own, pa.array((np.arange(len(flat)) - np.repeat(first, many)).astype(np.int32)), flat.cast(pa.string()), pa.array(starts.astype(np.int32)), pa.array((starts + sizes).astype(np.int32))]
            made = pa.RecordBatch.from_arrays(columns, ["doc_id", "position", "raw_text", "start", "end"])
            for at in range(0, made.num_rows, 10_000):
                yield made.slice(at, 10_000)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, position int, raw_text string, start int, end int")


def document_view(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(views(doc_id, text), segments(doc_id, seg, kind, start, end, position)) of blocks(doc_id, position, raw_text).

    Blocks are joined by one separator; there are 2 n - 1 segments of n blocks, empty blocks with a segment of length 0."""
    w = Window.partitionBy("doc_id").orderBy("position")
    placed = blocks.withColumns({
        "_i": F.row_number().over(w) - 1,
        "start": F.coalesce(F.sum(F.length("raw_text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_next": F.lead("position").over(w),
    })
    end = F.col("start") + F.length("raw_text")
    both = F.array(
        F.struct((2 * F.col("_i")).alias("seg"), F.lit("source").alias("kind"), F.col("start").alias("start"), end.alias("end"), F.col("position").alias("position")),
        F.when(F.col("_next").isNotNull(), F.struct((2 * F.col("_i") + 1).alias("seg"), F.lit("separator").alias("kind"), end.alias("start"), (end + 1).alias("end"), F.lit(None).cast(blocks.schema["position"].dataType).alias("position"))),
    )
    segments = placed.select("doc_id", F.explode(F.filter(both, lambda s: s.isNotNull())).alias("s")).select("doc_id", "s.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "raw_text"))), lambda x: x["raw_text"]), "\n")
    return blocks.groupBy("doc_id").agg(text.alias("text")), segments


def source_map(spans: DataFrame, segments: DataFrame, width: int = 4096) -> DataFrame:
    """Spans (doc_id, start, end and more) with the segments they touch: seg, kind, position, from, to (relative to the segment).

    A range join as an equi-join: both sides are dealt to buckets of ``width`` characters and each pair counts only in
    its first common bucket, so a very long document is spread over tasks.  Empty spans touch nothing."""
    def dealt(df: DataFrame, a: str, b: str) -> DataFrame:
        last = F.greatest(F.col(a), F.col(b) - 1)
        return df.withColumn("_b", F.explode(F.sequence((F.col(a) / width).cast("int"), (last / width).cast("int"))))

    left = dealt(spans.where("start < end"), "start", "end")
    right = dealt(segments.select("doc_id", "seg", "kind", "position", F.col("start").alias("_s"), F.col("end").alias("_e")).where("_s < _e"), "_s", "_e")
    low, high = F.greatest("start", "_s"), F.least("end", "_e")
    joined = left.join(right, ["doc_id", "_b"]).where((low < high) & (F.col("_b") == (low / width).cast("int")))
    return joined.withColumns({"from": low - F.col("_s"), "to": high - F.col("_s")}).withColumn("whole", (F.col("from") == 0) & (F.col("_e") - F.col("_s") == F.col("to"))).drop("_b", "_s", "_e")


def reconstruct(mapped: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """Text of each mapped span from its blocks, to compare with the view's."""
    joined = mapped.join(blocks.select("doc_id", "position", "raw_text"), ["doc_id", "position"], "left")
    piece = F.when(F.col("kind") == "separator", F.lit("\n")).otherwise(F.substring(F.col("raw_text"), F.col("from") + 1, F.col("to") - F.col("from")))
    return joined.groupBy("doc_id", *key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", piece.alias("t")))), lambda x: x["t"]), "").alias("text"))
