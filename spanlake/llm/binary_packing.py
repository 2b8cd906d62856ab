"""Packing by power-of-two decomposition: a document becomes pieces of binary length, equal lengths share a bucket.

A sequence is one piece of one document, so attention never crosses documents, and as its length is a power of two it
needs no padding.  The work is row-local: no shuffle, and each task holds one batch of texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_texts, raw
from .subwords import chunk_ids, default_path

LONGEST = 4096
END_ID = 2


def lengths(tokens: int, longest: int) -> list[int]:
    """The binary lengths of ``tokens`` ids in falling order: whole ``longest`` pieces, then the set bits of the rest."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, end_id: int | None = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, bucket (log2 of length), ids (little-endian uint32), doc_tokens.

    ``longest`` is a power of two.  A null text counts as empty and has the end id alone (no row without ``end_id``);
    a null doc_id stays null; repeated rows are cut each for itself; texts of any length are cut whole; other columns of
    ``docs``, whatever their names, are ignored.  An empty table gives no row."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = tokenizer or default_path()
    tail = b"" if end_id is None else np.array(end_id, "<u4").tobytes()

    def make():
        table = chunk_ids(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), raw(batch, "text")):
                ids = table.of(text) + tail
                start, total = 0, len(ids) // 4
                for n in lengths(total, longest):
                    for column, value in zip(out, (key, start, n, n.bit_length() - 1, ids[4 * start : 4 * (start + n)], total)):
                        column.append(value)
                    start += n
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "start", "length", "bucket", "ids", "doc_tokens"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, ["doc_id", "text"], "doc_id long, start long, length long, bucket int, ids binary, doc_tokens long", make)


def sequences(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, end_id: int | None = END_ID) -> DataFrame:
    """``pieces`` with sequence_id and offset: each piece is a sequence of its own, so offset is 0.

    The id holds the task's number and the row's place in it, so it is unique without a shuffle."""
    return pieces(docs, tokenizer, longest, end_id).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(rows: DataFrame, path: str) -> None:
    """Writes pieces as Parquet, a folder for each bucket: a reader takes batches of equal lengths from one folder."""
    rows.write.partitionBy("bucket").mode("errorifexists").parquet(path)


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The contract's rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket."""
    return sequences(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
