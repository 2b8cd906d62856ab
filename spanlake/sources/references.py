"""Reference rows: JSON lines with their line numbers, an allow list of fields, and missing ones as empty text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .docx import member

#: The fields of the input format.
FIELDS = ("document", "source_ref", "citation", "heading", "text")


def numbered_lines(spark: SparkSession, path: str, inside: str) -> DataFrame:
    """(line, value) of a member of the archives at ``path``; numbers start at 1 and count blank lines.  Lines end at
    whatever ``str.splitlines`` takes for an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                lines = member(content, inside).decode("utf-8").splitlines()
                yield pa.RecordBatch.from_arrays([pa.array(range(1, len(lines) + 1), pa.int32()), pa.array(lines)], ["line", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line int, value string")


def reference_rows(lines: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows of the lines that are not blank, with the allowed fields alone."""
    held = lines.where(F.trim("value") != "")
    return held.select(F.col("line").alias("archive_line"), *[F.coalesce(F.get_json_object("value", f"$.{f}"), F.lit("")).alias(f) for f in fields])


def lines_with(lines: DataFrame, literal: str) -> DataFrame:
    return lines.where(F.col("value").contains(literal)).select("line")
