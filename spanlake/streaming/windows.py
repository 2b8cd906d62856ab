"""The row-local span operators over streams: what arrives is cut as it comes, with no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.windows import FIXED_GRID, fixed_grid


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of documents (doc_id, text) as a stream."""
    return spark.readStream.schema("doc_id long, text string").parquet(path)


def stream_windows(docs: DataFrame, out: str, checkpoint: str, grid: tuple[tuple[int, int], ...] = FIXED_GRID):
    """Appends the windows of each new document; the file sink and its checkpoint make a restart exact."""
    rows = fixed_grid(docs, grid, keep_text=True)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
