"""Results under a name that holds their fingerprint: written once, verified by reading back, never replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.identity import fingerprint


def write_report(rows: DataFrame, folder: str, name: str, without: tuple[str, ...] = ("text",)) -> str:
    """Writes ``rows`` without text to folder/name.<digest>; returns the path.

    If that path is there, its rows must have the same fingerprint; after a write they are read back and compared.  The
    rows are written to a temporary name and renamed, so a half-written report is never found under its final name."""
    spark = rows.sparkSession
    kept = rows.drop(*without)
    digest = fingerprint(kept).first().digest
    path = f"{folder.rstrip('/')}/{name}.{digest[:16]}"
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(to(f"{path}/_SUCCESS")):
        kept.write.mode("overwrite").parquet(f"{path}.part")
        if not fs.rename(to(f"{path}.part"), to(path)):
            raise OSError(f"cannot rename to {path}")
    if fingerprint(spark.read.parquet(path).select(*kept.columns)).first().digest != digest:
        raise ValueError(f"{path} does not hold what was to be written")
    return path
