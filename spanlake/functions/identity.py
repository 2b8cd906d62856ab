"""Content-derived identities: sha256 over fixed templates, and fingerprints of whole results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_id(source_hash: Column, part: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws(":", source_hash, part, path), 256)


def record_id(prefix: str, *values: Column) -> Column:
    """prefix:sha256 of the values as a JSON array of strings; numbers and text of the same form differ."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.to_json(F.array(*[F.to_json(F.struct(v.alias("v"))) for v in values])), 256))


def fingerprint(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row (n, digest) for all rows and columns.

    With ``order`` the digest covers the rows' order through their rank in it, yet rows are never gathered: each row's
    hash, with its order columns inside, is summed."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.coalesce(F.sum(p), F.lit(0).cast("decimal(38,0)")).cast("string") for p in parts]
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", *sums, F.lit(",".join(order or []))), 256).alias("digest"))
