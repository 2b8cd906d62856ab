"""Summaries: nearest-rank percentiles, histograms, shares, runs, picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (25, 50, 75, 90, 95)


def length_summary(values: DataFrame, key: list[str], value: str, percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """key, n, least, p25 ... p95, most, by nearest rank.

    Values are counted before they are ordered, so a hot key costs as many rows as it has different values."""
    rows = values.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*key).orderBy(value)
    rows = rows.withColumns({"_up": F.sum("_c").over(w), "_n": F.sum("_c").over(Window.partitionBy(*key))})
    picks = [F.min(F.when(F.col("_up") >= F.ceil(F.col("_n") * p / 100), F.col(value))).alias(f"p{p}") for p in percentiles]
    return rows.groupBy(*key).agg(F.sum("_c").alias("n"), F.min(value).alias("least"), *picks, F.max(value).alias("most"))


def shares_above(values: DataFrame, value: str, limits: tuple[int, ...]) -> DataFrame:
    """limit, n, total, percent: how many values exceed each limit, in one pass; equality does not."""
    one = values.agg(F.count(value).alias("total"), *[F.count_if(F.col(value) > x).alias(f"_{x}") for x in limits])
    rows = one.select("total", F.explode(F.array(*[F.struct(F.lit(x).alias("limit"), F.col(f"_{x}").alias("n")) for x in limits])).alias("r"))
    return rows.select("r.limit", "r.n", "total", F.round(100 * F.col("r.n") / F.col("total"), 2).alias("percent"))


def repeated_blocks(blocks: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, raw_text, n, extra_chars, positions (the first three) of blocks that stand more than once in a document."""
    rows = blocks.where(F.length("raw_text") >= least).groupBy("doc_id", "raw_text").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("position")), 1, 3).alias("positions"))
    return rows.where("n > 1").select("doc_id", "raw_text", "n", (F.length("raw_text") * (F.col("n") - 1)).alias("extra_chars"), "positions")


def runs(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """key, run, value, first, last, n: stretches of equal consecutive values."""
    w = Window.partitionBy(*key).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return marked.groupBy(*key, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def top(rows: DataFrame, key: list[str], by: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; give a unique tie-break last in ``by``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where(F.col("rank") <= k)


def nearest_to_median(rows: DataFrame, key: list[str], value: str, tie: str) -> DataFrame:
    mid = length_summary(rows, key, value).select(*key, F.col("p50").alias("median"))
    w = Window.partitionBy(*key).orderBy(F.abs(F.col(value) - F.col("median")), tie)
    return rows.join(mid, key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def evenly_spaced(rows: DataFrame, key: list[str], order: str, k: int) -> DataFrame:
    """Rows at bround(i (n - 1) / (k - 1)) for i below k, or all of k rows or fewer."""
    w = Window.partitionBy(*key)
    marked = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(1, k - 1))).cast("int"))
    return marked.where((F.col("_n") <= k) | F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def histogram(rows: DataFrame, value: str, categories: tuple[str, ...]) -> DataFrame:
    """value, n in the order of the categories, zeros included."""
    counts = rows.agg(*[F.count_if(F.col(value) == c).alias(f"c{i}") for i, c in enumerate(categories)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias(value), F.col(f"c{i}").alias("n")) for i, c in enumerate(categories)])).alias("r")).select("r.*")
