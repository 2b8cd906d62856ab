"""Algebra of half-open intervals (start, end) within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersection_length(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def union_length(spans: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """key, covered: the length of the union of each key's intervals; a reversed interval is an error.

    Equal intervals are merged before the shuffle."""
    rows = spans.groupBy(*key, start, end).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(end).over(w)
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))))
    bad = F.raise_error(F.lit("reversed interval")).cast("long")
    return rows.select(*key, F.when(F.col(end) < F.col(start), bad).otherwise(fresh).alias("_f")).groupBy(*key).agg(F.sum("_f").alias("covered"))


def overlapping(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = 4096) -> DataFrame:
    """Pairs of intervals of one key that share at least a place, with lo and hi of what they share.

    ``right`` has r_start and r_end.  Both are dealt to buckets of ``width`` and a pair counts in its first common one."""
    def dealt(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.where(F.col(a) < F.col(b)).withColumn("_b", F.explode(F.sequence((F.col(a) / width).cast("long"), ((F.col(b) - 1) / width).cast("long"))))

    lo, hi = F.greatest("start", "r_start"), F.least("end", "r_end")
    joined = dealt(left, "start", "end").join(dealt(right, "r_start", "r_end"), [key, "_b"])
    return joined.where((lo < hi) & (F.col("_b") == (lo / width).cast("long"))).withColumns({"lo": lo, "hi": hi}).drop("_b")


def touched_cut_contained(records: DataFrame, units: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of a record and a unit that touch, with whether the record cuts the unit and whether it contains it."""
    pairs = overlapping(records, units, key)
    contained = (F.col("start") <= F.col("r_start")) & (F.col("r_end") <= F.col("end"))
    cut = ((F.col("r_start") < F.col("start")) & (F.col("start") < F.col("r_end"))) | ((F.col("r_start") < F.col("end")) & (F.col("end") < F.col("r_end")))
    return pairs.withColumns({"cut": cut, "contained": contained})


def covering(inner: DataFrame, outer: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs where the interval of ``outer`` (r_start, r_end) contains that of ``inner``."""
    return overlapping(inner, outer, key).where("r_start <= start and end <= r_end").drop("lo", "hi")


def outermost(spans: DataFrame, key: list[str]) -> DataFrame:
    """Spans that lie in no other of their key, of nested or disjoint ones."""
    w = Window.partitionBy(*key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_m", F.max("end").over(w)).where("_m is null or end > _m").drop("_m")


def elementary(spans: DataFrame, key: list[str]) -> DataFrame:
    """key, start, end, depth: the pieces between all edges, and how many spans cover each."""
    edge = spans.where("start < end").select(*key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    at = edge.groupBy(*key, F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*key).orderBy("start")
    return at.withColumns({"end": F.lead("start").over(w), "depth": F.sum("d").over(w)}).where("end is not null").select(*key, "start", "end", "depth")


def adjacent_overlap(spans: DataFrame, key: list[str]) -> DataFrame:
    """Adds the overlap with the span before and after, at least 0."""
    w = Window.partitionBy(*key).orderBy("ordinal")
    before, after = F.lag("end").over(w) - F.col("start"), F.col("end") - F.lead("start").over(w)
    return spans.withColumns({"overlap_before": F.greatest(F.lit(0), F.coalesce(before, F.lit(0))), "overlap_after": F.greatest(F.lit(0), F.coalesce(after, F.lit(0)))})
