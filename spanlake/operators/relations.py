"""Relations of spans: larger parents, what encloses a sample, children with their context, markers in view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import adjacent_overlap, covering, overlapping, union_length
from .summaries import length_summary

WIDE = ("section", "chapter")


def larger_parents(units: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, parent, first, last, start, end, n_members for anchors(doc_id, parent, first, last): the units from first to last.

    An equi-join on (document, unit): each anchor names its units."""
    named = anchors.where("first <= last").withColumn("unit", F.explode(F.sequence(F.col("first").cast("long"), F.col("last").cast("long"))))
    rows = units.join(named, ["doc_id", "unit"])
    return rows.groupBy("doc_id", "parent", "first", "last").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_members"))


def expansion(members: DataFrame, key: list[str]) -> DataFrame:
    """key, n, least, median, most of the ratio of a parent's size (p_size) to its child's (c_size), by nearest rank."""
    rows = members.where("c_size > 0").withColumn("ratio", F.col("p_size") / F.col("c_size"))
    return length_summary(rows, key, "ratio").select(*key, "n", "least", F.col("p50").alias("median"), "most")


def parent_coverage(samples: DataFrame, parents: DataFrame) -> DataFrame:
    """sample_id, covered, whole, partial: characters of a sample under parents(doc_id, parent, start, end), and the sorted
    parents that contain it and that touch it only in part, joined by commas.  Samples that no parent touches count 0."""
    left = samples.select("sample_id", "doc_id", F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    pairs = overlapping(left, parents.select("doc_id", "parent", F.col("start").alias("r_start"), F.col("end").alias("r_end")))
    inside = (F.col("r_start") <= F.col("start")) & (F.col("end") <= F.col("r_end"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("parent")))).cast("array<string>"), ",")
    lists = pairs.groupBy("sample_id").agg(names(inside).alias("whole"), names(~inside).alias("partial"))
    out = samples.select("sample_id").join(union_length(pairs, ["sample_id"], "lo", "hi"), "sample_id", "left").join(lists, "sample_id", "left")
    return out.na.fill(0, ["covered"]).na.fill("", ["whole", "partial"])


def enclosing(samples: DataFrame, parents: DataFrame) -> DataFrame:
    """sample_id, choice, parent for parents(doc_id, parent, kind, start, end): the parents to show a sample in.

    Parents of no wide kind that touch it are taken together if they cover it ('small'); else the smallest one that
    encloses it, of equal ones the first ('enclosing'); else whatever touches it ('partial')."""
    left = samples.select("sample_id", "doc_id", F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    right = parents.select("doc_id", "parent", "kind", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = overlapping(left, right).withColumn("small", ~F.coalesce(F.col("kind").isin(*WIDE), F.lit(False)))
    full = union_length(pairs.where("small"), ["sample_id"], "lo", "hi").join(samples, "sample_id").where("covered = s_end - s_start").select("sample_id", F.lit(True).alias("_full"))
    w = Window.partitionBy("sample_id").orderBy(F.col("r_end") - F.col("r_start"), "parent")
    best = covering(left, right).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("sample_id", F.col("parent").alias("_best"))
    rows = pairs.join(full, "sample_id", "left").join(best, "sample_id", "left")
    choice = F.when(F.col("_full"), F.when(F.col("small"), "small")).when(F.col("_best").isNotNull(), F.when(F.col("parent") == F.col("_best"), "enclosing")).otherwise("partial")
    return rows.select("sample_id", choice.alias("choice"), "parent").where("choice is not null")


def with_context(spans: DataFrame, units: DataFrame, registry: DataFrame) -> DataFrame:
    """Spans(doc_id, ordinal, unit, start, end) with their unit's kind and label, the registry's columns of their document
    and their overlaps with the spans before and after.  A span without unit or registry row is left out."""
    rows = adjacent_overlap(spans, ["doc_id"]).join(units.select("doc_id", "unit", "kind", "label"), ["doc_id", "unit"])
    return rows.join(registry, "doc_id")


def resolve(links: DataFrame, child: str, link_set: str) -> str:
    """The parent of a child in a set of links; anything but one link is an error."""
    found = links.where((F.col("child_id") == child) & (F.col("link_set") == link_set)).select("parent_id").take(2)
    if len(found) != 1:
        raise ValueError(f"{child!r} has {'no link' if not found else 'more than one link'} in {link_set!r}")
    return found[0].parent_id


def unlike_children(one: DataFrame, two: DataFrame, key: list[str]) -> DataFrame:
    """key of units whose ordered children (key, ordinal, start, end) differ between two contexts, or stand in one alone."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end"))).alias(name))

    return listed(one, "a").join(listed(two, "b"), key, "full").where("not (a <=> b)").select(*key)


def marker_spans(blocks: DataFrame) -> DataFrame:
    """doc_id, kind, label, first, stop for blocks(doc_id, position, kind, label, is_stop): from a marker to the next block
    that is a marker or a heading; stop is null for the last one."""
    stops = blocks.where(F.col("kind").isNotNull() | F.coalesce(F.col("is_stop"), F.lit(False)))
    rows = stops.withColumn("stop", F.lead("position").over(Window.partitionBy("doc_id").orderBy("position")))
    return rows.where("kind is not null").select("doc_id", "kind", "label", F.col("position").alias("first"), "stop")


def observed_context(blocks: DataFrame, points: DataFrame, k: int = 6) -> DataFrame:
    """doc_id, at, rank, position: the last k marker blocks(doc_id, position) at or before each of points(doc_id, at).

    Each marker is ranked within its document first, so a point meets k of them, not all."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("position"))
    ranked = blocks.select("doc_id", "position").distinct().withColumn("_n", n)
    both = ranked.select("doc_id", F.col("position").alias("at"), "_n", F.lit(0).alias("_p")).unionByName(points.select("doc_id", "at").distinct().select("doc_id", "at", F.lit(None).cast("int").alias("_n"), F.lit(1).alias("_p")))
    upto = F.max("_n").over(Window.partitionBy("doc_id").orderBy("at", "_p").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_upto", upto).where("_p = 1 and _upto is not null").select("doc_id", "at", F.posexplode(F.sequence(F.col("_upto"), F.greatest(F.col("_upto") - k + 1, F.lit(1)))).alias("_i", "_n"))
    return found.join(ranked, ["doc_id", "_n"]).select("doc_id", "at", (F.col("_i") + 1).alias("rank"), "position")
