"""Diagnostics of span sets: against the corpus, against samples, of parents and children, and the rubric over them.

Records have (*key, doc_id, ordinal, start, end); samples (sample_id, doc_id, s_start, s_end)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import adjacent_overlap, overlapping, touched_cut_contained, union_length

# Sizes of a record and of a parent above which the rubric has a concern.
RECORD_CONCERN, PARENT_CONCERN = 4000, 8000


def corpus_diagnostics(records: DataFrame, paragraphs: DataFrame, units: DataFrame, key: list[str]) -> DataFrame:
    """key, n, least, most, total, covered, extra, paragraphs_cut, units_cut, units_contained, n_combining.

    Cut paragraphs and units are counted once for each key; a record combines if it touches two units or more.  What a
    pair yields is reduced by document before it meets the other documents of its key."""
    size = F.col("end") - F.col("start")
    sizes = records.groupBy(*key).agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.sum(size).alias("total"))
    covered = union_length(records, [*key, "doc_id"]).groupBy(*key).agg(F.sum("covered").alias("covered"))

    def per_unit(units: DataFrame, name: str) -> DataFrame:
        pairs = touched_cut_contained(records, units)
        return pairs.groupBy(*key, "doc_id", "r_start").agg(F.max("cut").alias("cut"), F.max("contained").alias("contained")).groupBy(*key).agg(
            F.count_if("cut").alias(f"{name}_cut"), F.count_if("contained").alias(f"{name}_contained"))

    combining = overlapping(records, units).groupBy(*key, "doc_id", "ordinal").count().groupBy(*key).agg(F.count_if(F.col("count") > 1).alias("n_combining"))
    out = sizes.join(covered, key).join(per_unit(paragraphs, "paragraphs").drop("paragraphs_contained"), key, "left").join(per_unit(units, "units"), key, "left").join(combining, key, "left")
    return out.withColumn("extra", F.col("total") - F.col("covered")).na.fill(0)


def sample_diagnostics(records: DataFrame, samples: DataFrame, key: list[str]) -> DataFrame:
    """key, sample_id, n, covered, duplicated, whole, internal_edges, outside, largest for each key and sample that touch.

    covered is the union of what lies in the sample, duplicated what is there more than once, internal_edges the number of
    places inside the sample where a record starts or ends, outside the characters of its records beyond it."""
    own = [*key, "sample_id"]
    right = samples.select("sample_id", "doc_id", F.col("s_start").alias("r_start"), F.col("s_end").alias("r_end"))
    pairs = overlapping(records.select(*key, "doc_id", "ordinal", "start", "end"), right)
    shared, size = F.col("hi") - F.col("lo"), F.col("end") - F.col("start")
    sums = pairs.groupBy(*own).agg(
        F.count("*").alias("n"), F.sum(shared).alias("_shared"), F.max((F.col("start") <= F.col("r_start")) & (F.col("r_end") <= F.col("end"))).alias("whole"), F.max(size).alias("largest"),
    )
    covered = union_length(pairs, own, "lo", "hi")
    beyond = union_length(pairs, own).withColumnRenamed("covered", "_all")
    edge = pairs.select(*own, "r_start", "r_end", F.explode(F.array("start", "end")).alias("e")).where("r_start < e and e < r_end")
    edges = edge.groupBy(*own).agg(F.count_distinct("e").alias("internal_edges"))
    out = sums.join(covered, own).join(beyond, own).join(edges, own, "left")
    return out.select(*own, "n", "covered", (F.col("_shared") - F.col("covered")).alias("duplicated"), "whole", F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"), (F.col("_all") - F.col("covered")).alias("outside"), "largest")


def rubric(metrics: DataFrame, key: list[str]) -> DataFrame:
    """key, criterion, rating for metrics(key, sample_size, covered, units_cut, n_combining, largest, duplicated, largest_parent, structural)."""
    over = F.coalesce(F.col("largest"), F.lit(0))
    concern = lambda c, other: F.when(F.coalesce(c, F.lit(False)), "CONCERN").otherwise(other)
    ratings = {
        "source preservation": F.when(F.col("covered") == F.col("sample_size"), "PASS").otherwise("FAIL"),
        "legal boundary quality": concern((F.col("units_cut") > 0) | (F.col("n_combining") > 0), "UNCERTAIN"),
        "chunk size": concern(over > RECORD_CONCERN, "PASS"),
        "duplication / overlap": concern(F.col("duplicated") > 0, "PASS"),
        "context preservation": F.lit("UNCERTAIN"),
        "parent expansion": concern(F.col("largest_parent") > PARENT_CONCERN, "UNCERTAIN"),
        "metadata usefulness": F.lit("PASS"),
        "traceability / provenance": F.lit("PASS"),
        "long-unit handling": concern(F.col("structural") & (over > PARENT_CONCERN), "UNCERTAIN"),
    }
    rows = F.array(*[F.struct(F.lit(c).alias("criterion"), r.alias("rating")) for c, r in ratings.items()])
    return metrics.select(*key, F.explode(rows).alias("r")).select(*key, "r.*")


def group_metrics(children: DataFrame, key: list[str], requested: str = "overlap") -> DataFrame:
    """key, n, least, most, total, repeated, n_reduced of children(key, doc_id, unit, ordinal, start, end, overlap).

    repeated sums the overlaps with the child before; a child that overlaps it by less than requested is reduced."""
    size = F.col("end") - F.col("start")
    rows = adjacent_overlap(children, [*key, "doc_id", "unit"])
    return rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.sum(size).alias("total"), F.sum("overlap_before").alias("repeated"),
        F.count_if((F.col("ordinal") > 1) & (F.col("overlap_before") < F.col(requested))).alias("n_reduced"),
    )


def threshold_rows(units: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """limit, n, total, kinds, least, most: units larger than each limit (not equal), with a histogram of their kinds as
    'kind:n' in the order of the kinds; a limit that no unit exceeds has n 0 and nulls."""
    size = F.col("end") - F.col("start")
    counts = units.groupBy("kind").agg(F.count("*").alias("all"), *[f(F.when(size > x, size)).alias(f"{n}_{x}") for x in limits for n, f in (("c", F.count), ("lo", F.min), ("hi", F.max))])
    per = counts.select("kind", "all", F.explode(F.array(*[F.struct(F.lit(x).alias("limit"), F.col(f"c_{x}").alias("n"), F.col(f"lo_{x}").alias("lo"), F.col(f"hi_{x}").alias("hi")) for x in limits])).alias("r"))
    kinds = F.transform(F.array_sort(F.collect_list(F.when(F.col("r.n") > 0, F.struct("kind", "r.n")))), lambda x: F.concat_ws(":", x["kind"], x["n"]))
    return per.groupBy("r.limit").agg(F.sum("r.n").alias("n"), F.sum("all").alias("total"), F.array_join(kinds, ",").alias("kinds"), F.min("r.lo").alias("least"), F.max("r.hi").alias("most"))


def hybrid_aggregates(outputs: DataFrame) -> DataFrame:
    """kept, divided, children, payload, n_long, n_short of hybrid outputs(doc_id, unit, child, start, end): units kept
    and divided, their children, all characters with repeats, outputs above 2,000 and below 100 characters."""
    size = F.col("end") - F.col("start")
    per = outputs.groupBy("doc_id", "unit").agg(F.max("child").alias("c"), F.sum(size).alias("s"), F.count_if(size > 2000).alias("l"), F.count_if(size < 100).alias("t"))
    return per.agg(F.count_if(F.col("c") == 0).alias("kept"), F.count_if(F.col("c") > 0).alias("divided"), F.sum("c").cast("long").alias("children"), F.sum("s").alias("payload"), F.sum("l").alias("n_long"), F.sum("t").alias("n_short"))
