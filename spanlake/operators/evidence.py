"""Views for readers and reviewers: neighbourhoods, first examples and witnesses, what is annotated, parents with their
children, label dictionaries, identities of spans; and the contracts of blocks, units, compositions and source maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlapping


def span_id(prefix: str, configuration: Column, doc: Column, start: Column, end: Column) -> Column:
    """prefix:sha256 over a fixed template of what tells a span from others; no value in it needs escaping."""
    said = F.concat(F.lit('["'), configuration, F.lit('",'), doc.cast("string"), F.lit(","), start.cast("string"), F.lit(","), end.cast("string"), F.lit("]"))
    return F.concat(F.lit(f"{prefix}:"), F.sha2(said, 256))


def classified(rows: DataFrame, fields: dict[str, str], label: str = "field") -> DataFrame:
    """Adds interpreted: the field that a row's label stands for, null for a label that the dictionary does not have.
    Labels are compared as they stand; repeated and empty rows stay."""
    named = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    return rows.withColumn("interpreted", named[F.col(label)])


def raw_values(rows: DataFrame, doc: int, field: str, fields: tuple[str, ...]) -> list[str | None]:
    """Values of a field of one document in the order of their rows; an unknown field or document is an error."""
    if field not in fields:
        raise ValueError(f"unknown field {field!r}")
    own = rows.where(F.col("doc_id") == doc)
    if own.isEmpty():
        raise ValueError(f"unknown document {doc!r}")
    return [r.raw_value for r in own.where(F.col("field") == field).orderBy("row_index").collect()]


def neighbourhood(points: DataFrame, blocks: DataFrame, width: int = 2) -> DataFrame:
    """sample_id, doc_id, position: blocks(doc_id, position) within ``width`` of any of points(sample_id, doc_id, position),
    each once; an equi-join on the position."""
    near = points.select("sample_id", "doc_id", F.explode(F.sequence(F.col("position") - width, F.col("position") + width)).alias("position")).distinct()
    return near.join(blocks.select("doc_id", "position"), ["doc_id", "position"]).select("sample_id", "doc_id", "position")


def first_of_kind(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by ``order``; one partial aggregate."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    return rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*key, "_r.*")


def witnesses(found: DataFrame, wanted: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """For each of ``wanted`` its first row of ``found``, with found false where there is none."""
    first = first_of_kind(found, key, order).withColumn("found", F.lit(True))
    return wanted.join(first, key, "left").na.fill(False, ["found"])


def represented(records: DataFrame, annotations: DataFrame, record_key: list[str], key: str = "doc_id") -> DataFrame:
    """record_key, n, ids: how many annotations(doc_id, annotation, r_start, r_end) each record touches and their ids in
    order, joined by commas; none is 0 and an empty text."""
    own = [key, *record_key]
    pairs = overlapping(records.select(*own, "start", "end"), annotations)
    ids = pairs.groupBy(*own).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("annotation")).cast("array<string>"), ",").alias("ids"))
    return records.select(*own).join(ids, own, "left").na.fill(0, ["n"]).na.fill("", ["ids"])


def with_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """doc_id, unit, start, end, n_children, children: each parent with the spans of its ordered children as
    'ordinal:start-end', joined by commas; a parent without any has 0 and an empty text."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end"))), lambda c: F.concat(c["ordinal"].cast("string"), F.lit(":"), c["start"].cast("string"), F.lit("-"), c["end"].cast("string")))
    listed = children.groupBy("doc_id", "unit").agg(F.count("*").alias("n_children"), F.array_join(said, ",").alias("children"))
    return parents.select("doc_id", "unit", "start", "end").join(listed, ["doc_id", "unit"], "left").na.fill(0, ["n_children"]).na.fill("", ["children"])


def partition_faults(units: DataFrame, ends: DataFrame) -> DataFrame:
    """check, violations: units that are empty or do not begin where the one before ends, documents(doc_id, n) whose first
    unit does not begin at 0 or whose last one does not end at n, and documents without units."""
    w = Window.partitionBy("doc_id").orderBy("unit")
    rows = units.withColumn("_before", F.lag("end").over(w))
    per = rows.groupBy("doc_id").agg(F.count_if(F.col("start") >= F.col("end")).alias("empty"), F.count_if(F.col("_before") != F.col("start")).alias("seam"), F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    return _counted(ends.join(per, "doc_id", "left"), {
        "empty": F.sum("empty"), "seam": F.sum("seam"), "first": F.count_if(F.col("_lo") != 0), "last": F.count_if(F.col("_hi") != F.col("n")), "missing": F.count_if(F.col("_lo").isNull()),
    })


def composition_faults(outputs: DataFrame, units: DataFrame, threshold: int) -> DataFrame:
    """check, violations of hybrid outputs(doc_id, unit, child, ordinal, start, end) against their units: small units that
    are not one whole span, large ones that were kept whole, units not covered from end to end, gaps between children, and
    documents whose ordinals are not 1 to n."""
    w = Window.partitionBy("doc_id", "unit").orderBy("child")
    rows = outputs.withColumn("_before", F.lag("end").over(w))
    per = rows.groupBy("doc_id", "unit").agg(F.count("*").alias("n"), F.min("child").alias("c"), F.min("start").alias("lo"), F.max("end").alias("hi"), F.count_if(F.col("start") > F.col("_before")).alias("gap"))
    both = units.select("doc_id", "unit", "start", "end").join(per, ["doc_id", "unit"], "full")
    small = F.col("end") - F.col("start") <= threshold
    broken = lambda ok: F.count_if(~F.coalesce(ok, F.lit(False)))
    one = _counted(both, {
        "kept": broken(~small | (F.col("n") == 1) & (F.col("c") == 0)), "divided": broken(small | (F.col("c") > 0)),
        "covered": broken((F.col("lo") == F.col("start")) & (F.col("hi") == F.col("end"))), "gap": F.sum("gap"),
    })
    order = outputs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count_distinct("ordinal").alias("k"))
    return one.unionByName(_counted(order, {"ordinal": broken((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("k") == F.col("n")))}))


def block_faults(blocks: DataFrame) -> DataFrame:
    """check, violations of blocks(doc_id, position, raw_text, start, end): positions that do not count from 0, sizes that
    are not the text's, starts that do not follow the block before and its separator, and repeated places."""
    w = Window.partitionBy("doc_id").orderBy("position", "start")
    rows = blocks.select("doc_id", "position", "start", "end", F.length("raw_text").alias("_n"))
    rows = rows.withColumns({"_i": F.row_number().over(w) - 1, "_before": F.lag("end").over(w), "_same": F.lag("position").over(w) == F.col("position")})
    return _counted(rows, {
        "position": F.count_if(F.col("position") != F.col("_i")), "size": F.count_if(F.col("end") - F.col("start") != F.col("_n")),
        "start": F.count_if(F.col("start") != F.coalesce(F.col("_before") + 1, F.lit(0))), "repeated": F.count_if("_same"),
    })


def map_faults(mapped: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """check, violations of a source map (key, seg, from, to) of ``spans``: parts that are empty, spans that their parts do
    not fill, and spans with more than one segment missing between two parts (an empty block has none)."""
    per = mapped.groupBy(*key).agg(F.count_if(F.col("from") >= F.col("to")).alias("e"), F.sum(F.col("to") - F.col("from")).alias("s"), F.count("*").alias("k"), (F.max("seg") - F.min("seg")).alias("w"))
    both = spans.select(*key, (F.col("end") - F.col("start")).alias("n")).join(per, key, "left")
    return _counted(both, {"empty": F.sum("e"), "filled": F.count_if(F.coalesce("s", F.lit(0)) != F.col("n")), "consecutive": F.count_if(F.col("w") >= 2 * F.col("k"))})


def _counted(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    one = rows.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])).alias("r")).select("r.*")
