"""Reference excerpts against documents: mapping by title and address, and literal alignment."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation, probes, url_without_fragment

#: What becomes of a reference.
STATUSES = ("exact", "partial", "ambiguous", "unmatched")


def map_documents(references: DataFrame, registry: DataFrame) -> DataFrame:
    """reference_id, doc_ids, status: documents of equal title and address (without fragment)."""
    right = registry.select("doc_id", F.col("title").alias("_t"), url_without_fragment(F.col("url")).alias("_u"))
    joined = references.join(right, (references["title"] == F.col("_t")) & (url_without_fragment(references["url"]) == F.col("_u")), "left")
    found = joined.groupBy("reference_id").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    return found.withColumn("status", F.when(F.size("doc_ids") == 1, "exact").when(F.size("doc_ids") > 1, "ambiguous").otherwise("unmatched"))


def _search(patterns: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for i, pattern in patterns.value:
            automaton.add_word(pattern, (i, len(pattern)))
        automaton.make_automaton()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1).to_pylist()):
                found = [(i, end + 1 - n, end + 1) for end, (i, n) in automaton.iter(text)]
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(some), batch.schema.field(0).type), *[pa.array(c, pa.int32()) for c in zip(*some)]], ["doc_id", "pattern", "start", "end"])

    return run


def occurrences(patterns: DataFrame, texts: DataFrame, most: int = 32_000_000) -> DataFrame:
    """pattern, doc_id, start, end of all, also overlapping, places of patterns(pattern) in texts(doc_id, text).

    Patterns are the stated query set: distinct ones are dealt to blocks of about ``most`` characters, whose number follows
    from their whole size, and each block is an automaton that reads every text once in linear time.  Texts are neither
    shuffled nor joined.  Null and empty patterns and texts have no place."""
    spark, wanted = texts.sparkSession, patterns.where("pattern <> ''").select("pattern").distinct()
    blocks = max(1, -(-(wanted.agg(F.sum(F.length("pattern"))).first()[0] or 0) // most))
    rows = texts.where("text <> ''").select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = None
    for block in range(blocks):
        own = [r.pattern for r in wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).collect()]
        if not own and blocks > 1:
            continue
        sent = spark.sparkContext.broadcast(list(enumerate(own)))
        names = spark.createDataFrame(list(enumerate(own)), "i int, pattern string")
        found = rows.mapInArrow(_search(sent), f"doc_id {kind}, i int, start int, end int") if own else rows.limit(0).selectExpr("doc_id", "0 as i", "0 as start", "0 as end")
        part = found.join(names, "i").select("pattern", "doc_id", "start", "end")
        out = part if out is None else out.unionByName(part)
    return out


def align(excerpts: DataFrame, texts: DataFrame) -> DataFrame:
    """reference_id, doc_id, start, end of every occurrence of excerpts(reference_id, excerpt) in texts(doc_id, text)."""
    found = occurrences(excerpts.select(F.col("excerpt").alias("pattern")), texts)
    return found.join(excerpts.select("reference_id", F.col("excerpt").alias("pattern")), "pattern").select("reference_id", "doc_id", "start", "end")


def citation_locations(blocks: DataFrame, ends: DataFrame) -> DataFrame:
    """doc_id, family, number, start, end: from a block that leads with a label to the next such block, or to the end of
    the text; blocks(doc_id, position, raw_text, start and, optional, the marker's kind), ends(doc_id, n)."""
    kind = F.col("kind") if "kind" in blocks.columns else None
    rows = blocks.withColumn("c", citation(F.col("raw_text"), kind)).where("c is not null").select("doc_id", "c.*", "position", "start")
    nxt = F.lead("start").over(Window.partitionBy("doc_id").orderBy("position"))
    return rows.withColumn("_n", nxt).join(ends, "doc_id").select("doc_id", "family", "number", "start", F.coalesce("_n", "n").alias("end"))


def decide(references: DataFrame, texts: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """reference_id, status, n_full, n_hits for references(reference_id, excerpt and, optional, mapped, doc_id, family, number).

    A mapping (``mapped``) that is not exact is the status.  Where the excerpt stands, it is exact if it stands once, in a
    location of its own citation, else ambiguous.  Elsewhere its probes decide: partial if those compatible with the
    citation (all, without one) lie in one location (without citation: are one hit), ambiguous if there are more, else
    unmatched.  With ``doc_id`` only that document counts.  A null excerpt is unmatched."""
    given = {"mapped": "string", "doc_id": texts.schema["doc_id"].dataType.simpleString(), "family": "string", "number": "string"}
    refs = references.select("reference_id", "excerpt", *[F.col(c) if c in references.columns else F.lit(None).cast(t).alias(c) for c, t in given.items()])
    full = refs.select("reference_id", F.lit(True).alias("whole"), F.col("excerpt").alias("pattern"))
    probe = refs.select("reference_id", F.lit(False).alias("whole"), F.explode(probes(F.col("excerpt"))).alias("pattern"))
    sought = full.unionByName(probe)
    hits = occurrences(sought, texts).join(sought, "pattern").withColumnRenamed("doc_id", "_doc")
    hits = hits.join(refs.select("reference_id", "doc_id", "family", "number"), "reference_id").where("doc_id is null or doc_id = _doc")
    if locations is None:
        hits = hits.withColumn("_at", F.lit(None).cast("int"))
    else:
        at = locations.select(F.col("doc_id").alias("_d"), F.col("family").alias("_f"), F.lower("number").alias("_n"), F.col("start").alias("_at"), F.col("end").alias("_to"))
        hits = hits.join(at, (F.col("_doc") == F.col("_d")) & (F.col("family") == F.col("_f")) & (F.lower("number") == F.col("_n")) & (F.col("_at") <= F.col("start")) & (F.col("end") <= F.col("_to")), "left")
    fits = F.col("family").isNull() | F.col("_at").isNotNull()
    counts = hits.groupBy("reference_id").agg(
        F.count_if("whole").alias("n_full"), F.count_if(F.col("whole") & fits).alias("n_fit"), F.count_if(~F.col("whole") & fits).alias("n_hits"),
        F.count_distinct(F.when(~F.col("whole") & F.col("_at").isNotNull(), F.struct("_doc", "_at"))).alias("n_places"),
    )
    rows = refs.join(counts, "reference_id", "left").na.fill(0, ["n_full", "n_fit", "n_hits", "n_places"])
    single = F.when(F.col("family").isNotNull(), F.col("n_places") == 1).otherwise(F.col("n_hits") == 1)
    status = (
        F.when(F.col("mapped").isNotNull() & (F.col("mapped") != "exact"), F.col("mapped")).when(F.col("n_full") > 0, F.when((F.col("n_full") == 1) & (F.col("n_fit") == 1), "exact").otherwise("ambiguous"))
        .when(F.col("n_hits") > 0, F.when(single, "partial").otherwise("ambiguous")).otherwise("unmatched")
    )
    return rows.select("reference_id", status.alias("status"), "n_full", "n_hits")


def statuses(excerpts: DataFrame, found: DataFrame) -> DataFrame:
    """reference_id, n, status: exact for one occurrence, ambiguous for more, else unmatched."""
    counts = found.groupBy("reference_id").agg(F.count("*").alias("n"))
    rows = excerpts.select("reference_id").join(counts, "reference_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("status", F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").otherwise("unmatched"))
