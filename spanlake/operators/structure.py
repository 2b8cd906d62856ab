"""Structure of ordered blocks: documents, regions, the ledger of boundary decisions and the units between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import amends

CONTEXT = ("part", "chapter", "section")
STRUCTURAL = (*CONTEXT, "article", "paragraph_sign", "annex")


def documents_of(blocks: DataFrame) -> DataFrame:
    """Adds document (from 1; 0 is front matter) and region to blocks(source, position, is_start, full_marker, reference_marker)."""
    w = Window.partitionBy("source").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blocks.withColumn("document", F.sum(F.col("is_start").cast("int")).over(w))
    own = Window.partitionBy("source", "document").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full, reference = [F.max(F.col(c).cast("int")).over(own) == 1 for c in ("full_marker", "reference_marker")]
    return rows.withColumn("region", F.when(F.col("document") == 0, "front_matter").when(reference, "reference_rules").when(full, "full_text").otherwise("document_metadata"))


def ledger(blocks: DataFrame) -> DataFrame:
    """Decisions for blocks(doc_id, position, start, raw_text, kind, label, lo, hi, n_candidates, heading) and, optional,
    override ('boundary', 'retain'), override_kind, title_of (position of the label that a title belongs to, of a
    context kind or not: title_of_context).

    What happens inside an annex depends on the decisions before; but only certain boundaries (overrides, leading annex
    labels, residuals, the first block) change that state, so two windows replace the sequential scan.  Blocks without a
    decision give no row."""
    given = {"override": "string", "override_kind": "string", "title_of": "int", "title_of_context": "boolean"}
    rows = blocks.withColumns({c: F.lit(None).cast(t) for c, t in given.items() if c not in blocks.columns})
    w = Window.partitionBy("doc_id").orderBy("position")
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "after_title": F.coalesce(F.lag("title_of_context").over(w), F.lit(False))})
    one, supported = F.col("n_candidates") == 1, F.col("kind").isin(*STRUCTURAL)
    leading = (F.col("lo") == 0) & (F.col("hi") > 0)
    reference = amends(F.substring(F.col("raw_text"), F.col("hi") + 1, F.length("raw_text")))
    plain = F.col("override").isNull() & F.col("title_of").isNull()
    case = (
        F.when(F.col("override") == "boundary", "reviewed_boundary").when(F.col("override").isNotNull(), "reviewed_false_candidate_retained")
        .when(F.col("title_of").isNotNull(), "reviewed_title_attached").when(F.col("n_candidates") > 1, "conflicting_candidates")
        .when(one & ~leading, "nonleading_candidate_retained").when(one & reference, "possible_reference_retained")
        .when(one & supported, "candidate_boundary").when(one, "unsupported_candidate")
        .when(F.col("heading").isNotNull(), "unclassified_heading_boundary").when(F.col("after_title"), "residual_after_heading")
        .when(F.col("i") == 0, "document_start_residual")
    )
    rows = rows.withColumn("decision", case)
    certain = (
        F.when(F.col("decision") == "reviewed_boundary", F.col("override_kind")).when((F.col("decision") == "candidate_boundary") & (F.col("kind") == "annex"), "annex")
        .when(F.col("decision").isin("residual_after_heading", "document_start_residual"), "residual").when((F.col("i") == 0) & F.col("decision").isNotNull() & ~(plain & F.col("decision").isin("candidate_boundary")), "unclassified")
    )
    inside = F.coalesce(F.last(certain, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) == "annex", F.lit(False))
    rows = rows.withColumn("in_annex", inside)
    held = F.col("in_annex") & one & leading & ~reference & plain & (F.col("kind") != "annex")
    rows = rows.withColumn("decision", F.when(held & F.col("decision").isin("candidate_boundary", "unsupported_candidate"), "uncertain_marker_inside_annex").when(F.col("in_annex") & (F.col("decision") == "unclassified_heading_boundary"), "uncertain_heading_inside_annex").otherwise(F.col("decision")))
    kind = (
        F.when(F.col("decision") == "reviewed_boundary", F.col("override_kind")).when(F.col("decision") == "candidate_boundary", F.col("kind"))
        .when(F.col("decision").isin("conflicting_candidates", "unsupported_candidate") & ~F.col("in_annex"), "unclassified").when(F.col("decision") == "unclassified_heading_boundary", "unclassified")
        .when(F.col("decision").isin("residual_after_heading", "document_start_residual"), "residual").when((F.col("i") == 0) & F.col("decision").isNotNull(), "unclassified")
    )
    rows = rows.where("decision is not null").withColumn("proposed_kind", kind).withColumn("creates_boundary", F.col("proposed_kind").isNotNull())
    shown = F.when(one, F.col("label")).otherwise(F.substring("raw_text", 1, 160))
    again = F.row_number().over(Window.partitionBy("doc_id", "proposed_kind", "_label").orderBy("position")) > 1
    rows = rows.withColumn("_label", shown).withColumn("repeated_label", again & F.coalesce(F.col("proposed_kind").isin(*STRUCTURAL), F.lit(False)))
    scope = F.last(F.when(F.col("proposed_kind").isin(*CONTEXT, "annex", "unclassified", "residual"), F.col("position")), ignorenulls=True)
    return rows.select("doc_id", "position", "start", F.col("_label").alias("label"), "decision", "proposed_kind", "creates_boundary", "repeated_label", scope.over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("scope_position"))


def units(decisions: DataFrame, ends: DataFrame) -> DataFrame:
    """doc_id, unit, kind, label, start, end, n_decisions: spans from a boundary to the next; ``ends`` has (doc_id, n)."""
    w = Window.partitionBy("doc_id").orderBy("position")
    rows = decisions.withColumn("unit", F.sum(F.col("creates_boundary").cast("int")).over(w)).where("unit > 0")
    per = rows.groupBy("doc_id", "unit").agg(F.min("start").alias("start"), F.min_by("proposed_kind", "position").alias("kind"), F.min_by("label", "position").alias("label"), F.count("*").alias("n_decisions"))
    nxt = F.lead("start").over(Window.partitionBy("doc_id").orderBy("unit"))
    return per.withColumn("_next", nxt).join(ends, "doc_id").select("doc_id", "unit", "kind", "label", "start", F.coalesce("_next", "n").alias("end"), "n_decisions")


def hybrid(all_units: DataFrame, children: DataFrame, threshold: int) -> DataFrame:
    """Units of at most ``threshold`` characters stay whole, others give way to their children(doc_id, unit, ordinal, start, end)."""
    whole = all_units.where(F.col("end") - F.col("start") <= threshold).select("doc_id", "unit", F.lit(0).alias("child"), "start", "end", F.lit("retain_whole").alias("action"))
    split = all_units.where(F.col("end") - F.col("start") > threshold).select("doc_id", "unit").join(children, ["doc_id", "unit"]).select("doc_id", "unit", F.col("ordinal").alias("child"), "start", "end", F.lit("reuse_tested_children").alias("action"))
    return whole.unionByName(split).withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("unit", "child")))


def relationship_faults(parents: DataFrame, children: DataFrame, links: DataFrame) -> DataFrame:
    """link set, parent and fault for each parent whose ordered children cross documents, leave it, leave a gap, are out
    of order, redundant, or have gaps in their ordinals; no row if all is well.

    parents(parent_id, p_doc, p_start, p_end), children(child_id, c_doc, c_start, c_end), links(link_set, parent_id, child_id, ordinal)."""
    rows = links.join(parents, "parent_id").join(children, "child_id")
    w = Window.partitionBy("link_set", "parent_id").orderBy("ordinal")
    before = F.max("c_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_before": before, "_place": F.row_number().over(w), "_last": F.max("c_end").over(Window.partitionBy("link_set", "parent_id")), "_prev": F.lag("c_start").over(w)})
    fault = (
        F.when(F.col("p_doc") != F.col("c_doc"), "crosses documents").when((F.col("c_start") < F.col("p_start")) | (F.col("c_end") > F.col("p_end")), "outside parent")
        .when(F.col("ordinal") != F.col("_place"), "ordinal").when(F.col("_prev") >= F.col("c_start"), "order")
        .when(F.col("c_start") > F.coalesce("_before", "p_start"), "gap").when(F.col("c_end") <= F.col("_before"), "redundant").when(F.col("_last") < F.col("p_end"), "gap")
    )
    return rows.select("link_set", "parent_id", fault.alias("fault")).where("fault is not null").distinct()
