"""Publication notes: parenthesised spans with a cue and an issue, matched without a stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NOTE_CUE, NOTE_ISSUE
from .intervals import outermost, overlapping, union_length


def _pieces(texts: DataFrame, key: str, cue: str | None = None, issue: str | None = None) -> DataFrame:
    """key, i, size, d, blank, cue, issue: texts cut after each bracket, d being 1 or -1 for the bracket that ends a piece
    and 0 for the end of the text; blank is the white space that a piece begins with.  No text leaves the scan."""
    pieces = F.posexplode(F.regexp_extract_all(F.col("text"), F.lit("(?s)[^()]*[()]|[^()]+$"), F.lit(0))).alias("i", "piece")
    rows = texts.where(F.col("text").rlike("[()]")).select(key, pieces)
    found = lambda p: F.lit(0) if p is None else F.col("piece").rlike(p).cast("int")
    d = F.when(F.col("piece").endswith("("), 1).when(F.col("piece").endswith(")"), -1).otherwise(0)
    return rows.select(key, "i", F.length("piece").alias("size"), d.alias("d"), F.length(F.regexp_extract("piece", r"(?U)^[\s\x1c-\x1f]*", 0)).alias("blank"), found(cue).alias("cue"), found(issue).alias("issue"))


def _matched(pieces: DataFrame, key: str) -> DataFrame:
    """Brackets with their partner: key, start, end, reason, and how many pieces with a cue and with an issue lie inside.

    The depth is a running sum less its running minimum below 0; a pair is two neighbours of one level."""
    order = Window.partitionBy(key).orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pieces.select(key, "d", (F.sum("size").over(upto) - 1).cast("int").alias("at"), F.sum("cue").over(upto).alias("cues"), F.sum("issue").over(upto).alias("issues")).where("d <> 0")
    w = Window.partitionBy(key).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_s", F.sum("d").over(run)).withColumn("_low", F.least(F.lit(0), F.min("_s").over(run)))
    rows = rows.withColumn("_before", F.lag(F.col("_s") - F.col("_low"), 1, 0).over(w))
    rows = rows.withColumn("level", F.when(F.col("d") == 1, F.col("_s") - F.col("_low")).otherwise(F.col("_before")))
    own = Window.partitionBy(key, "level").orderBy("at")
    rows = rows.withColumns({f"_{c}2": F.lead(c).over(own) for c in ("d", "at", "cues", "issues")})
    pair = (F.col("d") == 1) & (F.col("_d2") == -1) & (F.col("level") > 0)
    reason = F.when((F.col("d") == 1) & ~F.coalesce(pair, F.lit(False)), "unmatched_open").when((F.col("d") == -1) & (F.col("level") == 0), "unmatched_close")
    rows = rows.withColumns({"start": F.col("at"), "end": F.when(pair, F.col("_at2") + 1), "reason": reason}).where("end is not null or reason is not null")
    return rows.select(key, "start", "end", "reason", (F.col("_cues2") - F.col("cues")).alias("cues"), (F.col("_issues2") - F.col("issues")).alias("issues"))


def parentheses(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end of matched pairs, and unresolved ones with end null and reason."""
    return _matched(_pieces(texts, key), key).select(key, "start", "end", "reason")


def notes(texts: DataFrame, key: str = "doc_id", cue: str = NOTE_CUE, issue: str = NOTE_ISSUE) -> DataFrame:
    """key, start, end of the outermost parentheses that hold both a cue and an issue.

    ``cue`` and ``issue`` match between two brackets, not across one: each piece of a text is searched once."""
    pairs = _matched(_pieces(texts, key, cue, issue), key).where("end is not null and cues > 0 and issues > 0")
    return outermost(pairs.select(key, "start", "end"), [key])


def anchors(found: DataFrame, texts: DataFrame, key: str = "doc_id", most: int = 60) -> DataFrame:
    """key, start, end, a_start, a_end: what follows each note, without leading white space, at most ``most`` characters and
    not into the next note; a note that nothing follows has no anchor.

    White space after a note is what the piece behind its bracket begins with, however long; texts are not joined."""
    order = Window.partitionBy(key).orderBy("i")
    after = F.coalesce(F.lead("blank").over(order), F.lit(0))
    at = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    places = _pieces(texts, key).select(key, at.alias("end"), after.alias("_blank"), F.sum("size").over(Window.partitionBy(key)).cast("int").alias("_size"))
    nxt = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    rows = found.select(key, "start", "end").withColumn("_next", nxt).join(places, [key, "end"])
    stop = F.coalesce("_next", "_size")
    first = F.col("end") + F.col("_blank")
    return rows.where(first < stop).select(key, "start", "end", first.alias("a_start"), F.least(first + most, stop).alias("a_end"))


def shares(records: DataFrame, annotations: DataFrame, record_key: list[str], key: str = "doc_id") -> DataFrame:
    """record_key, size, annotated, n_cut: characters of each record under annotations (their union), and how many
    annotations that touch it are not whole in it.  Records without annotations count 0."""
    own = [key, *record_key]
    pairs = overlapping(records.select(*own, "start", "end"), annotations.select(key, F.col("start").alias("r_start"), F.col("end").alias("r_end")), key)
    covered = union_length(pairs, own, "lo", "hi").withColumnRenamed("covered", "annotated")
    cut = pairs.groupBy(*own).agg(F.count_if((F.col("r_start") < F.col("start")) | (F.col("r_end") > F.col("end"))).alias("n_cut"))
    rows = records.select(*own, (F.col("end") - F.col("start")).cast("long").alias("size")).join(covered, own, "left").join(cut, own, "left")
    return rows.na.fill(0, ["annotated", "n_cut"])


def uncovered(texts: DataFrame, spans: DataFrame, token: str, key: str = "doc_id") -> DataFrame:
    """key, at: places of the regular expression ``token`` that lie in no span."""
    parts = F.posexplode(F.split("text", f"(?={token})", -1)).alias("i", "piece")
    rows = texts.where(F.col("text").rlike(token)).select(key, parts).select(key, "i", F.length("piece").alias("size"), F.col("piece").rlike(f"^(?:{token})").alias("hit"))
    start = F.coalesce(F.sum("size").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = rows.withColumn("at", start.cast("int")).where("hit").select(key, "at")
    inside = overlapping(hits.select(key, F.col("at").alias("start"), (F.col("at") + 1).alias("end")), spans.select(key, F.col("start").alias("r_start"), F.col("end").alias("r_end")), key)
    return hits.join(inside.select(key, F.col("start").alias("at")).distinct(), [key, "at"], "left_anti")
