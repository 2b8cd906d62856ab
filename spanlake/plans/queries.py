"""The queries over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.identity import block_id, fingerprint
from ..operators import alignment, history, intervals, structure, summaries, views, windows

#: A rule table for the invented prose of the test documents: a short first sentence is an article, piped lines an annex.
RULES = (T.MarkerRule("annex", r"^([^ ]+ \|)", False), T.MarkerRule("chapter", r"^(Licensed under|All rights)", False), T.MarkerRule("article", r"^([A-Z][a-z]+\.)", False))
CUE, ISSUE = r"[0-9]", r"[0-9]{3}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _sized_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.fixed_grid(docs(spark, sf_dir))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the lines, from the array of lines: no shuffle."""
    lines = views.line_blocks(docs(spark, sf_dir))
    source = F.struct((2 * F.col("position")).alias("seg"), F.lit("source").alias("kind"), F.col("start").alias("start"), F.col("end").alias("end"))
    gap = F.struct((2 * F.col("position") - 1).alias("seg"), F.lit("separator").alias("kind"), (F.col("start") - 1).alias("start"), F.col("start").alias("end"))
    return lines.select("doc_id", "position", F.explode(F.when(F.col("position") > 0, F.array(gap, source)).otherwise(F.array(source))).alias("s")).select("doc_id", "position", "s.*")


def line_blocks(s, d):
    return views.line_blocks(docs(s, d)).select("doc_id", "position", "start", "end", F.md5("raw_text").alias("digest"))


def block_identity(s, d):
    rows = views.line_blocks(docs(s, d))
    return rows.select("doc_id", "position", block_id(F.col("doc_id").cast("string"), F.lit("line"), F.col("position").cast("string")).alias("block_id"))


def document_views(s, d):
    view, _ = views.document_view(views.line_blocks(docs(s, d)).select("doc_id", "position", "raw_text"))
    return view.select("doc_id", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))


def fixed_windows(s, d):
    return windows.fixed_grid(docs(s, d), keep_text=True).select("configuration", "doc_id", "ordinal", "start", "end", F.md5("text").alias("digest"))


def window_lengths(s, d):
    return summaries.length_summary(_sized_windows(s, d).withColumn("size", F.col("end") - F.col("start")), ["configuration"], "size")


def window_overlaps(s, d):
    rows = intervals.adjacent_overlap(_sized_windows(s, d), ["configuration", "doc_id"])
    return rows.groupBy("configuration").agg(F.count("*").alias("n"), F.sum("overlap_before").alias("before"), F.sum("overlap_after").alias("after"))


def tail_windows(s, d):
    return _sized_windows(s, d).groupBy("configuration", "doc_id").agg(F.count("*").alias("n"), F.max_by(F.col("end") - F.col("start"), "ordinal").alias("last_size"))


def source_map(s, d):
    spans = windows.fixed_grid(docs(s, d), ((1000, 10),))
    mapped = views.source_map(spans, _segments(s, d))
    return mapped.select("doc_id", "ordinal", "seg", "kind", "from", "to", "whole")


def paragraph_cuts(s, d):
    lines = views.line_blocks(docs(s, d)).select("doc_id", "position", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = intervals.touched_cut_contained(_sized_windows(s, d), lines)
    return pairs.groupBy("configuration").agg(F.count("*").alias("touched"), F.count_if("cut").alias("cut"), F.count_if("contained").alias("contained"), F.sum(F.col("hi") - F.col("lo")).alias("shared"))


def interval_union(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 1 + F.pmod(F.col("event_id"), F.lit(997))).alias("end"))
    return intervals.union_length(e, ["user_id"])


def elementary_pieces(s, d):
    spans = windows.fixed_grid(docs(s, d), ((1000, 20), (2000, 10)))
    return intervals.elementary(spans, ["doc_id"])


def line_shares(s, d):
    return summaries.shares_above(views.line_blocks(docs(s, d)).select((F.col("end") - F.col("start")).alias("size")), "size", (100, 500, 1000, 2000, 4000))


def line_summary(s, d):
    rows = views.line_blocks(docs(s, d)).join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return summaries.length_summary(rows.select("lang", (F.col("end") - F.col("start")).alias("size")), ["lang"], "size")


def quantity_summary(s, d):
    return summaries.length_summary(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


def repeated_lines(s, d):
    rows = summaries.repeated_blocks(views.line_blocks(docs(s, d)))
    return rows.select("doc_id", F.md5("raw_text").alias("digest"), "n", "extra_chars", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def turn_runs(s, d):
    return summaries.runs(table(s, d, "conversations"), ["conv_id"], "turn", "role")


def longest_lines(s, d):
    rows = views.line_blocks(docs(s, d)).join(table(s, d, "documents").select("doc_id", "source"), "doc_id").withColumn("size", F.col("end") - F.col("start"))
    return summaries.top(rows.select("source", "doc_id", "position", "size"), ["source"], [F.desc("size"), F.col("doc_id"), F.col("position")], 8)


def median_documents(s, d):
    rows = table(s, d, "documents").select("source", "doc_id", F.length("text").alias("size"))
    return summaries.nearest_to_median(rows, ["source"], "size", "doc_id")


def gallery(s, d):
    return summaries.evenly_spaced(table(s, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 6)


def language_pivot(s, d):
    return table(s, d, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


def address_parts(s, d):
    p = table(s, d, "pages")
    return p.select("page_id", T.url_without_fragment(F.col("url")).alias("address"), T.is_web_url(F.col("url")).alias("is_web"))


def _blocks_with_markers(s, d) -> DataFrame:
    rows = views.line_blocks(docs(s, d))
    m = T.marker(F.col("raw_text"), F.lit(2), None, RULES)
    return rows.withColumn("m", m).select("doc_id", "position", "start", "raw_text", "m.kind", "m.label", "m.lo", "m.hi", F.when(F.col("m").isNotNull(), 1).otherwise(0).alias("n_candidates"), F.lit(None).cast("int").alias("heading"))


def boundary_ledger(s, d):
    return structure.ledger(_blocks_with_markers(s, d)).select("doc_id", "position", "start", "label", "decision", "proposed_kind", "creates_boundary", "repeated_label", "scope_position")


def _units(s, d) -> DataFrame:
    return structure.units(structure.ledger(_blocks_with_markers(s, d)), docs(s, d).where("text <> ''").select("doc_id", F.length("text").alias("n")))


def structural_units(s, d):
    return _units(s, d)


def unit_kinds(s, d):
    return summaries.length_summary(_units(s, d).select("kind", (F.col("end") - F.col("start")).alias("size")), ["kind"], "size")


def _children(s, d) -> DataFrame:
    return windows.span_windows(_units(s, d).where("end - start > 4000").select("doc_id", "unit", "start", "end"), 2000, 200).select("doc_id", "unit", "ordinal", "start", "end")


def hybrid_spans(s, d):
    return structure.hybrid(_units(s, d), _children(s, d), 4000).select("doc_id", "ordinal", "unit", "child", "start", "end", "action")


def parent_child_faults(s, d):
    """No row if the children of every oversized unit cover it in order."""
    u, c = _units(s, d), _children(s, d)
    uid = F.concat_ws(":", "doc_id", "unit")
    parents = u.select(uid.alias("parent_id"), F.col("doc_id").alias("p_doc"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    children = c.select(F.concat_ws(":", "doc_id", "unit", "ordinal").alias("child_id"), F.col("doc_id").alias("c_doc"), F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    links = c.select(F.lit("oversized-2000-10").alias("link_set"), uid.alias("parent_id"), F.concat_ws(":", "doc_id", "unit", "ordinal").alias("child_id"), "ordinal")
    return structure.relationship_faults(parents, children, links)


def aware_spans(s, d):
    return windows.aware_windows(windows.paragraph_spans(docs(s, d)), 1000, 100)


def aware_against_exact(s, d):
    """Lines cut by windows of 1,000 characters with 10 per cent of overlap, by either method."""
    aware = aware_spans(s, d).select("doc_id", "start", "end", F.lit("boundary_aware").alias("method"))
    exact = windows.fixed_grid(docs(s, d), ((1000, 10),)).select("doc_id", "start", "end", F.lit("exact").alias("method"))
    lines = views.line_blocks(docs(s, d)).select("doc_id", "position", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    rows = intervals.touched_cut_contained(aware.unionByName(exact), lines)
    return rows.groupBy("method").agg(F.count_if("cut").alias("cut"), F.count("*").alias("touched"))


def bracket_notes(s, d):
    return history.notes(docs(s, d), "doc_id", CUE, ISSUE)


def brackets(s, d):
    return history.parentheses(docs(s, d))


def reference_alignment(s, d):
    items = table(s, d, "benchmark").select(F.col("item_id").alias("reference_id"), F.col("text").alias("excerpt"))
    return alignment.align(items, docs(s, d))


def reference_statuses(s, d):
    items = table(s, d, "benchmark").select(F.col("item_id").alias("reference_id"), F.col("text").alias("excerpt"))
    return summaries.histogram(alignment.statuses(items, alignment.align(items, docs(s, d))), "status", alignment.STATUSES)


def reference_probes(s, d):
    rows = table(s, d, "benchmark").select("item_id", F.posexplode(T.probes(F.col("text"))).alias("place", "probe"))
    return rows.select("item_id", "place", F.md5("probe").alias("digest"))


def registry_fields(s, d):
    """Field rows of documents with their label row, absent where there is none."""
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("raw_value")) for c in ("lang", "source", "quality", "toxic")])
    return rows.select("doc_id", F.posexplode(fields).alias("row_index", "f")).select("doc_id", "row_index", "f.field", "f.raw_value")


def window_fingerprint(s, d):
    return fingerprint(_sized_windows(s, d))


def union_by_config(s, d):
    rows = _sized_windows(s, d)
    return intervals.union_length(rows, ["configuration", "doc_id"]).groupBy("configuration").agg(F.sum("covered").alias("covered"))


def page_regions(s, d):
    """Marker-delimited regions: text before, inside and after the body tag of raw pages."""
    p = table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    lines = views.line_blocks(p)
    rows = lines.select(F.col("doc_id").alias("source"), "position", (F.col("position") == 0).alias("is_start"), F.col("raw_text").contains("<body").alias("full_marker"), F.col("raw_text").contains("</body").alias("reference_marker"))
    return structure.documents_of(rows).groupBy("source", "region").agg(F.count("*").alias("n"))


_LINES = """l as (
  select doc_id, unnest(string_split(text, chr(10))) as raw_text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as position from documents where text is not null
), b as (
  select doc_id, cast(position as int) as position, raw_text,
    cast(coalesce(sum(length(raw_text) + 1) over (partition by doc_id order by position rows between unbounded preceding and 1 preceding), 0) as int) as start,
    cast(sum(length(raw_text) + 1) over (partition by doc_id order by position) - 1 as int) as "end" from l
)"""
_WINDOWS = """g as (
  select 'fixed-' || n || '-' || p as configuration, n, n - n * p // 100 as stride from (values (1000), (2000), (4000)) a(n), (values (0), (10), (20)) c(p)
), w0 as (
  select configuration, doc_id, text, n, stride, unnest(range(0, 1 + greatest(0, cast(ceil((length(text) - n) / stride) as bigint)))) as k from documents, g where length(text) > 0
), w as (
  select configuration, doc_id, cast(k + 1 as int) as ordinal, cast(k * stride as int) as start, cast(least(k * stride + n, length(text)) as int) as "end", text from w0
)"""
_P = ", ".join(f"quantile_disc({{v}}, {p / 100}) as p{p}" for p in summaries.PERCENTILES)
_MARKED = """m as (
  select doc_id, position, start, raw_text, case when regexp_matches(raw_text, '^[^ ]+ \\|') then 'annex' when regexp_matches(raw_text, '^(Licensed under|All rights)') then 'chapter' when regexp_matches(raw_text, '^[A-Z][a-z]+\\.') then 'article' end as kind,
    case when regexp_matches(raw_text, '^[^ ]+ \\|') then regexp_extract(raw_text, '^([^ ]+ \\|)', 1) when regexp_matches(raw_text, '^(Licensed under|All rights)') then regexp_extract(raw_text, '^(Licensed under|All rights)', 1) when regexp_matches(raw_text, '^[A-Z][a-z]+\\.') then regexp_extract(raw_text, '^([A-Z][a-z]+\\.)', 1) end as label
  from b
), s as (
  select *, coalesce(last_value(case when kind = 'annex' then 'annex' when position = 0 and kind is null then 'residual' end ignore nulls) over (partition by doc_id order by position rows between unbounded preceding and 1 preceding) = 'annex', false) as inside from m
), t as (
  select doc_id, position, start, coalesce(label, substr(raw_text, 1, 160)) as label,
    case when kind is null then 'document_start_residual' when inside and kind <> 'annex' then 'uncertain_marker_inside_annex' else 'candidate_boundary' end as decision,
    case when kind is null then 'residual' when inside and kind <> 'annex' then null else kind end as proposed_kind from s where kind is not null or position = 0
), j as (
  select doc_id, position, start, label, decision, proposed_kind, proposed_kind is not null as creates_boundary,
    coalesce(row_number() over (partition by doc_id, proposed_kind, label order by position) > 1 and proposed_kind in ('part', 'chapter', 'section', 'article', 'paragraph_sign', 'annex'), false) as repeated_label,
    last_value(case when proposed_kind in ('chapter', 'annex', 'residual') then position end ignore nulls) over (partition by doc_id order by position rows between unbounded preceding and current row) as scope_position from t
)"""
_UNITS = """u0 as (select *, sum(cast(creates_boundary as int)) over (partition by doc_id order by position) as unit from j
), u as (
  select u1.doc_id, unit, kind, label, start, cast(coalesce(lead(start) over (partition by u1.doc_id order by unit), length(text)) as int) as "end", n_decisions
  from (select doc_id, cast(unit as bigint) unit, min(start) as start, arg_min(proposed_kind, position) as kind, arg_min(label, position) as label, count(*) as n_decisions from u0 where unit > 0 group by 1, 2) u1
  join documents on documents.doc_id = u1.doc_id where text <> ''
)"""
_CHILDREN = """k0 as (
  select doc_id, unit, start as base, "end" - start as n, unnest(range(0, 1 + greatest(0, cast(ceil(("end" - start - 2000) / 1800) as bigint)))) as k from u where "end" - start > 4000
), k as (select doc_id, unit, cast(k + 1 as int) as ordinal, cast(base + k * 1800 as int) as start, cast(base + least(k * 1800 + 2000, n) as int) as "end" from k0)"""

SQL = {
    "parent_child_faults": f"""with {_LINES}, {_MARKED}, {_UNITS}, {_CHILDREN}, y as (select k.doc_id || ':' || k.unit as parent_id, u.start as p0, u."end" as p1, k.ordinal, k.start, k."end" as stop from k join u on u.doc_id = k.doc_id and u.unit = k.unit),
      x as (select *, row_number() over q as place, lag(start) over q as prev, max(stop) over (partition by parent_id order by ordinal rows between unbounded preceding and 1 preceding) as before, max(stop) over (partition by parent_id) as last from y window q as (partition by parent_id order by ordinal)),
      f as (select parent_id, case when start < p0 or stop > p1 then 'outside parent' when ordinal <> place then 'ordinal' when prev >= start then 'order' when start > coalesce(before, p0) then 'gap' when stop <= before then 'redundant' when last < p1 then 'gap' end as fault from x)
      select distinct 'oversized-2000-10' as link_set, parent_id, fault from f where fault is not null""",
    "reference_statuses": """with h as (select b.item_id, cast(coalesce(sum(len(list_filter(range(0, length(d.text) - length(b.text) + 1), lambda i: substr(d.text, i + 1, length(b.text)) = b.text))), 0) as bigint) as k from benchmark b left join documents d on length(b.text) > 0 and contains(d.text, b.text) group by 1),
      s as (select case when k = 1 then 'exact' when k > 1 then 'ambiguous' else 'unmatched' end as status from h), c as (select * from (values (0, 'exact'), (1, 'partial'), (2, 'ambiguous'), (3, 'unmatched')) v(place, status))
      select cast(place as int) as place, c.status, count(s.status) as n from c left join s on s.status = c.status group by 1, 2""",
    "line_blocks": f'with {_LINES} select doc_id, position, start, "end", md5(raw_text) as digest from b',
    "block_identity": f"with {_LINES} select doc_id, position, sha256(doc_id || ':line:' || position) as block_id from b",
    "document_views": "select doc_id, cast(length(text) as int) as n, sha256(text) as digest from documents where text is not null",
    "fixed_windows": f'with {_WINDOWS} select configuration, doc_id, ordinal, start, "end", md5(substr(text, start + 1, "end" - start)) as digest from w',
    "window_lengths": f'with {_WINDOWS} select configuration, count(*) as n, min("end" - start) as least, {_P.format(v=chr(34) + "end" + chr(34) + " - start")}, max("end" - start) as most from w group by 1',
    "window_overlaps": f'with {_WINDOWS}, o as (select configuration, greatest(0, coalesce(lag("end") over q - start, 0)) as x, greatest(0, coalesce("end" - lead(start) over q, 0)) as y from w window q as (partition by configuration, doc_id order by ordinal)) select configuration, count(*) as n, cast(sum(x) as bigint) as before, cast(sum(y) as bigint) as after from o group by 1',
    "tail_windows": f'with {_WINDOWS} select configuration, doc_id, count(*) as n, arg_max("end" - start, ordinal) as last_size from w group by 1, 2',
    "source_map": f"""with {_LINES}, {_WINDOWS}, seg as (select doc_id, 2 * position as seg, 'source' as kind, start, "end" from b union all select doc_id, 2 * position - 1, 'separator', start - 1, start from b where position > 0)
      select w.doc_id, ordinal, seg, kind, greatest(w.start, seg.start) - seg.start as "from", least(w."end", seg."end") - seg.start as "to", w.start <= seg.start and seg."end" <= w."end" as whole
      from w join seg on w.doc_id = seg.doc_id and w.start < seg."end" and seg.start < w."end" and seg.start < seg."end" where configuration = 'fixed-1000-10'""",
    "paragraph_cuts": f"""with {_LINES}, {_WINDOWS} select configuration, count(*) as touched, count(*) filter ((b.start < w.start and w.start < b."end") or (b.start < w."end" and w."end" < b."end")) as cut, count(*) filter (w.start <= b.start and b."end" <= w."end") as contained,
      cast(sum(least(w."end", b."end") - greatest(w.start, b.start)) as bigint) as shared from w join b on w.doc_id = b.doc_id and w.start < b."end" and b.start < w."end" and b.start < b."end" group by 1""",
    "interval_union": """with e as (select user_id, event_id as s, event_id + 1 + event_id % 997 as e from events), m as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as before from e)
      select user_id, cast(sum(greatest(0, e - greatest(s, coalesce(before, s)))) as bigint) as covered from m group by 1""",
    "elementary_pieces": f"""with {_WINDOWS}, x as (select * from w where configuration in ('fixed-1000-20', 'fixed-2000-10')), e as (select doc_id, start as edge from x union select doc_id, "end" from x),
      p as (select doc_id, edge as start, lead(edge) over (partition by doc_id order by edge) as "end" from e)
      select p.doc_id, p.start, p."end", (select count(*) from x where x.doc_id = p.doc_id and x.start <= p.start and p."end" <= x."end") as depth from p where p."end" is not null""",
    "line_shares": f'with {_LINES}, v as (select unnest([100, 500, 1000, 2000, 4000]) as "limit") select "limit", count(*) filter (b."end" - b.start > "limit") as n, count(*) as total, round(100 * count(*) filter (b."end" - b.start > "limit") / count(*), 2) as percent from b, v group by 1',
    "line_summary": f'with {_LINES} select lang, count(*) as n, min(b."end" - b.start) as least, {_P.format(v="b." + chr(34) + "end" + chr(34) + " - b.start")}, max(b."end" - b.start) as most from b join documents using (doc_id) group by 1',
    "quantity_summary": f"select l_returnflag, l_linestatus, count(*) as n, min(l_quantity) as least, {_P.format(v='l_quantity')}, max(l_quantity) as most from lineitem group by 1, 2",
    "repeated_lines": f"with {_LINES} select doc_id, md5(raw_text) as digest, count(*) as n, length(raw_text) * (count(*) - 1) as extra_chars, array_to_string(list(position order by position)[1:3], ',') as positions from b where length(raw_text) >= 40 group by doc_id, raw_text having count(*) > 1",
    "turn_runs": """with a as (select *, case when role is not distinct from lag(role) over q and row_number() over q > 1 then 0 else 1 end as new from conversations window q as (partition by conv_id order by turn)),
      r as (select *, cast(sum(new) over (partition by conv_id order by turn) as bigint) as run from a) select conv_id, run, any_value(role) as role, min(turn) as first, max(turn) as last, count(*) as n from r group by 1, 2""",
    "longest_lines": f'with {_LINES}, r as (select source, doc_id, position, "end" - start as size, cast(row_number() over (partition by source order by "end" - start desc, doc_id, position) as int) as rank from b join documents using (doc_id)) select * from r where rank <= 8',
    "median_documents": """with m as (select source, quantile_disc(cast(length(text) as int), 0.5) as median from documents group by 1), r as (select documents.source, doc_id, cast(length(text) as int) as size, median, row_number() over (partition by documents.source order by abs(length(text) - median), doc_id) as k from documents join m on m.source = documents.source) select source, doc_id, size, median from r where k = 1""",
    "gallery": """with r as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from documents)
      select source, doc_id from r where n <= 6 or i in (select round_even(k * (n - 1) / 5, 0) from range(6) t(k))""",
    "language_pivot": "select source, " + ", ".join(f"count(*) filter (lang = '{x}') as {x}" for x in ("de", "en", "es", "fr")) + " from documents group by 1",
    "address_parts": "select page_id, split_part(url, '#', 1) as address, regexp_matches(url, '^https?://[^/?#]+') as is_web from pages",
    "boundary_ledger": f"with {_LINES}, {_MARKED} select * from j",
    "structural_units": f"with {_LINES}, {_MARKED}, {_UNITS} select * from u",
    "unit_kinds": f'with {_LINES}, {_MARKED}, {_UNITS} select kind, count(*) as n, min("end" - start) as least, {_P.format(v=chr(34) + "end" + chr(34) + " - start")}, max("end" - start) as most from u group by 1',
    "hybrid_spans": f"""with {_LINES}, {_MARKED}, {_UNITS}, {_CHILDREN}, h as (select doc_id, unit, 0 as child, start, "end", 'retain_whole' as action from u where "end" - start <= 4000 union all select doc_id, unit, ordinal, start, "end", 'reuse_tested_children' from k)
      select doc_id, cast(row_number() over (partition by doc_id order by unit, child) as int) as ordinal, unit, child, start, "end", action from h""",
    "registry_fields": "with f as (select d.doc_id, unnest([{'i': 0, 'f': 'lang', 'v': lang}, {'i': 1, 'f': 'source', 'v': source}, {'i': 2, 'f': 'quality', 'v': cast(quality as varchar)}, {'i': 3, 'f': 'toxic', 'v': cast(toxic as varchar)}]) as r from documents d left join labels using (doc_id)) select doc_id, r.i as row_index, r.f as field, r.v as raw_value from f",
    "union_by_config": f'with {_WINDOWS} select configuration, cast(sum(length(text)) as bigint) as covered from (select distinct configuration, doc_id, text from w) group by 1',
    "reference_alignment": 'with h as (select item_id as reference_id, doc_id, length(b.text) as n, unnest(list_filter(range(0, length(d.text) - length(b.text) + 1), lambda i: substr(d.text, i + 1, length(b.text)) = b.text)) as i from benchmark b, documents d where length(b.text) > 0 and contains(d.text, b.text)) select reference_id, doc_id, cast(i as int) as start, cast(i + n as int) as "end" from h',
    "reference_probes": """with p as (select item_id, unnest(list_distinct_ordered) as probe, generate_subscripts(list_distinct_ordered, 1) - 1 as place from (select item_id, list_filter(list_transform(range(0, length(text), 40), lambda i: substr(text, i + 1, 80)), lambda s: length(s) >= 60) as list_distinct_ordered from benchmark)) select item_id, cast(place as int) as place, md5(probe) as digest from p""",
    "page_regions": """with l as (select page_id, unnest(string_split(html, chr(10))) as t, generate_subscripts(string_split(html, chr(10)), 1) as i from pages where html is not null), f as (select page_id, max(contains(t, '</body')) over q as r, max(contains(t, '<body')) over q as x from l window q as (partition by page_id order by i rows between unbounded preceding and current row))
      select page_id as source, case when r then 'reference_rules' when x then 'full_text' else 'document_metadata' end as region, count(*) as n from f group by 1, 2""",
}

QUERIES = (
    line_blocks, block_identity, document_views, fixed_windows, window_lengths, window_overlaps, tail_windows, source_map, paragraph_cuts, interval_union, elementary_pieces, line_shares, line_summary,
    quantity_summary, repeated_lines, turn_runs, longest_lines, median_documents, gallery, language_pivot, address_parts, boundary_ledger, structural_units, unit_kinds, hybrid_spans, parent_child_faults,
    aware_spans, aware_against_exact, bracket_notes, brackets, reference_alignment, reference_statuses, reference_probes, registry_fields, window_fingerprint, union_by_config, page_regions,
)


def queries():
    return {q.__name__: q for q in QUERIES}
