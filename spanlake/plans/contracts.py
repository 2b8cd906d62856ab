"""Queries of contracts, identities and reviewers' views over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, intervals, views, windows
from . import queries as Q
from . import reports

FIELDS = {"lang": "language", "source": "origin"}


def fixed_window_ids(s, d):
    return Q._sized_windows(s, d).select("configuration", "doc_id", "ordinal", evidence.span_id("fixed", F.col("configuration"), F.col("doc_id"), F.col("start"), F.col("end")).alias("id"))


def block_previews(s, d):
    return views.line_blocks(Q.docs(s, d)).select("doc_id", "position", T.preview(F.col("raw_text")).alias("preview"))


def escaped_pages(s, d):
    return Q.table(s, d, "pages").select("page_id", F.md5(T.escaped(F.col("html"))).alias("digest"))


def classified_rows(s, d):
    return evidence.classified(Q.registry_fields(s, d), FIELDS)


def unit_violations(s, d):
    return evidence.partition_faults(Q._units(s, d), Q.docs(s, d).where("text <> ''").select("doc_id", F.length("text").alias("n")))


def hybrid_violations(s, d):
    return evidence.composition_faults(Q.hybrid_spans(s, d), Q._units(s, d), 4000)


def block_violations(s, d):
    return evidence.block_faults(views.line_blocks(Q.docs(s, d)))


def source_map_violations(s, d):
    return evidence.map_faults(Q.source_map(s, d), windows.fixed_grid(Q.docs(s, d), ((1000, 10),)), ["doc_id", "ordinal"])


def sample_neighbourhood(s, d):
    """Lines within two of the lines where a sample begins and ends."""
    lines = views.line_blocks(Q.docs(s, d)).select("doc_id", "position", F.col("start").alias("r_start"), (F.col("end") + 1).alias("r_end"))
    ends = reports._samples(s, d).select("sample_id", "doc_id", F.explode(F.array("s_start", "s_end")).alias("start")).withColumn("end", F.col("start") + 1)
    return evidence.neighbourhood(intervals.overlapping(ends, lines).select("sample_id", "doc_id", "position"), lines)


def first_markers(s, d):
    rows = Q._blocks_with_markers(s, d).where("kind is not null").select("kind", "doc_id", "position", "label")
    return evidence.first_of_kind(rows, ["kind"], ["doc_id", "position"])


def cut_witnesses(s, d):
    """For each configuration, and one that is not in the grid, the first window that cuts a line, or none."""
    lines = reports._lines(s, d).withColumnRenamed("position", "line")
    cut = intervals.touched_cut_contained(Q._sized_windows(s, d), lines).where("cut").select("configuration", "doc_id", "ordinal", "line")
    wanted = s.createDataFrame([(f"fixed-{n}-{p}",) for n, p in (*windows.FIXED_GRID, (9000, 0))], "configuration string")
    return evidence.witnesses(cut, wanted, ["configuration"], ["doc_id", "ordinal", "line"])


def note_representation(s, d):
    """Windows of 1,000 characters with the places of the notes that they touch."""
    notes = Q.bracket_notes(s, d).select("doc_id", F.col("start").alias("annotation"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return evidence.represented(Q._sized_windows(s, d).where("configuration = 'fixed-1000-10'"), notes, ["ordinal"])


def parents_with_children(s, d):
    return evidence.with_children(Q._units(s, d), Q._children(s, d))


_U = f"with {Q._LINES}, {Q._MARKED}, {Q._UNITS}"


def _checks(names: dict[str, str], source: str) -> str:
    rows = ", ".join(f"{{'c': '{n}', 'v': cast(coalesce({x}, 0) as bigint)}}" for n, x in names.items())
    return f'select r.c as "check", r.v as violations from (select unnest([{rows}]) as r from {source})'


SQL = {
    "fixed_window_ids": f"""with {Q._WINDOWS} select configuration, doc_id, ordinal, 'fixed:' || sha256('["' || configuration || '",' || doc_id || ',' || start || ',' || "end" || ']') as id from w""",
    "block_previews": f"with {Q._LINES} select doc_id, position, substr(raw_text, 1, 160) as preview from b",
    "escaped_pages": """select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')) as digest from pages""",
    "classified_rows": f"with c as ({Q.SQL['registry_fields']}) select *, case field when 'lang' then 'language' when 'source' then 'origin' end as interpreted from c",
    "unit_violations": f"""{_U}, v as (select *, lag("end") over (partition by doc_id order by unit) as before from u), e as (select d.doc_id, length(text) as n, min(start) as lo, max("end") as hi, count(*) filter (start >= "end") as empty, count(*) filter (before <> start) as seam
      from documents d left join v on v.doc_id = d.doc_id where text <> '' group by 1, 2) """
    + _checks({"empty": "sum(empty)", "seam": "sum(seam)", "first": "count(*) filter (lo <> 0)", "last": "count(*) filter (hi <> n)", "missing": "count(*) filter (lo is null)"}, "e"),
    "hybrid_violations": f"""{_U}, {reports._HYBRID}, v as (select *, lag("end") over (partition by doc_id, unit order by child) as before from ho), p as (select doc_id, unit, count(*) as n, min(child) as c, min(start) as lo, max("end") as hi, count(*) filter (start > before) as gap from v group by 1, 2),
      q as (select u.start, u."end", n, c, lo, hi, gap from u full join p on u.doc_id = p.doc_id and u.unit = p.unit), o as (select count(*) as n, min(ordinal) as lo, max(ordinal) as hi, count(distinct ordinal) as k from ho group by doc_id) """
    + _checks({"kept": "count(*) filter (not coalesce(\"end\" - start > 4000 or (n = 1 and c = 0), false))", "divided": "count(*) filter (not coalesce(\"end\" - start <= 4000 or c > 0, false))", "covered": "count(*) filter (not coalesce(lo = start and hi = \"end\", false))", "gap": "sum(gap)"}, "q")
    + " union all " + _checks({"ordinal": "count(*) filter (not (lo = 1 and hi = n and k = n))"}, "o"),
    "block_violations": f"""with {Q._LINES}, v as (select position, start, "end", length(raw_text) as n, row_number() over q - 1 as i, lag("end") over q as before, lag(position) over q = position as same from b window q as (partition by doc_id order by position, start)) """
    + _checks({"position": "count(*) filter (position <> i)", "size": "count(*) filter (\"end\" - start <> n)", "start": "count(*) filter (start <> coalesce(before + 1, 0))", "repeated": "count(*) filter (same)"}, "v"),
    "source_map_violations": f"""with mp as ({Q.SQL['source_map']}), {Q._WINDOWS}, p as (select doc_id, ordinal, count(*) filter ("from" >= "to") as e, sum("to" - "from") as s, count(*) as k, max(seg) - min(seg) as wd from mp group by 1, 2),
      v as (select w."end" - w.start as n, e, s, k, wd from w left join p on w.doc_id = p.doc_id and w.ordinal = p.ordinal where configuration = 'fixed-1000-10') """
    + _checks({"empty": "sum(e)", "filled": "count(*) filter (coalesce(s, 0) <> n)", "consecutive": "count(*) filter (wd >= 2 * k)"}, "v"),
    "sample_neighbourhood": f"""with {Q._LINES}, {reports._S}, e as (select sample_id, doc_id, unnest([s_start, s_end]) as x from smp), p as (select sample_id, e.doc_id, position from e join b on b.doc_id = e.doc_id and b.start <= x and x <= b."end")
      select distinct sample_id, b.doc_id, b.position from p join b on b.doc_id = p.doc_id and abs(b.position - p.position) <= 2""",
    "first_markers": f"with {Q._LINES}, {Q._MARKED}, r as (select kind, doc_id, position, label, row_number() over (partition by kind order by doc_id, position) as k from m where kind is not null) select kind, doc_id, position, label from r where k = 1",
    "cut_witnesses": f"""with {Q._LINES}, {Q._WINDOWS}, x as (select configuration, w.doc_id, ordinal, position as line, row_number() over (partition by configuration order by w.doc_id, ordinal, position) as k from w join b on w.doc_id = b.doc_id and ((b.start < w.start and w.start < b."end") or (b.start < w."end" and w."end" < b."end"))),
      n as (select distinct configuration from g union all select 'fixed-9000-0') select n.configuration, doc_id, ordinal, line, k is not null as found from n left join x on x.configuration = n.configuration and k = 1""",
    "note_representation": f"""with {Q._WINDOWS}, {reports._BRACKETS}, r as (select * from w where configuration = 'fixed-1000-10') select r.doc_id, r.ordinal, count(nt.start) as n, coalesce(string_agg(cast(nt.start as varchar), ',' order by nt.start), '') as ids
      from r left join nt on nt.doc_id = r.doc_id and nt.start < r."end" and r.start < nt."end" group by 1, 2""",
    "parents_with_children": f"""{_U}, {Q._CHILDREN} select u.doc_id, u.unit, any_value(u.start) as start, any_value(u."end") as "end", count(k.ordinal) as n_children, coalesce(string_agg(k.ordinal || ':' || k.start || '-' || k."end", ',' order by k.ordinal), '') as children from u left join k on u.doc_id = k.doc_id and u.unit = k.unit group by 1, 2""",
}

QUERIES = (
    fixed_window_ids, block_previews, escaped_pages, classified_rows, unit_violations, hybrid_violations, block_violations, source_map_violations, sample_neighbourhood, first_markers, cut_witnesses, note_representation, parents_with_children,
)


def queries():
    return {q.__name__: q for q in QUERIES}
