"""Queries of diagnostics, relations, notes and alignment decisions over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import alignment, diagnostics, history, relations, structure, summaries, views, windows
from . import queries as Q
from . import validation

LIMITS = (1000, 2000, 4000)


def _lines(s, d):
    return views.line_blocks(Q.docs(s, d)).select("doc_id", "position", F.col("start").alias("r_start"), F.col("end").alias("r_end"))


def _unit_spans(s, d):
    return Q._units(s, d).select("doc_id", "unit", F.col("start").alias("r_start"), F.col("end").alias("r_end"))


def _samples(s, d):
    """The second quarter of every document of four characters or more."""
    n = F.length("text")
    return Q.docs(s, d).where(n >= 4).select(F.col("doc_id").alias("sample_id"), "doc_id", F.floor(n / 4).cast("int").alias("s_start"), F.floor(n / 2).cast("int").alias("s_end"))


def _larger(s, d):
    """Three units each: a parent from unit 3 k + 1 to unit 3 k + 3."""
    u = Q._units(s, d)
    first = (F.floor((F.col("unit") - 1) / 3) * 3 + 1).cast("long")
    anchors = u.select("doc_id", first.alias("first")).distinct().select("doc_id", ((F.col("first") + 2) / 3).cast("int").alias("parent"), "first", (F.col("first") + 2).alias("last"))
    return relations.larger_parents(u, anchors)


def fixed_corpus_diagnostics(s, d):
    return diagnostics.corpus_diagnostics(Q._sized_windows(s, d), _lines(s, d), _unit_spans(s, d), ["configuration"])


def fixed_sample_diagnostics(s, d):
    return diagnostics.sample_diagnostics(Q._sized_windows(s, d), _samples(s, d), ["configuration"])


def fixed_violations(s, d):
    return validation.window_rules(Q._sized_windows(s, d).where("configuration = 'fixed-1000-10'"), 1000, 100)


def fixed_grid_violations(s, d):
    """All rules of all nine configurations."""
    return validation.grid_rules(windows.fixed_grid(Q.docs(s, d), keep_text=True), Q.docs(s, d), windows.FIXED_GRID)


def unit_size_flags(s, d):
    u = Q._units(s, d).withColumn("size", F.col("end") - F.col("start"))
    edges = summaries.length_summary(u, ["kind"], "size", (10, 90)).select("kind", "p10", "p90")
    return u.join(edges, "kind").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("size") <= F.col("p10")).alias("small"), F.count_if(F.col("size") >= F.col("p90")).alias("large"))


def exceed_shares(s, d):
    return summaries.shares_above(Q._units(s, d).select((F.col("end") - F.col("start")).alias("size")), "size", LIMITS)


def decision_counts(s, d):
    return structure.ledger(Q._blocks_with_markers(s, d)).groupBy("decision").count().withColumnRenamed("count", "n")


def oversized_thresholds(s, d):
    return diagnostics.threshold_rows(Q._units(s, d), windows.TRIGGERS)


def _oversized(s, d):
    """Children of every setting with each trigger that their unit exceeds."""
    u = Q._units(s, d)
    sized = u.select("doc_id", "unit", (F.col("end") - F.col("start")).alias("_size"))
    rows = windows.oversized_children(u, Q.docs(s, d)).join(sized, ["doc_id", "unit"])
    return rows.withColumn("trigger", F.explode(F.array(*[F.lit(t) for t in windows.TRIGGERS]))).where("_size > trigger").drop("_size")


def oversized_exact(s, d):
    return diagnostics.group_metrics(_oversized(s, d).where("method = 'exact'"), ["trigger", "setting"])


def oversized_diagnostics(s, d):
    return diagnostics.group_metrics(_oversized(s, d), ["trigger", "method", "target", "overlap"])


def exact_against_aware(s, d):
    rows = oversized_diagnostics(s, d).groupBy("trigger", "target", "overlap")
    return rows.pivot("method", ["exact", "boundary_aware"]).agg(F.first("n").alias("n"), F.first("repeated").alias("repeated"), F.first("n_reduced").alias("n_reduced"))


def larger_parents(s, d):
    return _larger(s, d)


def parent_expansion(s, d):
    u = Q._units(s, d).select("doc_id", "unit", "kind", (F.col("end") - F.col("start")).alias("c_size"), (F.floor((F.col("unit") - 1) / 3) + 1).cast("int").alias("parent"))
    p = _larger(s, d).select("doc_id", "parent", (F.col("end") - F.col("start")).alias("p_size"))
    return relations.expansion(u.join(p, ["doc_id", "parent"]), ["kind"])


def parent_sample_coverage(s, d):
    return relations.parent_coverage(_samples(s, d), _larger(s, d))


def enclosing_parents(s, d):
    return relations.enclosing(_samples(s, d), Q._units(s, d).withColumnRenamed("unit", "parent"))


def span_context(s, d):
    registry = Q.table(s, d, "documents").select("doc_id", "lang", "source")
    return relations.with_context(Q.hybrid_spans(s, d), Q._units(s, d), registry)


def hybrid_totals(s, d):
    return diagnostics.hybrid_aggregates(Q.hybrid_spans(s, d))


def hybrid_against_fixed(s, d):
    """Covered, repeated and outside characters of samples under hybrid spans less those under fixed windows of 2,000."""
    hybrid = Q.hybrid_spans(s, d).select(F.lit("hybrid").alias("strategy"), "doc_id", "ordinal", "start", "end")
    fixed = Q._sized_windows(s, d).where("configuration = 'fixed-2000-0'").select(F.lit("fixed").alias("strategy"), "doc_id", "ordinal", "start", "end")
    m = diagnostics.sample_diagnostics(hybrid.unionByName(fixed), _samples(s, d), ["strategy"])
    pick = lambda c, x: F.sum(F.when(F.col("strategy") == x, F.col(c)))
    return m.groupBy("sample_id").agg(*[(pick(c, "hybrid") - pick(c, "fixed")).alias(c) for c in ("n", "duplicated", "internal_edges", "outside")])


def strategy_rubric(s, d):
    m = fixed_sample_diagnostics(s, d).join(_samples(s, d).select("sample_id", (F.col("s_end") - F.col("s_start")).alias("sample_size")), "sample_id")
    m = m.withColumns({"units_cut": F.col("internal_edges"), "n_combining": F.lit(0), "largest_parent": F.lit(None).cast("int"), "structural": F.lit(False)})
    return diagnostics.rubric(m, ["configuration", "sample_id"]).groupBy("configuration", "criterion", "rating").agg(F.count("*").alias("n"))


def note_anchors(s, d):
    return history.anchors(history.notes(Q.docs(s, d), "doc_id", Q.CUE, Q.ISSUE), Q.docs(s, d))


def note_shares(s, d):
    pairs = history.parentheses(Q.docs(s, d)).where("end is not null")
    rows = history.shares(Q._sized_windows(s, d).where("configuration = 'fixed-1000-10'").select("doc_id", "ordinal", "start", "end"), pairs, ["ordinal"])
    return rows.agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("annotated").alias("annotated"), F.sum("n_cut").alias("n_cut"))


def uncovered_tokens(s, d):
    """Places of 'the' in no pair of brackets."""
    pairs = history.parentheses(Q.docs(s, d)).where("end is not null")
    return history.uncovered(Q.docs(s, d), pairs, "the ").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def alignment_decisions(s, d):
    items = Q.table(s, d, "benchmark").select(F.col("item_id").alias("reference_id"), F.col("text").alias("excerpt"))
    return alignment.decide(items, Q.docs(s, d))


def page_map(s, d):
    """Pages against the registry of pages, by address without fragment, both as title and as address."""
    p = Q.table(s, d, "pages")
    refs = p.select(F.col("page_id").alias("reference_id"), T.url_without_fragment(F.col("url")).alias("title"), "url")
    registry = p.select(F.col("page_id").alias("doc_id"), T.url_without_fragment(F.col("url")).alias("title"), "url")
    return alignment.map_documents(refs, registry).select("reference_id", F.size("doc_ids").cast("long").alias("n"), "status")


def marker_inventory(s, d):
    rows = Q._blocks_with_markers(s, d).withColumn("is_stop", F.lit(False))
    return relations.marker_spans(rows)


def observed_context(s, d):
    """The last six markers at or before every line."""
    rows = Q._blocks_with_markers(s, d)
    return relations.observed_context(rows.where("kind is not null"), rows.select("doc_id", F.col("position").alias("at")))


def repeated_labels(s, d):
    rows = Q._blocks_with_markers(s, d).where("label is not null").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first"))
    return rows.where("n > 1")


def view_faults(s, d):
    """No row if the view of the lines of every text is the text."""
    view, _ = views.document_view(views.line_blocks(Q.docs(s, d)).select("doc_id", "position", "raw_text"))
    return Q.docs(s, d).where("text is not null").join(view.withColumnRenamed("text", "_v"), "doc_id", "left").where("not (text <=> _v)").select("doc_id")


_S = "smp as (select doc_id as sample_id, doc_id, length(text) // 4 as s_start, length(text) // 2 as s_end from documents where length(text) >= 4)"
_L3 = """pl as (select doc_id, cast((unit - 1) // 3 + 1 as int) as parent, (unit - 1) // 3 * 3 + 1 as first, (unit - 1) // 3 * 3 + 3 as last, min(start) as start, max("end") as "end", count(*) as n_members from u group by 1, 2, 3, 4)"""


def _sampled(rows: str) -> str:
    """Diagnostics of samples from ``rows`` (configuration, doc_id, start, end); unions by gaps and islands."""
    def union(a: str, b: str, name: str) -> str:
        return f"""{name} as (select configuration, sample_id, sum(greatest(0, b - greatest(a, coalesce(m, a)))) as c from
          (select configuration, sample_id, {a} as a, {b} as b, max({b}) over (partition by configuration, sample_id order by {a}, {b} rows between unbounded preceding and 1 preceding) as m from ps) group by 1, 2)"""

    return f"""ps as (select configuration, sample_id, s_start, s_end, r.start, r."end" as stop, greatest(r.start, s_start) as lo, least(r."end", s_end) as hi from {rows} r join smp on smp.doc_id = r.doc_id and r.start < s_end and s_start < r."end" and s_start < s_end),
    {union('lo', 'hi', 'un')}, {union('start', 'stop', 'al')},
    ed as (select configuration, sample_id, count(distinct e) as k from (select configuration, sample_id, s_start, s_end, unnest([start, stop]) as e from ps) where s_start < e and e < s_end group by 1, 2),
    sm as (select configuration, sample_id, count(*) as n, cast(any_value(un.c) as bigint) as covered, cast(sum(hi - lo) - any_value(un.c) as bigint) as duplicated, bool_or(start <= s_start and s_end <= stop) as whole, coalesce(any_value(k), 0) as internal_edges, cast(any_value(al.c) - any_value(un.c) as bigint) as outside, max(stop - start) as largest
      from ps join un using (configuration, sample_id) join al using (configuration, sample_id) left join ed using (configuration, sample_id) group by 1, 2)"""


_U = f"with {Q._LINES}, {Q._MARKED}, {Q._UNITS}"
_HYBRID = f"""{Q._CHILDREN}, h as (select doc_id, unit, 0 as child, start, "end", 'retain_whole' as action from u where "end" - start <= 4000 union all select doc_id, unit, ordinal, start, "end", 'reuse_tested_children' from k),
    ho as (select doc_id, cast(row_number() over (partition by doc_id order by unit, child) as int) as ordinal, unit, child, start, "end", action from h)"""
_TAGGED = ", ".join(f"('{c}', {r})" for c, r in {
    "source preservation": "case when covered = s_end - s_start then 'PASS' else 'FAIL' end", "legal boundary quality": "case when internal_edges > 0 then 'CONCERN' else 'UNCERTAIN' end",
    "chunk size": "case when largest > 4000 then 'CONCERN' else 'PASS' end", "duplication / overlap": "case when duplicated > 0 then 'CONCERN' else 'PASS' end", "context preservation": "'UNCERTAIN'",
    "parent expansion": "'UNCERTAIN'", "metadata usefulness": "'PASS'", "traceability / provenance": "'PASS'", "long-unit handling": "'UNCERTAIN'"}.items())

_BRACKETS = """br as (select doc_id, text, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) in ('(', ')'))) as p from documents where contains(text, '(') or contains(text, ')')),
    bs as (select doc_id, p - 1 as i, case when substr(text, p, 1) = '(' then 1 else -1 end as d, sum(case when substr(text, p, 1) = '(' then 1 else -1 end) over (partition by doc_id order by p) as s from br),
    pr as (select x.doc_id, x.i as start, min(y.i) + 1 as "end" from bs x left join bs y on x.doc_id = y.doc_id and y.i > x.i and y.s < x.s where x.d = 1 group by 1, 2),
    q0 as (select pr.* from pr join documents using (doc_id) where "end" is not null and regexp_matches(substr(text, start + 1, "end" - start), '[0-9]{3}')),
    nt as (select x.* from q0 x where not exists (select 1 from q0 y where x.doc_id = y.doc_id and y.start < x.start and x."end" < y."end"))"""

SQL = {
    "fixed_corpus_diagnostics": f"""{_U}, {Q._WINDOWS}, z as (select configuration, count(*) as n, min("end" - start) as least, max("end" - start) as most, cast(sum("end" - start) as bigint) as total from w group by 1),
      c as (select configuration, cast(sum(length(text)) as bigint) as covered from (select distinct configuration, doc_id, text from w) group by 1),
      p as (select configuration, count(distinct (w.doc_id, b.start)) as paragraphs_cut from w join b on w.doc_id = b.doc_id and ((b.start < w.start and w.start < b."end") or (b.start < w."end" and w."end" < b."end")) group by 1),
      tt as (select configuration, w.doc_id, ordinal, u.start, (u.start < w.start and w.start < u."end") or (u.start < w."end" and w."end" < u."end") as cut, w.start <= u.start and u."end" <= w."end" as contained from w join u on w.doc_id = u.doc_id and w.start < u."end" and u.start < w."end"),
      q as (select configuration, count(distinct (doc_id, start)) filter (cut) as units_cut, count(distinct (doc_id, start)) filter (contained) as units_contained from tt group by 1),
      mm as (select configuration, count(*) filter (k > 1) as n_combining from (select configuration, doc_id, ordinal, count(*) as k from tt group by 1, 2, 3) group by 1)
      select z.*, covered, total - covered as extra, coalesce(paragraphs_cut, 0) as paragraphs_cut, coalesce(units_cut, 0) as units_cut, coalesce(units_contained, 0) as units_contained, coalesce(n_combining, 0) as n_combining from z join c using (configuration) left join p using (configuration) left join q using (configuration) left join mm using (configuration)""",
    "fixed_sample_diagnostics": f"with {_S}, {Q._WINDOWS}, {_sampled('w')} select * from sm",
    "fixed_violations": f"""with {Q._WINDOWS} select 'stride' as "check", count(*) filter (start <> (ordinal - 1) * 900) as violations from w where configuration = 'fixed-1000-10' union all select 'size', count(*) filter ("end" - start not between 1 and 1000) from w where configuration = 'fixed-1000-10'""",
    "unit_size_flags": f'{_U}, q as (select kind, quantile_disc("end" - start, 0.1) as a, quantile_disc("end" - start, 0.9) as z from u group by 1) select kind, count(*) as n, count(*) filter ("end" - start <= a) as small, count(*) filter ("end" - start >= z) as large from u join q using (kind) group by 1',
    "exceed_shares": f'{_U}, v as (select unnest([1000, 2000, 4000]) as "limit") select "limit", count(*) filter ("end" - start > "limit") as n, count(*) as total, round(100 * count(*) filter ("end" - start > "limit") / count(*), 2) as percent from u, v group by 1',
    "decision_counts": f"with {Q._LINES}, {Q._MARKED} select decision, count(*) as n from j group by 1",
    "oversized_thresholds": f"""{_U}, v as (select unnest([2000, 4000, 8000]) as "limit"), g as (select "limit", kind, count(*) filter ("end" - start > "limit") as c, count(*) as a, min("end" - start) filter ("end" - start > "limit") as lo, max("end" - start) filter ("end" - start > "limit") as hi from u, v group by 1, 2)
      select "limit", cast(sum(c) as bigint) as n, cast(sum(a) as bigint) as total, coalesce(string_agg(kind || ':' || c, ',' order by kind) filter (c > 0), '') as kinds, min(lo) as least, max(hi) as most from g group by 1""",
    "oversized_exact": f"""{_U}, g as (select 'exact-' || n || '-' || p as setting, n, n * p // 100 as o from (values (1000), (2000)) a(n), (values (0), (10)) c(p)), x0 as (select setting, doc_id, unit, n, o, "end" - start as size, unnest(range(0, 1 + greatest(0, cast(ceil(("end" - start - n) / (n - o)) as bigint)))) as k from u, g where "end" - start > 2000),
      x as (select setting, o, size, k, k * (n - o) as a, least(k * (n - o) + n, size) as z, lag(least(k * (n - o) + n, size)) over (partition by setting, doc_id, unit order by k) as before from x0)
      select t as "trigger", setting, count(*) as n, cast(min(z - a) as int) as least, cast(max(z - a) as int) as most, cast(sum(z - a) as bigint) as total, cast(sum(greatest(0, coalesce(before - a, 0))) as bigint) as repeated, count(*) filter (k > 0 and greatest(0, before - a) < o) as n_reduced from x, (values (2000), (4000), (8000)) v(t) where size > t group by 1, 2""",
    "larger_parents": f"{_U}, {_L3} select * from pl",
    "parent_expansion": f"""{_U}, {_L3}, r as (select kind, (pl."end" - pl.start) / (u."end" - u.start) as ratio from u join pl on u.doc_id = pl.doc_id and (unit - 1) // 3 + 1 = parent where u."end" > u.start) select kind, count(*) as n, min(ratio) as least, quantile_disc(ratio, 0.5) as median, max(ratio) as most from r group by 1""",
    "parent_sample_coverage": f"""{_U}, {_L3}, {_S} select sample_id, cast(coalesce(sum(least(pl."end", s_end) - greatest(pl.start, s_start)), 0) as bigint) as covered, coalesce(string_agg(cast(parent as varchar), ',' order by parent) filter (pl.start <= s_start and s_end <= pl."end"), '') as whole, coalesce(string_agg(cast(parent as varchar), ',' order by parent) filter (not (pl.start <= s_start and s_end <= pl."end")), '') as partial
      from smp left join pl on pl.doc_id = smp.doc_id and pl.start < s_end and s_start < pl."end" group by 1""",
    "enclosing_parents": f"""{_U}, {_S}, p as (select sample_id, unit as parent, kind not in ('section', 'chapter') as small, u.start, u."end", s_start, s_end from u join smp on u.doc_id = smp.doc_id and u.start < s_end and s_start < u."end"),
      f as (select sample_id from p where small group by 1 having sum(least("end", s_end) - greatest(start, s_start)) = any_value(s_end - s_start)), e as (select sample_id, arg_min(parent, ("end" - start, parent)) as best from p where start <= s_start and s_end <= "end" group by 1),
      c as (select p.sample_id, parent, case when f.sample_id is not null then case when small then 'small' end when best is not null then case when parent = best then 'enclosing' end else 'partial' end as choice from p left join f on f.sample_id = p.sample_id left join e on e.sample_id = p.sample_id) select sample_id, choice, parent from c where choice is not null""",
    "span_context": f"""{_U}, {_HYBRID} select ho.*, greatest(0, coalesce(lag(ho."end") over q - ho.start, 0)) as overlap_before, greatest(0, coalesce(ho."end" - lead(ho.start) over q, 0)) as overlap_after, u.kind, u.label, lang, source from ho join u on u.doc_id = ho.doc_id and u.unit = ho.unit join documents on documents.doc_id = ho.doc_id window q as (partition by ho.doc_id order by ho.ordinal)""",
    "hybrid_totals": f'{_U}, {_HYBRID} select count(*) filter (child = 0) as kept, count(distinct (doc_id, unit)) filter (child > 0) as divided, count(*) filter (child > 0) as children, cast(sum("end" - start) as bigint) as payload, count(*) filter ("end" - start > 2000) as n_long, count(*) filter ("end" - start < 100) as n_short from ho',
    "hybrid_against_fixed": f"""{_U}, {_HYBRID}, {_S}, {Q._WINDOWS}, al2 as (select 'hybrid' as configuration, doc_id, start, "end" from ho union all select 'fixed', doc_id, start, "end" from w where configuration = 'fixed-2000-0'), {_sampled('al2')}
      select sample_id, """ + ", ".join(f"cast(sum({c}) filter (configuration = 'hybrid') - sum({c}) filter (configuration = 'fixed') as bigint) as {c}" for c in ("n", "duplicated", "internal_edges", "outside")) + " from sm group by 1",
    "strategy_rubric": f"with {_S}, {Q._WINDOWS}, {_sampled('w')}, r as (select configuration, unnest([{_TAGGED}]) as t from sm join smp using (sample_id)) select configuration, t[1] as criterion, t[2] as rating, count(*) as n from r group by 1, 2, 3",
    "brackets": f"""with {_BRACKETS} select doc_id, cast(start as int) as start, cast("end" as int) as "end", case when "end" is null then 'unmatched_open' end as reason from pr union all select doc_id, cast(i as int), null, 'unmatched_close' from bs where d = -1 and not exists (select 1 from pr where pr.doc_id = bs.doc_id and pr."end" = i + 1)""",
    "bracket_notes": f'with {_BRACKETS} select doc_id, cast(start as int) as start, cast("end" as int) as "end" from nt',
    "note_anchors": f"""with {_BRACKETS}, x as (select doc_id, start, "end", coalesce(lead(start) over (partition by doc_id order by start), length(text)) as stop, length(regexp_extract(substr(text, "end" + 1), '^[ \\n\\t]*')) as blank from nt join documents using (doc_id))
      select doc_id, cast(start as int) as start, cast("end" as int) as "end", cast(least("end" + blank, stop) as int) as a_start, cast(least(least("end" + blank, stop) + 60, stop) as int) as a_end from x where "end" + blank < stop""",
    "note_shares": f"""with {Q._WINDOWS}, {_BRACKETS}, o as (select * from pr x where "end" is not null and not exists (select 1 from pr y where x.doc_id = y.doc_id and y.start < x.start and x."end" < y."end")),
      r as (select * from w where configuration = 'fixed-1000-10'), a as (select sum(least(r."end", o."end") - greatest(r.start, o.start)) as k from r join o on r.doc_id = o.doc_id and r.start < o."end" and o.start < r."end"),
      c as (select count(*) as k from r join pr on r.doc_id = pr.doc_id and r.start < pr."end" and pr.start < r."end" where pr.start < r.start or pr."end" > r."end")
      select count(*) as n, cast(sum("end" - start) as bigint) as size, cast(coalesce(any_value(a.k), 0) as bigint) as annotated, any_value(c.k) as n_cut from r, a, c""",
    "uncovered_tokens": f"""with {_BRACKETS}, h as (select doc_id, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 4) = 'the ')) as i from documents where contains(text, 'the '))
      select doc_id, count(*) as n, cast(min(i) as int) as first, cast(max(i) as int) as last from h where not exists (select 1 from pr where pr.doc_id = h.doc_id and pr.start <= i and i < pr."end") group by 1""",
    "alignment_decisions": """with f as (select item_id, cast(sum(len(list_filter(range(0, length(d.text) - length(b.text) + 1), lambda i: substr(d.text, i + 1, length(b.text)) = b.text))) as bigint) as k from benchmark b, documents d where length(b.text) > 0 and contains(d.text, b.text) group by 1),
      p as (select distinct item_id, unnest(list_filter(list_transform(range(0, length(text), 40), lambda i: substr(text, i + 1, 80)), lambda s: length(s) >= 60)) as probe from benchmark),
      h as (select item_id, cast(sum(len(list_filter(range(0, length(d.text) - length(probe) + 1), lambda i: substr(d.text, i + 1, length(probe)) = probe))) as bigint) as k from p, documents d where contains(d.text, probe) group by 1)
      select b.item_id as reference_id, case when coalesce(f.k, 0) = 1 then 'exact' when f.k > 1 then 'ambiguous' when coalesce(h.k, 0) = 1 then 'partial' when h.k > 1 then 'ambiguous' else 'unmatched' end as status, coalesce(f.k, 0) as n_full, coalesce(h.k, 0) as n_hits from benchmark b left join f on f.item_id = b.item_id left join h on h.item_id = b.item_id""",
    "page_map": "with r as (select page_id, split_part(url, '#', 1) as a from pages) select x.page_id as reference_id, count(distinct y.page_id) as n, case count(distinct y.page_id) when 1 then 'exact' when 0 then 'unmatched' else 'ambiguous' end as status from r x left join r y on x.a = y.a group by 1",
    "marker_inventory": f"with {Q._LINES}, {Q._MARKED} select doc_id, kind, label, position as first, lead(position) over (partition by doc_id order by position) as stop from m where kind is not null",
    "observed_context": f'with {Q._LINES}, {Q._MARKED}, c as (select doc_id, list(position order by position) as marks from m where kind is not null group by 1), x as (select m.doc_id, m.position as "at", list_reverse(list_filter(marks, lambda p: p <= m.position))[1:6] as last from m join c on m.doc_id = c.doc_id) select doc_id, "at", cast(unnest(range(1, len(last) + 1)) as int) as rank, unnest(last) as position from x where len(last) > 0',
    "repeated_labels": f"with {Q._LINES}, {Q._MARKED} select label, count(*) as n, count(distinct doc_id) as n_docs, min(doc_id) as first from m where label is not null group by 1 having count(*) > 1",
    "view_faults": "select doc_id from documents where text <> text",
}

QUERIES = (
    fixed_corpus_diagnostics, fixed_sample_diagnostics, fixed_violations, fixed_grid_violations, unit_size_flags, exceed_shares, decision_counts, oversized_thresholds, oversized_exact, oversized_diagnostics, exact_against_aware,
    larger_parents, parent_expansion, parent_sample_coverage, enclosing_parents, span_context, hybrid_totals, hybrid_against_fixed, strategy_rubric, note_anchors, note_shares, uncovered_tokens,
    alignment_decisions, page_map, marker_inventory, observed_context, repeated_labels, view_faults,
)


def queries():
    return {q.__name__: q for q in QUERIES}
