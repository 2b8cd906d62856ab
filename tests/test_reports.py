"""Report queries beside their SQL, and the relations and decisions on small fixtures."""

import compare
import pytest

from spanlake.operators import alignment, diagnostics, history, relations, windows
from spanlake.plans import queries, reports

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(reports.SQL))
def test_same_as_sql(spark, name):
    assert compare.same(spark, SF, (queries.queries() | reports.queries())[name], reports.SQL[name]) == ""


def test_grid_violations_see_each_fault(spark):
    from spanlake.plans import validation

    got = reports.queries()["fixed_grid_violations"](spark, SF).collect()
    assert len(got) == 9 * 8 and not any(r.violations for r in got)
    texts = spark.createDataFrame([(1, "abcdefghij" * 3), (2, ""), (3, None), (4, "xy")], "doc_id long, text string")
    grid = ((10, 20),)
    good = [tuple(r) for r in windows.fixed_grid(texts, grid, keep_text=True).select("configuration", "doc_id", "ordinal", "start", "end", "text").collect()]

    def faults(rows):
        df = spark.createDataFrame(rows, "configuration string, doc_id long, ordinal int, start int, end int, text string")
        return {r.check for r in validation.grid_rules(df, texts, grid).collect() if r.violations}

    one = good[0][0]
    assert faults(good) == set() and len(good) == 5
    assert faults([r for r in good if r[1:3] != (1, 4)]) == {"count", "coverage"}
    assert faults([r for r in good if r[1] != 4]) == {"count", "coverage"}
    assert faults([*good, (one, 4, 2, 8, 2, "")]) >= {"count", "progress"} and faults([*good, (one, 2, 1, 0, 0, "")]) >= {"count"}
    assert faults([(*r[:5], "?" + r[5][1:]) if r[1:3] == (1, 2) else r for r in good]) == {"text", "overlap_text"}


def test_oversized_children_restore_their_units(spark):
    texts = spark.createDataFrame([(1, "x\n" + "abc def\n" * 700), (2, "y" * 2500), (3, ""), (4, None)], "doc_id long, text string")
    units = spark.createDataFrame([(1, 1, 0, 2), (1, 2, 2, 5602), (2, 1, 0, 2500)], "doc_id long, unit long, start int, end int")
    full = {r.doc_id: r.text for r in texts.collect()}
    seen = {}
    for r in windows.oversized_children(units, texts).orderBy("ordinal").collect():
        seen.setdefault((r.setting, r.doc_id, r.unit, r.target, r.overlap), []).append((r.start, r.end))
    assert len(seen) == 16 and {k[1:3] for k in seen} == {(1, 2), (2, 1)}
    for (_, doc, _, target, overlap), found in seen.items():
        base, stop = (2, 5602) if doc == 1 else (0, 2500)
        assert found[0][0] == base and found[-1][1] == stop
        out, covered = "", base
        for a, b in found:
            assert 0 < b - a <= target and 0 <= covered - a <= overlap
            out, covered = out + full[doc][max(a, covered) : b], b
        assert out == full[doc][base:stop]


def decided(spark, references, texts, locations=None):
    refs = spark.createDataFrame(references, "reference_id int, excerpt string, mapped string, doc_id long, family string, number string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    at = spark.createDataFrame(locations, "doc_id long, family string, number string, start int, end int") if locations else None
    return {r.reference_id: r.status for r in alignment.decide(refs, docs, at).collect()}


def test_decisions(spark):
    probe = "".join(chr(0x430 + i * i % 32) for i in range(80))
    texts = [(1, "абв где абв"), (2, "одно и също " + probe), (3, None), (4, "")]
    refs = [(1, "где", None, None, None, None), (2, "абв", None, None, None, None), (3, probe + " друг край", None, None, None, None), (4, "липсва", None, None, None, None), (5, None, None, None, None, None), (6, "", None, None, None, None), (7, "где", "ambiguous", None, None, None), (8, "где", None, 2, None, None)]
    assert decided(spark, refs, texts) == {1: "exact", 2: "ambiguous", 3: "partial", 4: "unmatched", 5: "unmatched", 6: "unmatched", 7: "ambiguous", 8: "unmatched"}
    places = [(1, "article", "2а", 0, 8), (1, "article", "3", 8, 11)]
    refs = [(1, "где", None, None, "article", "2А"), (2, "где", None, None, "article", "3"), (3, "абв", None, None, "article", "3")]
    assert decided(spark, refs, texts, places) == {1: "exact", 2: "ambiguous", 3: "ambiguous"}


def test_occurrences_overlap_and_blocks(spark):
    texts = spark.createDataFrame([(1, "ааа🙂аа"), (2, "")], "doc_id long, text string")
    wanted = spark.createDataFrame([("аа",), ("🙂",), ("",), (None,), ("аа",), ("zz",)], "pattern string")
    for most in (1, 1000):
        got = alignment.occurrences(wanted, texts, most).collect()
        assert sorted((r.pattern, r.doc_id, r.start, r.end) for r in got) == [("аа", 1, 0, 2), ("аа", 1, 1, 3), ("аа", 1, 4, 6), ("🙂", 1, 3, 4)]
    assert alignment.occurrences(wanted.limit(0), texts).isEmpty()


def test_anchor_stops_before_the_next_note(spark):
    texts = spark.createDataFrame([(1, "(a)  bc(d) " + "e" * 99)], "doc_id long, text string")
    found = spark.createDataFrame([(1, 0, 3), (1, 7, 10)], "doc_id long, start int, end int")
    assert sorted((r.start, r.a_start, r.a_end) for r in history.anchors(found, texts).collect()) == [(0, 5, 7), (7, 11, 71)]


def test_anchor_after_a_long_blank_run(spark):
    texts = spark.createDataFrame([(1, "(a)" + " \n\t" * 70_000 + "bc"), (2, "(a)" + " " * 9000 + "(d)" + " " * 5000)], "doc_id long, text string")
    found = spark.createDataFrame([(1, 0, 3), (2, 0, 3), (2, 9003, 9006)], "doc_id long, start int, end int")
    got = sorted((r.doc_id, r.start, r.a_start, r.a_end) for r in history.anchors(found, texts).collect())
    assert got == [(1, 0, 210_003, 210_005)]  # a note that only white space follows has no anchor


def test_citation_ends_with_a_word(spark):
    from pyspark.sql import functions as F

    from spanlake.functions import text as T

    rows = [("Чл. 2текст", None), ("Чл. 2а текст", "article"), ("§ 6.", "article"), ("Член 7", "article"), (None, "article")]
    got = spark.createDataFrame(rows, "t string, k string").select(T.citation(F.col("t")).alias("c"), T.citation(F.col("t"), F.col("k")).alias("d")).collect()
    assert [r.c and (r.c.family, r.c.number) for r in got] == [None, ("article", "2а"), ("paragraph_sign", "6"), ("article", "7"), None]
    assert [r.d and r.d.number for r in got] == [None, "2а", None, "7", None]


def test_linear_lines_and_windows_of_a_long_text(spark):
    """Lines, paragraphs and windows of one text of a million code points, beside plain slicing."""
    import random

    from spanlake.operators import views

    rng = random.Random(2)
    text = "".join(rng.choice(["ab", "я", "🙂", "\n", " "]) for _ in range(600_000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\n"), (5, "x\n\ny")], "doc_id long, text string")
    got = views.line_blocks(docs).orderBy("doc_id", "position").collect()
    want, texts = [], {1: text, 3: "", 4: "\n", 5: "x\n\ny"}
    for doc, t in texts.items():
        at = 0
        for i, line in enumerate(t.split("\n")):
            want.append((doc, i, line, at, at + len(line)))
            at += len(line) + 1
    assert [tuple(r) for r in got] == want
    spans = {r.doc_id: r.paragraphs for r in windows.paragraph_spans(docs).collect()}
    assert spans[2] is None and spans[3] == [] and [tuple(s) for s in spans[4]] == [(0, 1)] and [tuple(s) for s in spans[5]] == [(0, 2), (2, 3), (3, 4)]
    assert "".join(text[s.a : s.b] for s in spans[1]) == text and all(text[s.b - 1] == "\n" for s in spans[1][:-1])
    cut = windows.fixed_windows(docs, 1000, 100).where("doc_id = 1").orderBy("ordinal").collect()
    assert [r.text for r in cut] == [text[i : i + 1000] for i in range(0, max(1, len(text) - 100), 900)] and all(r.text == text[r.start : r.end] for r in cut)


def test_uncovered(spark):
    texts = spark.createDataFrame([(1, "дв (дв) дв"), (2, "(дв)"), (3, None)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 3, 7), (2, 0, 4)], "doc_id long, start int, end int")
    assert sorted((r.doc_id, r["at"]) for r in history.uncovered(texts, spans, "дв").collect()) == [(1, 0), (1, 8)]


def test_observed_context_of_every_line(spark):
    blocks = {}
    for r in queries._blocks_with_markers(spark, SF).select("doc_id", "position", "kind").collect():
        blocks.setdefault(r.doc_id, []).append((r.position, r.kind))
    want = set()
    for doc, lines in blocks.items():
        marks = sorted(p for p, kind in lines if kind is not None)
        for at, _ in lines:
            want |= {(doc, at, rank, p) for rank, p in enumerate([p for p in marks if p <= at][: -7 : -1], 1)}
    got = [(r.doc_id, r["at"], r.rank, r.position) for r in reports.queries()["observed_context"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want and {at % 10 for _, at, _, _ in got} == set(range(10))


def test_resolve_and_unlike_children(spark):
    links = spark.createDataFrame([("a", "p", "s"), ("b", "p", "s"), ("b", "q", "s")], "child_id string, parent_id string, link_set string")
    assert relations.resolve(links, "a", "s") == "p"
    for child in ("b", "c"):
        with pytest.raises(ValueError):
            relations.resolve(links, child, "s")
    kind = "unit int, ordinal int, start int, end int"
    one = spark.createDataFrame([(1, 1, 0, 4), (2, 1, 4, 8), (3, 1, 8, 9)], kind)
    two = spark.createDataFrame([(1, 1, 0, 4), (2, 1, 4, 7)], kind)
    assert sorted(r.unit for r in relations.unlike_children(one, two, ["unit"]).collect()) == [2, 3]


def test_rubric_limits(spark):
    df = spark.createDataFrame([(1, 10, 10, 0, 0, 4000, 0, 8000, True), (2, 10, 9, 1, 0, 8001, 1, 8001, True)], "k int, sample_size int, covered int, units_cut int, n_combining int, largest int, duplicated int, largest_parent int, structural boolean")
    got = {(r.k, r.criterion): r.rating for r in diagnostics.rubric(df, ["k"]).collect()}
    assert len(got) == 18 and [c for (k, c), r in got.items() if k == 1 and r in ("CONCERN", "FAIL")] == []
    assert sorted(r for (k, _), r in got.items() if k == 2).count("CONCERN") == 5 and got[2, "source preservation"] == "FAIL"
