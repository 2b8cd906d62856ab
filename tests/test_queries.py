"""Every query with SQL gives the same rows as DuckDB over the smallest tables; the others satisfy their invariants."""

import compare
import pytest

from spanlake.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, name):
    assert compare.same(spark, SF, plans.queries()[name], plans.SQL[name]) == ""


def test_children_cover_their_parents(spark):
    assert plans.parent_child_faults(spark, SF).isEmpty()


def test_statuses_add_up(spark):
    rows = {r.status: r.n for r in plans.reference_statuses(spark, SF).collect()}
    assert list(rows) == ["exact", "partial", "ambiguous", "unmatched"] and sum(rows.values()) == spark.read.parquet(f"{SF}/benchmark.parquet").count()


def test_fingerprint_is_stable_and_sees_change(spark):
    from spanlake.functions.identity import fingerprint

    one = plans.window_fingerprint(spark, SF).first()
    assert one == plans.window_fingerprint(spark, SF).first()
    a, b = spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), spark.createDataFrame([(2, "x"), (1, None)], "k int, v string")
    assert fingerprint(a).first() == fingerprint(b).first() != fingerprint(a.limit(1)).first()


def test_aware_cuts_fewer_lines(spark):
    rows = {r.method: r.cut for r in plans.aware_against_exact(spark, SF).collect()}
    assert rows["boundary_aware"] < rows["exact"]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 9
    assert set(entry.oracle_sql()) <= set(entry.queries())
