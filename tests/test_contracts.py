"""Contract queries beside their SQL; and faults that must be seen."""

import compare
import pytest
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import evidence
from spanlake.plans import contracts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(contracts.SQL))
def test_same_as_sql(spark, name):
    assert compare.same(spark, SF, contracts.queries()[name], contracts.SQL[name]) == ""


def faults(rows):
    return {r.check for r in rows.collect() if r.violations}


def test_faults_are_seen(spark):
    ends = spark.createDataFrame([(1, 9), (2, 4)], "doc_id long, n int")
    units = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, unit long, start int, end int")
    good = [(1, 1, 0, 5), (1, 2, 5, 9), (2, 1, 0, 4)]
    assert faults(evidence.partition_faults(units(*good), ends)) == set()
    assert faults(evidence.partition_faults(units((1, 1, 0, 5), (1, 2, 6, 8)), ends)) == {"seam", "last", "missing"}
    assert faults(evidence.partition_faults(units((1, 1, 1, 1), (1, 2, 1, 9), good[2]), ends)) == {"empty", "first"}
    out = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, ordinal int, unit long, child int, start int, end int")
    fine = [(1, 1, 1, 1, 0, 3), (1, 2, 1, 2, 2, 5), (1, 3, 2, 0, 5, 9), (2, 1, 1, 0, 0, 4)]
    assert faults(evidence.composition_faults(out(*fine), units(*good), 4)) == set()
    assert faults(evidence.composition_faults(out(fine[0], (1, 2, 1, 2, 4, 5), *fine[2:]), units(*good), 4)) == {"gap"}
    assert faults(evidence.composition_faults(out((1, 1, 1, 0, 0, 5), (1, 5, 2, 1, 5, 8), fine[3]), units(*good), 4)) == {"kept", "divided", "covered", "ordinal"}
    blocks = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, position int, raw_text string, start int, end int")
    assert faults(evidence.block_faults(blocks((1, 0, "ab", 0, 2), (1, 1, "", 3, 3), (1, 2, "c", 4, 5)))) == set()
    assert faults(evidence.block_faults(blocks((1, 0, "ab", 0, 3), (1, 0, "ab", 0, 2), (1, 3, "c", 4, 5)))) == {"position", "size", "start", "repeated"}


def test_values_and_scalars(spark):
    rows = spark.createDataFrame([(1, 0, "lang", "de"), (1, 2, "lang", ""), (1, 1, "lang", None)], "doc_id long, row_index int, field string, raw_value string")
    assert evidence.raw_values(rows, 1, "lang", ("lang", "x")) == ["de", None, ""] and evidence.raw_values(rows, 1, "x", ("lang", "x")) == []
    for doc, field in ((2, "lang"), (1, "y")):
        with pytest.raises(ValueError):
            evidence.raw_values(rows, doc, field, ("lang", "x"))
    df = spark.createDataFrame([("a & 'b' <c> \"d\"", 2), (None, 2), ("X", 3), ("X", 2)], "t string, h int")
    got = df.select(T.escaped(F.col("t")).alias("e"), T.is_region_marker(F.col("t"), F.col("h"), "X").alias("m")).collect()
    assert got[0].e == "a &amp; &#x27;b&#x27; &lt;c&gt; &quot;d&quot;" and got[1].e is None and [r.m for r in got] == [False, False, False, True]
