"""Checks as rows: (name, violations), all of one table in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rules(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, violations: how many rows break each rule; null counts as broken."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])).alias("r")).select("r.*")


def window_rules(spans: DataFrame, length: int, overlap: int) -> DataFrame:
    """Fixed windows: stride, size, bounds."""
    size = F.col("end") - F.col("start")
    return rules(spans, {"stride": F.col("start") == (F.col("ordinal") - 1) * (length - overlap), "size": (size > 0) & (size <= length)})


def grid_rules(spans: DataFrame, texts: DataFrame, grid: tuple[tuple[int, int], ...]) -> DataFrame:
    """configuration, check, violations of fixed windows (configuration, doc_id, ordinal, start, end, text) in every setting.

    Windows: stride, end, text (that of the source), progress (no gap, something new), overlap and overlap_text.  Documents:
    count (the closed form, missing and surplus windows) and coverage (from 0 to the end of the text)."""
    configs = F.array(*[F.struct(F.lit(f"fixed-{n}-{p}").alias("configuration"), F.lit(n).alias("_n"), F.lit(n * p // 100).alias("_o")) for n, p in grid])
    full = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("_full"))
    docs = texts.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("_size"), F.explode(configs).alias("c")).select("doc_id", "_size", "c.*")
    w = Window.partitionBy("doc_id", "configuration").orderBy("ordinal")
    # Digests take the place of texts before the shuffle.
    rows = spans.withColumn("c", F.filter(configs, lambda c: c["configuration"] == F.col("configuration"))[0]).select("configuration", "doc_id", "ordinal", "start", "end", "c._n", "c._o", "text")
    rows = rows.withColumns({"_d": F.md5("text"), "_head": F.md5(F.expr("substring(text, 1, _o)")), "_tail": F.md5(F.expr("substring(text, greatest(length(text) - _o, 0) + 1, _o)"))}).drop("text")
    rows = rows.withColumns({"_end": F.lag("end").over(w), "_before": F.lag("_tail").over(w), "_first": F.row_number().over(w) == 1}).join(full, "doc_id", "left").withColumn("_size", F.length("_full"))
    first = F.col("_first")
    same = F.col("_before") == F.col("_head")
    by_window = {
        "stride": F.col("start") == (F.col("ordinal") - 1) * (F.col("_n") - F.col("_o")), "end": F.col("end") == F.least(F.col("start") + F.col("_n"), F.col("_size")),
        "text": F.col("_d") == F.md5(F.expr("substring(_full, start + 1, end - start)")), "progress": first & (F.col("start") == 0) & (F.col("end") > 0) | ~first & (F.col("start") <= F.col("_end")) & (F.col("end") > F.col("_end")),
        "overlap": first | (F.col("_end") - F.col("start") == F.col("_o")), "overlap_text": first | (F.col("_o") == 0) | same,
    }
    have = spans.groupBy("configuration", "doc_id").agg(F.count("*").alias("_k"), F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    whole = docs.join(have, ["configuration", "doc_id"], "full")
    k = F.when(F.col("_size") > 0, 1 + F.greatest(F.lit(0), F.ceil((F.col("_size") - F.col("_n")) / (F.col("_n") - F.col("_o"))))).when(F.col("_size") == 0, 0)
    by_text = {"count": F.coalesce("_k", F.lit(0)) == k, "coverage": (F.col("_size") == 0) & F.col("_k").isNull() | (F.col("_lo") == 0) & (F.col("_hi") == F.col("_size"))}

    def counted(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
        one = df.groupBy("configuration").agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
        return one.select("configuration", F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])).alias("r")).select("configuration", "r.*")

    return counted(rows, by_window).unionByName(counted(whole, by_text))


def unique(df: DataFrame, key: list[str]) -> bool:
    return df.groupBy(*key).count().where("count > 1").isEmpty()


def same_rows(one: DataFrame, two: DataFrame) -> bool:
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def forbidden_fields(df: DataFrame, names: frozenset[str]) -> list[str]:
    """Paths of fields, at any depth of the schema, that may not be there."""
    def walk(kind, path: str) -> list[str]:
        if hasattr(kind, "fields"):
            return [p for f in kind.fields for p in ([f"{path}{f.name}"] if f.name in names else []) + walk(f.dataType, f"{path}{f.name}.")]
        inner = [getattr(kind, a) for a in ("elementType", "keyType", "valueType") if hasattr(kind, a)]
        return [p for k in inner for p in walk(k, path)]

    return walk(df.schema, "")
