"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bbit_minhash, binary_packing, fit_packing, isolation_rules, language_id, merkle_fixity, neighbour_quality, template_leaks, token_rollup, weak_toxicity
from .frames import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_rollup": lambda s, d: token_rollup.maintained(table(s, d, "documents"), table(s, d, "labels")),
        "op2_fit_packing": lambda s, d: fit_packing.digests(table(s, d, "documents")),
        "op3_language_id": lambda s, d: language_id.predictions(table(s, d, "documents")),
        "op4_binary_packing": lambda s, d: binary_packing.digests(table(s, d, "documents")),
        "op5_isolation_rules": lambda s, d: isolation_rules.verdicts(table(s, d, "documents"), table(s, d, "labels")),
        "op6_merkle_fixity": lambda s, d: merkle_fixity.replicas(table(s, d, "pages")),
        "op7_weak_toxicity": lambda s, d: weak_toxicity.predictions(table(s, d, "documents"), table(s, d, "labels")),
        "op8_bbit_minhash": lambda s, d: bbit_minhash.groups(table(s, d, "documents")),
        "op9_neighbour_quality": lambda s, d: neighbour_quality.predictions(table(s, d, "documents"), table(s, d, "labels")),
        "op10_template_leaks": lambda s, d: template_leaks.leaks(table(s, d, "documents"), table(s, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_merkle_fixity": merkle_fixity.ORACLE}
