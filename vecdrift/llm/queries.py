"""The thin queries of this subpackage and their SQL, keyed by name; ``__spark_entry__`` adds them if it can import this."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, line_dedup, mixing, quality_model, quality_rules, secrets, simhash, suffix_dedup, token_output, toxicity
from .common import table


def _docs(module) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: module.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": _docs(secrets),
    "op2_line_dedup": _docs(line_dedup),
    "op3_quality": lambda spark, d: quality_model.digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_simhash": _docs(simhash),
    "op5_decontaminate": lambda spark, d: decontaminate.digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op6_mixing": _docs(mixing),
    "op7_suffix_dedup": _docs(suffix_dedup),
    "op8_token_output": _docs(token_output),
    "op9_quality_rules": _docs(quality_rules),
    "op10_toxicity": lambda spark, d: toxicity.digest(table(spark, d, "documents"), table(spark, d, "labels")),
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": secrets.ORACLE_SQL,
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op7_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
}
