"""The operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import decontam, katz, licenses, linededup, quality, secrets, sentencepieces, simhash, topk, toxicity
from tempora.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def docs(f):
        return lambda spark, d: f(table(spark, d, "documents"))

    def docs_and(other, f):
        return lambda spark, d: f(table(spark, d, "documents"), table(spark, d, other))

    return {
        "op1_quality_classifier": docs_and("labels", quality.query),
        "op2_line_dedup": docs(linededup.query),
        "op3_license_scan": docs(licenses.query),
        "op4_secret_scan": docs(secrets.query),
        "op5_simhash_near_dedup": docs(simhash.query),
        "op6_sentencepiece": docs(sentencepieces.query),
        "op7_exact_topk": lambda spark, d: topk.query(table(spark, d, "embeddings")),
        "op8_decontamination": docs_and("benchmark", decontam.query),
        "op9_katz_lm": docs(katz.query),
        "op10_toxicity": docs_and("labels", toxicity.query),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": licenses.oracle(), "op7_exact_topk": topk.ORACLE}
