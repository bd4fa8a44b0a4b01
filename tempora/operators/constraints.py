"""Declared constraints as queries: what breaks them, and what a cascade removes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) that occur more than once; null keys are no duplicates."""
    whole = df.dropna(subset=keys)
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_violations(df: DataFrame, check: Column) -> DataFrame:
    return df.filter(~F.coalesce(check, F.lit(True)))


def missing_parents(child: DataFrame, parent: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Child rows whose whole key is set and has no parent."""
    keys = parent.select(*(F.col(p).alias(f"_p{i}") for i, (_, p) in enumerate(pairs)))
    on = [child[c] == keys[f"_p{i}"] for i, (c, _) in enumerate(pairs)]
    return child.dropna(subset=[c for c, _ in pairs]).join(keys, on, "left_anti")


def with_parents(child: DataFrame, parent: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    keys = parent.select(*(F.col(p).alias(f"_p{i}") for i, (_, p) in enumerate(pairs)))
    return child.join(keys, [child[c] == keys[f"_p{i}"] for i, (c, _) in enumerate(pairs)], "left_semi")


def cascade(child: DataFrame, gone: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Child rows that a deletion of parents takes with them."""
    return with_parents(child, gone, pairs)
