"""Data-quality rules as data: one long table of violations, its summary, and checks of columns and types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule that a row breaks where ``broken`` is true (null is not broken)."""

    rule_id: str
    severity: str
    broken: Column
    detail: Column


def violations(df: DataFrame, key: Column, rules: list[Rule]) -> DataFrame:
    """(rule_id, severity, row_key, detail): one row for each rule a row breaks, from one pass over the rows."""
    one = [F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), r.detail.cast("string").alias("detail"))) for r in rules]
    return df.select(key.cast("string").alias("row_key"), F.inline(F.array_compact(F.array(*one)))).select("rule_id", "severity", "row_key", "detail")


def summary(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, severity, n_checked, n_broken, passed) of every rule, broken or not, from one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(r.broken, F.lit(False))).alias(f"b{i}") for i, r in enumerate(rules)])
    rows = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.col("n").alias("n_checked"), F.col(f"b{i}").alias("n_broken"), (F.col(f"b{i}") == 0).alias("passed")) for i, r in enumerate(rules)]
    return one.select(F.inline(F.array(*rows)))


def required(columns: list[str]) -> list[Rule]:
    return [Rule(f"null_{c}", "error", F.col(c).isNull(), F.lit(c)) for c in columns]


def not_blank(columns: list[str]) -> list[Rule]:
    return [Rule(f"blank_{c}", "warning", F.trim(c) == "", F.lit(c)) for c in columns]


def within(column: str, low: float, high: float, severity: str = "error") -> Rule:
    return Rule(f"range_{column}", severity, ~F.col(column).between(low, high), F.col(column))


def domain(column: str, *values: str) -> Rule:
    """Values outside a list, case aside; nulls are allowed."""
    return Rule(f"domain_{column}", "warning", ~F.lower(column).isin(*[v.lower() for v in values]), F.col(column))


def column_report(spark: SparkSession, df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(column_name, problem, severity): missing (error), extra (warning) and wrongly typed columns; an integer serves as a number."""
    have, wide = dict(df.dtypes), {"int", "bigint", "double", "float", "smallint"}
    rows = [(c, "missing", "error") for c in expected if c not in have] + [(c, "extra", "warning") for c in have if c not in expected]
    rows += [(c, f"type {have[c]}, not {t}", "error") for c, t in expected.items() if c in have and have[c] != t and not (t == "double" and have[c] in wide) and have[c] != "void"]
    return spark.createDataFrame(rows, "column_name string, problem string, severity string")
