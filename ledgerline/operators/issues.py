"""Issues: what every rule returns, one row (table, row_number, column, code) for each violation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SCHEMA = "table string, row_number bigint, column string, code string"


def check(df: DataFrame, table: str, rules: Iterable[tuple[str, str, Column]], row: str = "row_number") -> DataFrame:
    """All rules of a table in one scan. A rule (column, code, condition) fails where its condition is true; null passes."""
    found = [F.when(broken, F.struct(F.lit(column).alias("column"), F.lit(code).alias("code"))) for column, code, broken in rules]
    kept = df.select(F.col(row).cast("long").alias("row_number"), F.array_compact(F.array(*found)).alias("found"))
    return kept.select(F.lit(table).alias("table"), "row_number", F.inline("found")).select("table", "row_number", "column", "code")


def first_failure(df: DataFrame, table: str, rules: Iterable[tuple[str, str, Column]], row: str = "row_number") -> DataFrame:
    """Of rules that exclude each other in order, only the first broken one of a row."""
    found = F.coalesce(*[F.when(broken, F.struct(F.lit(column).alias("column"), F.lit(code).alias("code"))) for column, code, broken in rules])
    return df.select(F.lit(table).alias("table"), F.col(row).cast("long").alias("row_number"), found.alias("f")).filter("f is not null").select("table", "row_number", "f.column", "f.code")


def report(parts: Iterable[DataFrame]) -> DataFrame:
    """One report of several rule results."""
    return reduce(DataFrame.unionByName, parts)


def formatted(issues: DataFrame) -> DataFrame:
    """``issues`` with the line a person reads."""
    return issues.withColumn("line", F.concat(F.col("table"), F.lit(":"), F.col("row_number").cast("string"), F.lit(":"), F.col("column"), F.lit(": "), F.col("code")))


def is_ok(issues: DataFrame) -> bool:
    """The gate between row checks and cross-table rules: the one action of a validation."""
    return issues.isEmpty()
