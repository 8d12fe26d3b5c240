"""Append-only lineage: rows that supersede earlier rows of their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .issues import check
from .keys import in_order


def tails(df: DataFrame, id_col: str, supersedes_col: str) -> DataFrame:
    """Rows that no row supersedes."""
    used = df.select(F.col(supersedes_col).alias(id_col)).filter(F.col(id_col).isNotNull())
    return df.join(used, id_col, "left_anti")


def current(df: DataFrame, key: str, id_col: str, supersedes_col: str) -> DataFrame:
    """The tail of each key that has exactly one.

    One aggregate: Spark pushes a semi join into the parts of a union, whose partitions then may not fit those of the next join ("Can't zip RDDs").
    """
    ends = tails(df, id_col, supersedes_col)
    once = ends.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*df.columns)).alias("__row"))
    return once.filter("__n = 1 and __key is not null").select("__row.*")


def tail_counts(df: DataFrame, key: str, id_col: str, supersedes_col: str) -> DataFrame:
    """Keys that don't have exactly one tail, with their count."""
    return tails(df, id_col, supersedes_col).groupBy(key).agg(F.count(F.lit(1)).alias("n_tails")).filter("n_tails <> 1")


def with_parent(df: DataFrame, id_col: str, supersedes_col: str, columns: list[str]) -> DataFrame:
    """``df`` with ``parent_<column>`` of the row it supersedes, null without one.

    Rows that supersede nothing stay out of the join: all their nulls would meet in one task.
    """
    parents = df.select(F.col(id_col).alias("__parent"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    later = df.filter(F.col(supersedes_col).isNotNull())
    first = df.filter(F.col(supersedes_col).isNull()).select("*", *[F.lit(None).cast(df.schema[c].dataType).alias(f"parent_{c}") for c in columns])
    return later.join(parents, F.col(supersedes_col) == F.col("__parent"), "left").drop("__parent").unionByName(first)


def check_lineage(df: DataFrame, table: str, key: str, id_col: str, supersedes_col: str) -> DataFrame:
    """Superseded rows must exist and be another row; those that do must stand earlier and share the key, each an issue of its own."""
    rows = with_parent(df, id_col, supersedes_col, ["row_number", key]).filter(F.col(supersedes_col).isNotNull())
    itself, there = F.col(supersedes_col) == F.col(id_col), F.col("parent_row_number").isNotNull()
    return check(
        rows, table,
        [
            (supersedes_col, "supersedes_itself", itself), (supersedes_col, "missing_parent", ~itself & ~there),
            (supersedes_col, "later_parent", ~itself & there & (F.col("parent_row_number") >= F.col("row_number"))),
            (supersedes_col, "other_key", ~itself & there & ~F.col(f"parent_{key}").eqNullSafe(F.col(key))),
        ],
    )


def branches(df: DataFrame, table: str, key: str, id_col: str, supersedes_col: str) -> DataFrame:
    """Rows that supersede other than the row that was last of their key then.

    Rows that supersede themselves or a row that doesn't exist never become the last one and aren't judged here.
    """
    rows = with_parent(df, id_col, supersedes_col, ["row_number"]).filter(F.col(supersedes_col).isNull() | (F.col("parent_row_number").isNotNull() & (F.col(supersedes_col) != F.col(id_col))))
    rows = rows.withColumn("__last", F.lag(id_col).over(in_order([key])))
    return check(rows, table, [(supersedes_col, "not_current", F.col(supersedes_col).isNotNull() & ~F.col("__last").eqNullSafe(F.col(supersedes_col)))])


def bad_transitions(df: DataFrame, table: str, id_col: str, supersedes_col: str, status_col: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows whose status may not follow that of the row they supersede."""
    rows = with_parent(df, id_col, supersedes_col, [status_col]).filter(F.col(f"parent_{status_col}").isNotNull())
    fine = F.lit(False)
    for before, after in allowed.items():
        fine = fine | ((F.col(f"parent_{status_col}") == before) & F.col(status_col).isin(*after))
    return check(rows, table, [(status_col, "transition", ~fine)])


def version_number(version: Column) -> Column:
    """Of ``v<n>``, n from 1 up; null for other forms."""
    return F.when(version.rlike(r"^v[1-9]\d{0,17}$"), F.substring(version, 2, 18).try_cast("bigint"))


def version_issues(df: DataFrame, table: str, key: str, version_col: str) -> DataFrame:
    """Versions of other forms, and those not above all earlier ones of their key."""
    earlier = Window.partitionBy(key).orderBy("row_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__v", version_number(F.col(version_col))).withColumn("__most", F.max("__v").over(earlier))
    return check(rows, table, [(version_col, "version_form", F.col("__v").isNull()), (version_col, "version_order", F.col("__v") <= F.col("__most"))])


def modified_in_place(df: DataFrame, table: str, key: list[str], hash_col: str) -> DataFrame:
    """Rows whose hash differs from that of the row before with the same key: changed where a new version was due."""
    rows = df.withColumn("__last", F.lag(hash_col).over(in_order(key)))
    return check(rows, table, [(hash_col, "modified_in_place", F.col("__last").isNotNull() & (F.col("__last") != F.col(hash_col)))])


def repeated(df: DataFrame, table: str, columns: list[str], code: str) -> DataFrame:
    """Rows that repeat a combination, but for its first row; nulls don't count."""
    rows = df.dropna(subset=columns).withColumn("__n", F.row_number().over(in_order(columns)))
    return check(rows, table, [(",".join(columns), code, F.col("__n") > 1)])
