"""Keys and references between tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .rowchecks import blank


def duplicate_keys(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """Rows that repeat a key, with the first row that has it. Rows with a blank part don't count."""
    whole = df.filter(~_any_blank(key))
    # The first row by aggregate and join: a hot key doesn't meet in one window.
    first = whole.groupBy(*key).agg(F.min("row_number").alias("first_row"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = whole.join(first, key).filter(F.col("row_number") > F.col("first_row"))
    return again.select(F.lit(table).alias("table"), "row_number", F.lit(",".join(key)).alias("column"), F.lit("duplicate_key").alias("code"), "first_row")


def _any_blank(columns: Iterable[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | blank(F.col(c).cast("string"))
    return out


def _all_blank(columns: Iterable[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & blank(F.col(c).cast("string"))
    return out


def missing_references(df: DataFrame, table: str, columns: list[str], parents: DataFrame, ref_columns: list[str], nullable: bool = False) -> DataFrame:
    """Rows whose reference no parent has. A nullable one is let off only if all its parts are blank."""
    rows = df.filter(~_all_blank(columns)) if nullable else df
    ids = parents.select(*[F.col(r).alias(f"__{i}") for i, r in enumerate(ref_columns)])  # an anti join needs no distinct keys
    link = [rows[c].eqNullSafe(ids[f"__{i}"]) if not nullable else rows[c] == ids[f"__{i}"] for i, c in enumerate(columns)]
    lost = rows.join(ids, link, "left_anti")
    return lost.select(F.lit(table).alias("table"), F.col("row_number").cast("long"), F.lit(",".join(columns)).alias("column"), F.lit("missing_reference").alias("code"))


def entity_ids(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(entity_type, entity_id) of the primary keys of several tables."""
    parts = [df.select(F.lit(name).alias("entity_type"), F.col(key).cast("string").alias("entity_id")) for name, (df, key) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def missing_entities(df: DataFrame, table: str, type_col: str, id_col: str, entities: DataFrame) -> DataFrame:
    """Rows whose (type, id) no entity has."""
    lost = df.join(entities, (df[type_col] == entities["entity_type"]) & (df[id_col] == entities["entity_id"]), "left_anti")
    return lost.select(F.lit(table).alias("table"), F.col("row_number").cast("long"), F.lit(f"{type_col},{id_col}").alias("column"), F.lit("missing_entity").alias("code"))


def in_order(key: list[str], order: str = "row_number") -> Window:
    return Window.partitionBy(*key).orderBy(order)
