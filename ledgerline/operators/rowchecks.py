"""Row checks of one table: required cells, types, allowed values and ranges, in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.specs import ColumnSpec, TableSpec
from .issues import check

# The forms of cells that parse.
FORMS = {
    "integer": r"^[+-]?\d+$",
    "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "time": r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?([+-]\d{2}:\d{2})?$",
    "datetime": r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?)?$",
    "aware_datetime": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?[+-]\d{2}:\d{2}$",
    "boolean": r"(?i)^(true|false)$",
}
TARGETS = {"integer": "bigint", "decimal": "decimal(38,10)", "date": "date", "datetime": "timestamp", "aware_datetime": "timestamp"}


def blank(cell: Column) -> Column:
    return F.trim(F.coalesce(cell, F.lit(""))) == ""


def typed(cell: Column, kind: str) -> Column:
    """The cell's value, null where it is blank or doesn't parse. Times stay strings."""
    cell = F.trim(cell)
    well_formed = cell.rlike(FORMS[kind]) if kind in FORMS else F.lit(True)
    if kind == "boolean":
        return F.when(well_formed, F.lower(cell) == "true")
    value = cell.try_cast(TARGETS[kind]) if kind in TARGETS else cell
    return F.when(well_formed & ~blank(cell), value)


def column_rules(spec: ColumnSpec) -> list[tuple[str, str, Column]]:
    cell = F.col(f"`{spec.name}`")
    rules = [(spec.name, "required", blank(cell))] if spec.required else []
    if spec.kind in FORMS:
        rules.append((spec.name, f"not_{spec.kind}", ~blank(cell) & typed(cell, spec.kind).isNull()))
    if spec.allowed:
        rules.append((spec.name, "not_allowed", ~blank(cell) & ~F.trim(cell).isin(*spec.allowed)))
    if spec.kind in ("integer", "decimal"):
        if spec.minimum is not None:
            rules.append((spec.name, "below_minimum", typed(cell, spec.kind) < spec.minimum))
        if spec.maximum is not None:
            rules.append((spec.name, "above_maximum", typed(cell, spec.kind) > spec.maximum))
    return rules


def row_checks(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Issues of all columns that ``raw`` (all strings, with ``row_number``) has."""
    return check(raw, spec.table, [rule for c in spec.columns if c.name in raw.columns for rule in column_rules(c)])


def typed_table(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """``raw`` in declared types, blank cells as nulls."""
    return raw.select("row_number", *[typed(F.col(f"`{c.name}`"), c.kind).alias(c.name) if c.kind != "string" else F.when(~blank(F.col(f"`{c.name}`")), F.col(f"`{c.name}`")).alias(c.name) for c in spec.columns if c.name in raw.columns])


def is_human(cell: Column) -> Column:
    """``human:<id>``"""
    return F.coalesce(cell.rlike(r"^human:\S.*$"), F.lit(False))


def is_authorizer(cell: Column) -> Column:
    """A person or ``system_policy:<id>``."""
    return is_human(cell) | F.coalesce(cell.rlike(r"^system_policy:\S.*$"), F.lit(False))
