"""Validation of a table or a data set: row checks first, and cross-table rules where those are clean."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from ..sources.specs import TableSpec
from ..sources.tables import missing_headers
from .issues import is_ok, report
from .keys import duplicate_keys, missing_references
from .rowchecks import row_checks


def validate_table(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Header, row and key issues of one table of strings."""
    parts = [missing_headers(raw, spec), row_checks(raw, spec)]
    parts += [duplicate_keys(raw, spec.table, list(key)).drop("first_row") for key in (spec.primary_key, *spec.unique) if key and set(key) <= set(raw.columns)]
    return report(parts)


def reference_issues(tables: dict[str, DataFrame], specs: dict[str, TableSpec], group: Iterable[str] | None = None) -> DataFrame | None:
    """Missing references between the given tables; with ``group`` only those that stay inside it."""
    inside = set(group or tables)
    parts = [
        missing_references(tables[name], name, list(r.columns), tables[r.table], list(r.ref_columns), r.nullable)
        for name, spec in specs.items() if name in tables and name in inside
        for r in spec.references if r.table in tables and r.table in inside
    ]
    return report(parts) if parts else None


def validate_dataset(tables: dict[str, DataFrame], specs: dict[str, TableSpec], rules: Iterable[Callable[[dict[str, DataFrame]], DataFrame]] = ()) -> DataFrame:
    """All issues of a data set. Cross-table rules run only over clean rows; asking for that is the one action here."""
    rows = report([validate_table(df, specs[name]) for name, df in tables.items()])
    if not is_ok(rows):
        return rows
    between = [p for p in [reference_issues(tables, specs)] if p is not None] + [rule(tables) for rule in rules]
    return report(between) if between else rows
