"""Declared schemas: what columns a table has, their types, keys and references. Never inferred."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T

_SPARK = {"integer": T.LongType(), "decimal": T.DecimalType(38, 10), "date": T.DateType(), "datetime": T.TimestampType(), "aware_datetime": T.TimestampType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str = "string"
    required: bool = False
    header_required: bool = True
    allowed: tuple[str, ...] = ()
    minimum: float | None = None
    maximum: float | None = None


@dataclass(frozen=True)
class Reference:
    columns: tuple[str, ...]
    table: str
    ref_columns: tuple[str, ...]
    nullable: bool = False


@dataclass(frozen=True)
class TableSpec:
    table: str
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = field(default=())

    @property
    def required_headers(self) -> list[str]:
        return [c.name for c in self.columns if c.header_required]

    def raw_schema(self) -> T.StructType:
        """All strings, as files hold them."""
        return T.StructType([T.StructField(c.name, T.StringType()) for c in self.columns])

    def struct(self) -> T.StructType:
        """Declared types; what else is known of a column is its metadata."""
        return T.StructType([T.StructField(c.name, _SPARK.get(c.kind, T.StringType()), True, {"kind": c.kind, "required": c.required, "allowed": list(c.allowed), "key": c.name in self.primary_key}) for c in self.columns])


def parse_spec(text: str) -> TableSpec:
    """A spec from its JSON form: table, columns, primary_key, unique, foreign_keys."""
    raw = json.loads(text)
    columns = tuple(
        ColumnSpec(c["name"], c.get("type", "string") if c.get("type") != "enum" else "string", bool(c.get("required")), c.get("header_required", True), tuple(c.get("allowed", ())), c.get("min"), c.get("max"))
        for c in raw["columns"]
    )
    references = tuple(Reference(tuple(r["columns"]), r["ref_table"], tuple(r["ref_columns"]), bool(r.get("nullable"))) for r in raw.get("foreign_keys", ()))
    return TableSpec(raw["table"], columns, tuple(raw.get("primary_key", ())), tuple(tuple(u) for u in raw.get("unique", ())), references)


def load_specs(folder: str | Path) -> dict[str, TableSpec]:
    """All ``*.schema.json`` of a folder, by table."""
    specs = [parse_spec(p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.schema.json"))]
    return {s.table: s for s in specs}
