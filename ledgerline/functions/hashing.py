"""Canonical forms and hashes of records, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import let


def canonical(cell: Column, kind: str) -> Column:
    """A cell's canonical text: UTC times with ``Z``, with microseconds where there are any, plain decimals with all digits but trailing zeros, lower booleans."""
    if kind in ("datetime", "aware_datetime"):
        utc = F.to_utc_timestamp(cell.cast("timestamp"), F.current_timezone())
        whole = F.unix_micros(cell.cast("timestamp")) % 1_000_000 == 0
        return F.when(whole, F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    if kind == "decimal":
        text, form = F.trim(cell.cast("string")), r"^([+-]?)0*(\d*)(?:\.(\d*?)0*)?$"
        text = let(text, lambda t: F.when(t.rlike(form), t).otherwise(cell.try_cast("decimal(38,18)").cast("string")))  # what is written with an exponent
        parts = let(text, lambda t: F.array(*[F.regexp_extract(t, form, i) for i in (1, 2, 3)]))

        def plain(p: Column) -> Column:
            sign, front, rest = (F.get(p, F.lit(i)) for i in range(3))
            bare = F.concat(F.when(front == "", "0").otherwise(front), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
            return F.when((sign == "-") & (bare != "0"), F.concat(F.lit("-"), bare)).otherwise(bare)

        return let(parts, plain)
    if kind == "integer":
        return cell.cast("bigint").cast("string")
    if kind == "boolean":
        return F.lower(cell.cast("string"))
    return cell.cast("string")


def compact_json(value: Column) -> Column:
    """Compact JSON in which control characters are escaped with lower hex digits."""

    def lower(text: Column) -> Column:
        for code in (*range(0x0A, 0x10), *range(0x1A, 0x20)):
            text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u00{code:02X}", rf"$1\\u00{code:02x}")
        return text

    return let(F.to_json(value), lambda text: F.when(text.contains("\\u00"), lower(text)).otherwise(text))


def record_hash(fields: list[tuple[str, Column]]) -> Column:
    """SHA-256 of the compact JSON of ordered [field, value] pairs; a null value is blank."""
    pairs = [F.array(F.lit(name), F.coalesce(value, F.lit(""))) for name, value in fields]
    return F.sha2(compact_json(F.array(*pairs)), 256)


def _sorted(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    return value


def json_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the compact JSON object of the columns, keys sorted at every depth, nulls kept."""
    fields = [_sorted(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def short_id(prefix: str, parts: list[Column], digits: int = 16) -> Column:
    """``prefix`` and the first digits of the SHA-256 of the parts, joined by bars."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))


def metadata_fingerprint(url: Column, title: Column, document: Column, published: Column, metadata: Column) -> Column:
    """SHA-256 of five ordered [name, value] pairs; null differs from empty, the map goes in key order."""
    entries = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.array(e["key"], e["value"]))
    quoted = lambda c: F.regexp_replace(compact_json(F.array(c)), r"^\[|\]$", "")
    names = ("source_url", "title", "document_id", "published_at")
    parts = [F.concat(F.lit(f'["{n}",'), quoted(c), F.lit("]")) for n, c in zip(names, (url, title, document, published), strict=True)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit(',["stable_metadata",'), F.coalesce(compact_json(entries), F.lit("[]")), F.lit("]]")), 256)


def manifest(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, table, rows, content_hash): what a bundle of each key holds of each table, whatever the rows' order.

    Row hashes are added up word by word: such sums don't depend on the order, and no list of a key's rows is gathered.
    """
    out = None
    for name, df in tables.items():
        hashed = df.select(F.col(key), json_hash(df, [c for c in df.columns if c != key]).alias("h"))
        words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(28,0)")) for i in range(8)]
        sums = F.concat_ws(",", F.count(F.lit(1)).cast("string"), *[w.cast("string") for w in words])
        part = hashed.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sha2(sums, 256).alias("content_hash"))
        part = part.select(key, F.lit(name).alias("table"), "rows", "content_hash")
        out = part if out is None else out.unionByName(part)
    return out


def manifest_differences(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What two manifests don't agree on."""
    a, b = before.alias("a"), after.alias("b")
    joined = a.join(b, [F.col(f"a.{key}") == F.col(f"b.{key}"), F.col("a.table") == F.col("b.table")], "full")
    return joined.filter(~F.col("a.content_hash").eqNullSafe(F.col("b.content_hash"))).select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.coalesce("a.table", "b.table").alias("table"), F.col("a.content_hash").alias("before"), F.col("b.content_hash").alias("after"))
