"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each and interleaved by the
Hilbert curve, rows are sorted by their index on it, and the sorted run is cut into
shards. Neighbours in all dimensions meet in few files, so that readers can skip files by
the minimum and maximum of any dimension.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import picked, staged

BITS = 6


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the curve of integer points (rows x dimensions, each 0 .. 2**bits - 1).

    Transposed form: undo excess work from the top bit down, Gray-encode, then interleave.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= np.where(high, 0, swap)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@F.pandas_udf(T.LongType())
def _curve(cells: pd.Series) -> pd.Series:
    if not len(cells):
        return pd.Series([], dtype="int64")
    return pd.Series(hilbert_index(np.stack(cells.to_numpy())))


def _is_number(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")


def _cuts(df: DataFrame, column: str, steps: int) -> list:
    """At most ``steps`` - 1 values at which cells begin, in the order of the column: approximate quantiles of numbers; of other values, taken as text, those
    at even steps among the distinct ones, whole values in byte order."""
    if _is_number(df, column):
        one = df.select(F.col(column).cast("double").alias("x"))
        return sorted(set(one.approxQuantile("x", [i / steps for i in range(1, steps)], 0.005)))
    values = df.select(F.col(column).cast("string").alias("x")).filter("x is not null").distinct()
    few = [r["x"] for r in values.limit(steps + 1).collect()]
    if len(few) <= steps:
        return sorted(few)[1:]
    order = ranked(values, ["x"])
    n = order.count()
    at = sorted({i * n // steps for i in range(1, steps)})
    return sorted(r["x"] for r in order.filter(F.col("rank").isin(at)).select("x").collect())


def cell(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """Quantised value in the order of the values, from 1 up to 2**bits - 1; 0 for null. Few values are spread over all cells, so that they part the curve as coarsely as any other dimension does."""
    steps, value = (1 << bits) - 1, F.col(column) if _is_number(df, column) else F.col(column).cast("string")
    cuts = _cuts(df, column, steps)
    above = sum((F.when(value > c if _is_number(df, column) else value >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    return F.when(value.isNull(), 0).otherwise(F.floor(above * ((steps - 1) / max(1, len(cuts)))) + 1).cast("int")


def ranked(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``rank``, its 0-based place in the total order; no task holds more than a range of it.

    Rows go to ranges, each range is numbered by itself, and the ranges' counts (a row each) give
    the offsets.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = staged(df.repartitionByRange(n, *order).withColumn("range_no", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("range_no").agg(F.count(F.lit(1)).alias("in_range"))
    before = counts.withColumn("before", F.coalesce(F.sum("in_range").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(*order)) - 1
    return (
        ranges.withColumn("inside", inside)
        .join(F.broadcast(before.select("range_no", "before")), "range_no")  # one row for each of n ranges
        .withColumn("rank", F.col("before") + F.col("inside"))
        .drop("range_no", "inside", "before")
    )


def hilbert_shards(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: tuple[str, ...] = ("lang", "source", "n_chars"),
    bits: int = BITS,
) -> DataFrame:
    """Per row: ``doc_id``, ``size``, ``text_crc32``, ``curve``, ``law`` ('rows'), ``shard``, ``slot``.

    Shards hold equal counts of rows, at most one apart. A null text has size 16 and the CRC of an
    empty one; a null dimension is cell 0. Equal points and repeated rows are ordered by id, size and CRC. An
    empty table gives no rows; missing dimensions aren't allowed; extra columns are ignored.
    """
    return _placed(docs, shards, id_col, text_col, dimensions, bits, ())


def write_shards(
    docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = BITS, partitions: int | None = None
) -> None:
    """The rows of ``docs``, all columns, as Parquet in folders ``shard=k`` of ``path``, in the order of the curve, so that the files' own minima and maxima let
    readers skip them. A shard is as many files as ranges of rows meet in it; no task holds a whole one that is large. Rows as in ``hilbert_shards``.
    """
    rows = _placed(docs, shards, id_col, text_col, dimensions, bits, tuple(docs.columns))
    n = max(shards, partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").select("shard", "row.*").write.partitionBy("shard").parquet(path)


def _placed(docs: DataFrame, shards: int, id_col: str, text_col: str, dimensions: tuple[str, ...], bits: int, kept: tuple[str, ...]) -> DataFrame:
    """With ``kept`` these columns too, in ``row``."""
    if "shard" in kept:
        raise ValueError("a column named shard would clash with the folders' own")
    row = [F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")] if kept else []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"dim{i}") for i, c in enumerate(dimensions)], *row)
    raw, row = F.coalesce(F.col("text"), F.lit("")).cast("binary"), ["row"] if kept else []
    flat = staged(rows.select("doc_id", *[f"dim{i}" for i in range(len(dimensions))], (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *row), "sizes")
    cells = F.array(*[cell(flat, f"dim{i}", bits) for i in range(len(dimensions))])
    placed = ranked(flat.select("doc_id", "size", "text_crc32", _curve(cells).alias("curve"), *row), ["curve", "doc_id", "size", "text_crc32"])
    total = flat.count()
    shard = F.expr(f"rank * {shards} div {max(1, total)}").cast("long")
    placed = placed.withColumn("shard_no", shard)
    first = F.expr(f"(shard_no * {total} + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"), F.col("shard_no").cast("int").alias("shard"),
        (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *row,
    )


def shard_manifest(placed: DataFrame, docs: DataFrame, dimensions: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """Per shard: rows, bytes and the least and greatest value of each dimension, for pruning."""
    dims = picked(docs, doc_id=id_col, **{f"dim{i}": c for i, c in enumerate(dimensions)})
    joined = placed.select("doc_id", "shard", "size").join(dims, "doc_id")
    bounds = [f(f"dim{i}").alias(f"{n}_{c}") for i, c in enumerate(dimensions) for n, f in (("min", F.min), ("max", F.max))]
    return joined.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *bounds)
