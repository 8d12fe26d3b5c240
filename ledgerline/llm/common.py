"""What the operators share: staged tables in the cluster's shared folder and input selection."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset (local tests) a temporary folder of this machine takes its place.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: later stages restart from files that outlive any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra or clashing ones go."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def integral(df: DataFrame, id_col: str) -> Column:
    """An integer id as long; ids of other types are refused, since a cast would lose them."""
    kind = df.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer, not {kind}")
    return F.col("doc_id").cast("long")


def give_back() -> None:
    """Give the memory that this process has freed back to the system: Spark's Python workers live on, and so does what an earlier stage's tasks left in them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Groups of more than one in so many rows are hot; there are at most so many of them.
HOT_PARTS = 1024


def with_groups(rows: DataFrame, groups: DataFrame, key: str, spread: str, n_rows: int) -> DataFrame:
    """Left join of ``rows`` to ``groups``, which has one row for each ``key`` (never null) and its number of rows, ``n``.

    Hot groups, at most ``HOT_PARTS``, are broadcast, and their rows are dealt by ``spread`` over the parts of the
    shuffle join that all other groups take.
    """
    hot = F.col("n") * HOT_PARTS > n_rows
    fields = [c for c in groups.columns if c != key]
    large = groups.filter(hot).select(key, F.struct(*fields).alias("__hot"))
    # one struct, since a part of its own that is 0 on one side would become a filter and no key of the shuffle
    small = groups.filter(~hot).select(F.struct(F.col(key).alias("key"), F.lit(0).alias("part")).alias("__to"), F.struct(*fields).alias("__cool"))
    part = F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(HOT_PARTS)).cast("int"))
    met = rows.join(F.broadcast(large), key, "left").withColumn("__to", F.struct(F.col(key).alias("key"), part.alias("part"))).join(small, "__to", "left")
    return met.withColumn("__group", F.coalesce("__hot", "__cool")).select(*rows.columns, *[F.col(f"__group.{c}") for c in fields])
