"""Scans and sinks: declared CSV and JSON tables in, append-only or replaceable results out."""

from __future__ import annotations

import csv
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.issues import SCHEMA
from .specs import TableSpec


#: Up to so many blocks of files their offsets are broadcast (about 200 bytes each).
BROADCAST_BLOCKS = 100_000


def _offsets(rows: DataFrame) -> DataFrame:
    """A row for each block of a file: the rows before it (in the order of paths and blocks), its first row's id, and how many files began up to it."""
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    blocks = blocks.withColumn("begins", F.col("block") == F.min("block").over(Window.partitionBy("file")))
    order = Window.orderBy("file", "block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.select("file", "block", "first_at", "begins", before.alias("before"), F.sum(F.col("begins").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("files"))


def scan_csv(spark: SparkSession, path: str, spec: TableSpec, sequence: str | None = None) -> DataFrame:
    """All cells as strings, blanks as nulls, and ``row_number``: 1 is the header, the first record is 2, without gaps.

    Several files of one table count on in the order of their paths. With ``sequence`` that column gives the numbers instead. Lines are read
    in blocks of files wherever no cell holds a line end; else a file is one task. Rows are written once with their block and place in
    it; the blocks' counts give the offsets. Empty lines aren't records; cells beyond the header's go, missing ones are null, of a repeated
    name the last column counts. Files with different headers are refused. Without any line there are no columns but ``row_number``.
    """
    where = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = staged_rows(spark.read.text(path).select("value", *where).filter("value <> ''").withColumn("at", F.monotonically_increasing_id()))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    firsts = lines.groupBy("file", "block").agg(F.min_by("value", "at").alias("head"), F.max(odd).alias("odd")).groupBy("file").agg(F.min_by("head", "block").alias("head"), F.max("odd").alias("odd"), F.count(F.lit(1)).alias("blocks"))
    bare = F.regexp_replace("head", "^\ufeff", "")
    found = firsts.agg(F.min(bare).alias("head"), F.max(bare).alias("other"), F.max("odd").alias("odd"), F.sum("blocks").alias("blocks")).first()  # one row
    if found["head"] is None:
        return spark.range(0).select(F.col("id").alias("row_number"))
    if found["head"] != found["other"]:
        raise ValueError("files of one table have different headers")
    split = not found["odd"]
    if split:
        header = next(csv.reader([found["head"]]))
    else:
        whole = spark.read.option("multiLine", True).option("escape", '"').option("header", True)
        header = [h.lstrip("\ufeff") for h in whole.csv(path).columns]
    names = [f"_c{i}" for i in range(len(header))]
    schema = ", ".join(f"{c} string" for c in names)
    if split:
        rows = lines.select("file", "block", "at", F.from_csv("value", F.lit(schema), {"escape": '"'}).alias("r"))
    else:
        read = whole.option("enforceSchema", True).schema(schema).csv(path).select(F.struct(*names).alias("r"), *where)
        rows = staged_rows(read.withColumn("at", F.monotonically_increasing_id()))
    offsets = _offsets(rows.select("file", "block", "at"))
    if found["blocks"] <= BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    placed = rows.join(offsets, ["file", "block"])
    inside = F.col("at") - F.col("first_at")
    number = F.col("before") + inside + 2
    if split:
        placed, number = placed.filter(~F.col("begins") | (inside > 0)), number - F.col("files")
    last = {h: f"r.{c}" for h, c in zip(header, names, strict=True)}
    order = F.col(last[sequence]).cast("long") if sequence else number
    cells = [F.when(F.trim(F.col(last[c.name])) != "", F.col(last[c.name])).alias(c.name) for c in spec.columns if c.name in last]
    return placed.select(order.alias("row_number"), *cells)


def missing_headers(df: DataFrame, spec: TableSpec) -> DataFrame:
    """An issue for each column that the header must have and hasn't. Only names are looked at."""
    rows = [(spec.table, 1, c, "missing_column") for c in spec.required_headers if c not in df.columns]
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def header_matches(df: DataFrame, spec: TableSpec) -> bool:
    """A registry's header has exactly the declared columns in order."""
    return [c for c in df.columns if c != "row_number"] == [c.name for c in spec.columns]


def scan_dataset(spark: SparkSession, paths: dict[str, str], specs: dict[str, TableSpec], optional: set[str] = frozenset(), groups: tuple[frozenset[str], ...] = ()) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, issues). Optional tables may be missing; of a group all or none may be."""
    tables, missing = {}, []
    for name, spec in specs.items():
        if name in paths:
            tables[name] = scan_csv(spark, paths[name], spec)
        else:
            partly = any(name in g and g & paths.keys() for g in groups)
            if partly or name not in optional | frozenset().union(*groups):
                missing.append((name, 0, "", "missing_table"))
            tables[name] = spark.createDataFrame([], T.StructType([T.StructField("row_number", T.LongType()), *spec.raw_schema().fields]))
    return tables, spark.createDataFrame(missing, SCHEMA)


def scan_snapshots(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Nested JSON documents, one a file, in their declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def single(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose key it has once, keys with their count where it isn't one)."""
    counts = keys.select(key).distinct().join(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    return df.join(counts.filter("n = 1").select(key), key, "left_semi"), counts.filter("n <> 1")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share, which a cluster names in ``spark.checkpoint.dir``; only a local session may do without."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append_only(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key is new: neither in ``path`` nor repeated inside ``df``. All others come back, unwritten.

    One writer at a time: two that append at once could both find a key new. Rows are dealt by their key before anything is counted: keys are mostly
    distinct, so that a count of each file's part would hold all its keys at once.
    """
    spark = df.sparkSession
    columns, alone = df.columns, "__once"
    df = dealt(df, key).withColumn(alone, (F.count(F.lit(1)).over(Window.partitionBy(key)) == 1) & F.col(key).isNotNull())
    repeated, df = df.filter(~F.col(alone)).select(*columns), df.filter(alone).select(*columns)
    try:
        held = spark.read.parquet(path).select(key)
    except AnalysisException as missing:  # nothing written yet
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        df.write.parquet(path)
        return repeated
    refused = staged_rows(df.join(held, key, "left_semi").select(*columns).union(repeated))  # before the append changes what is known
    df.join(held, key, "left_anti").select(*columns).write.mode("append").parquet(path)
    return refused


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over many tasks, for rows that are small in their file but cost much work each; a given number isn't coalesced again."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def staged_rows(df: DataFrame) -> DataFrame:
    """``df`` as it is now, written to the shared folder."""
    path = new_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)
