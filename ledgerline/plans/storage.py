"""Registered queries: tables written to the shared folder and read back through the declared scans and sinks, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.issues import formatted, report
from ..operators.validate import reference_issues, validate_table
from ..sources import tables
from ..sources.specs import ColumnSpec, Reference, TableSpec
from .views import view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


CUSTOMERS = TableSpec("customers", (ColumnSpec("id", "integer", required=True), ColumnSpec("name", required=True), ColumnSpec("segment", allowed=("BUILDING", "MACHINERY")), ColumnSpec("balance", "decimal", minimum=0), ColumnSpec("absent", required=True)), primary_key=("id",))
_CSV = "SELECT CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN concat('Two', chr(10), 'lines, \"quoted\"') ELSE c_name END AS name, c_mktsegment AS segment, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS STRING) AS balance FROM {customer}"


def _written(spark: SparkSession, sf_dir: str) -> str:
    path = tables.new_folder(spark, "csv")
    spark.sql(_CSV, customer=view(spark, sf_dir, "customer")).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


@query(f"WITH c AS ({_CSV.format(customer='customer')}) SELECT id, nullif(name, '') AS name, segment, balance FROM c")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_csv(spark, _written(spark, sf_dir), CUSTOMERS, sequence="id").select("id", "name", "segment", "balance")


@query(f"WITH c AS ({_CSV.format(customer='customer')}) SELECT 'customers:' || id || ':name: required' AS line FROM c WHERE trim(name) = '' UNION ALL SELECT 'customers:' || id || ':segment: not_allowed' FROM c WHERE segment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'customers:' || id || ':balance: below_minimum' FROM c WHERE CAST(balance AS DECIMAL(18, 2)) < 0 UNION ALL SELECT 'customers:1:absent: missing_column'")
def csv_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.scan_csv(spark, _written(spark, sf_dir), CUSTOMERS, sequence="id")
    rows = TableSpec("customers", CUSTOMERS.columns[:4], primary_key=("id",))
    return formatted(tables.missing_headers(df, CUSTOMERS).unionByName(validate_table(df, rows))).select("line")


@query("SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 = 0")
def append_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a second batch whose key the first one has."""
    rows, path = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")), tables.new_folder(spark, "appended")
    tables.append_only(rows.filter("k % 3 = 0"), path, "k")
    return tables.append_only(rows, path, "k")


@query("SELECT c_custkey AS key, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(o_orderkey) <> 1")
def not_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return tables.single(orders, view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key")[1]


@query("SELECT o_orderkey AS id, o_orderpriority AS priority, o_custkey AS customer FROM orders")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.new_folder(spark, "snapshots")
    nested = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer")).alias("detail"))
    tables.replace(nested, path)
    tables.replace(nested, path)  # replaces, doesn't add
    lines = f"{path}-json"
    spark.read.parquet(path).groupBy((F.col("id") % 64).alias("document")).agg(F.collect_list(F.struct("id", "detail")).alias("rows")).write.partitionBy("document").json(lines)  # a document for each of 64 groups
    schema = T.StructType().add("rows", T.ArrayType(T.StructType().add("id", "long").add("detail", T.StructType().add("priority", "string").add("customer", "long"))))
    return tables.scan_snapshots(spark, lines, schema).select(F.inline("rows")).select("id", "detail.priority", "detail.customer")


_ORDERS = "SELECT o_orderkey AS id, o_custkey AS customer, coalesce(o_orderpriority, '') AS priority FROM {orders}"


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) + 1 AS row_number FROM orders")
def csv_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of records over several files, none of them skipped; each file is written from a range of the ids."""
    path = tables.new_folder(spark, "ordered")
    rows = spark.sql(_ORDERS.format(orders="{o}"), o=view(spark, sf_dir, "orders"))
    rows.repartitionByRange(5, "id").sortWithinPartitions("id").write.option("header", True).csv(path)
    spec = TableSpec("orders", (ColumnSpec("id", "integer", required=True), ColumnSpec("priority")))
    return tables.scan_csv(spark, path, spec).select(F.col("id").cast("long").alias("id"), "row_number")


_PARENT = TableSpec("parents", (ColumnSpec("id", "integer", required=True), ColumnSpec("name")), primary_key=("id",))
_CHILD = TableSpec("children", (ColumnSpec("id", "integer", required=True), ColumnSpec("parent", "integer"), ColumnSpec("region", "integer")), primary_key=("id",), references=(Reference(("parent",), "parents", ("id",)), Reference(("region",), "regions", ("id",))))
_REGION = TableSpec("regions", (ColumnSpec("id", "integer", required=True),), primary_key=("id",))
_WRITTEN = {
    "parents": ("customer", "SELECT c_custkey AS id, c_name AS name FROM {customer} WHERE c_custkey % 10 <> 3"), "children": ("orders", "SELECT o_orderkey AS id, o_custkey AS parent, o_orderkey % 7 AS region FROM {orders}"),
    "regions": ("region", "SELECT r_regionkey AS id FROM {region}"),
}


def _dataset(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, str]:
    paths = {}
    for name in names:
        source, sql = _WRITTEN[name]
        paths[name] = tables.new_folder(spark, name)
        spark.sql(sql, **{source: view(spark, sf_dir, source)}).write.option("header", True).csv(paths[name])
    return paths


@query("""SELECT 'dataset' AS part, 'children' AS "table", 'parent' AS "column", 'missing_reference' AS code, count(*) AS n FROM orders WHERE o_custkey % 10 = 3 OR o_custkey NOT IN (SELECT c_custkey FROM customer) HAVING count(*) > 0
  UNION ALL SELECT 'dataset', 'children', 'region', 'missing_reference', count(*) FROM orders WHERE o_orderkey % 7 NOT IN (SELECT r_regionkey FROM region) HAVING count(*) > 0
  UNION ALL SELECT 'group', 'children', 'parent', 'missing_reference', count(*) FROM orders WHERE o_custkey % 10 = 3 OR o_custkey NOT IN (SELECT c_custkey FROM customer) HAVING count(*) > 0
  UNION ALL SELECT 'files', 'notes', '', 'missing_table', 1 UNION ALL SELECT 'files', 'checks', '', 'missing_table', 1""")
def dataset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset read from its files: tables that are missing, references over all of it, and those inside a group of its tables."""
    specs = {s.table: s for s in (_PARENT, _CHILD, _REGION)} | {n: TableSpec(n, (ColumnSpec("id"),)) for n in ("notes", "checks", "drafts", "extra")}
    read, missing = tables.scan_dataset(spark, _dataset(spark, sf_dir, "parents", "children", "regions"), specs, optional={"drafts"}, groups=(frozenset({"regions", "checks"}), frozenset({"extra"})))
    assert not [n for n in ("parents", "children", "regions") if not tables.header_matches(read[n], specs[n])]
    parts = [("files", missing), ("dataset", reference_issues(read, specs)), ("group", reference_issues(read, specs, ("parents", "children")))]
    return report([p.withColumn("part", F.lit(name)) for name, p in parts]).groupBy("part", "table", "column", "code").agg(F.count(F.lit(1)).alias("n"))
