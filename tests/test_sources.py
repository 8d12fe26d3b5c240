"""CSV scans: numbers of records over blocks and files, line ends in cells, headers."""

import csv
import random

import pytest

from ledgerline.sources import specs, tables

SPEC = specs.TableSpec("t", (specs.ColumnSpec("id", "integer"), specs.ColumnSpec("text"), specs.ColumnSpec("absent")))


def written(path, rows, header=("id", "text", "more")):
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerows([header, *rows])


def expected(*paths):
    out, number = [], 2
    for path in paths:
        with path.open(encoding="utf-8-sig", newline="") as f:
            for row in csv.DictReader(f):
                out.append((number, row["id"] or None, row["text"] if (row["text"] or "").strip() else None))
                number += 1
    return out


def scanned(spark, path):
    return sorted(tuple(r) for r in tables.scan_csv(spark, str(path), SPEC).collect())


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("odd", ["plain", 'a "quoted" word, with commas', "two\nlines", ""])
def test_numbers_over_blocks_and_files(spark, tmp_path, small_blocks, odd):
    dice = random.Random(3)
    files = []
    for k in range(3):
        files.append(tmp_path / f"part-{k}.csv")
        rows = [(i, dice.choice([odd, "x" * dice.randint(0, 60), "é", "  "]), "m") for i in range(k * 1000, k * 1000 + (400, 1, 250)[k])]
        written(files[-1], rows)
    with files[2].open("a") as f:
        f.write("\n\n77,last\n")
    got = scanned(spark, tmp_path)
    assert got == expected(*files)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5


def test_one_row_and_no_rows(spark, tmp_path):
    written(tmp_path / "a.csv", [])
    assert scanned(spark, tmp_path / "a.csv") == []
    (tmp_path / "b.csv").write_text("")
    assert tables.scan_csv(spark, str(tmp_path / "b.csv"), SPEC).columns == ["row_number"]
    (tmp_path / "c.csv").write_text('\n\n"id",text\n1,a,extra,cells\n2\n')
    assert scanned(spark, tmp_path / "c.csv") == [(2, "1", "a"), (3, "2", None)]


def test_different_headers_are_refused(spark, tmp_path):
    written(tmp_path / "a.csv", [(1, "a", "b")])
    written(tmp_path / "b.csv", [(1, "a", "b")], header=("id", "more", "text"))
    with pytest.raises(ValueError):
        tables.scan_csv(spark, str(tmp_path), SPEC)


def test_specs_are_read_from_a_folder(spark, tmp_path):
    (tmp_path / "t.schema.json").write_text('{"table": "t", "columns": [{"name": "id", "type": "integer", "required": true}, {"name": "kind", "type": "enum", "allowed": ["a"]}], "primary_key": ["id"], "foreign_keys": [{"columns": ["kind"], "ref_table": "k", "ref_columns": ["id"]}]}')
    spec = specs.load_specs(tmp_path)["t"]
    assert [c.name for c in spec.columns] == ["id", "kind"] and spec.primary_key == ("id",) and spec.references[0].table == "k"
    df = spark.createDataFrame([(2, "1", "a")], "row_number long, id string, kind string")
    assert tables.header_matches(df, spec) and not tables.header_matches(df.select("row_number", "kind", "id"), spec)
