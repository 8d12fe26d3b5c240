"""Expressions over arrays that must be computed once a row, not once for each element or mention."""

from pyspark.sql import functions as F

from ledgerline.operators import pages, releases


def test_calendar_parses_a_page_once(spark):
    assert str(pages.segments(F.col("html"))).count("regexp_extract_all") == 1
    body = "<noscript>2026年3月3日 決算発表</noscript>" + "<p>x</p>" * 1500 + "<p>2026年4月5日 決算発表</p>"
    got = pages.calendar(spark.createDataFrame([(1, body)], "page_id int, html string")).first()
    assert (got["exact"], got["code"]) == (["2026-04-05=決算発表"], None)


def test_release_finds_its_numeric_lines_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(releases, "staged_rows", lambda df: seen.append(df) or df)
    releases.read_releases(spark.createDataFrame([(1, "a")], "doc_id int, text string"))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(releases._NUMBER) == 1


def test_releases_are_read_in_many_tasks(spark):
    from ledgerline.plans import releases as plans

    from . import oracle

    assert plans._pages(spark, oracle.DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_rows_without_parent_stay_out_of_the_join(spark):
    from ledgerline.operators import lineage

    df = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("c", "z", 3)], "id string, sup string, row_number int")
    out = lineage.with_parent(df, "id", "sup", ["row_number"])
    assert sorted((r["id"], r["parent_row_number"]) for r in out.collect()) == [("a", None), ("b", 1), ("c", None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "isnotnull(sup" in plan


def test_record_hash_is_written_once_for_a_comparison(spark):
    from ledgerline.plans import records

    from . import oracle

    plan = records.hash_mismatch(spark, oracle.DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("sha2(") <= 3  # in the filter and in the issues; 8 with a mention each


def test_divergences_count_every_review(spark):
    from ledgerline.operators import review

    rows = spark.createDataFrame([(1, 1, review.HIGHER), (2, 1, review.ALIGNED)], "review_id int, event_id int, interpretation string")
    assert sorted(r["n_reviews"] for r in review.aggregate_divergences(rows, ["interpretation"]).collect()) == [1, 1]


def test_release_figures_become_numbers_once(spark, monkeypatch):
    monkeypatch.setattr(releases, "staged_rows", lambda df: df)
    out = releases.release_metrics(releases.read_releases(spark.createDataFrame([(1, "a")], "doc_id int, text string")))
    assert out._jdf.queryExecution().analyzed().toString().count("[△▲−-]?[\\d,]+") <= 1
