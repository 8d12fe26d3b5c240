"""Operators on small tables of our own: one valid table, one changed cell, exactly one issue."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import calendar, hashing, text
from ledgerline.operators import documents, evaluation, keys, lineage, monitor, observe, pages, reaction, review, rowchecks
from ledgerline.sources import specs, tables

SPEC = specs.parse_spec(
    """{"table": "thing", "primary_key": ["id"], "columns": [
    {"name": "id", "type": "string", "required": true}, {"name": "n", "type": "integer", "min": 1, "max": 9}, {"name": "x", "type": "decimal"},
    {"name": "at", "type": "datetime"}, {"name": "kind", "type": "enum", "allowed": ["a", "b"]}, {"name": "late", "type": "string", "header_required": false}]}"""
)
VALID = {"row_number": 2, "id": "1", "n": "5", "x": "1.50", "at": "2024-01-05T10:00:00+09:00", "kind": "a", "late": None}
SCHEMA = "row_number long, id string, n string, x string, at string, kind string, late string"


def issues(df):
    return sorted((r["column"], r["code"]) for r in df.collect())


@pytest.mark.parametrize(
    ("column", "value", "code"),
    [("id", " ", "required"), ("id", None, "required"), ("n", "1_0", "not_integer"), ("n", "0", "below_minimum"), ("n", "10", "above_maximum"), ("x", "NaN", "not_decimal"), ("at", "2024-13-01", "not_datetime"), ("at", "2024-01-05T10:00:00Z", "not_datetime"), ("kind", "c", "not_allowed")],
)
def test_one_changed_cell_is_one_issue(spark, column, value, code):
    frame = spark.createDataFrame([tuple((VALID | {column: value}).values())], SCHEMA)
    assert issues(rowchecks.row_checks(frame, SPEC)) == [(column, code)]


def test_valid_row_has_no_issue(spark):
    assert issues(rowchecks.row_checks(spark.createDataFrame([tuple(VALID.values())], SCHEMA), SPEC)) == []


def test_csv_scan(spark, tmp_path):
    (tmp_path / "thing.csv").write_bytes("﻿id,n,kind,other\n1,2,\"a\",z\n2,,\"b\nc\",z\n".encode())
    df = tables.scan_csv(spark, str(tmp_path / "thing.csv"), SPEC)
    assert [tuple(r) for r in df.select("row_number", "id", "n", "kind").orderBy("row_number").collect()] == [(2, "1", "2", "a"), (3, "2", None, "b\nc")]
    assert issues(tables.missing_headers(df, SPEC)) == [("at", "missing_column"), ("x", "missing_column")]


def test_append_only_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "out")
    assert tables.append_only(spark.createDataFrame([(1, "a")], "k int, v string"), path, "k").count() == 0
    assert [tuple(r) for r in tables.append_only(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), path, "k").collect()] == [(1, "b")]
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    again = spark.createDataFrame([(3, "d"), (3, "e"), (4, "f")], "k int, v string")  # a key repeated inside the batch is no new row
    assert sorted(tuple(r) for r in tables.append_only(again, path, "k").collect()) == [(3, "d"), (3, "e")]
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (4, "f")]


def test_duplicate_keys_skip_blanks(spark):
    df = spark.createDataFrame([(2, "a", "x"), (3, "a", "x"), (4, "", "x"), (5, "", "x"), (6, "a", "y")], "row_number long, p string, q string")
    assert [(r["row_number"], r["first_row"]) for r in keys.duplicate_keys(df, "t", ["p", "q"]).collect()] == [(3, 2)]


def test_lineage_failures(spark):
    rows = [(2, "e", "a", None), (3, "e", "b", "a"), (4, "e", "c", "c"), (5, "e", "d", "zz"), (6, "f", "g", "a"), (7, "e", "h", "i"), (8, "e", "i", None)]
    df = spark.createDataFrame(rows, "row_number long, event_id string, id string, sup string")
    found = {(r["row_number"], r["code"]) for r in lineage.check_lineage(df, "t", "event_id", "id", "sup").collect()}
    assert found == {(4, "supersedes_itself"), (5, "missing_parent"), (6, "other_key"), (7, "later_parent")}
    both = lineage.check_lineage(df.union(spark.createDataFrame([(9, "e", "j", "k"), (10, "f", "k", None)], df.schema)), "t", "event_id", "id", "sup").filter("row_number = 9")
    assert {r["code"] for r in both.collect()} == {"later_parent", "other_key"}


def test_canonical_forms_keep_every_digit(spark):
    import hashlib
    import json
    from decimal import Decimal

    forms = {"1.50": "1.5", "-0.00": "0", "+007": "7", "0.12345678901234567890": "0.1234567890123456789", "100": "100", ".5": "0.5", "-3.0": "-3", "12345678901234567890123456789.10": "12345678901234567890123456789.1", "1E+3": "1000"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in forms], "t string").select("t", hashing.canonical(F.col("t"), "decimal")).collect()}
    assert got == forms and all(format(Decimal(t).normalize(), "f") == got[t] for t in forms if t not in ("-0.00", "12345678901234567890123456789.10"))
    times = [dt.datetime(2026, 1, 2, 3, 4, 5), dt.datetime(2026, 1, 2, 3, 4, 5, 60)]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in times], "t timestamp").select(hashing.canonical(F.col("t"), "datetime")).collect()] == ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05.000060Z"]
    titles = ["plain", 'q"\\', "line\nend\t\x0b\x1f\x7f", "\\u000B", None, "日本/é"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    meta = F.create_map(F.lit("b"), F.col("t"), F.lit("a"), F.lit("\x0c\x1e"))
    got = [r[0] for r in rows.select(hashing.metadata_fingerprint(F.lit("https://h/"), F.col("t"), F.lit(None).cast("string"), F.lit(""), meta)).collect()]
    for title, found in zip(titles, got, strict=True):
        plain = [["source_url", "https://h/"], ["title", title], ["document_id", None], ["published_at", ""], ["stable_metadata", [["a", "\x0c\x1e"], ["b", title]]]]
        assert found == hashlib.sha256(json.dumps(plain, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest(), title


def test_business_time(spark):
    d, t = dt.date, dt.datetime
    days = spark.createDataFrame([(d(2024, 1, 5), d(2024, 1, 8)), (d(2024, 1, 8), d(2024, 1, 8)), (d(2024, 1, 1), d(2024, 1, 31)), (d(2024, 1, 9), d(2024, 1, 8))], "a date, b date")
    assert [r[0] for r in days.select(calendar.business_days_until(F.col("a"), F.col("b"))).collect()] == [1, 0, 22, 0]
    times = spark.createDataFrame([(t(2024, 1, 5, 12), t(2024, 1, 8, 12)), (t(2024, 1, 6, 1), t(2024, 1, 7, 5)), (t(1969, 12, 30), t(1970, 1, 5))], "a timestamp, b timestamp")
    assert [r[0] for r in times.select(calendar.business_seconds(F.col("a"), F.col("b"))).collect()] == [86400, 0, 4 * 86400]


def test_urls_and_numbers(spark):
    df = spark.createDataFrame([("HTTPS://Me@Ex.COM:443/A?b=C#x", "△1,234.5"), ("none", "12%")], "u string, n string")
    assert [tuple(r) for r in df.select(text.canonical_url(F.col("u")), text.number(F.col("n"))).collect()] == [("https://Me@ex.com:443/A?b=C", -1234.5), (None, None)]
    assert df.select(text.request_url(F.lit("https://ex.com:443"))).first()[0] == "https://ex.com/"


def test_manifest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (1, "x"), (2, "q")], "k int, v string")
    diff = hashing.manifest_differences(hashing.manifest({"t": a}, "k"), hashing.manifest({"t": b}, "k"), "k")
    assert [r["k"] for r in diff.collect()] == [2]


def test_japanese_release(spark):
    df = spark.createDataFrame([("d", "2024年3月期 第1四半期決算短信\n小売事業の売上高は1,200百万円、営業損失は30百万円となりました。\n業績予想の修正 有\n2024年5月9日")], "doc_id string, text string")
    row = df.select(documents.fiscal_year(F.col("text")), documents.period_scope(F.col("text")), documents.revision_flag(F.col("text"), "業績予想の修正"), documents.japanese_date(F.col("text")), documents.unit(F.col("text"), documents.MONEY_UNITS)).first()
    assert tuple(row) == (2024, "q1", True, dt.date(2024, 5, 9), "百万円")
    assert [tuple(r) for r in documents.segment_metrics(df).collect()] == [("d", "小売事業", 1.2e9, -3e7)]
    assert documents.value_after(documents.lines(df), "業績予想の修正 有").first()["value"] == "2024年5月9日"


def test_bands(spark):
    df = spark.createDataFrame([(110.0, 100.0), (100.5, 100.0), (1.0, 0.0), (-120.0, -100.0)], "a double, e double")
    assert [r[0] for r in df.select(evaluation.band(evaluation.pct_change(F.col("a"), F.col("e")))).collect()] == ["above", "in_line", "in_line", "below"]


def test_consensus_needs_scope_and_unit(spark):
    expected = spark.createDataFrame([("e", "revenue", 10.0, "full_year", "yen"), ("e", "profit", 5.0, "q1", "yen")], "event_id string, metric string, value double, scope string, unit string")
    actual = spark.createDataFrame([("e", "revenue", 12.0, "full_year", "yen"), ("e", "profit", 5.0, "full_year", "yen")], expected.schema)
    compared, limits = evaluation.consensus_comparison(expected, actual, ["event_id", "metric"])
    assert [(r["metric"], r["band"]) for r in compared.collect()] == [("revenue", "above")]
    assert [r["metric"] for r in limits.collect()] == ["profit"]


@pytest.mark.parametrize(("dirs", "pcts", "expected"), [
    (("positive", "muted", "negative"), (1.0, -1.0), "reversed"), (("positive", "muted", "muted"), (1.0, 0.1), "mixed"), (("positive", "positive", "positive"), (1.0, 2.0), "extended"),
    (("positive", "muted", "positive"), (2.0, 2.0), "sustained"), (("muted", "muted", "muted"), (0.1, 0.1), "muted"), (("muted", "pending", "muted"), (0.1, 0.1), "pending"), (("positive", "pending", "not_comparable"), (1.0, 0.0), "not_comparable"),
])
def test_reaction_path(spark, dirs, pcts, expected):
    assert spark.range(1).select(reaction.path(*[F.lit(d) for d in dirs], F.lit(pcts[0]), F.lit(pcts[1]))).first()[0] == expected


def test_schedule_rows_and_links(spark):
    html = "<html><head><title>t</title></head><body><script>2020-01-01</script><p>2024-05-09</p><b>Results</b><i>2024-06-01 Meeting</i><a href='x'></a><a href=\"/p\">P</a><a href=\"//h/q\">Q</a></body></html>"
    df = spark.createDataFrame([(1, "https://a.example/x/y", html)], "page_id long, url string, html string")
    assert [(r["day"], r["label"]) for r in observe.schedule_rows(df).orderBy("n").collect()] == [("2024-05-09", "Results"), ("2024-06-01", "Meeting")]
    assert sorted((r["link"], r["label"]) for r in pages.links(df).collect()) == [("https://a.example/p", "P"), ("https://a.example/x/x", ""), ("https://h/q", "Q")]


def test_handoff_limit(spark):
    df = spark.createDataFrame([("h", i, "ir" if i != 2 else "else") for i in range(7)], "h string, pos int, publisher string")
    assert [r["status"] for r in observe.within_handoff_limit(df, "h", ["ir"]).orderBy("pos").collect()] == ["accepted", "accepted", "foreign_publisher", "accepted", "accepted", "beyond_limit", "beyond_limit"]


def test_stream_rejects_late_rows():
    import pandas as pd

    from ledgerline.streaming.monitor_stream import _advance

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    def run(state, rows):
        frame = pd.DataFrame(rows, columns=["run_id", "row_number", "succeeded", "fingerprint", "error_code"])
        return [tuple(r) for f in _advance((1,), iter([frame]), state) for r in f[["run_id", "result", "version_after", "error_count", "state"]].itertuples(index=False)]

    state = State()
    assert run(state, [("b", 2, True, "y", None), ("a", 1, True, "x", None)]) == [("a", "initialized", 1, 0, "healthy"), ("b", "change_detected", 2, 0, "pending_human_review")]
    assert run(state, [("late", 1, True, "z", None), ("c", 3, False, None, "timeout"), ("d", 4, False, None, "timeout"), ("e", 5, False, None, "state_unavailable")]) == [("late", "rejected", 2, 0, "unchanged"), ("c", "error", 3, 1, "pending_human_review"), ("d", "error", 4, 2, "pending_human_review"), ("e", "error", 5, 1, "stopped")]


def test_version_chain_and_carryover(spark):
    df = spark.createDataFrame([("e", 1), ("e", 2), ("f", 1)], "event_id string, at int")
    got = {(r["event_id"], r["version"]): r for r in review.version_chain(df, ["event_id"], ["at"]).collect()}
    assert got["e", 2]["supersedes_review_id"] == got["e", 1]["review_id"] and got["f", 1]["supersedes_review_id"] is None


def test_replacement_and_summary(spark):
    df = spark.createDataFrame([("a", "b", None, "c"), (None, "b", "c", "c")], "o1 string, n1 string, o2 string, n2 string")
    got = df.select(monitor.replacement_suspected([(F.col("o1"), F.col("n1"))]), monitor.change_summary([("one", F.col("o1"), F.col("n1")), ("two", F.col("o2"), F.col("n2"))])).collect()
    assert [tuple(r) for r in got] == [(True, "Changed metadata fields: one, two"), (False, "Changed metadata fields: one")]


def test_validate_dataset_gates_cross_table_rules(spark):
    from ledgerline.operators.validate import validate_dataset

    child = specs.parse_spec('{"table": "child", "primary_key": ["id"], "columns": [{"name": "id", "required": true}, {"name": "thing_id"}], "foreign_keys": [{"columns": ["thing_id"], "ref_table": "thing", "ref_columns": ["id"], "nullable": true}]}')
    thing = spark.createDataFrame([tuple(VALID.values())], SCHEMA)
    rows = lambda *r: spark.createDataFrame(list(r), "row_number long, id string, thing_id string")
    known = {"thing": SPEC, "child": child}
    assert issues(validate_dataset({"thing": thing, "child": rows((2, "a", "1"), (3, "b", None))}, known)) == []
    assert issues(validate_dataset({"thing": thing, "child": rows((2, "a", "9"), (3, "b", None))}, known)) == [("thing_id", "missing_reference")]
    assert issues(validate_dataset({"thing": thing, "child": rows((2, "a", "9"), (3, "a", None))}, known)) == [("id", "duplicate_key")]


def test_bundle_timing(spark):
    from ledgerline.operators import reaction

    bundles = spark.sql("SELECT b AS bundle_id, 1 AS ticker, TIMESTAMP'2024-05-09 16:00:00' AS announced_at, s AS announcement_session, DATE'2024-05-08' AS pre_close_date, DATE'2024-05-10' AS next_date, DATE'2024-05-16' AS fifth_date FROM VALUES (1L, 'after_close'), (2L, 'intraday') AS t(b, s)")
    verified = spark.sql("SELECT 1 AS ticker, d AS day, CAST(d AS TIMESTAMP) + INTERVAL '9' HOUR AS open_at, CAST(d AS TIMESTAMP) + INTERVAL '15' HOUR AS close_at FROM VALUES (DATE'2024-05-08'), (DATE'2024-05-09'), (DATE'2024-05-10') AS t(d)")
    seen = [
        (1, 1, "immediate_post_announcement", "official_open", "2024-05-10", "2024-05-10 09:00:00"),
        (2, 1, "immediate_post_announcement", "official_close", "2024-05-09", "2024-05-09 17:00:00"),
        (3, 1, "next_business_day_close", "manual_trade_price", "2024-05-11", "2024-05-11 10:00:00"),
        (4, 1, "pre_event_close", "manual_trade_price", "2024-05-08", "2024-05-08 16:00:00"),
        (5, 1, "pre_announcement_reference", "official_open", "2024-05-09", "2024-05-09 09:30:00"),
    ]
    rows = spark.createDataFrame(seen, "row_number long, bundle_id long, role string, price_kind string, d string, t string").selectExpr("row_number", "bundle_id", "role", "price_kind", "CAST(d AS DATE) AS trading_date", "CAST(t AS TIMESTAMP) AS price_at")
    got = sorted((r["table"], r["row_number"], r["code"]) for r in reaction.bundle_timing_checks(rows, bundles, verified).collect())
    assert got == [
        ("bundle", 2, "no_reference"), ("observation", 2, "kind_not_of_session"), ("observation", 2, "not_at_close"), ("observation", 2, "unexpected_date"),
        ("observation", 3, "no_verified_session"), ("observation", 3, "unexpected_date"), ("observation", 4, "outside_session"),
        ("observation", 5, "not_at_open"), ("observation", 5, "reference_not_intraday"),
    ]


def test_schedule_dates_and_due_slots(spark):
    schedule = "2026-08-13=first;2026-11-13=second | 2027-02-中旬=later; 2026-02-30=never"
    df = spark.createDataFrame([(dt.date(2026, 8, 1),), (dt.date(2026, 8, 13),), (dt.date(2026, 8, 14),), (dt.date(2027, 1, 1),)], "d date").select(calendar.next_date(F.lit(schedule), F.col("d")).cast("string"))
    assert [r[0] for r in df.collect()] == ["2026-08-13", "2026-08-13", "2026-11-13", None]
    times = spark.createDataFrame([("2026-08-12 09:00:00", None), ("2026-08-12 12:00:00", None), ("2026-08-14 16:00:00", None), ("2026-08-12 01:00:00", dt.date(2026, 8, 13))], "t string, d date")
    got = times.select(calendar.is_due(F.col("t").cast("timestamp"), F.col("d")))  # in UTC: 18:00 and 21:00 of a Wednesday in Tokyo, then a Saturday, then the day before an event
    assert [r[0] for r in got.collect()] == [True, False, False, True]


def test_fetch_status(spark):
    df = spark.createDataFrame([(c,) for c in (200, 401, 403, 404, 408, 410, 429, 500, 599)], "c int").select(observe.status_error(F.col("c")), observe.is_retryable(F.col("c")))
    assert [tuple(r) for r in df.collect()] == [
        (None, False), ("authentication_required", False), ("authentication_required", False), ("source_unavailable", False), ("timeout", True), (None, False), ("rate_limited", True), ("source_unavailable", True), ("source_unavailable", True),
    ]


def test_review_reads_the_first_stage_alone(spark):
    rows = [("positive", "negative"), ("negative", "positive"), ("positive", "positive"), ("positive", "pending"), ("inconclusive", "positive"), ("positive", "not_comparable")]
    got = spark.createDataFrame(rows, "e string, i string").select(review.interpretation(F.col("e"), F.col("i"))).collect()
    assert [r[0] for r in got] == ["possible_higher_hurdle_than_recorded", "possible_lower_hurdle_than_recorded", "earnings_and_market_aligned", "insufficient_evidence", "insufficient_evidence", "not_comparable"]


def test_ambiguous_page_is_reported_once(spark):
    rows = [(1, "f", "a", True, None), (2, "f", "b", True, None), (3, "f", "b", True, None), (4, "g", "b", True, None), (5, None, None, False, "state_unavailable")]
    df = spark.createDataFrame([(1, n, f"r{n}", f, e, s, c) for n, f, e, s, c in rows], "target long, row_number long, run_id string, fingerprint string, etag string, succeeded boolean, error_code string")
    got = [(r["result"], r["error"], r["error_count"], r["state"]) for r in monitor.transitions(df).orderBy("row_number").collect()]
    assert got == [("initialized", None, 0, "healthy"), ("error", "content_ambiguous", 1, "degraded"), ("no_change", None, 0, "healthy"), ("change_detected", None, 0, "pending_human_review"), ("error", "state_unavailable", 1, "stopped")]


def test_unit_named_once_in_a_unit_line(spark):
    df = spark.createDataFrame([("売上高\n(単位:千円)\n1,200",), ("売上高\n千円\n1,200",), ("百万円 百万円",)], "text string")
    assert [r[0] for r in df.select(documents.unit(F.col("text"), documents.MONEY_UNITS)).collect()] == ["千円", None, "百万円"]


def test_rows_without_a_parent_are_never_the_last(spark):
    df = spark.createDataFrame([(2, "e", "a", None), (3, "e", "b", "zz"), (4, "e", "c", "a"), (5, "e", "d", "a")], "row_number long, event_id string, id string, sup string")
    assert [r["row_number"] for r in lineage.branches(df, "t", "event_id", "id", "sup").collect()] == [5]


def test_reaction_measures_the_first_move_from_its_own_reference(spark):
    day = lambda d, h: dt.datetime(2024, 5, d, h)
    prices = [(1, day(8, 9), 90.0), (1, day(8, 15), 100.0), (1, day(9, 10), 110.0), (1, day(9, 13), 121.0), (1, day(9, 15), 120.0), (1, day(10, 9), 130.0), (1, day(10, 15), 105.0)]
    p = spark.createDataFrame([(t, i, ts, v) for i, (t, ts, v) in enumerate(prices)], "ticker int, price_id long, ts timestamp, price double")
    a = spark.createDataFrame([(1, 1, day(9, 12), "intraday", False), (1, 2, day(9, 16), "after_close", False), (1, 3, day(9, 8), "before_open", True)], "ticker int, announcement_id long, announced_at timestamp, session string, corporate_action boolean")
    got = {r["announcement_id"]: r for r in reaction.reactions(reaction.milestones(a, p)).collect()}
    assert (got[1]["pre_close"], got[1]["reference"], got[1]["immediate_pct"], got[1]["next_close_pct"]) == (100.0, 110.0, 10.0, 5.0)
    assert (got[2]["pre_close"], got[2]["immediate"], got[2]["status"]) == (120.0, 130.0, "tracking")
    assert got[3]["path"] == "not_comparable" and got[3]["next_stage"] == "manual_review_required"


def test_titles_in_nfkc(spark):
    import unicodedata

    titles = ["２０２４年　３月期  決算短信", "ﾃｽﾄ①", " a\tb ", None, ""]
    got = spark.createDataFrame([(t,) for t in titles], "t string").select(text.canonical_title(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for t in titles]
