"""Prose of releases, consistency and session covers by examples and brute force."""

import datetime as dt
import random
import re

from ledgerline.operators import narrative, reaction
from ledgerline.operators.documents import MONEY_UNITS


def test_segments_take_the_next_result(spark):
    dice = random.Random(6)
    parts = ["食品事業の売上高は1,200百万円", "となった。", "物流事業の売上高は△5億円、", "セグメント利益は30円", "セグメント損失は△4千円", "セグメント損失は7.5千円", "。\n", "その他", "電子部品などの事業の売上高は-1円"]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randint(0, 12))) for _ in range(200)] + ["", None]
    number = lambda s: -float(re.sub("[,△▲−-]", "", s)) if s[0] in "△▲−-" else float(s.replace(",", ""))
    expected = []
    for i, text in enumerate(texts):
        line = "".join(x.strip() for x in (text or "").splitlines() if x.strip())
        for k, m in enumerate(re.finditer(narrative.SEGMENT, line)):
            sales, result = number(m[2]) * MONEY_UNITS[m[3]], number(m[5]) * MONEY_UNITS[m[6]]
            expected += [(i, k, m[1], "売上高", sales), (i, k, m[1], "セグメント" + m[4], -abs(result) if m[4] == "損失" else result)]
    got = [tuple(r) for r in narrative.segment_figures(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()]
    assert len(expected) > 50 and sorted(got) == sorted(expected)


def test_findings_use_the_last_page_with_a_marker(spark):
    pages = [(1, 1, "表紙"), (1, 2, narrative.RESULTS_OF_SEGMENTS + "経営環境は値上げ。"), (1, 3, narrative.RESULTS_OF_SEGMENTS + "\n経営環境は\n節約。 出店で増収。"), (1, 4, narrative.OUTLOOK + "業績は見通しどおり"), (2, 1, narrative.OUTLOOK), (3, 1, None)]
    df = spark.createDataFrame(pages, "doc_id int, page_no int, text string")
    got = [(r["doc_id"], r["finding_type"], r["statement"], r["page_no"]) for r in narrative.findings(df).orderBy("n").collect()]
    assert got == [(1, "business_environment", narrative.RESULTS_OF_SEGMENTS + "経営環境は節約。", 3), (1, "positive_factor", "出店で増収。", 3), (1, "outlook", narrative.OUTLOOK + "業績は見通しどおり", 4)]
    assert sorted(tuple(r) for r in narrative.missing_sections(df).collect()) == [(2, narrative.RESULTS_OF_SEGMENTS), (3, narrative.RESULTS_OF_SEGMENTS), (3, narrative.OUTLOOK)]


def test_consistency_rounds_to_one_place_and_asks_for_units(spark):
    rows = [
        ("near", "revenue", 107.46, 100.0, 1.0, 7.2, "JPY", "JPY", "JPY", "passed"), ("far", "revenue", 107.46, 100.0, 1.0, 7.1, "JPY", "JPY", "JPY", "review_required"), ("edge", "revenue", 110.0, 100.0, 1.0, 9.7, "JPY", "JPY", "JPY", "passed"),
        ("unit", "revenue", 110.0, 100.0, 1.0, 10.0, "JPY", "unknown", "JPY", "review_required"), ("zero", "revenue", 110.0, 0.0, 1.0, 10.0, "JPY", "JPY", "JPY", "review_required"), ("none", "revenue", None, 1.0, 1.0, None, "JPY", "JPY", None, "review_required"),
    ]
    kind = "doc_id string, metric string, actual double, prior double, forecast double, reported_yoy double, actual_unit string, prior_unit string, forecast_unit string"
    got = {r["doc_id"]: (r["check_type"], r["status"]) for r in narrative.consistency_checks(spark.createDataFrame([r[:-1] for r in rows], kind)).collect()}
    assert {k: s for k, (_, s) in got.items()} == {r[0]: r[-1] for r in rows}
    assert got["unit"][0] == got["none"][0] == "money_unit_presence"
    both = [("a", "revenue", 100.0, 1.0, 1.0, 1.0, "JPY", "JPY", "JPY"), ("a", "operating_profit", -50.1, 1.0, 1.0, 1.0, "JPY", "x", "JPY"), ("b", "revenue", 0.0, 1.0, 1.0, 1.0, "JPY", "JPY", "JPY"), ("b", "operating_profit", 1.0, 1.0, 1.0, 1.0, "JPY", "JPY", "JPY"), ("c", "revenue", 1.0, 1.0, 1.0, 1.0, "x", "JPY", "JPY"), ("c", "operating_profit", 1.0, 1.0, 1.0, 1.0, "JPY", "JPY", "JPY")]
    margins = {r["doc_id"]: r["status"] for r in narrative.consistency_checks(spark.createDataFrame(both, kind)).filter("check_type = 'operating_margin_sanity'").collect()}
    assert margins == {"a": "review_required", "b": "review_required"}


def test_sessions_cover_what_milestones_need(spark):
    day = lambda n: dt.date(2026, 3, n)
    days = [day(n) for n in (4, 5, 6, 9, 10, 11, 12)]
    bundles = [("whole", "2026-03-05T15:00:00+09:00", day(4), days[2:]), ("bare", "2026-03-05T15:00:00+09:00", day(4), days[2:]), ("short", "2026-03-05T15:00:00Z", day(4), days[2:5])]
    sessions = [("whole", k, d, f"{d}T09:00:00+09:00", f"{d}T15:30:00+09:00") for k, d in enumerate(days)] + [("short", k, d, f"{d}T09:00:00+09:00", f"{d}T15:30:00+09:00") for k, d in enumerate([*days[:5], day(4), day(7)])] + [("other", 0, day(4), "2026-03-04T09:00:00+09:00", "2026-03-04T15:30:00+09:00")]
    got = {}
    out = reaction.session_cover(spark.createDataFrame(bundles, "bundle_id string, announced_at string, pre_event_close_date date, next_dates array<date>"), spark.createDataFrame(sessions, "bundle_id string, pos int, trading_date date, open_at string, close_at string"))
    for r in out.collect():
        got.setdefault(r["bundle_id"], []).append((r["day"], r["code"]))
    assert "whole" not in got and sorted(got["bare"]) == [(d, "missing_session") for d in days]
    assert sorted(got["short"], key=str) == sorted([(None, "announcement_zone"), (None, "next_dates_order"), (day(4), "not_ascending"), (day(7), "weekend"), (day(7), "surplus_session")], key=str)
    assert got["other"] == [(day(4), "surplus_session")]
