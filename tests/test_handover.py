"""Access, handoffs, dispatches, carried contexts and legacy rows by examples, with nulls and empty tables."""

import datetime as dt

from ledgerline.operators import handover

TARGET = {"row_number": 2, "enabled": "TRUE", "automated_access_permitted": "true", "monitoring_level": "level_2", "terms_review_state": "candidate_specific_review_completed", "automation_approved_by": "human:a", "activation_state": "activated", "activation_approved_by": "system_policy:p"}
CODES = ["disabled", "not_permitted", "not_level_2", "terms_not_reviewed", "automation_unauthorised", "not_activated", "activation_unauthorised"]


def test_access_needs_every_permission(spark):
    names = list(TARGET)
    rows = [TARGET] + [TARGET | {"row_number": 10 + k, c: None if k % 2 else "other"} for k, c in enumerate(names[1:])] + [dict.fromkeys(names) | {"row_number": 50}]
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], "row_number long, " + ", ".join(f"{c} string" for c in names[1:]))
    got = {}
    for r in handover.access_gate(df).collect():
        got.setdefault(r["row_number"], []).append(r["code"])
    assert got == {10 + k: [c] for k, c in enumerate(CODES)} | {50: CODES}


def test_handoffs_carry_what_was_seen_last(spark):
    runs = spark.createDataFrame([(1, 1, "a", "change_detected", "t1", "s1"), (1, 2, "b", "change_detected", "t2", "s2"), (2, 3, "c", "no_change", "t", None), (3, 4, "d", "change_detected", "t", "s"), (4, 5, "e", "change_detected", "t", "s")], "target int, row_number int, run_id string, result string, finished_at string, summary string")
    targets = spark.createDataFrame([(k, handover.AUTONOMOUS if k != 3 else "human_review", "c", "", "u", "k") for k in (1, 2, 3, 4)], "target int, change_response string, company_id string, earnings_event_id string, source_url string, source_category string")
    seen = spark.createDataFrame([(1, "T", "", None, "u.pdf", "")], "target int, last_seen_title string, last_seen_document_id string, last_seen_published_at string, last_seen_document_url string, last_seen_schedule string")
    got = {r["monitor_target_id"]: r for r in handover.research_handoffs(runs, targets, seen).collect()}
    assert got.keys() == {1, 4} and (got[1]["monitor_run_id"], got[1]["detected_at"], got[1]["change_summary"]) == ("b", "t2", "s2")
    assert [got[1][c] for c in handover.LAST_SEEN] == ["T", None, None, "u.pdf", None] and [got[4][c] for c in handover.LAST_SEEN] == [None] * 5
    assert got[1]["earnings_event_id"] is None and len(got[1]["next_stages"]) == 6 and not got[1]["raw_content_included"]


def test_dispatches_count_what_is_left_out(spark):
    handoffs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "handoff_id string")
    documents = [("a", 0, "u", "earnings_release"), ("a", 1, "u", None), ("b", 0, "u", None)] + [("c", k, "u", "earnings_release") for k in range(5)]
    got = {r["handoff_id"]: (r["status"], r["analyzed_document_count"], r["excluded_document_count"]) for r in handover.dispatches(handoffs, spark.createDataFrame(documents, "handoff_id string, pos int, url string, kind string")).collect()}
    assert got == {"a": ("analysis_completed", 1, 1), "b": ("no_target_documents", 0, 1), "c": ("beyond_limit", 0, 0), "d": ("no_target_documents", 0, 0)}


def test_carried_contexts_hold_together(spark):
    now, later = dt.datetime(2026, 5, 8), dt.datetime(2026, 5, 9)
    sources = [(c, k, r, e, later if c == "late" else now) for c in ("fine", "late", "events", "count", "twice", "unknown", "copies") for k, (r, e) in enumerate([("r1", "e2"), ("r2", "e1"), ("r3", "e2")])] + [("copies", 3, "r1", "e2", now)]
    contexts = [(c, now, ["e1", "e2"] if c == "events" else ["e2", "e1"]) for c in ("fine", "late", "events", "count", "twice", "unknown", "copies")] + [("empty", now, [])]
    items = [("fine", 2, ["r1", "r3"]), ("count", 3, ["r1", "r3"]), ("twice", 2, ["r1", "r1"]), ("unknown", 1, ["r9"])]
    got = handover.carryover_contract(
        spark.createDataFrame(contexts, "context_id string, prepared_at timestamp, source_event_ids array<string>"), spark.createDataFrame(sources, "context_id string, pos int, review_id string, event_id string, reviewed_at timestamp"),
        spark.createDataFrame([(c, "f", "t", n, ids) for c, n, ids in items], "context_id string, field string, text string, occurrence_count int, source_review_ids array<string>"),
    )
    assert sorted(map(tuple, got.collect())) == [("copies", "repeated_source_review"), ("count", "other_count"), ("events", "other_source_events"), ("late", "source_from_later"), ("twice", "repeated_review"), ("unknown", "unknown_review")]


def test_legacy_rows(spark):
    rows = [(2, None, " ", True, None, "h"), (3, None, None, True, "t", "h"), (4, "x", None, True, None, None), (5, None, None, False, None, None), (6, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "row_number long, published_at string, reviewed_by string, is_locked boolean, locked_at string, record_hash string")
    codes = lambda capable: sorted((r["row_number"], r["code"]) for r in handover.legacy_baselines(df, ("published_at", "reviewed_by"), capable).collect())
    assert codes(False) == [(2, "legacy_lock_incomplete")] and codes(True) == [(2, "legacy_in_prospective_file"), (3, "legacy_in_prospective_file")]
