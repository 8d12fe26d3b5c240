"""The review contract with one fault at a time, and lists over many reviews."""

import datetime as dt

import pytest

from ledgerline.operators import learning

NOW = dt.datetime(2026, 5, 8)
REVIEW = {"row_number": 2, "review_id": "R", "version": 1, "supersedes_review_id": None, "status": "complete", "next_stage": "learning_record_ready", "reviewed_at": NOW, "baseline_id": "B", "evaluation_id": "E", "tracking_id": "T"}
VERIFIED = {"review_id": "R", "pos": 0, "hypothesis_id": "H", "hypothesis_text": "t", "result": "rejected", "source_ids": ["H", "E"], "invalidation_ids": ["I"]}
NUMERIC = {"review_id": "R", "pos": 0, "metric_name": "revenue", "result": "above", "source_id": "E"}
GUIDANCE = {"review_id": "R", "pos": 0, "metric_name": "revenue", "revision": "up", "source_id": "E"}
STAGED = [{"review_id": "R", "stage": s, "status": "complete", "direction": "positive", "return_pct": 1.0, "source_id": "T"} for s in learning.STAGES]
SOURCES = [{"review_id": "R", "record_type": t, "record_id": i, "recorded_at": NOW} for t, i in (*zip(learning.PRIMARY, "BET", strict=True), ("pre_event_hypothesis", "H"), ("hypothesis_invalidation", "I"))]
KINDS = (
    "row_number long, review_id string, version int, supersedes_review_id string, status string, next_stage string, reviewed_at timestamp, baseline_id string, evaluation_id string, tracking_id string",
    "review_id string, pos int, hypothesis_id string, hypothesis_text string, result string, source_ids array<string>, invalidation_ids array<string>", "review_id string, pos int, metric_name string, result string, source_id string",
    "review_id string, pos int, metric_name string, revision string, source_id string", "review_id string, stage string, status string, direction string, return_pct double, source_id string", "review_id string, record_type string, record_id string, recorded_at timestamp",
)
PENDING = {"status": "pending", "direction": "pending", "return_pct": None}

#: (what is changed, the codes that follow)
CASES = [
    ({}, []), ({"review": {"version": 2}}, ["version_chain"]), ({"review": {"supersedes_review_id": "Q"}}, ["version_chain"]), ({"stages": STAGED[:2]}, ["stage_set"]), ({"stages": [*STAGED[:2], STAGED[0]]}, ["stage_set"]), ({"stages": [*STAGED, STAGED[0]]}, ["stage_set"]),
    ({"stages": []}, ["stage_set", "complete_without_stages"]), ({"sources": [*SOURCES, SOURCES[3]]}, ["repeated_source", "ambiguous_source_id"]), ({"sources": [*SOURCES, SOURCES[3] | {"record_type": "note"}]}, ["ambiguous_source_id"]),
    ({"sources": SOURCES[1:]}, ["primary_source_count"]), ({"sources": []}, ["primary_source_count", "not_a_pre_event_hypothesis", "not_a_hypothesis_invalidation", "unresolved_reference", "unresolved_reference", "unresolved_reference", "unresolved_reference"]),
    ({"review": {"baseline_id": "B2"}}, ["primary_source_differs"]), ({"sources": [*SOURCES[:4], SOURCES[4] | {"recorded_at": NOW + dt.timedelta(seconds=1)}]}, ["future_source"]), ({"sources": [*SOURCES[:4], SOURCES[4] | {"recorded_at": None}]}, []),
    ({"stages": [STAGED[0] | {"return_pct": None}, *STAGED[1:]]}, ["return_missing"]), ({"stages": [STAGED[0] | {"direction": "pending"}, *STAGED[1:]]}, ["return_missing"]),
    ({"stages": [STAGED[0] | PENDING | {"return_pct": 1.0}, *STAGED[1:]], "review": {"status": "provisional", "next_stage": "awaiting_market_milestones"}}, ["return_without_completion"]),
    ({"stages": [STAGED[0] | PENDING | {"direction": "muted"}, *STAGED[1:]], "review": {"status": "provisional", "next_stage": "awaiting_market_milestones"}}, ["direction_differs"]),
    ({"stages": [STAGED[0] | PENDING, *STAGED[1:]]}, ["complete_without_stages"]), ({"review": {"status": "provisional", "next_stage": "awaiting_market_milestones"}}, ["provisional_without_pending"]), ({"review": {"status": "blocked", "next_stage": "comparison_blocked"}}, ["blocked_without_reason"]),
    ({"review": {"next_stage": "comparison_blocked"}}, ["next_stage"]), ({"numeric": NUMERIC | {"source_id": "B"}}, ["other_primary_source"]), ({"guidance": GUIDANCE | {"source_id": "Z"}}, ["other_primary_source", "unresolved_reference"]), ({"stages": [s | {"source_id": "E"} for s in STAGED]}, ["other_primary_source"]),
    ({"verified": VERIFIED | {"source_ids": ["H"]}}, ["uncited_source"]), ({"verified": VERIFIED | {"source_ids": ["H", "E", "Z"]}}, ["unresolved_reference"]), ({"verified": VERIFIED | {"invalidation_ids": ["H"]}}, ["not_a_hypothesis_invalidation"]),
]


def test_contract_one_fault_at_a_time(spark):
    """Every case is a review of its own in the same tables."""
    tables = [[], [], [], [], [], []]
    for n, (change, _) in enumerate(CASES):
        own = {"review_id": f"R{n}"}
        tables[0].append(REVIEW | {"row_number": n} | change.get("review", {}) | own)
        for k, (name, rows) in enumerate((("verified", VERIFIED), ("numeric", NUMERIC), ("guidance", GUIDANCE), ("stages", STAGED), ("sources", SOURCES)), start=1):
            given = change.get(name, rows)
            tables[k] += [r | own for r in ([given] if isinstance(given, dict) else given)]
    frames = [spark.createDataFrame([[r[c.split()[0]] for c in kind.split(", ")] for r in rows], kind) for rows, kind in zip(tables, KINDS, strict=True)]
    got = {}
    for r in learning.review_contract(*frames).collect():
        got.setdefault(r["row_number"], []).append(r["code"])
    for n, (change, codes) in enumerate(CASES):
        assert sorted(got.get(n, [])) == sorted(codes), change


@pytest.mark.parametrize("n", [3, 250])
def test_hot_texts_keep_counts_and_order(spark, n):
    reviews = spark.createDataFrame([(f"r{i:03d}", i % 2, i) for i in range(n)], "review_id string, group_id int, review_no int")
    lists = spark.createDataFrame([(f"r{i:03d}", ["own %d" % i, "shared", "shared"], ["shared"] if i else []) for i in range(n)], "review_id string, maintain_criteria array<string>, weaken_candidates array<string>")
    got = {(r["group_id"], r["field"], r["text"]): r for r in learning.carried_learning(reviews, lists, ("maintain_criteria", "weaken_candidates")).collect()}
    for group in (0, 1):
        members = [i for i in range(n) if i % 2 == group]
        r = got[group, "maintain_criteria", "shared"]
        assert r["occurrence_count"] == len(members) and r["place"] == 2
        assert r["source_review_ids"] == [f"r{i:03d}" for i in members][: learning.SHOWN]
        assert got[group, "maintain_criteria", f"own {members[-1]}"]["place"] == (len(members) + 1 if len(members) > 1 else 1)
        assert got[group, "weaken_candidates", "shared"]["occurrence_count"] == len([i for i in members if i])


def test_reasons_without_items(spark):
    reviews = spark.createDataFrame([("a", "positive", "pending")], "review_id string, earnings string, reaction_path string")
    empty = [spark.createDataFrame([], kind) for kind in KINDS[1:5]]
    r = learning.reasons(reviews, *empty).first()
    assert r["supported_hypothesis_ids"] == [] and r["company_guidance_read_result"] == "not_recorded"
    assert r["missing_or_blocked_reasons"] == [f"{s}:awaiting_price" for s in learning.STAGES] + ["no_numeric_comparison"]
