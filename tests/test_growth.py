"""What a query's plan or state must not do on large tables: the cause of each finding, on small ones."""

import pandas as pd

from ledgerline.operators import gates, lineage
from ledgerline.plans import registry
from ledgerline.sources import tables
from ledgerline.streaming import watch_stream as stream

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_current_row_needs_no_semi_join(spark):
    """Spark pushes one into the parts of a union, whose partitions then don't fit those of the next join (F1)."""
    schema = "event_id int, status_id string, supersedes string, status string"
    one = spark.createDataFrame([(1, "a", None, "x"), (2, "c", None, "x"), (3, "e", None, "x"), (None, "g", None, "x")], schema)
    rows = one.union(spark.createDataFrame([(1, "b", "a", "y"), (2, "d", None, "y")], schema))
    got = lineage.current(rows, "event_id", "status_id", "supersedes")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "b", "a", "y"), (3, "e", None, "x")] and got.columns == rows.columns
    assert "LeftSemi" not in plan(got)


def test_evidence_without_a_parent_stays_out_of_the_join(spark):
    """All its nulls would meet in one task (F16)."""
    rows = spark.createDataFrame([(1, "a", "original", None, "event", "0"), (2, "b", "correction", "a", "event", "1"), (3, "c", "correction", None, "event", "0"), (4, "d", "original", "x", "event", "0")], "row_number long, evidence_id string, status string, supersedes string, entity_type string, entity_id string")
    got = gates.evidence_status(rows)
    assert sorted((r["row_number"], r["code"]) for r in got.collect()) == [(2, "other_entity"), (3, "successor_without_parent"), (4, "missing_parent"), (4, "original_with_parent")]
    assert "isnotnull(supersedes" in plan(got)
    assert "RepartitionByExpression" in plan(registry.QUERIES["evidence_status_rules"](spark, SF))


def test_an_append_deals_rows_before_it_counts_keys(spark, tmp_path):
    """A count of each file's part would hold all its keys (F11)."""
    path = f"{tmp_path}/t"
    repeated = tables.append_only(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string"), path, "k")
    assert "Aggregate" not in plan(repeated) and "RepartitionByExpression" in plan(repeated)
    assert sorted(tuple(r)[1] for r in repeated.collect()) == ["b", "c", "d"]
    assert sorted(r["v"] for r in tables.append_only(spark.createDataFrame([(1, "e"), (3, "f")], "k int, v string"), path, "k").collect()) == ["e"]
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "f")]


def test_reviews_are_worked_out_once_for_all_their_items(spark):
    """Each item, and each rule on it, would rank prices again (F14)."""
    assert "events.parquet" not in str(registry.QUERIES["review_closure"](spark, SF).inputFiles())


def test_carried_texts_are_gathered_once(spark):
    """Two rules read them (F17)."""
    assert "collect_list(review_id" not in plan(registry.QUERIES["carryover_contract"](spark, SF))


class _Map(dict):
    """A map state that counts what it is asked."""

    asked = 0

    def __getattribute__(self, name):
        if name in ("getValue", "containsKey", "updateValue", "removeKey", "keys"):
            self.asked += 1
        return super().__getattribute__(name)

    getValue, containsKey = dict.get, dict.__contains__
    updateValue, removeKey = dict.__setitem__, dict.__delitem__


def test_open_changes_are_asked_for_and_written_once_a_batch():
    """The state was asked at each row (F9)."""
    kept = _Map()
    first = stream._Open(kept)
    for i in range(100):
        first.add(f"r{i}", i)
        assert first.some() and first.begun(f"r{i}") == i and first.begun("none") is None
    for i in range(1, 100):
        first.close(f"r{i}")
    first.write()
    assert kept == {("r0",): (0,)} and kept.asked <= 2
    later = stream._Open(kept)
    assert later.some() and later.begun("r0") == 0 and later.begun("r1") is None
    later.close("r0")
    assert not later.some() and later.begun("r0") is None
    later.write()
    assert not kept


def test_a_target_of_many_changes_asks_its_state_a_bounded_number_of_times():
    calls = _Map()

    class Value:
        exists = staticmethod(lambda: False)
        update = staticmethod(lambda row: None)

    class Handle:
        getValueState = staticmethod(lambda *a: Value)
        getMapState = staticmethod(lambda *a: calls)
        registerTimer = deleteTimer = staticmethod(lambda at: None)

    target = stream._Target()
    target.init(Handle)
    rows = [{"kind": "run", "run_id": f"r{i}", "row_number": i, "at_ms": 10 * i, "succeeded": True, "fingerprint": str(i), "error_code": None, "marks": [], "stale_ms": 10**9, "may_start": True} for i in range(50)]
    rows += [{**r, "kind": "resolution", "at_ms": r["at_ms"] + 1} for r in rows[1:]]
    out = pd.concat(target.handleInputRows((1,), iter([pd.DataFrame(rows)]), None))
    assert list(out["result"]).count("resolved") == 49 and calls.asked <= 2
