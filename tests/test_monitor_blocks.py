"""A hot target's rows in blocks: the same results whatever the size of a block, and no block with more rows than that."""

import random

import pytest

from ledgerline.operators import monitor


def observations():
    """One target has half of all rows; errors and changes cross the borders of blocks."""
    dice, rows = random.Random(9), []
    for n in range(600):
        target = 1 if dice.random() < 0.5 else dice.choice([2, 3, 4, 5, None])
        good = dice.random() < 0.6
        rows.append((target, f"r{n}", n, good, dice.choice("ab") * 1 if good else None, None if good else dice.choice(["timeout", "timeout", "rate_limited", None]), dice.choice(["e1", "e2", None]), dice.choice([None, "d1", "d2"]), dice.random() < 0.2))
    return rows


def told(rows):
    """The rules row by row."""
    out, state = {}, {}
    for target, run, _, good, fingerprint, code, etag, document, alone in rows:
        s = state.setdefault(target, {"old": None, "n": 0, "error": None, "count": 0, "first": True, "pending": False})
        s["n"] += 1
        old = s["old"]
        if not good or (old and old[0] == fingerprint and old[1] is not None and old[1] != etag):
            result = "error"
        else:
            result = "initialized" if old is None else "no_change" if old[0] == fingerprint else "change_detected"
        error = code if not good else monitor.AMBIGUOUS if result == "error" else None
        s["count"] = 0 if error is None else s["count"] + 1 if error == s["error"] else 1
        s["error"] = error
        s["pending"] |= result == "change_detected" and not alone
        if good:
            s["old"] = (fingerprint, etag, document)
        condition = "stopped" if error in monitor.FATAL else "pending_human_review" if s["pending"] else "degraded" if error else "healthy"
        out[run] = (result, s["n"], error, s["count"], condition)
    return out


KIND = "target long, run_id string, row_number long, succeeded boolean, fingerprint string, error_code string, etag string, document_id string, autonomous boolean"


@pytest.mark.parametrize("block", [1, 7, 64, 1_000_000])
def test_transitions_do_not_depend_on_blocks(spark, block):
    rows = observations()
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = {r["run_id"]: (r["result"], r["version_after"], r["error"], r["error_count"], r["state"]) for r in monitor.transitions(df, block).collect()}
    assert got == told(rows)
    most = monitor.in_blocks(df, block).groupBy("target", "block").count().agg({"count": "max"}).first()[0]
    assert most <= block


def test_lineage_does_not_depend_on_blocks(spark):
    dice, rows = random.Random(4), []
    for n in range(400):
        target = 1 if dice.random() < 0.5 else dice.randint(2, 6)
        rows.append((target, n, f"r{n}", f"r{n - dice.randint(1, 3)}" if dice.random() < 0.9 else None, n * 10 + dice.randint(-8, 0), n * 10 + 5, dice.choice(["initialized", "no_change", "no_change"]), dice.random() < 0.7, dice.random() < 0.8, dice.choice("ab"), dice.choice(["a", "b", None]), n % 9))
    df = spark.createDataFrame(rows, "target long, row_number long, run_id string, previous_run_id string, started_at long, finished_at long, result string, succeeded boolean, committed boolean, fingerprint_before string, fingerprint_after string, version_after long")
    seen, expected = {}, []
    for target, n, run, before, start, end, result, good, done, fp, after, version in rows:
        s = seen.setdefault(target, {"run": None, "end": None, "fp": None, "version": 0})
        expected += [(n, c) for c, wrong in (
            ("not_previous", before != s["run"]), ("overlap", s["end"] is not None and start < s["end"]), ("first_not_initialized", s["run"] is None and result != "initialized"), ("initialized_again", s["run"] is not None and result == "initialized"),
            ("fingerprint_gap", fp != s["fp"]), ("version_gap", done and version != s["version"] + 1)) if wrong]
        s["run"], s["end"] = run, end
        s["fp"] = after if good and after is not None else s["fp"]
        s["version"] = version if done else s["version"]
    for block in (1, 10, 1_000_000):
        assert sorted((r["row_number"], r["code"]) for r in monitor.run_lineage(df, block).collect()) == sorted(expected)
