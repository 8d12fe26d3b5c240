"""Disclosure indexes and generic metadata: each failure planted."""

import datetime as dt
import json

from ledgerline.operators import disclosure

SEEN = dt.datetime(2026, 5, 8, 6, 0)  # 15:00 in Tokyo
ITEM = {"title": " Results  Q1 ", "id": 12, "pubdate": "2026-05-08 15:04:59", "document_url": "https://h.example/a.pdf"}


def test_newest_item_and_its_failures(spark):
    def index(**changes):
        items = [{k: v for k, v in (ITEM | changes).items() if v != "absent"}, ITEM | {"title": "older"}]
        return json.dumps({"items": items} | ({"total_count": changes["total_count"]} if "total_count" in changes else {}))

    cases = {
        index(): None, index(total_count=""): None, index(total_count=" 7 "): None, index(title="--"): "invalid_title", index(title="absent"): "invalid_title", index(id="absent"): "invalid_id", index(id="x" * 201): "invalid_id",
        index(pubdate="absent"): "invalid_time", index(pubdate="2026/05/08 15:00:00"): "invalid_time", index(pubdate="2026-02-30 15:00:00"): "invalid_time", index(pubdate="2026-05-08 15:05:01"): "invalid_time", index(pubdate="2026-5-8 9:0:0"): None,
        index(document_url="absent"): "missing_url", index(document_url="http://h.example/a"): "invalid_url", index(document_url="https:///a"): "invalid_url", index(document_url="https://@h/a"): "invalid_url", index(document_url="HTTPS://h.example:443/a"): None,
        index(total_count="many"): "invalid_count", index(update_history="corrected"): None, '{"items": []}': "no_item", '{"items": {}}': "no_item", '{"items": [3]}': "no_item", "[]": "no_item", "not json": "no_item", None: "no_item",
    }
    df = spark.createDataFrame([(i, body, SEEN) for i, body in enumerate(cases)], "k int, body string, observed_at timestamp")
    got = {r["k"]: r for r in disclosure.newest(df, "k").collect()}
    assert [got[i]["code"] for i in range(len(cases))] == list(cases.values())
    assert tuple(got[0])[1:] == ("Results Q1", "12", dt.datetime(2026, 5, 8, 6, 4, 59), "https://h.example/a.pdf", False, 2, None)
    assert got[2]["item_count"] == 7 and [r["replacement_suspected"] for r in got.values() if r["code"] is None].count(True) == 1


def test_generic_metadata_and_its_failures(spark):
    cases = [
        ({"title": "A  b", "stable_metadata": {"Category": " x ", "other": {"deep": 1}, "period": None, "language": 3}}, None, {"category": "x", "language": "3"}),
        ([], "not_object", None), ("not json", "not_object", None), ({"x": 1}, "unrecognised", None), ({"title": "--"}, "invalid_title", None), ({"document_id": "x" * 201}, "invalid_document_id", None),
        ({"published_at": "2026-01-02T03:04:05"}, "invalid_time", None), ({"title": "a", "stable_metadata": [1]}, "metadata_not_object", None), ({"title": "a", "stable_metadata": {"period": {"a": 1}}}, "not_scalar", None),
        ({"title": "a", "stable_metadata": {"period": [1]}}, "not_scalar", None), ({"title": "a", "stable_metadata": {"period": "x" * 201}}, "invalid_metadata", None), ({"corrected": "yes"}, "nothing_usable", None),
        ({"document_id": 7, "updated": True, "published_at": "2026-01-02T03:04:05Z"}, None, {}), ({"title": "a", "stable_metadata": None}, None, {}), (None, "not_object", None),
    ]
    rows = [(i, body if body is None or body == "not json" else json.dumps(body)) for i, (body, _, _) in enumerate(cases)]
    got = {r["k"]: r for r in disclosure.generic(spark.createDataFrame(rows, "k int, body string"), "k").collect()}
    assert [(got[i]["code"], got[i]["stable_metadata"]) for i in range(len(cases))] == [(code, m) for _, code, m in cases]
    assert got[0]["title"] == "A b" and tuple(got[12])[1:5] == (None, "7", dt.datetime(2026, 1, 2, 3, 4, 5), True)
