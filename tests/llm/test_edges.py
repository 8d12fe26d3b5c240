"""Null and repeated ids, texts of megabytes, dense families and what each method must not do without."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import common, decontamination, license_scan, line_dedup, ngram_join, packing, quality_classifier, quality_rules, sharding, substring_dedup, warc
from ledgerline.llm.queries import tokenizer_path

DICE = random.Random(11)
WORDS = ["".join(DICE.choice("abcdefghij") for _ in range(DICE.randint(3, 8))) for _ in range(400)]
PASSAGE = " ".join(DICE.choice(WORDS) for _ in range(60))
LONG = "\n".join(" ".join(DICE.choice(WORDS) for _ in range(50)) for _ in range(4000)) + "\n" + PASSAGE
ROWS = [(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (None, None), (2, LONG), (2, "other text of the same id\n" + PASSAGE), (3, ""), (4, PASSAGE + " " + PASSAGE)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, c string, gone string, row string, label int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "x", "y", "z", "w", 7) for i, t in ROWS], SCHEMA)


def test_every_operator_takes_null_and_repeated_ids(spark, docs):
    n = len(ROWS)
    assert quality_rules.host_quality(docs).count() == n
    repeated = substring_dedup.repeated_substrings(docs)
    assert sorted((r["doc_id"], r["n_removed"]) for r in repeated.filter("doc_id is not null").collect()) == [(1, 0), (1, 0), (2, 60), (2, 60), (3, 0), (4, 120)]
    assert {r["n_removed"] for r in repeated.filter("doc_id is null").collect()} == {0}
    assert packing.pack_documents(docs, tokenizer_path()).filter("piece = 0").count() == n
    benchmark = spark.createDataFrame([("a", PASSAGE), (None, "abc"), ("b", None)], "item_id string, text string")
    assert decontamination.contamination(docs, benchmark).filter("contaminated").count() == 6
    assert decontamination.contamination(docs, benchmark, block_bytes=50).filter("contaminated").count() == 6
    lines = line_dedup.duplicate_lines(docs)
    assert sorted((r["doc_id"], r["line_no"], r["kept"]) for r in lines.filter("doc_id <> 2").collect()) == [(1, 0, True), (1, 0, True), (4, 0, False)] or lines.filter("doc_id = 1 and not kept").count() == 0
    left = line_dedup.deduplicated(docs, length_col="n_chars")
    assert left.columns == docs.columns and left.filter("doc_id is null").count() == 2
    assert sharding.hilbert_shards(docs, shards=3).count() == n
    groups = ngram_join.similar_groups(docs)
    assert groups.count() >= n and groups.filter("doc_id is null and component_id is not null").count() == 0
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, 0)], "doc_id long, quality int")
    assert quality_classifier.quality_scores(docs, labels).count() == n
    assert license_scan.findings(docs).filter("confirmed").count() == 0


def test_text_ids_are_refused_where_integers_are_meant(spark):
    df = spark.createDataFrame([("a", "one two")], "doc_id string, text string")
    for operator in (substring_dedup.repeated_substrings, ngram_join.similar_groups):
        with pytest.raises(TypeError):
            operator(df)


def test_recall_in_dense_families(spark):
    """Variants of few lines, by all character shingles: what brute force joins is joined."""
    dice, rows = random.Random(5), []
    for _ in range(12):
        base = [dice.choice(WORDS) for _ in range(24)]
        for _ in range(25):
            words = list(base)
            for k in dice.sample(range(24), dice.randint(1, 4)):
                words[k] = dice.choice(WORDS)
            rows.append(" ".join(words))
    sets = [{x[k : k + 9] for k in range(max(1, len(x) - 8))} for x in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["first_doc_id"] for r in line_dedup.duplicate_lines(docs).collect()}
    gone = [k for k in range(len(rows)) if find(k) != k]
    assert len(gone) > 60
    found = sum(got[k] != k for k in gone)
    print(f"recall {found} of {len(gone)}")
    assert found >= 0.99 * len(gone)
    assert all(find(k) == find(got[k]) for k in got)


def test_signatures_do_not_depend_on_repetition(spark):
    """Lines whose shingles are the same set share all bands, however often they repeat them."""
    lines = spark.createDataFrame([("Thor " * n).strip() for n in (300, 5000, 20000)], "string").toDF("line").withColumn("h", F.xxhash64("line"))
    got = line_dedup.signatures(lines).collect()
    assert len(got) == 3 and len({tuple(r[f"band{k}"] for k in range(len(line_dedup.BANDS))) for r in got}) == 1


def test_automaton_alone_finds_later_occurrences(spark, monkeypatch):
    docs = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE + " between " + PASSAGE)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_substrings(docs).collect()} == {1: 0, 2: 120}
    from ledgerline.llm import words

    data, offs = np.frombuffer((PASSAGE + " between " + PASSAGE).encode(), np.uint8), np.array([0, 2 * len(PASSAGE) + 9])
    w = words.Words(data, offs, words.SPACED)
    _, ids = np.unique(w.hash, return_inverse=True)
    starts = substring_dedup._located(ids, w, np.array([20]), 50, 8)
    assert {0, 10, 61, 71} <= set(starts.tolist())  # the phrase is given at word 20 only, and found 61 words later too


def test_short_items_leave_the_suffix_array_small():
    block = decontamination.Block.of([("long", " ".join(WORDS[:40])), ("short", "abc")])
    assert block.lead == decontamination.LEAD and len(block.short[1][0]) == 1


def test_shards_prune_every_dimension(spark):
    """Cut along the curve, each shard spans a part of each dimension, far less than shards cut at random."""
    rows = [(i, "x", f"l{i % 7}", f"s{(i * 31) % 40:02d}", (i * 7919) % 5000) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    placed = sharding.hilbert_shards(docs, shards=20)
    by = placed.select("doc_id", "shard", "slot", "curve").collect()
    order = sorted(by, key=lambda r: (r["curve"], r["doc_id"]))
    assert all(r["shard"] == k * 20 // 4000 and r["slot"] == k % 200 for k, r in enumerate(order))
    spans = sharding.shard_manifest(placed, docs, ("lang", "source", "n_chars")).collect()
    width = np.mean([(r["max_n_chars"] - r["min_n_chars"]) / 5000 for r in spans])
    many = np.mean([(int(r["max_source"][1:]) - int(r["min_source"][1:])) / 40 for r in spans])
    assert width < 0.75 and many < 0.75


def test_license_precision_and_recall(spark):
    dice = random.Random(3)
    held = [(f, t) for f, t in license_scan.examples(seed=99, each=3) if len(t.split()) >= 6]
    rows = [(i, t) for i, (_, t) in enumerate(held)] + [(10_000 + i, " ".join(dice.choice(WORDS) for _ in range(dice.randint(5, 30)))) for i in range(300)]
    got = {r["doc_id"]: r["family"] for r in license_scan.findings(spark.createDataFrame(rows, "doc_id long, text string")).filter("confirmed").collect()}
    right = sum(got.get(i) == f for i, (f, _) in enumerate(held))
    print(f"precision {right / len(got):.3f}, recall {right / len(held):.3f}")
    assert right >= 0.92 * len(held) and right >= 0.97 * len(got)


def test_packing_cuts_words_only_for_the_file_it_knows(tmp_path):
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        known = json.load(f)
    assert packing.cuts_words(known)
    assert not packing.cuts_words(known | {"normalizer": None}) and not packing.cuts_words({"model": {"type": "BPE"}})


def test_words_of_a_text_are_those_of_its_tokenizer():
    tokens = packing.WordTokens(tokenizer_path())
    import pyarrow as pa

    from ledgerline.llm import words

    odd = ["it's 12,5 don't L'été ½ «a» '' 'S -- x", "''s 's's 'Re've x're're'", "'", "s", "a'", "Ma'T'", "“x”…—a ² ³x", "日本 a", "a<|endoftext|>b", "ÉÈß÷× ŉ", "aİb c", "'ll'l", "naïve\n\n\tfoo\x0bbar", "x" * 3000, "1234 12a", "a\xa0b", "", " "]
    data, offs = words.text_bytes(pa.array(odd))
    for text, ids in zip(odd, tokens.ids(data, offs), strict=True):
        assert ids.tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids, re.escape(text)


def test_automata_of_confirmed_phrases_decide(spark, monkeypatch):
    """Phrases of several documents alone are compiled, and what is no phrase of an automaton isn't found."""
    other = " ".join(f"other{k}" for k in range(70))
    docs = spark.createDataFrame([(1, PASSAGE), (2, "x " + PASSAGE), (3, other), (4, other + " y"), (5, " ".join(f"own{k}" for k in range(90)))], "doc_id long, text string")
    n_words = len(PASSAGE.split())
    removed = lambda: {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_substrings(docs, shard_phrases=1, block_bytes=200).collect()}
    assert removed() == {1: 0, 2: n_words, 3: 0, 4: 70, 5: 0}
    every = substring_dedup.recurring_phrases

    def some(survey):
        found = every(survey)
        assert not [r for r in found.collect() if b"own" in r["phrase"]]
        return found.filter(~F.col("phrase").cast("string").contains("other"))

    monkeypatch.setattr(substring_dedup, "recurring_phrases", some)
    assert removed() == {1: 0, 2: n_words, 3: 0, 4: 0, 5: 0}


def test_a_frequent_phrase_is_dealt_into_blocks(spark, monkeypatch):
    """Half of all documents hold one passage: no block has more than its share of them, and salted lookups find the same."""
    docs = spark.createDataFrame([(i, (f"word{i} " + PASSAGE) if i % 2 else f"word{i}") for i in range(400)], "doc_id long, text string")
    n_words = len(PASSAGE.split())
    want = {i: n_words if i % 2 and i > 1 else 0 for i in range(400)}
    seen = []
    real = substring_dedup.staged
    monkeypatch.setattr(substring_dedup, "staged", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_substrings(docs, block_bytes=5000).collect()} == want
    blocks = [len(r["doc_ids"]) for r in dict(seen)["located"].collect()]
    assert sum(blocks) == 200 and max(blocks) < 60
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", 0)
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_substrings(docs).collect()} == want


def test_hot_groups_are_dealt_over_tasks(spark):
    """Half of all rows have one key: it is broadcast, and its rows spread over the shuffle's parts."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 1500).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).filter("k <> 7")
    with_broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = common.with_groups(rows, groups, "k", "doc_id", 4000)
        per_task = [r["count"] for r in met.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("count"), F.sum("least")).collect()]
        got = {(r["doc_id"], r["k"], r["n"], r["least"]) for r in met.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_broadcast)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = {r["k"]: (r["n"], r["least"]) for r in groups.collect()}
    assert got == {(r["doc_id"], r["k"], *sizes.get(r["k"], (None, None))) for r in rows.collect()}
    assert max(per_task) < 1.2 * 4000 / len(per_task), per_task  # undealt, one task would have more than 2,000


def test_archives_are_cut_by_their_own_bytes(spark, tmp_path):
    """Long pages beside many short ones: no file is longer than asked for unless it is one record; a null id and a very long payload come back."""
    rows = [(i, f"http://h/{i}", f"page {i} " * (400 if i % 9 == 0 else 1)) for i in range(300)] + [(None, "http://n", "without id"), (1000, "http://l", "long " * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    heads = warc.resolved(warc.headers(pages))
    path = str(tmp_path / "archive")
    warc.write_archive(heads, path, file_bytes=10_000)
    files = [(f.stat().st_size, sum(1 for _ in warc.parse(f.read_bytes()))) for f in (tmp_path / "archive").glob("part-*")]
    assert sum(n for _, n in files) == 302 and all(size <= 10_000 + 4 or n == 1 for size, n in files)
    got = {r["page_id"]: (r["payload_bytes"], r["intact"]) for r in warc.read_archive(spark, path).collect()}
    assert got == {i: (len(t), True) for i, _, t in rows}


def test_parities_never_exceed_the_difference_and_tell_variants_apart():
    """Of sets of 300 n-grams, none of similarity 0.75 is ruled out, and all of 0.6 are."""
    dice = np.random.default_rng(4)
    for shared, alike in ((258, True), (225, False)):  # of 300 each: 258 / 342 and 225 / 375
        for _ in range(50):
            grams = dice.integers(0, 2**63, 600 - shared, dtype=np.uint64)
            sets = [np.sort(grams[:300]), np.sort(grams[300 - shared :])]
            cells = ngram_join._parities(sets).flatten().to_numpy().reshape(-1, ngram_join.CELLS)
            apart = int(ngram_join._apart(cells[:1], cells[2:3])[0])
            assert apart <= 600 - 2 * shared and (7 * apart <= 600) == alike
