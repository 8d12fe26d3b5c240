"""The ten operators against brute force on small documents with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerline.llm import decontamination, license_scan, line_dedup, ngram_join, packing, quality_classifier, quality_rules, sharding, substring_dedup, warc
from ledgerline.llm.components import connected
from ledgerline.llm.queries import tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, row string, sig string"


def corpus(seed=3):
    """Random prose with copies, near copies, shared passages, repeats and awkward rows."""
    dice = random.Random(seed)
    vocabulary = ["".join(dice.choice("abcdeéß") for _ in range(dice.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(dice.choice(vocabulary) for _ in range(n))
    passage, texts = prose(70), []
    for _ in range(40):
        texts.append("\n".join(prose(dice.randint(5, 40)) for _ in range(dice.randint(1, 6))))
    for i in range(12):
        words = texts[0].split(" ")
        words[i % len(words)] = "changed" + str(i)
        texts.append(" ".join(words))
    texts += [prose(30) + "\n" + passage + " " + prose(20), passage, prose(5) + " " + passage, texts[1], texts[1], texts[2]]
    texts += [None, "", " \n\t ", "one", "one", "one two three", "the same " * 40, "x" * 5000, prose(4000), "İΣ ﬁ   ok", "<|endoftext|> a", "d'été it's 12,5"]
    return [(i, t) for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), 0, "x", "y", "z") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_quality_measures(docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.host_quality(docs).collect()}
    for i, t in ROWS:
        ws = WORDS.findall(t or "")
        wins = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
        hit = {k + j for k, w in enumerate(wins) if wins.count(w) > 1 for j in range(5)} if len(ws) < 1000 or len(set(wins)) < len(wins) else set()
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)), i
        assert r["base_failed"] == (len(ws) < 10 or 100 * len(hit) > 20 * len(ws))
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.host_quality(empty).count() == 0


def test_bad_host_goes(spark):
    rows = [(i, "bad", "bad") for i in range(50)] + [(100 + i, " ".join(f"w{j}" for j in range(30)), h) for i, h in enumerate(["bad"] * 3 + ["good"] * 40 + ["one"])]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(50)) and not got[100] and got[110] and got[143]


def test_repeated_substrings(docs, empty):
    words = {i: WORDS.findall(t or "") for i, t in ROWS}
    owner = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            owner.setdefault(tuple(words[i][k : k + 50]), i)
    got = {r["doc_id"]: r for r in substring_dedup.repeated_substrings(docs).collect()}
    assert len(got) == len(ROWS)
    for i, ws in words.items():
        gone = {k + j for k in range(len(ws) - 49) if owner[tuple(ws[k : k + 50])] < i for j in range(50)}
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i
        assert sum(s["length"] for s in got[i]["removed"] or []) == len(gone)
    assert any(r["n_removed"] for r in got.values())
    assert substring_dedup.repeated_substrings(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), capacity=256).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, t in ROWS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["start"] for p in parts] == list(range(0, len(ids), 256))
        assert np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").tolist() == ids
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= 1.1 * total / 256 + 1
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_plan_needs_no_more_than_first_fit():
    dice = random.Random(5)
    histogram = {}
    for _ in range(3000):
        n = dice.randint(1, 100)
        histogram[n] = histogram.get(n, 0) + 1
    rows = packing.plan(histogram, 100)
    used = sum(k * v for k, v in histogram.items())
    assert max(r[2] + -(-1 // r[3]) for r in rows) <= 1.02 * used / 100 + 2
    assert packing.plan({}, 100) == []


def test_decontamination(spark, docs, empty):
    items = [("a", " ".join(WORDS.findall(ROWS[3][1])[2:30])), ("b", "one two"), ("c", None), ("d", ""), ("e", "Absent words only here to be found never at all indeed"), ("b2", "ONE, two")]
    benchmark = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id string, text string, row string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    for size in (8 << 20, 40):  # one block, and several
        got = {r["doc_id"]: r for r in decontamination.contamination(docs, benchmark, block_bytes=size).collect()}
        for i, t in ROWS:
            ws, hit, found = split(t), set(), set()
            for item, text in items:
                it = split(text)
                n = min(10, len(it))
                wins = {tuple(it[k : k + n]) for k in range(len(it) - n + 1)} if n else set()
                for k in range(len(ws) - n + 1) if n else ():
                    if tuple(ws[k : k + n]) in wins:
                        hit |= set(range(k, k + n))
                        found.add(item)
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(ws), len(hit), sorted(found), bool(hit)), (i, size)
    kept = decontamination.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(not r["contaminated"] for r in got.values()) < len(ROWS)
    assert decontamination.contamination(empty, benchmark).count() == 0
    assert decontamination.contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_line_dedup(spark, docs, empty):
    shingles = lambda x: {x.lower()[k : k + 9] for k in range(max(1, len(x.lower()) - 8))}
    lines = {(i, n): x for i, t in ROWS if t for n, x in enumerate(t.split("\n")) if len(re.findall(r"\S+", x, re.ASCII)) >= 3}
    got = {(r["doc_id"], r["line_no"]): r for r in line_dedup.duplicate_lines(docs).collect()}
    assert set(got) == set(lines)
    place, sets = sorted(lines), {k: shingles(v) for k, v in lines.items()}
    root = {k: k for k in place}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(place):
        for b in place[:n]:
            if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    wrong = [k for k in place if (got[k]["first_doc_id"], got[k]["first_line_no"]) != find(k)]
    assert len(wrong) <= 0.02 * len(place)
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["first_doc_id"], r["first_line_no"])) for r in got.values())
    out = line_dedup.deduplicated(docs, length_col="n_chars")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and rows[0]["text"] == ROWS[0][1] and 55 not in rows and rows[58]["text"] is None
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"])
    assert line_dedup.duplicate_lines(empty).count() == 0


def test_warc(spark):
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, "http://c\r\nX: y", None), (8, "http://d", ""), (7, None, "é\r\n\r\nWARC/1.1\r\n"), (3, "http://b", "same"), (1, "http://e", "alone" * 3000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.dedup_archive(pages).collect()
    assert all(r["intact"] for r in got)
    by = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    assert len(got) == 7 and by == {5: ("revisit", 3, 4), 3: ("response", None, 4), 9: ("revisit", 8, 0), 8: ("response", None, 0), 7: ("response", None, len("é\r\n\r\nWARC/1.1\r\n".encode())), 1: ("response", None, 15000)}
    import base64

    assert {r["payload_digest"] for r in got if r["page_id"] == 5} == {base64.b32encode(hashlib.sha1(b"same").digest()).decode()}
    assert warc.dedup_archive(pages.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.dedup_archive(pages, min_bytes=10**6).collect()} == {"response"}


def test_hilbert(docs, empty):
    cells = np.stack(np.meshgrid(range(8), range(8), range(8)), -1).reshape(-1, 3)
    index = sharding.hilbert_index(cells, 3)
    assert sorted(index.tolist()) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1)
    assert (steps == 1).all()
    got = sharding.hilbert_shards(docs, shards=7).collect()
    counts = {}
    for r in got:
        counts.setdefault(r["shard"], []).append(r["slot"])
        text = (ROWS[r["doc_id"]][1] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
    assert len(got) == len(ROWS) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert sharding.shard_manifest(sharding.hilbert_shards(docs, shards=7), docs, ("n_chars",)).count() == 7
    assert sharding.hilbert_shards(empty).count() == 0


def test_quality_classifier(spark, docs, empty):
    dice = random.Random(1)
    good = [" ".join(dice.choice(["river", "stone", "meadow", "quiet", "morning", "winter"]) for _ in range(40)) for _ in range(200)]
    bad = [" ".join(dice.choice(["river", "stone", "meadow", "quiet"]) + dice.choice(["%%%", "$$$", "***"]) for _ in range(40)) for _ in range(200)]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(good + bad)] + [(1000, None, "x"), (1001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)] + [(3, 0), (None, 1), (5, 7)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_classifier.quality_scores(table, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(400))
    assert sum(got[i]["predicted"] == int(i < 200) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 402
    assert quality_classifier.accepted(table, labels).columns == table.columns
    assert quality_classifier.quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in quality_classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def jaccard_components(rows):
    sets = {}
    for i, t in rows:
        ws = WORDS.findall(lower(t))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())
    root = {i: i for i in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(docs).collect()}
    assert got == jaccard_components(ROWS)
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in got.values()})
    assert ngram_join.similar_groups(empty).count() == 0


def test_similar_sets_share_a_signature():
    """Pairs of every size at or above the similarity meet, also after each has left out what it can spare."""
    dice = np.random.default_rng(4)
    for n in [*range(1, 40), 60, 100, 230, 700]:
        for _ in range(6):
            a = np.unique(dice.integers(0, 1 << 62, n).astype(np.uint64))
            change = dice.integers(0, 1 + (len(a) // 4))
            lost = dice.integers(0, change + 1)
            b = np.unique(np.concatenate([a[lost:], dice.integers(0, 1 << 62, change - lost).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 4 * both < 3 * (len(a) + len(b) - both):
                continue
            sig, who, spare = ngram_join.signatures([a, b])
            mine = [{x for x, w in zip(sig.tolist(), who.tolist()) if w // 2 == k} for k in (0, 1)]
            assert mine[0] & mine[1], (n, change)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, **{200 + i: 200 for i in range(50)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_license_scan(spark, empty):
    lines = {"MIT": "Released under the MIT License.", "GPL": "// This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "all-rights-reserved": "All rights reserved."}
    plain = [" ".join(random.Random(i).choice(["river", "stone", "quiet", "the", "of", "work", "version"]) for _ in range(12)) for i in range(60)]
    rows = [(i, f"{plain[i]}\n{t}\n{plain[i + 9]}") for i, t in enumerate(lines.values())] + [(50 + i, t) for i, t in enumerate(plain)] + [(900, None), (901, ""), (902, "A driving licence must be carried at all times.")]
    got = license_scan.findings(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, family string")).filter("confirmed").collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in got) == [(i, 1, f) for i, f in enumerate(lines)]
    assert [r["text"] for r in got if r["doc_id"] == 1] == [lines["GPL"]]
    assert license_scan.findings(empty).count() == 0


def test_lines_that_only_a_third_one_brings_together(spark):
    """Two alike lines stay linked where the least line of their bucket is like neither."""
    dice = random.Random(5)
    word = lambda: "".join(dice.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(60)]
    rows = []
    for _ in range(40):  # each pair differs by a word, and from other pairs by a third of the words
        one = [w if dice.random() < 0.72 else word() for w in base]
        two = [word() if k == 30 else w for k, w in enumerate(one)]
        rows += [" ".join(one), " ".join(two)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["first_doc_id"] for r in line_dedup.duplicate_lines(docs).collect()}
    assert got == {k: k - k % 2 for k in range(80)}


def test_lines_that_sketches_tell_apart_are_not_compared(spark, monkeypatch):
    """Of a family of lines alike by about a half, only the pairs that may reach the similarity are compared, and none of the links is lost."""
    dice = random.Random(8)
    word = lambda: "".join(dice.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(60)]
    rows = []
    for _ in range(60):  # each pair differs by a word
        other = set(dice.sample([k for k in range(60) if k != 30], 9))
        one = [word() if k in other else w for k, w in enumerate(base)]
        rows += [" ".join(one), " ".join(word() if k == 30 else w for k, w in enumerate(one))]
    counts, real = [], line_dedup.staged
    monkeypatch.setattr(line_dedup, "staged", lambda df, name: counts.append((name, real(df, name))) or counts[-1][1])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["first_doc_id"] for r in line_dedup.duplicate_lines(docs).collect()}
    assert got == {k: k - k % 2 for k in range(120)}
    assert sum(df.count() for name, df in counts if name == "compared_lines") <= 240


def test_small_buckets_take_no_rounds(spark, monkeypatch):
    """All pairs of small buckets are made at once, only lines with enough values in common are sketched, and rounds of stars link the same lines."""
    dice = random.Random(11)
    word = lambda: "".join(dice.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(60)]
    rows = []
    for _ in range(30):  # pairs differ by a word, families by a fifth of the words; the lines after them by two thirds
        one = [w if dice.random() < 0.8 else word() for w in base]
        rows += [" ".join(one), " ".join(word() if k == 30 else w for k, w in enumerate(one)), " ".join(w if dice.random() < 0.35 else word() for w in base)]
    names, real = [], line_dedup.staged
    monkeypatch.setattr(line_dedup, "staged", lambda df, name: names.append((name, real(df, name))) or names[-1][1])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = lambda: {r["doc_id"]: r["first_doc_id"] for r in line_dedup.duplicate_lines(docs).collect()}
    got = found()
    assert got == {k: k - (k % 3 == 1) for k in range(90)}
    steps = dict(names)
    assert "open_buckets" not in steps and steps["line_sketches"].count() < steps["line_buckets"].select("h").distinct().count()
    monkeypatch.setattr(line_dedup, "SMALL", 1)
    assert found() == got and "open_buckets" in dict(names)


def test_lines_that_differ_within_long_words(spark):
    """All positions count, so lines that differ past a word's ninth character aren't equal."""
    pairs = ["Invoice number INV-2024-000123 total", "Invoice number INV-2024-000999 total", "see https://example.org/a/report.pdf for details", "see https://example.org/b/minutes.html for details", "a long enough line, once", "A long enough line, once"]
    docs = spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string")
    got = {r["doc_id"]: r["first_doc_id"] for r in line_dedup.duplicate_lines(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
