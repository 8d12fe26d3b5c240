"""Operators 11 to 13 against brute force, with awkward rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import centroid_clustering as cc, chat_format as cf, merkle_manifest as mm, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11: centroid clustering


def lloyd(rows, dims, clusters, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((sha(f"2:{'' if i is None else i}"), v) for i, v in kept)[:clusters]
    centroids = [v for _, v in first]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((apart(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        of = [place(v)[1] for _, v in kept]
        groups = [[v for (_, v), k in zip(kept, of, strict=True) if k == c] for c in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else centroids[c] for c, g in enumerate(groups)]
    placed = [(i, *place(v)) for i, v in kept]
    inertia = [sum(d for _, d, k in placed if k == c) for c in range(len(centroids))]
    return sorted(((i, k, d, inertia[k], sum(inertia), sha(",".join(map(str, centroids[k])))) for i, d, k in placed), key=str)


def vectors(seed=1, dims=8, n=300):
    dice = random.Random(seed)
    middles = [[dice.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [x + dice.gauss(0, 0.1) for x in dice.choice(middles)]) for i in range(n)]
    rows += [(n + k, rows[0][1]) for k in range(120)] + [(5, rows[7][1]), (5, rows[7][1]), (None, rows[8][1]), (None, [0.0] * dims)]
    rows += [(900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [None] + [0.0] * (dims - 1)), (904, [float("nan")] * dims), (905, [float("-inf")] * dims), (906, [-0.001953125] * dims), (907, [0.001953125] * dims)]
    return rows


def clusters_of(df, **options):
    return sorted((tuple(r)[:6] for r in cc.centroid_clusters(df, **options).collect()), key=str)


@pytest.mark.parametrize("pivots", [1, 3, 16])
def test_clusters_equal_plain_rounds(spark, pivots):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(5)
    assert clusters_of(df, dims=8, clusters=12, pivots=pivots) == lloyd(rows, 8, 12, 5)


def test_clusters_of_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.5, 0.25])]
    assert clusters_of(spark.createDataFrame(rows, kind), dims=2) == lloyd(rows, 2, 40, 5)
    empty = cc.centroid_clusters(spark.createDataFrame([], kind))
    assert empty.count() == 0 and empty.columns == cc.centroid_clusters(spark.createDataFrame(rows, kind), dims=2).columns
    assert clusters_of(spark.createDataFrame([(1, [1.0])], kind), dims=2) == []
    far = spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0])], kind)
    assert {r["distance"] for r in cc.centroid_clusters(far, dims=2).collect()} == {0}


def test_pivots_spare_distances_and_keep_ties():
    dice = np.random.default_rng(4)
    middles = dice.integers(-2000, 2000, (30, 16))
    v = np.repeat(middles, 40, axis=0) + dice.integers(-40, 40, (1200, 16))
    pivots = cc.far_apart(middles, 8)
    table = np.stack([cc.squared(v, p) for p in pivots], axis=1)
    cluster, best, computed = cc.nearest(v, table, middles, pivots)
    every = ((v[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (cluster == every.argmin(axis=1)).all()
    assert computed < 0.25 * every.size
    twice = np.concatenate([middles, middles])
    assert (cc.nearest(v, table, twice, pivots)[0] == cluster).all()


# 12: chat format

ODD = [
    "", "</s>", "[INST] a [/INST]", r"<\/s>", r"[\\INST]", "[/s> <INST]", "[[INST]]", "<s", ">", "[", "<", "\\", "[\\", "<\\", "</", "/s>", "a\n\n[ANS]b</s>", "[ROLE]x[TEXT]y[/ROLE]", "日本[SYS]語", "[SYS", "SYS]", "\U0001f600<s>" * 3, "$1\\$2"
]


def chat_rows(seed=2):
    dice, rows = random.Random(seed), []
    for conv in range(60):
        for turn in range(dice.randint(1, 9)):
            rows.append((conv, turn, dice.choice(["user", "assistant", "system", "user", "assistant", "tool", "[INST]", "", None, "a[TEXT]b"]), "".join(dice.choice(ODD + ["word "]) for _ in range(dice.randint(0, 6)))))
    for k in range(50):  # in order
        rows += [(100 + k, 2 * t + s, ("user", "assistant")[s], dice.choice(ODD)) for t in range(k % 4 + 1) for s in (0, 1)]
    rows += [(200, 0, "user", None), (200, 0, "user", None), (200, None, "system", "first"), (200, 1, "assistant", None), (None, 0, "user", "no id"), (None, 1, "assistant", "x" * 300_000 + "[INST]" * 1000)]
    return rows + [(300, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(1200)]


def told(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        turns = [(role, text) for _, _, role, text in turns]
        state, bad, order = "", None, {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
        for k, (role, _) in enumerate(turns):
            bad = k if bad is None and role not in order.get(state, ()) else bad
            state = role
        bad = len(turns) if bad is None and state != "assistant" else bad
        out[conv] = (turns, "".join(text for role, text in turns if role == "assistant"), bad)
    return out


def test_chats_come_back_from_their_segments(spark):
    rows = chat_rows()
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id long, turn long, role string, text string, segments string, valid boolean").repartition(6)
    chats = cf.formatted(df).cache()
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss_text"], r["bad_turn"]) for r in cf.read_back(chats).collect()}
    assert got == told(rows)
    controls = cf.DEFAULT.controls()
    for r in chats.collect():
        texts, marks = [s["text"] for s in r["segments"]], 0
        for s in r["segments"]:
            if s["loss"]:
                assert not any(c in s["text"] for c in controls)
        whole = "".join(texts)
        marks = sum(whole.count(t.after) for t in (*cf.DEFAULT.turns.values(), cf.DEFAULT.other))
        assert marks == len(got[r["conv_id"]][0]) and whole.count("<s>") == 1 and whole.startswith("<s>")
        assert r["valid"] == (r["bad_turn"] is None)


def test_texts_without_control_strings_stay(spark):
    rows = [(1, 0, "user", "a < b [x] \\ done"), (1, 1, "assistant", "plain")]
    r = cf.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(cf.joined().alias("t")).first()
    assert r["t"] == "<s>[INST]a < b [x] \\ done[/INST][ANS]plain</s>"
    assert cf.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_other_templates(spark):
    t = cf.Template("{b}", {"human": cf.Turn("{h}", "{/h}"), "model": cf.Turn("{m}", "{/m}", loss=True)}, cf.Turn("{o}", "{/o}"), "{n}", {"": ("human",), "human": ("model",), "model": ("human",)}, ("model",))
    rows = [(1, 0, "human", "{m} {\\m}"), (1, 1, "model", "{/m}{b}"), (1, 2, "user", "[INST]")]
    back = cf.read_back(cf.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t), t).first()
    assert [tuple(x) for x in back["turns"]] == [("human", "{m} {\\m}"), ("model", "{/m}{b}"), ("user", "[INST]")]
    assert back["loss_text"] == "{/m}{b}" and back["bad_turn"] == 2
    for wrong in (dict(begin="[INST]"), dict(begin="<a<b>"), dict(named="]x["), dict(other=cf.Turn("[INST]", "[/ROLE]"))):
        with pytest.raises(ValueError):
            cf.Template(**wrong)


def test_chat_plan_has_no_python(spark, tmp_path):
    rows = [(1, 0, "user", "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = queries.op12_chat_format(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
    own = {r["conv_id"]: r for r in queries.op12_chat_format(spark, str(tmp_path)).collect()}[-7]
    text = "</s>[INST] ok [/INST]"
    assert (own["n_turns"], own["loss_chars"], own["loss_sha256"], own["turns_sha256"]) == (2, len(text), sha(text), sha(f"user\n{text}\nassistant\n{text}\n"))


# 13: Merkle manifest


def tree(leaves):
    """(root, for each leaf its way up: (side, sibling) for each level)."""
    ways, level = [[] for _ in leaves], [(h, [k]) for k, h in enumerate(leaves)]
    while len(level) > 1:
        ups = []
        for k in range(0, len(level), 2):
            run = level[k : k + 2]
            for j, (_, members) in enumerate(run):
                for m in members:
                    ways[m].append([("L" if o < j else "R", run[o][0]) for o in range(len(run)) if o != j])
            ups.append((sha("".join(h for h, _ in run)), [m for _, ms in run for m in ms]))
        level = ups
    return (level[0][0] if level else None), ways


def proofs(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(part(v) for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    langs = sorted({r[2] for r in rows}, key=lambda x: b"" if x is None else b"=" + x.encode())
    held = {x: sorted(((r[0] is not None, r[0] or 0, leaf(r)), r) for r in rows if r[2] == x) for x in langs} if all(r[1] is not None for r in rows) else None
    held = held or {x: sorted((((r[0] is not None, r[0] or 0, leaf(r)), r) for r in rows if r[2] == x), key=lambda y: y[0]) for x in langs}
    below = {x: tree([k[2] for k, _ in held[x]]) for x in langs}
    root, above = tree([below[x][0] for x in langs])
    out = []
    for n, x in enumerate(langs):
        for (key, r), way in zip(held[x], below[x][1], strict=True):
            way = way + above[n]
            bent = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            cur = leaf(r, int(bent))
            for siblings in way:
                cur = sha("".join([h for s, h in siblings if s == "L"] + [cur] + [h for s, h in siblings if s == "R"]))
            out.append((r[0], key[2], below[x][0], root, sha("".join(h for siblings in way for _, h in siblings)), cur, cur == root))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, id string, index string, note string"


def audited(spark, rows, bits):
    df = spark.createDataFrame([(*r, "t", "d", "i", "x", "n") for r in rows], DOCS).repartition(4)
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    return sorted((tuple(r)[:7] for r in mm.audit(df, more, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, bits=bits).collect()), key=str)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_proofs_equal_plain_trees(spark, bits):
    dice = random.Random(bits)
    rows = [(i, dice.choice(["", "a:b", "é" * 7, "x" * 50_000]), dice.choice(["en", "en", "en", "de", "é"]), dice.choice(["s", ""]), dice.choice([0, 12, 2**63 - 1])) for i in range(90)]
    rows += [(200, "one", "alone", "s", 3), (5, "again", "en", "s", 1), (6, "same", "en", "s", 1), (6, "same", "en", "s", 1), (None, "no id", "en", "s", 1), (-3, "x", None, None, None), (7, "-", "", "s", 1), (49, "no count", "de", None, None)]
    rows += [(300 + i, "copy", "zz", "s", 4) for i in range(33)]
    assert audited(spark, rows, bits) == proofs(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_small_datasets(spark, n):
    rows = [(i, None if i == 1 else "t", "en", None, 1) for i in range(n)]
    assert audited(spark, rows, 10) == proofs(rows)


def test_positions_are_places_in_postorder():
    for n in range(1, 70):
        order, levels = [], [n]
        while levels[-1] > 1:
            levels.append(-(-levels[-1] // 2))

        def visit(level, index):
            if level:
                for child in (2 * index, 2 * index + 1):
                    if child < levels[level - 1]:
                        visit(level - 1, child)
            order.append((level, index))

        visit(len(levels) - 1, 0)
        assert mm.height(n) == len(levels) - 1
        assert [mm.position(level, index, n) for level, index in order] == list(range(len(order)))


def test_builders_write_in_completion_order(spark):
    rows = [(i, "t", "en", "s", 1) for i in range(37)]
    df = spark.createDataFrame([(*r, "t", "d", "i", "x", "n") for r in rows], DOCS)
    leaves = df.select(F.lit("=en").alias("tree"), F.col("doc_id").alias("id"), mm.leaf_digest({"doc_id": F.col("doc_id")}).alias("digest"), F.lit(None).cast("string").alias("note"))
    log = mm.append_log(leaves, "id", bits=3)
    nodes = sorted((r["position"], r["level"], r["index"]) for r in log.nodes.collect())
    assert [p for p, _, _ in nodes] == list(range(len(nodes))) and log.tiers == 2
    again = mm.append_log(leaves.limit(24), "id", bits=3)  # full nodes keep their places as the log grows
    before = {(r["level"], r["index"]): (r["position"], r["digest"]) for r in again.nodes.collect() if (r["index"] + 1) << r["level"] <= 24}
    after = {(r["level"], r["index"]): (r["position"], r["digest"]) for r in log.nodes.collect()}
    assert len(before) == 2 * 24 - 2 and all(after[k] == v for k, v in before.items())
    assert log.nodes.groupBy("tree", F.shiftright("index", 3)).count().count() == 5


# 7: shards of texts with one odd value, and their files


def test_one_odd_value_leaves_the_cells_of_the_rest(spark):
    """Values that begin alike keep cells of their own, few or many of them."""
    from ledgerline.llm import sharding

    for n in (50, 500):
        rows = [("a",), (None,)] + [(f"https://host{i:04d}.org",) for i in range(n)]
        df = spark.createDataFrame(rows, "host string")
        got = df.select("host", sharding.cell(df, "host").alias("c")).orderBy("host").collect()
        cells = [r["c"] for r in got]
        assert cells[0] == 0 and cells == sorted(cells) and cells[-1] <= 63 and len(set(cells)) >= min(n + 2, 60)


def test_written_shards_let_readers_skip(spark, tmp_path):
    """Files along the curve are skipped by ranges of each dimension far more often than files of random order."""
    import pyarrow.parquet as pq

    from ledgerline.llm import sharding

    dice = random.Random(2)
    rows = [(i, "x" * dice.randint(0, 20) if i % 50 else None, f"l{dice.randint(0, 7)}", f"https://host{dice.randint(0, 300):03d}", dice.randint(0, 5000)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sharding.write_shards(docs, f"{tmp_path}/curve", shards=40)
    docs.orderBy(F.xxhash64("doc_id")).repartition(40).write.parquet(f"{tmp_path}/random")
    again = spark.read.parquet(f"{tmp_path}/curve")
    assert sorted(map(str, again.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    placed = {r["doc_id"]: r["shard"] for r in sharding.hilbert_shards(docs, shards=40).collect()}
    assert {r["doc_id"]: r["shard"] for r in again.select("doc_id", "shard").collect()} == placed

    def skipped(path, column, low, high):
        files = [pq.ParquetFile(f) for f in path.rglob("*.parquet")]
        stats = [f.metadata.row_group(0).column(f.schema_arrow.names.index(column)).statistics for f in files]
        return sum(s.max < low or s.min > high for s in stats) / len(stats)

    ranges = {"n_chars": (1000, 1500), "source": ("https://host100", "https://host130"), "lang": ("l3", "l3")}
    share = {c: (skipped(tmp_path / "curve", c, *r), skipped(tmp_path / "random", c, *r)) for c, r in ranges.items()}
    print({c: f"{a:.2f} of files skipped, {b:.2f} in random order" for c, (a, b) in share.items()})
    assert all(a >= 0.4 and b <= 0.05 for a, b in share.values())
