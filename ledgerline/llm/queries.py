"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroid_clustering, chat_format, decontamination, license_scan, line_dedup, merkle_manifest, ngram_join, packing, quality_classifier, quality_rules, sharding, substring_dedup, warc
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.host_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op5_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents"), min_words=1)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.dedup_archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"), shards=40).drop("curve")


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op10_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.findings(table(spark, sf_dir, "documents"))


def op11_laesa_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.centroid_clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -7, whose texts hold control strings."""
    own = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat_format.read_back(chat_format.formatted(chats))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    loss = F.length("loss_text").cast("long")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), loss.alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "valid", "bad_turn")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; where 7 divides the CRC-32 of the id, one is added to ``n_chars`` before the proof is tried."""
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    return merkle_manifest.audit(table(spark, sf_dir, "documents"), more, F.crc32(F.col("doc_id").cast("string")) % 7 == 0).drop("n_steps")


QUERIES = {
    f.__name__: f
    for f in (
        op1_host_quality_rules, op2_repeated_passages, op3_best_fit_packing, op4_benchmark_decontamination, op5_fuzzy_line_dedup, op6_warc_revisits,
        op7_hilbert_sharding, op8_compression_quality, op9_ngram_jaccard_join, op10_license_paragraphs,
        op11_laesa_clusters, op12_chat_format, op13_merkle_manifest,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_host_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
g AS (SELECT doc_id, pos, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN
        word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS win
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT doc_id, pos, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 THEN 1 ELSE 0 END AS twice FROM g),
r AS (SELECT doc_id, sum(hit) AS n FROM (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM c) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, d.source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY 1),
p AS (SELECT avg(f / n) AS mean, var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) AS v FROM h),
q AS (SELECT source, (f + mean * k) / (n + k) AS rate FROM h, (SELECT mean, CASE WHEN v > 0 THEN greatest(1, mean * (1 - mean) / v - 1) ELSE 1e9 END AS k FROM p))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source""",
    "op2_repeated_passages": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
o AS (SELECT h, min(doc_id) AS owner FROM s GROUP BY 1),
f AS (SELECT doc_id, i FROM s JOIN o USING (h) WHERE owner < doc_id),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
c AS (SELECT w.doc_id, w.i, word, max(CASE WHEN f.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM w LEFT JOIN f ON w.doc_id = f.doc_id AND w.i = f.i),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op4_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
m AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
    "op6_warc_revisits": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS original FROM pages),
s AS (SELECT *, sha1(html) AS hex FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1), '' ORDER BY i) FROM range(32) t(i)) AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to
FROM s""",
}


def _laesa_sql(rounds: int = 5) -> str:
    """Lloyd's rounds one after another, every distance in full (whole numbers in doubles, exact below 2**53)."""
    near = "(SELECT rid, min({'d': list_dot_product(v.c, v.c) - 2 * list_dot_product(v.c, q.c) + list_dot_product(q.c, q.c), 'k': k}) AS b FROM v, %s q GROUP BY rid)"
    step = """a{0} AS MATERIALIZED (SELECT rid, b.k AS k FROM {1}),
m{0} AS (SELECT k, list(x ORDER BY i) AS c FROM (SELECT k, i, floor(sum(v.c[i]) / count(*)) AS x FROM a{0} JOIN v USING (rid), range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
c{2} AS MATERIALIZED (SELECT k, coalesce(m{0}.c, c{0}.c) AS c FROM c{0} LEFT JOIN m{0} USING (k)),
"""
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, c) - 1 AS k, c FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, c FROM v ORDER BY h, c LIMIT 40)),
{"".join(step.format(r, near % f"c{r}", r + 1) for r in range(rounds))}f AS MATERIALIZED (SELECT vec_id, b.k AS k, b.d::BIGINT AS d FROM {near % f"c{rounds}"} JOIN v USING (rid))
SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM f JOIN c{rounds} USING (k)"""


def _chat_sql() -> str:
    t, order = chat_format.DEFAULT, chat_format.DEFAULT.order
    escaped = "regexp_replace({}, '" + t.pattern() + r"', '\1\\\2\3', 'g')"
    marks = " ".join(f"WHEN '{name}' THEN {len(turn.before) + len(turn.after)}" for name, turn in t.turns.items())
    other = len(t.other.before) + len(t.named) + len(t.other.after)
    steps = ", ".join(f"'{state}>{role}'" for state, nexts in order.items() for role in nexts)
    loss = ", ".join(f"'{name}'" for name, turn in t.turns.items() if turn.loss)
    ends = ", ".join(f"'{x}'" for x in t.ends)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
o AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(lag(role) OVER w, '') AS state, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
k AS (SELECT *, CASE WHEN state || '>' || role NOT IN ({steps}) THEN i WHEN i = n - 1 AND role NOT IN ({ends}) THEN n END AS bad,
  length({escaped.format('text')}) + CASE role {marks} ELSE {other} + length({escaped.format('role')}) END AS chars FROM o),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS whole, coalesce(string_agg(CASE WHEN role IN ({loss}) THEN text END, '' ORDER BY i), '') AS under,
  sum(chars) + {len(t.begin)} AS chars, min(bad) AS bad FROM k GROUP BY 1)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(under) AS loss_chars, sha256(under) AS loss_sha256, chars::BIGINT AS formatted_chars, bad IS NULL AS valid, bad::INT AS bad_turn FROM g"""


def _merkle_sql(levels: int = 20, upper: int = 6) -> str:
    """Level by level, each leaf with its sibling; ``levels`` are enough for a million documents of a language, ``upper`` for 64 languages."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}, '-')"
    leaf = lambda n: "sha256(" + " || ".join(field.format(n if c == "n_chars" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    crc = "xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: list_reduce(range(8), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(a, b)), 4294967295))"

    def climb(name: str, count: int) -> str:
        """Levels of the forest {name}0 (tree, i, n, h)."""
        return "".join(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, i // 2 AS i, (n + 1) // 2 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {name}{k} GROUP BY tree, i // 2, n),\n" for k in range(count))

    def up(name: str, start: str, count: int, keep: str) -> str:
        """From the ways in ``start`` ({keep}, tree, i, cur, proof) up all levels of the forest."""
        out, last = "", start
        for k in range(count):
            cur = "CASE WHEN x.n <= 1 THEN cur WHEN s.h IS NULL THEN sha256(cur) WHEN x.i % 2 = 1 THEN sha256(s.h || cur) ELSE sha256(cur || s.h) END"
            out += f"{start}{name}{k} AS MATERIALIZED (SELECT {keep}, w.tree, w.i // 2 AS i, {cur} AS cur, proof || coalesce(s.h, '') AS proof FROM {last} w JOIN {name}{k} x ON x.tree = w.tree AND x.i = w.i LEFT JOIN {name}{k} s ON s.tree = w.tree AND s.i = xor(w.i, 1) AND x.n > 1),\n"
            last = f"{start}{name}{k}"
        return out

    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("n_chars")} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf("(n_chars::HUGEINT + 1)")} END AS changed FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
a0 AS MATERIALIZED (SELECT tree, i, n, leaf AS h FROM r),
{climb("a", levels)}t AS MATERIALIZED (SELECT tree AS name, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM a{levels}),
b0 AS MATERIALIZED (SELECT '' AS tree, i, n, subroot AS h FROM t),
{climb("b", upper)}w AS (SELECT doc_id, leaf, tree AS name, tree, i, coalesce(changed, leaf) AS cur, '' AS proof FROM r),
{up("a", "w", levels, "doc_id, leaf, name")}y AS (SELECT doc_id, leaf, name, '' AS tree, t.i, cur, proof, subroot FROM wa{levels - 1} JOIN t USING (name)),
{up("b", "y", upper, "doc_id, leaf, subroot")}z AS (SELECT h AS root FROM b{upper})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM yb{upper - 1}, z"""


ORACLES |= {"op11_laesa_clusters": _laesa_sql(), "op12_chat_format": _chat_sql(), "op13_merkle_manifest": _merkle_sql()}
