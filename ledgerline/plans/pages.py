"""Registered queries over web pages, each with its SQL. What the given pages lack (odd anchors, meta elements, calendars) is planted by their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import html
from ..operators import disclosure, pages
from .views import view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_PLANTED = """SELECT page_id, url, replace(html, '<nav>', CASE page_id % 13
    WHEN 0 THEN '<a class="k" href="a.pdf">A</a><nav>' WHEN 1 THEN '<A HREF=''../b.pdf'' >B &amp; C</A ><nav>' WHEN 2 THEN '<a href=c.pdf><b>t</b> <i>u</i></a><nav>' WHEN 3 THEN '<a href="?q=1&amp;r=2#z">q</a><nav>'
    WHEN 4 THEN '<a href="mailto:x@example.org">m</a><a href="">self</a><nav>' WHEN 5 THEN '<a href="/x/./y/../z">dots</a><a href="/x/z">again</a><nav>' WHEN 6 THEN '<a title="a > b" href="//other.example/p">gt</a><nav>'
    WHEN 7 THEN '<!-- <a href="no.pdf">no</a> --><a>no href</a><nav>' WHEN 8 THEN '<script>var a = "<a href=no>x</a>";</script><nav>' WHEN 9 THEN '<a href="open.pdf">open <nav>'
    WHEN 10 THEN '<meta name="Document-ID" content="D-1"><meta content="2026-01-02T03:04:05+09:00" property="article:published_time"><META NAME=''document-id'' CONTENT=D-2><nav>'
    WHEN 11 THEN '<meta name="date" content="2026-01-02T03:04:05"><meta name="updated" content=" Yes "><nav>' ELSE '<nav>' END) AS html FROM {pages}"""

_INSIDE = r"""(?:[^>=]|=\s*(?:"[^"]*"|''[^'']*'')?)*"""
_TOKEN = rf"(?is)<!--.*?-->|<script(?:[\s/]{_INSIDE})?>.*?</script\s*>|<style(?:[\s/]{_INSIDE})?>.*?</style\s*>|</?[a-z]{_INSIDE}>|</?[a-z][^>]*>|<[!?][^>]*>|[^<]+|<"
_UNESCAPED = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_ATTRIBUTE = r"""trim(regexp_extract(' ' || {0}, '(?is)[\s/]{1}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"''')"""


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PLANTED, pages=view(spark, sf_dir, "pages"))


@query(rf"""
WITH p AS ({_PLANTED.format(pages='pages')}),
t AS (SELECT page_id, url, array_to_string(list_transform(regexp_extract_all(html, '{_TOKEN}'), lambda x: CASE WHEN left(x, 1) <> '<' OR x = '<' THEN x
    WHEN regexp_matches(x, '(?i)^<([!?]|script[\s/>]|style[\s/>])') THEN chr(1) || '!' || chr(2) ELSE CASE WHEN regexp_matches(x, '(?i)^<a[\s/>]') THEN chr(3) ELSE chr(1) END || x[2:-2] || chr(2) END), '') AS m FROM p),
c AS (SELECT page_id, url, unnest(list_slice(string_split(m, chr(3)), 2, 999999)) AS piece, generate_subscripts(list_slice(string_split(m, chr(3)), 2, 999999), 1) AS i FROM t),
b AS (SELECT page_id, url, i, split_part(piece, chr(2), 1) AS inside, substr(piece, length(split_part(piece, chr(2), 1)) + 2) AS rest FROM c),
a AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, {_UNESCAPED.format(_ATTRIBUTE.format('inside', 'href'))} AS ref,
    trim({_UNESCAPED.format(r"array_to_string(list_filter(string_split_regex(string_split_regex(rest, '\x01/[aA]\s*\x02')[1], '\x01[^\x02]*\x02'), lambda x: x <> ''), ' ')")}) AS label
  FROM b WHERE regexp_matches(rest, '\x01/[aA]\s*\x02') AND regexp_matches(inside, '(?i)[\s/]href\s*=')),
u AS (SELECT *, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS base,
    regexp_extract(ref, '^([^?#]*)', 1) AS path, regexp_extract(ref, '^[^?#]*(.*)$', 1) AS tail FROM a),
s AS (SELECT *, string_split(CASE WHEN path LIKE '/%' THEN path ELSE regexp_replace(base, '[^/]*$', '') || path END, '/') AS segs FROM u),
d AS (SELECT *, array_to_string(list_reduce(list_transform(segs, lambda x: [x]), lambda acc, x: CASE x[1] WHEN '..' THEN acc[1:-2] WHEN '.' THEN acc ELSE acc || x END, []::VARCHAR[]), '/') AS joined FROM s),
l AS (SELECT page_id, pos, label, CASE WHEN ref = '' THEN url WHEN regexp_matches(ref, '^[a-z]+:') THEN ref WHEN ref LIKE '//%' THEN scheme || ':' || ref WHEN path = '' THEN site || base || tail ELSE site || joined || tail END AS link FROM d)
SELECT page_id, link, min(pos)::BIGINT AS pos, arg_min(label, pos) AS label FROM l GROUP BY 1, 2""")  # fmt: skip
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(_planted(spark, sf_dir))


_META = rf"""p AS ({_PLANTED.format(pages='pages')}),
e AS (SELECT page_id, x, i FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<meta\s[^>]*>')) AS x, generate_subscripts(regexp_extract_all(html, '(?is)<meta\s[^>]*>'), 1) AS i FROM p)),
k AS (SELECT page_id, i, lower(coalesce(nullif({_ATTRIBUTE.format('x', 'name')}, ''), {_ATTRIBUTE.format('x', 'property')})) AS k, trim({_ATTRIBUTE.format('x', 'content')}) AS v FROM e WHERE x ILIKE '%content=%'),
m AS (SELECT page_id, k, arg_max(v, i) AS v FROM k WHERE k <> '' GROUP BY 1, 2)"""
_RAW_TITLE = _UNESCAPED.format("regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)")
_TITLE = f"trim(regexp_replace({_RAW_TITLE}, '\\s+', ' ', 'g'))"


@query(f"""WITH {_META}, j AS (SELECT page_id, string_agg(k || '=' || v, ';' ORDER BY k) AS meta FROM m GROUP BY 1)
SELECT page_id, nullif({_TITLE}, '') AS title, coalesce(meta, '') AS meta, nullif(regexp_extract(html, '<meta\\s+charset="([^"]*)"', 1), '') AS charset, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang FROM p LEFT JOIN j USING (page_id)""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _planted(spark, sf_dir).select("page_id", html.nodes(F.col("html")).alias("nodes"))
    of = lambda tag, name: F.try_element_at(F.filter(F.transform(F.filter("nodes", lambda n: n["tag"] == tag), lambda n: html.attribute(n["inside"], name)), lambda v: v.isNotNull()), F.lit(1))
    told = cut.select("page_id", pages.title(F.col("nodes")).alias("title"), pages.meta(F.col("nodes")).alias("meta"), of("meta", "charset").alias("charset"), of("html", "lang").alias("lang"))
    return told.withColumn("meta", F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


@query(f"""WITH {_META}, w AS (SELECT page_id, max(CASE WHEN k = 'document-id' THEN v END) AS document_id, max(CASE WHEN k IN ('article:published_time', 'date') THEN v END) AS t, max(CASE WHEN k = 'updated' THEN lower(v) END) AS updated FROM m GROUP BY 1),
o AS (SELECT p.page_id, nullif({_TITLE}, '') AS title, document_id, t, CASE WHEN regexp_matches(t, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN CAST(t AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS published_at, coalesce(updated IN ('1', 'true', 'yes', 'corrected', 'updated'), false) AS r FROM p LEFT JOIN w USING (page_id)),
c AS (SELECT *, CASE WHEN NOT regexp_matches(title, '[\\p{{L}}\\p{{N}}]') OR length(title) > 500 THEN 'invalid_title' WHEN t IS NOT NULL AND published_at IS NULL THEN 'invalid_time' WHEN coalesce(title, document_id, t) IS NULL THEN 'no_metadata' END AS code FROM o)
SELECT page_id, CASE WHEN code IS NULL THEN title END AS title, CASE WHEN code IS NULL THEN document_id END AS document_id, CASE WHEN code IS NULL THEN published_at END AS published_at, CASE WHEN code IS NULL THEN r END AS replacement_suspected, CAST(NULL AS VARCHAR) AS og_type, code FROM c""")
def page_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.observed(_planted(spark, sf_dir))


#: What stands beside a page, by its id; NULL as a value is a present null.
_BESIDE = {0: None, 1: {"title": None, "document_id": "M"}, 2: {"published_at": None, "content_length": "9"}, 3: {"published_at": "2026-01-02"}, 4: {"content_length": "many"}, 5: {"error_code": "timeout", "retry_count": "2"}, 6: {"replacement_suspected": "true", "source_url": "https://other.example/"}}


def _beside_sql(key: str) -> tuple[str, str]:
    """(whether the key is there, its value) by page."""
    have = [n for n, m in _BESIDE.items() if m and key in m]
    values = " ".join(f"WHEN {n} THEN '{_BESIDE[n][key]}'" for n in have if _BESIDE[n][key] is not None)
    return f"page_id % 7 IN ({', '.join(map(str, have)) or -1})", f"CASE page_id % 7 {values} END" if values else "NULL"


def _over(key: str, own: str) -> str:
    there, value = _beside_sql(key)
    return f"CASE WHEN {there} THEN {value} ELSE {own} END"


@query(f"""WITH {_META}, w AS (SELECT page_id, max(CASE WHEN k = 'document-id' THEN v END) AS doc, max(CASE WHEN k = 'updated' THEN lower(v) END) AS updated FROM m GROUP BY 1),
o AS (SELECT page_id, {_beside_sql('error_code')[1]} AS error_code, {_beside_sql('retry_count')[1]} AS retries, {_over('source_url', 'url')} AS source_url, {_over('title', f"nullif({_RAW_TITLE}, '')")} AS title, {_over('document_id', 'doc')} AS document_id,
    {_over('published_at', 'NULL')} AS t, {_over('content_length', 'NULL')} AS len, coalesce({_over('replacement_suspected', 'NULL')} = 'true', false) OR coalesce(updated IN ('1', 'true', 'yes'), false) AS r FROM p LEFT JOIN w USING (page_id)),
c AS (SELECT *, CASE WHEN error_code IS NOT NULL THEN error_code WHEN t IS NOT NULL THEN 'invalid_time' WHEN len = 'many' THEN 'invalid_length' END AS code FROM o)
SELECT page_id, CASE WHEN code IS NULL THEN source_url END AS source_url, CASE WHEN code IS NULL THEN title END AS title, CASE WHEN code IS NULL THEN document_id END AS document_id, CAST(NULL AS TIMESTAMP) AS published_at, CAST(NULL AS VARCHAR) AS etag, CAST(NULL AS VARCHAR) AS last_modified,
  CASE WHEN code IS NULL THEN CAST(len AS BIGINT) END AS content_length, CASE WHEN code IS NULL THEN r END AS replacement_suspected, code, CASE WHEN error_code IS NOT NULL THEN 'observation_failed' END AS error_detail, CASE WHEN error_code IS NOT NULL THEN CAST(retries AS INT) END AS retry_count FROM c""")
def page_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = " ".join(f"WHEN {n} THEN map({', '.join(repr(k) + ', ' + ('CAST(NULL AS STRING)' if v is None else repr(v)) for k, v in m.items())})" for n, m in _BESIDE.items() if m)
    return pages.observed_with_metadata(_planted(spark, sf_dir).withColumn("metadata", F.expr(f"CASE CAST(page_id % 7 AS INT) {maps} END")))


_MONTH, _DAY = "CAST(1 + page_id % 12 AS STRING)", "CAST(1 + page_id % 31 AS STRING)"
_DATED = f"""SELECT page_id, concat(html, CASE page_id % 9
    WHEN 0 THEN concat('<table><tr><td>2026年', {_MONTH}, '月', {_DAY}, '日</td><td><b>2027年3月期第', CAST(1 + page_id % 4 AS STRING), '四半期決算発表</b></td></tr></table>')
    WHEN 1 THEN concat('<p>2026年 ', {_MONTH}, ' 月 9 日 通期決算発表（予定）</p><li>2027年', {_MONTH}, '月中旬 決算発表</li>')
    WHEN 2 THEN concat('<p>2026年', {_MONTH}, '月', {_DAY}, '日 定時株主総会</p><p>決算発表資料</p>') WHEN 3 THEN concat('<p>2026年', {_MONTH}, '月1日 2026年', {_MONTH}, '月2日 ', url, '決算発表</p>')
    WHEN 4 THEN concat('<noscript>2026年3月3日 決算発表</noscript><td>2026年', {_MONTH}, '月末</td>', '<td>Q1決算発表</td>') WHEN 5 THEN repeat(concat('<p>2026年', {_MONTH}, '月3日 決算発表</p>'), CAST(10 + page_id % 6 AS INT))
    WHEN 6 THEN concat('<p>2026&#24180;', {_MONTH}, '月7日</p> &#12288; <p>決算発表</p>') ELSE '' END) AS html FROM {{pages}}"""
_JP = r"(20[0-9]{2})\s*年\s*([0-9]{1,2})\s*月\s*(?:([0-9]{1,2})\s*日|(上旬|中旬|下旬|初旬|末))"


@query(rf"""
WITH p AS ({_DATED.format(pages='pages')}),
v AS (SELECT page_id, replace(replace(regexp_replace(html, '(?is)<!--.*?-->|<head\b.*?</head>|<noscript>.*?</noscript>|<script\b.*?</script>|<style\b.*?</style>', '<i>', 'g'), '&#24180;', '年'), '&#12288;', ' ') AS html FROM p),
s AS (SELECT page_id, list_filter(list_transform(string_split_regex(html, '<[^>]*>'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS texts FROM v),
n AS (SELECT page_id, texts, unnest(texts) AS text, generate_subscripts(texts, 1) AS i FROM s),
d AS (SELECT page_id, i, regexp_extract_all(text, '{_JP}') AS ds, string_split_regex(text, '{_JP}') AS parts, coalesce(texts[i + 1], '') AS following FROM n),
r AS (SELECT page_id, i, j, ds[j] AS d, CASE WHEN trim(array_to_string(list_transform(range(j, len(ds) + 1), lambda k: parts[k + 1] || coalesce(ds[k + 1], '')), '')) <> ''
    THEN trim(array_to_string(list_transform(range(j, len(ds) + 1), lambda k: parts[k + 1] || coalesce(ds[k + 1], '')), '')) ELSE following END AS label FROM (SELECT *, unnest(range(1, len(ds) + 1)) AS j FROM d)),
l AS (SELECT page_id, i, j, regexp_extract(d, '{_JP}', 1) || '-' || lpad(regexp_extract(d, '{_JP}', 2), 2, '0') || '-' AS ym, regexp_extract(d, '{_JP}', 3) AS day, regexp_extract(d, '{_JP}', 4) AS part, left(split_part(label, '決算発表', 1) || '決算発表', 40) AS label FROM r WHERE contains(label, '決算発表')),
g AS (SELECT page_id, count(*) AS n, bool_or(day <> '' AND TRY_CAST(ym || lpad(day, 2, '0') AS DATE) IS NULL) AS wrong, coalesce(string_agg(CASE WHEN day <> '' THEN ym || lpad(day, 2, '0') || '=' || label END, ';' ORDER BY i, j), '') AS exact, coalesce(string_agg(CASE WHEN day = '' THEN ym || part || '=' || label END, ';' ORDER BY i, j), '') AS approximate FROM l GROUP BY 1),
c AS (SELECT p.page_id, exact, approximate, CASE WHEN wrong THEN 'invalid_date' WHEN n IS NULL THEN 'no_announcement' WHEN n > 12 THEN 'implausible_rows' END AS code FROM p LEFT JOIN g USING (page_id))
SELECT page_id, CASE WHEN code IS NULL THEN exact END AS exact, CASE WHEN code IS NULL THEN approximate END AS approximate, code FROM c""")  # fmt: skip
def page_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.calendar(spark.sql(_DATED, pages=view(spark, sf_dir, "pages")))
    return out.select("page_id", F.array_join("exact", ";").alias("exact"), F.array_join("approximate", ";").alias("approximate"), "code")


_INDEX = """concat('{"items": [', CASE page_id % 9 WHEN 0 THEN '' WHEN 1 THEN '{"title": "--"}, ' ELSE concat('{"title": " Results  ', CAST(page_id AS STRING), ' ", "id": ', CAST(page_id AS STRING), ', "pubdate": "',
    CASE page_id % 9 WHEN 2 THEN '2026/05/08 10:00:00' WHEN 3 THEN '2026-05-08 15:05:01' ELSE '2026-05-07 10:00:00' END, '", "document_url": "', CASE page_id % 9 WHEN 4 THEN url WHEN 5 THEN '' ELSE concat('https', substr(url, strpos(url, ':'))) END,
    '", "update_history": "', CASE WHEN page_id % 2 = 0 THEN 'corrected' ELSE '-' END, '"}, ') END, '{"title": "older"}]', CASE page_id % 9 WHEN 6 THEN ', "total_count": "many"' WHEN 7 THEN ', "total_count": 40' ELSE '' END, '}')"""
_STRPOS = _INDEX.replace("strpos(url, ':')", "instr(url, ':')")


@query(f"""WITH j AS (SELECT page_id, {_INDEX} AS j FROM pages),
f AS (SELECT page_id, trim(regexp_replace(json_extract_string(j, '$.items[0].title'), '\\s+', ' ', 'g')) AS title, json_extract_string(j, '$.items[0].id') AS id, TRY_CAST(CASE WHEN json_extract_string(j, '$.items[0].pubdate') LIKE '____-__-__ %' THEN json_extract_string(j, '$.items[0].pubdate') END AS TIMESTAMP) - INTERVAL '9' HOUR AS t,
  nullif(json_extract_string(j, '$.items[0].document_url'), '') AS u, regexp_matches(coalesce(json_extract_string(j, '$.items[0].update_history'), ''), '[a-z]') AS r, json_array_length(j, '$.items') AS n, json_extract_string(j, '$.total_count') AS c FROM j),
k AS (SELECT *, CASE WHEN NOT regexp_matches(title, '[A-Za-z0-9]') THEN 'invalid_title' WHEN id IS NULL THEN 'invalid_id' WHEN t IS NULL OR t > TIMESTAMP '2026-05-08 06:05:00' THEN 'invalid_time' WHEN u IS NULL THEN 'missing_url' WHEN u NOT LIKE 'https://%' THEN 'invalid_url' WHEN c IS NOT NULL AND TRY_CAST(c AS BIGINT) IS NULL THEN 'invalid_count' END AS code FROM f)
SELECT page_id, CASE WHEN code IS NULL THEN title END AS title, CASE WHEN code IS NULL THEN id END AS document_id, CASE WHEN code IS NULL THEN t END AS published_at, CASE WHEN code IS NULL THEN u END AS document_url, CASE WHEN code IS NULL THEN r END AS replacement_suspected, CASE WHEN code IS NULL THEN coalesce(CAST(c AS BIGINT), n::BIGINT) END AS item_count, code FROM k""")  # fmt: skip
def disclosure_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as an index of two items, or one, some of them faulty."""
    given = view(spark, sf_dir, "pages").selectExpr("page_id", f"{_STRPOS} AS body", "TIMESTAMP '2026-05-08 06:00:00' AS observed_at")
    return disclosure.newest(given, "page_id")


_GENERIC = """concat(CASE WHEN page_id % 10 = 0 THEN '[' ELSE '' END, '{"', CASE page_id % 10 WHEN 1 THEN 'name' ELSE 'title' END, '": "', CASE page_id % 10 WHEN 2 THEN '--' ELSE concat('Page  ', CAST(page_id AS STRING)) END, '"', CASE page_id % 10 WHEN 3 THEN ', "published_at": "2026-01-02T03:04:05"' WHEN 4 THEN ', "published_at": "2026-01-02T03:04:05+09:00"' ELSE '' END,
    ', "', CASE page_id % 10 WHEN 1 THEN 'values' ELSE 'stable_metadata' END, '": ', CASE page_id % 10 WHEN 5 THEN '[1]' WHEN 6 THEN '{"period": {"a": 1}}' ELSE concat('{"Category": " c', CAST(page_id % 3 AS STRING), ' ", "language": ', CAST(page_id % 7 AS STRING), ', "else": [1]}') END, '}', CASE WHEN page_id % 10 = 0 THEN ']' ELSE '' END)"""


@query(f"""WITH j AS (SELECT page_id, {_GENERIC} AS j FROM pages), f AS (SELECT page_id, page_id % 10 AS m, json_extract_string(j, '$.title') AS title, json_extract_string(j, '$.published_at') AS t, json_extract_string(j, '$.stable_metadata.Category') AS c, json_extract_string(j, '$.stable_metadata.language') AS l FROM j),
k AS (SELECT *, CASE m WHEN 0 THEN 'not_object' WHEN 1 THEN 'unrecognised' WHEN 2 THEN 'invalid_title' WHEN 3 THEN 'invalid_time' WHEN 5 THEN 'metadata_not_object' WHEN 6 THEN 'not_scalar' END AS code FROM f)
SELECT page_id, CASE WHEN code IS NULL THEN regexp_replace(title, '\\s+', ' ', 'g') END AS title, CASE WHEN code IS NULL THEN CAST(CAST(t AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) END AS published_at, CASE WHEN code IS NULL THEN 'category=' || trim(c) || ';language=' || l END AS stable, code FROM k""")  # fmt: skip
def json_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = disclosure.generic(view(spark, sf_dir, "pages").selectExpr("page_id", f"{_GENERIC} AS body"), "page_id")
    return out.select("page_id", "title", "published_at", F.array_join(F.transform(F.array_sort(F.map_entries("stable_metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("stable"), "code")
