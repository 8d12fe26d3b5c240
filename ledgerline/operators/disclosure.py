"""JSON of sources: the newest item of a disclosure index, and generic metadata of which only listed keys count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html
from .pages import is_meaningful, zoned

# The clock of the index, how far it may be ahead, and the keys of stable metadata.
INDEX_OFFSET, AHEAD_SECONDS = "+0900", 300
STABLE_KEYS = ("category", "document_type", "language", "period")
RECOGNISED = ("title", "document_id", "published_at", "corrected", "updated", "stable_metadata")
LONGEST = 200


def _cleaned(text: Column) -> Column:
    """White space collapsed; null for nothing."""
    return F.nullif(html.clean(text), F.lit(""))


def _invalid(text: Column) -> Column:
    return F.coalesce((F.length(text) > LONGEST) | text.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def newest(indexes: DataFrame, key: str, body: str = "body", observed_at: str = "observed_at") -> DataFrame:
    """Per index: title, document_id, published_at, document_url, replacement_suspected and item_count of its first item, or ``code`` and nulls.

    The index gives times without a zone; they are read at ``INDEX_OFFSET``, whatever the session's zone is. Codes, the first that applies: 'no_item'
    (also for what is no JSON object), 'invalid_title', 'invalid_id', 'invalid_time' (missing, of another form, or later than the observation by more
    than ``AHEAD_SECONDS``), 'missing_url', 'invalid_url', 'invalid_count'. Without an observation's time none is too late.
    """
    kind = "items array<struct<title string, id string, pubdate string, document_url string, update_history string>>, total_count string"
    read = indexes.select(key, F.col(observed_at).cast("timestamp").alias("seen"), F.from_json(body, kind).alias("j"))
    item = F.get("j.items", F.lit(0))
    rows = read.select(key, "seen", item.alias("i"), F.size("j.items").alias("n"), F.col("j.total_count").alias("declared"))
    title, document, url = html.clean(F.coalesce("i.title", F.lit(""))), _cleaned(F.col("i.id")), _cleaned(F.col("i.document_url"))
    time = F.when(F.col("i.pubdate").rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), F.try_to_timestamp(F.concat("i.pubdate", F.lit(f" {INDEX_OFFSET}")), F.lit("y-M-d H:m:s Z")))
    count = F.when(F.coalesce("declared", F.lit("")) == "", F.col("n").cast("long")).otherwise(F.when(html.stripped(F.col("declared")).rlike(r"^[+-]?\d{1,18}$"), html.stripped(F.col("declared")).try_cast("long")))
    rows = rows.select(
        key, "seen", F.col("i").isNull().alias("none"), title.alias("title"), document.alias("document_id"), time.alias("published_at"), url.alias("document_url"),
        F.coalesce(is_meaningful(html.clean(F.col("i.update_history"))), F.lit(False)).alias("replacement_suspected"), count.alias("item_count"),
    )
    authority = F.regexp_extract("document_url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    safe = F.lower(F.col("document_url")).startswith("https://") & (F.regexp_replace(authority, r":\d*$", "") != "") & ~authority.contains("@")
    late = F.coalesce(F.col("published_at") > F.col("seen") + F.expr(f"INTERVAL '{AHEAD_SECONDS}' SECOND"), F.lit(False))
    code = (
        F.when(F.col("none"), "no_item").when(~is_meaningful(F.col("title")), "invalid_title").when(F.col("document_id").isNull() | _invalid(F.col("document_id")), "invalid_id")
        .when(F.col("published_at").isNull() | late, "invalid_time").when(F.col("document_url").isNull(), "missing_url").when(_invalid(F.col("document_url")) | ~safe, "invalid_url").when(F.col("item_count").isNull(), "invalid_count")
    )
    return _refused(rows, key, code, ("title", "document_id", "published_at", "document_url", "replacement_suspected", "item_count"))


def _refused(rows: DataFrame, key: str, code: Column, values: tuple[str, ...]) -> DataFrame:
    coded = rows.withColumn("code", code)
    return coded.select(key, *[F.when(F.col("code").isNull(), F.col(v)).alias(v) for v in values], "code")


def generic(sources: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Per source: title, document_id, published_at, replacement_suspected and stable_metadata (listed keys only, in lower case), or ``code`` and nulls.

    Codes, the first that applies: 'not_object', 'unrecognised' (none of the known keys), 'invalid_title', 'invalid_document_id', 'invalid_time',
    'metadata_not_object', 'not_scalar' (a listed key holds an object or a list), 'invalid_metadata', 'nothing_usable'. Of keys that are equal in lower case the last counts.
    """
    parsed = F.try_parse_json(body)
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    read = sources.select(key, parsed.alias("v"), F.from_json(body, "map<string, string>").alias("top"), F.from_json(body, "struct<stable_metadata: map<string, variant>>")["stable_metadata"].alias("m"))
    shape = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    stable = F.try_variant_get("v", "$.stable_metadata", "variant")
    listed = F.filter(F.transform(F.map_entries("m"), lambda e: F.struct(F.lower(html.stripped(e["key"])).alias("k"), e["value"].alias("v"))), lambda e: e["k"].isin(*STABLE_KEYS))
    rows = read.select(
        key, F.coalesce(shape(F.col("v")) != "OBJECT", F.lit(True)).alias("other"), F.exists(F.map_keys("top"), lambda k: k.isin(*RECOGNISED)).alias("known"), html.clean(text("title")).alias("title"), _cleaned(text("document_id")).alias("document_id"),
        F.nullif(text("published_at"), F.lit("")).alias("time"), F.coalesce(F.lower(html.stripped(F.coalesce(F.nullif(text("corrected"), F.lit("")), F.lit("")))).isin("1", "true", "yes", "corrected", "updated"), F.lit(False)).alias("corrected"),
        F.coalesce(F.lower(html.stripped(text("updated"))).isin("1", "true", "yes", "corrected", "updated"), F.lit(False)).alias("updated"),
        (stable.isNotNull() & ~shape(stable).isin("OBJECT", "VOID")).alias("flat"), F.coalesce(listed, F.array().cast("array<struct<k:string,v:variant>>")).alias("listed"),
    )
    nested = F.exists("listed", lambda e: shape(e["v"]).isin("OBJECT", "ARRAY"))
    values = F.filter(F.transform("listed", lambda e: F.struct(e["k"].alias("k"), _cleaned(F.try_variant_get(e["v"], "$", "string")).alias("v"))), lambda e: e["v"].isNotNull())
    rows = rows.withColumn("nested", nested).withColumn("values", values).withColumn("published_at", zoned(F.col("time"))).withColumn("replacement_suspected", F.col("corrected") | F.col("updated"))
    last = F.filter("values", lambda e, i: ~F.exists(F.slice("values", i + 2, F.size("values")), lambda u: u["k"] == e["k"]))
    code = (
        F.when(F.col("other"), "not_object").when(~F.coalesce("known", F.lit(False)), "unrecognised").when(~is_meaningful(F.col("title")), "invalid_title").when(_invalid(F.col("document_id")), "invalid_document_id")
        .when(F.col("time").isNotNull() & F.col("published_at").isNull(), "invalid_time").when(F.col("flat"), "metadata_not_object").when(F.col("nested"), "not_scalar")
        .when(F.exists("values", lambda e: _invalid(e["v"])), "invalid_metadata").when(F.coalesce("title", "document_id", F.col("published_at").cast("string")).isNull(), "nothing_usable")
    )
    return _refused(rows.withColumn("stable_metadata", F.map_from_entries(last)), key, code, ("title", "document_id", "published_at", "replacement_suspected", "stable_metadata"))
