"""Observations: pages, links, JSON indexes, fetch results and what is stale, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import tails


def first_group(html: Column, pattern: str) -> Column:
    """The first group of a pattern's first match, null without one."""
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def page_title(html: Column) -> Column:
    return first_group(html, "<title>([^<]*)</title>")


def schedule_rows(pages: DataFrame, date: str = r"\d{4}-\d{2}-\d{2}", limit: int = 12) -> DataFrame:
    """Dates in a page's visible text with the label in the same or the next text node; ``plausible`` is false for all rows of a page with more than ``limit``."""
    visible = F.regexp_replace("html", r"(?s)<(script|style|head)\b.*?</\1>|<!--.*?-->", "")
    nodes = pages.select("page_id", F.posexplode(F.filter(F.transform(F.split(visible, r"<[^>]*>"), lambda t: F.trim(t)), lambda t: t != "")).alias("pos", "node"))
    by = Window.partitionBy("page_id").orderBy("pos")
    rows = nodes.withColumn("following", F.lead("node").over(by)).withColumn("day", first_group(F.col("node"), f"({date})")).filter("day is not null")
    rest = F.trim(F.regexp_replace("node", date, ""))
    rows = rows.withColumn("label", F.when(rest != "", rest).otherwise(F.col("following"))).withColumn("n", F.row_number().over(by))
    return rows.select("page_id", "day", "label", "n", (F.count(F.lit(1)).over(Window.partitionBy("page_id")) <= limit).alias("plausible"))


def json_fields(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``df`` with the fields that a JSON column may have; others are passed over, unreadable ones are null."""
    return df.withColumn("__json", F.from_json(column, schema)).select(*[c for c in df.columns if c != column], "__json.*")


def digest_changes(pages: DataFrame) -> DataFrame:
    """Against the page before of the same target: whether the digest changed and the size suggests a replacement."""
    by = Window.partitionBy("target").orderBy("page_id")
    old, size = F.lag("digest").over(by), F.lag("size").over(by)
    return pages.select("page_id", "digest", (old.isNotNull() & (old != F.col("digest"))).alias("changed"), F.coalesce(size != F.col("size"), F.lit(False)).alias("replacement_suspected"))


def status_error(code: Column) -> Column:
    """What a fetch's status says of its source; null where it is no failure of its own."""
    # The error codes of monitor runs.
    return (
        F.when(code.isin(401, 403), "authentication_required").when(code == 429, "rate_limited").when(code == 408, "timeout")
        .when((code == 404) | code.between(500, 599), "source_unavailable")
    )


def is_retryable(code: Column) -> Column:
    return code.isin(408, 429) | code.between(500, 599)


def stale_reference(state: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """The later of the last success and the last end of a gap whose acknowledgement still stands."""
    ends = tails(acknowledgements, "ack_id", "supersedes").groupBy("target").agg(F.max("gap_end").alias("gap_end"))
    return state.join(ends, "target", "left").withColumn("reference", F.greatest("last_success_at", "gap_end"))


def within_handoff_limit(documents: DataFrame, key: str, allowed_publishers: list[str], limit: int = 4) -> DataFrame:
    """Documents of a handoff with ``status``: accepted, foreign publisher, or beyond the limit, in their order."""
    known = F.col("publisher").isin(*allowed_publishers)
    n = F.sum(known.cast("int")).over(Window.partitionBy(key).orderBy("pos"))
    return documents.withColumn("status", F.when(~F.coalesce(known, F.lit(False)), "foreign_publisher").when(n > limit, "beyond_limit").otherwise("accepted"))
