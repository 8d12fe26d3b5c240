"""Pages as tables: links, metadata, announcement calendars, and what metadata beside a page says in its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html
from ..functions.text import let

# The marks of Japanese announcement calendars, and the elements that aren't shown.
DATE = r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(?:(\d{1,2})\s*日|(上旬|中旬|下旬|初旬|末))"
ANNOUNCEMENT = "決算発表"
HIDDEN = ("head", "noscript", "template")
MOST_ROWS, LABEL = 12, 40


def links(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per page and distinct absolute link: ``pos`` and ``label`` of its first anchor.

    An anchor ends at its end tag; one that another anchor or the page's end comes before is none. The label is its texts, tags between them as
    spaces; scripts and styles are no text. Null pages have no links; pages that share a key are one page.
    """
    pieces = F.split(html.marked(F.col(source)), html.ANCHOR, -1)
    anchors = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def anchor(piece: Column) -> Column:
        inside = F.substring_index(piece, html.TEXT, 1)
        body = F.split(F.substring(piece, F.length(inside) + 2, F.length(piece)), f"{html.TAG}/[aA]\\s*{html.TEXT}", 2)
        texts = F.filter(F.split(F.element_at(body, 1), f"{html.TAG}[^{html.TEXT}]*{html.TEXT}", -1), lambda t: t != "")
        label = html.stripped(html.unescaped(F.array_join(texts, " ")))
        return F.struct(F.when(F.size(body) > 1, html.attribute(inside, "href")).alias("href"), label.alias("label"))

    found = F.filter(F.transform(anchors, anchor), lambda a: a["href"].isNotNull())
    rows = pages.select(key, F.col(url).alias("base"), F.posexplode(found).alias("pos", "a"))
    rows = rows.select(key, F.col("pos").cast("long").alias("pos"), html.resolved(F.col("a.href"), F.col("base")).alias("link"), F.col("a.label").alias("label"))
    return rows.filter("link is not null").groupBy(key, "link").agg(F.min("pos").alias("pos"), F.min_by("label", F.struct("pos", "label")).alias("label"))


def title(nodes: Column, raw: bool = False) -> Column:
    """The texts of all title elements, null without any text. ``raw``: one after another as they are, else with spaces between them and cleaned."""
    within = F.filter(nodes, lambda n: n["tag"] == "title")
    texts = F.filter(F.transform(within, lambda n: html.unescaped(n["text"])), lambda t: t != "")
    return F.when(F.size(texts) > 0, F.array_join(texts, "") if raw else html.clean(F.array_join(texts, " ")))


def meta(nodes: Column, raw: bool = False) -> Column:
    """Map of the meta elements, by name or property in lower case; of a repeated name the last content counts. ``raw``: with the white space at their ends."""
    ends = (lambda c: c) if raw else html.stripped
    name = lambda n: F.coalesce(F.nullif(html.attribute(n["inside"], "name"), F.lit("")), html.attribute(n["inside"], "property"))
    tags = F.transform(F.filter(nodes, lambda n: n["tag"] == "meta"), lambda n: F.struct(ends(F.lower(name(n))).alias("key"), ends(html.attribute(n["inside"], "content")).alias("value")))
    whole = F.filter(tags, lambda t: (t["key"] != "") & t["value"].isNotNull())
    last = F.filter(whole, lambda t, i: ~F.array_contains(F.transform(F.slice(whole, i + 2, F.size(whole)), lambda u: u["key"]), t["key"]))
    return F.map_from_entries(last)


def metadata(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """Per page: title and the map of its meta elements. A null page has neither."""
    cut = pages.select(key, html.nodes(F.col(source)).alias("nodes"))
    return cut.select(key, title(F.col("nodes")).alias("title"), meta(F.col("nodes")).alias("meta"))


def segments(source: Column) -> Column:
    """A page's visible texts, one for each text node."""
    return let(html.nodes(source), lambda cut: let(_hidden(cut), lambda hidden: _shown(cut, hidden)))


def _hidden(cut: Column) -> Column:
    """The runs of nodes (from, up to) that lie in elements that aren't shown."""
    ends = F.filter(F.transform(cut, lambda n, i: F.struct(n["tag"].alias("tag"), i.alias("i"))), lambda n: n["tag"].isin(*HIDDEN, *[f"/{t}" for t in HIDDEN]))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("since"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        depth = F.when(~n["tag"].startswith("/"), acc["depth"] + 1).otherwise(F.greatest(acc["depth"] - 1, F.lit(0)))
        closed = (acc["depth"] == 1) & n["tag"].startswith("/")
        hidden = F.concat(acc["out"], F.array(F.struct(acc["since"].alias("a"), n["i"].alias("b"))))
        return F.struct(depth.alias("depth"), F.when(acc["depth"] == 0, n["i"]).otherwise(acc["since"]).alias("since"), F.when(closed, hidden).otherwise(acc["out"]).alias("out"))

    open_end = lambda acc: F.when(acc["depth"] > 0, F.concat(acc["out"], F.array(F.struct(acc["since"].alias("a"), F.lit(2**31 - 1).alias("b"))))).otherwise(acc["out"])
    return F.aggregate(ends, start, step, open_end)


def _shown(cut: Column, hidden: Column) -> Column:
    shown = F.filter(cut, lambda n, i: ~F.exists(hidden, lambda h: (h["a"] <= i) & (i < h["b"])))
    return F.filter(F.transform(shown, lambda n: html.clean(html.unescaped(n["text"]))), lambda t: t != "")


def calendar(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """Per page: ``exact`` and ``approximate`` announcements ('date=label', 'year-month-part=label'), in the page's order, and ``code``.

    A date's label is what follows it in its own text, else the next text, up to the announcement mark; a date without one is none. A page is
    refused whole, its lists null, by ``code``: 'invalid_date' for an announced day that doesn't exist, 'no_announcement', or
    'implausible_rows' beyond ``MOST_ROWS``. Null pages have no announcement.
    """
    texts = pages.select(key, segments(F.coalesce(F.col(source), F.lit(""))).alias("texts"))

    def dates(text: Column, i: Column) -> Column:
        """The dates of a text, each with its label."""
        following = F.coalesce(F.get(F.col("texts"), i + 1), F.lit(""))
        start = F.struct(text.alias("rest"), F.array().cast("array<struct<date:string,label:string>>").alias("out"))

        def step(acc: Column, date: Column) -> Column:
            rest = F.substring(acc["rest"], F.position(date, acc["rest"]) + F.length(date), F.length(acc["rest"]))
            of = F.when(F.trim(rest) != "", F.trim(rest)).otherwise(following)
            label = F.substring(of, F.lit(1), F.position(F.lit(ANNOUNCEMENT), of) + len(ANNOUNCEMENT) - 1)
            one = F.struct(date.alias("date"), F.when(of.contains(ANNOUNCEMENT) & (F.length(label) <= 500), F.substring(label, 1, LABEL)).alias("label"))
            return F.struct(rest.alias("rest"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), start, step, lambda acc: acc["out"])

    def row(d: Column) -> Column:
        year, month, day, part = (F.regexp_extract(d["date"], DATE, i) for i in (1, 2, 3, 4))
        begin = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"))
        date = F.concat(begin, F.lpad(day, 2, "0"))
        return F.struct(F.when(day != "", date.try_cast("date").isNotNull()).alias("real"), F.concat(F.when(day != "", date).otherwise(F.concat(begin, part)), F.lit("="), d["label"]).alias("text"))

    labelled = F.filter(F.flatten(F.transform("texts", dates)), lambda d: d["label"].isNotNull())
    rows = texts.select(key, F.transform(labelled, row).alias("rows"))
    code = (
        F.when(F.exists("rows", lambda r: r["real"] == F.lit(False)), "invalid_date").when(F.size("rows") == 0, "no_announcement")
        .when(F.size("rows") > MOST_ROWS, "implausible_rows")
    )
    found = rows.select(key, "rows", code.alias("code"))
    kind = lambda exact: F.when(F.col("code").isNull(), F.transform(F.filter("rows", lambda r: r["real"].isNotNull() == F.lit(exact)), lambda r: r["text"]))
    return found.select(key, kind(True).alias("exact"), kind(False).alias("approximate"), "code")


ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"


def zoned(text: Column) -> Column:
    """A time with its zone; null for other forms."""
    return F.when(text.rlike(ZONED), text.try_cast("timestamp"))


def is_meaningful(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]") & (F.length(text) <= 500)


def observed(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """What a page says of itself: title, document_id, published_at, replacement_suspected, og_type, and ``code`` where it is refused, the rest then null.

    Codes, the first that applies: 'nul', 'unclosed_title', 'invalid_title', 'invalid_document_id', 'invalid_time', 'no_metadata'. Null pages have no metadata.
    """
    cut = pages.select(key, F.col(source).alias("html"), html.nodes(F.coalesce(F.col(source), F.lit(""))).alias("nodes"))
    told = cut.select(key, F.col("html").contains("\x00").alias("nul"), title(F.col("nodes")).alias("title"), meta(F.col("nodes")).alias("meta"),
        F.try_element_at(F.filter("nodes", lambda n: n["tag"].isin("title", "/title")), F.lit(-1))["tag"].alias("last"))
    first = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("meta", F.lit(n)), F.lit("")) for n in names])
    # The names under which pages give these, in order.
    document = F.nullif(html.clean(first("document_id", "document-id", "citation_doi", "og:id")), F.lit(""))
    time = first("published_at", "article:published_time", "date", "dc.date")
    corrected = F.lower(html.stripped(first("corrected", "updated", "article:modified_time"))).isin("1", "true", "yes", "corrected", "updated")
    rows = told.select(key, "nul", "last", "title", document.alias("document_id"), time.alias("time"), zoned(time).alias("published_at"), F.coalesce(corrected, F.lit(False)).alias("replacement_suspected"), first("og:type").alias("og_type"))
    code = (
        F.when(F.col("nul"), "nul").when(F.col("last") == "title", "unclosed_title").when(~is_meaningful(F.col("title")), "invalid_title")
        .when((F.length("document_id") > 200) | F.col("document_id").rlike(r"[\x00-\x1f\x7f]"), "invalid_document_id").when(F.col("time").isNotNull() & F.col("published_at").isNull(), "invalid_time")
        .when(F.col("title").isNull() & F.col("document_id").isNull() & F.col("published_at").isNull(), "no_metadata")
    )
    return rows.withColumn("code", code).select(key, *[F.when(F.col("code").isNull(), F.col(c)).alias(c) for c in ("title", "document_id", "published_at", "replacement_suspected", "og_type")], "code")


def layered(page: Column, beside: Column, key: str) -> Column:
    """A key's value from the map beside the page where that has the key, even with null, else from the page's map, hyphens for underscores."""
    return F.when(F.map_contains_key(beside, F.lit(key)), F.try_element_at(beside, F.lit(key))).otherwise(F.try_element_at(page, F.lit(key.replace("_", "-"))))


def observed_with_metadata(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", beside: str = "metadata") -> DataFrame:
    """An observation from a page and the map given beside it, whose keys win by being there, null or not.

    An ``error_code`` there makes the row a failure with its detail and retries, all else null. ``code`` tells a time without zone or a length that
    is no integer; such a row is refused too. Without a map the page alone speaks; a null page has no metadata of its own.
    """
    cut = pages.select(key, F.col(url).alias("target_url"), html.nodes(F.coalesce(F.col(source), F.lit(""))).alias("nodes"), F.coalesce(F.col(beside), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("m"))
    cut = cut.select(key, "target_url", "m", title(F.col("nodes"), raw=True).alias("own_title"), meta(F.col("nodes"), raw=True).alias("p"))
    p, m = F.col("p"), F.col("m")
    given, present = lambda k: F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")), lambda k: F.map_contains_key(m, F.lit(k))
    yes = lambda c: F.coalesce(F.lower(html.stripped(c)).isin("1", "true", "yes"), F.lit(False))
    marker = F.coalesce(F.nullif(F.try_element_at(p, F.lit("corrected")), F.lit("")), F.try_element_at(p, F.lit("updated")))
    time, length = layered(p, m, "published_at"), layered(p, m, "content_length")
    whole = html.stripped(length)
    rows = cut.select(
        key, given("error_code").alias("error_code"), F.coalesce(given("error_detail"), F.lit("observation_failed")).alias("detail"), F.coalesce(given("retry_count").try_cast("int"), F.lit(0)).alias("retries"),
        F.coalesce(given("source_url"), F.col("target_url"), F.lit("")).alias("source_url"), F.when(present("title"), F.try_element_at(m, F.lit("title"))).otherwise(F.col("own_title")).alias("title"),
        layered(p, m, "document_id").alias("document_id"), time.alias("time"), zoned(time).alias("published_at"), layered(p, m, "etag").alias("etag"), layered(p, m, "last_modified").alias("last_modified"),
        length.alias("length"), F.when(whole.rlike("^[+-]?[0-9]+$"), whole.try_cast("long")).alias("content_length"), (yes(layered(p, m, "replacement_suspected")) | yes(marker)).alias("replacement_suspected"),
    )
    code = F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(F.col("time").isNotNull() & F.col("published_at").isNull(), "invalid_time").when(F.col("length").isNotNull() & F.col("content_length").isNull(), "invalid_length")
    fine = F.col("code").isNull()
    values = ("source_url", "title", "document_id", "published_at", "etag", "last_modified", "content_length", "replacement_suspected")
    return rows.withColumn("code", code).select(
        key, *[F.when(fine, F.col(c)).alias(c) for c in values], "code", F.when(F.col("error_code").isNotNull(), F.col("detail")).alias("error_detail"), F.when(F.col("error_code").isNotNull(), F.col("retries")).alias("retry_count"),
    )
