"""Column functions on web pages: tags with the text after them, attributes, character references, and references to other pages.

A page is cut into tokens by one pattern without backtracking over groups, so that long pages and broken tags cost linear time. Everything stays in
Spark's functions.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

#: A tag's inside: quotes count only after an equals sign.
_INSIDE = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
TOKEN = (
    rf"(?is)<!--.*?-->|<script(?=[\s/>]){_INSIDE}>.*?(?:</script\s*+>|\z)|<style(?=[\s/>]){_INSIDE}>.*?(?:</style\s*+>|\z)"
    rf"|</?[a-z]{_INSIDE}>|</?[a-z][^>]*+>|<[!?][^>]*+>|[^<]++|<"
)
_ATTRIBUTE = r"([^\s=/>\"']+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
#: White space as Unicode has it.
SPACE = r"[\s\u000b\u001c-\u001f\u0085   -     　]"
# Marks that text can't hold: a tag begins, an anchor begins, the text after a tag begins.
TAG, ANCHOR, TEXT = "\x01", "\x03", "\x02"
# Numeric references from 128 to 159 stand for these characters, as browsers read them.
_C1 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def clean(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def unescaped(text: Column) -> Column:
    """Character references as characters: numeric ones, and the names that HTML 4 has, both with a semicolon. Others stay as they are."""
    names = F.create_map(*[F.lit(x) for name, code in {**name2codepoint, "apos": 39}.items() for x in (name, chr(code))])

    def one(piece: Column) -> Column:
        body = F.regexp_extract(piece, r"^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);", 1)
        hexed = F.when(body.rlike("^#[xX]"), F.substring(body, 3, 8)).otherwise(F.conv(F.substring(body, 2, 9), 10, 16))
        code = F.conv(hexed, 16, 10).cast("long")
        known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.when(known, hexed).otherwise("FFFD"), 8, "0")), "UTF-32")
        char = F.translate(char, "".join(map(chr, range(128, 160))), _C1)
        found = F.when(body.startswith("#"), char).otherwise(F.try_element_at(names, body))
        return F.when(found.isNull() | (body == ""), F.concat(F.lit("&"), piece)).otherwise(F.concat(found, F.substring(piece, F.length(body) + 2, F.length(piece))))

    pieces = F.split(text, "&", -1)
    rest = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), one)
    return F.when(text.contains("&"), F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))).otherwise(text)


def marked(html: Column) -> Column:
    """The page with each tag as mark, inside, mark; comments, scripts and styles as empty tags."""

    def mark(token: Column) -> Column:
        inside = F.substring(token, F.lit(2), F.length(token) - 2)
        return (
            F.when(~token.startswith("<") | (token == "<"), token)
            .when(token.rlike(r"(?i)^<(?:[!?]|script[\s/>]|style[\s/>])"), F.lit(f"{TAG}!{TEXT}"))
            .when(token.rlike(r"(?i)^<a[\s/>]"), F.concat(F.lit(ANCHOR), inside, F.lit(TEXT)))
            .otherwise(F.concat(F.lit(TAG), inside, F.lit(TEXT)))
        )

    return F.array_join(F.transform(F.regexp_extract_all(F.translate(html, TAG + ANCHOR + TEXT, ""), F.lit(TOKEN), F.lit(0)), mark), "")


def nodes(html: Column) -> Column:
    """Array of (tag, inside, text): each tag in lower case, with a slash where it ends one, what its brackets hold, and the text up to the next tag.

    The first node is the text before any tag; its tag is empty.
    """
    pieces = F.split(marked(html), f"[{TAG}{ANCHOR}]", -1)

    def node(piece: Column, i: Column) -> Column:
        inside = F.when(i > 0, F.substring_index(piece, TEXT, 1)).otherwise("")
        return F.struct(
            F.lower(F.regexp_extract(inside, r"^/?[a-zA-Z][^\s/>]*", 0)).alias("tag"), inside.alias("inside"),
            F.when(i > 0, F.substring(piece, F.length(inside) + 2, F.length(piece))).otherwise(piece).alias("text"),
        )

    return F.transform(pieces, node)


def attribute(inside: Column, name: str) -> Column:
    """An attribute's value, whatever the case, order and quotes; null without the attribute or a value. A repeated one's last counts."""
    attributes = F.regexp_replace(inside, r"^[a-zA-Z][^\s/>]*", "")
    names, values = (F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), F.lit(i)) for i in (1, 2))
    found = F.try_element_at(F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda a: F.lower(a["n"]) == name), F.lit(-1))["v"]
    bare = F.when(found.rlike("^[\"']"), F.substring(found, F.lit(2), F.length(found) - 2)).otherwise(found)
    return F.when(found != "", unescaped(bare))


_BASE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _path(segments: Column) -> Column:
    """Segments without dots: one dot goes, two take the one before along."""

    def step(done: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    left = F.aggregate(segments, F.array().cast("array<string>"), step)
    left = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(left, F.array(F.lit("")))).otherwise(left)
    path = F.array_join(left, "/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def resolved(reference: Column, base: Column) -> Column:
    """A reference as an absolute URL, by the rules of RFC 3986 for a base with a host.

    References of another scheme stay as they are; an empty one is the base. Empty segments in the middle of a merged path go. Null for a
    null reference, and for a relative one where the base has no scheme and host.
    """
    ref = F.regexp_replace(F.translate(reference, "\t\r\n", ""), r"^[\u0000- ]+", "")
    part = lambda column, pattern, i: F.regexp_extract(column, pattern, i)
    scheme, own = F.lower(part(base, _BASE, 1)), F.lower(part(ref, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.when(own == "", ref).otherwise(F.substring(ref, F.length(own) + 2, F.length(ref)))
    pieces = r"^(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?"
    authority, path, fragment = part(rest, pieces, 1), part(rest, pieces, 2), part(rest, pieces, 4)
    query, base_path = part(rest, pieces, 3), part(base, _BASE, 3)
    query, fragment = F.when(query == "?", "").otherwise(query), F.when(fragment == "#", "").otherwise(fragment)
    segments = F.split(path, "/", -1)
    parents = F.split(base_path, "/", -1)
    parents = F.when((F.element_at(parents, -1) != "") & (F.size(parents) > 0), F.slice(parents, F.lit(1), F.size(parents) - 1)).otherwise(parents)
    both = F.concat(parents, segments)
    merged = F.filter(both, lambda s, i: (s != "") | (i == 0) | (i == F.size(both) - 1))
    full = (
        F.when(authority != "", F.concat(authority, path, query))
        .when(path == "", F.concat(F.lit("//"), part(base, _BASE, 2), base_path, F.when(query != "", query).otherwise(part(base, _BASE, 4))))
        .when(path.startswith("/"), F.concat(F.lit("//"), part(base, _BASE, 2), _path(segments), query))
        .otherwise(F.concat(F.lit("//"), part(base, _BASE, 2), _path(merged), query))
    )
    return (
        F.when(ref == "", base).when((own != "") & (own != scheme), ref)
        .when(base.rlike(_BASE), F.concat(scheme, F.lit(":"), full, fragment))
    )
