"""Column functions on text: canonical URLs and titles, tokens, polarity, document lines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once a row however often the body, or a function over an array in it, names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment; user info, port, path and query stay. Null for other forms."""
    part = lambda i: F.regexp_extract(url, _URL, i)
    authority = part(2)
    host = F.concat(F.regexp_extract(authority, "^(.*@)?", 0), F.lower(F.regexp_replace(authority, "^.*@", "")))
    return F.when(url.rlike(_URL), F.concat(F.lower(part(1)), F.lit("://"), host, part(3), part(4)))


def request_url(url: Column) -> Column:
    """The form that is asked for: as canonical, without the default port, with at least the path ``/``."""
    base = F.regexp_replace(canonical_url(url), r"^(https://[^/?]*?):443(?=[/?]|$)", "$1")
    return F.regexp_replace(base, r"^([^/?]*//[^/?]*)(?=\?|$)", "$1/")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical_title(title: Column) -> Column:
    return collapsed(nfkc(title))


def url_problem(url: Column, secret_keys: tuple[str, ...] = ("token", "key", "secret", "password")) -> Column:
    """Why a URL mustn't be fetched, null if it may: scheme, user info, port, host, secret."""
    authority = F.regexp_extract(url, _URL, 2)
    host = F.lower(F.regexp_replace(authority, r"^.*@|:\d*$", ""))
    private = host.rlike(r"^(localhost|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|\[.*\]|.*\.local|.*\.internal)$") | (host == "")
    query = F.lower(F.regexp_extract(url, _URL, 4))
    return (
        F.when(url.isNull() | ~url.rlike(_URL), "malformed")
        .when(~F.lower(F.regexp_extract(url, _URL, 1)).eqNullSafe("https"), "not_https")
        .when(authority.contains("@"), "user_info")
        .when(authority.rlike(r":\d+$") & ~authority.endswith(":443"), "port")
        .when(private, "private_host")
        .when(query.rlike("[?&](" + "|".join(secret_keys) + ")="), "secret_in_query")
    )


def classify_document(title: Column, url: Column, kinds: dict[str, tuple[str, ...]], suffix: str = ".pdf") -> Column:
    """The first kind one of whose words the title has, if the URL's path ends as documents do."""
    path = F.lower(F.regexp_extract(url, _URL, 3))
    kind = F.coalesce(*[F.when(F.lower(title).rlike("|".join(words)), F.lit(name)) for name, words in kinds.items()])
    return F.when(path.endswith(suffix), kind)


def tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct Latin words, and runs of two or more kana or CJK characters, in lower case."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z]+|[぀-ヿ㐀-鿿]{2,})"), F.lit(1)), lambda t: F.lower(t))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(s) for s in stop]).cast("array<string>"))


def polarity(text: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """Sign of the number of positive less negative lexicon entries that the text holds."""
    count = lambda words: sum((F.lower(text).contains(w).cast("int") for w in words), F.lit(0))
    return F.signum(count(positive) - count(negative)).cast("int")


def number(cell: Column) -> Column:
    """A figure with thousands separators; a triangle or minus sign makes it negative."""
    bare = F.regexp_replace(F.trim(cell), "[,△▲−-]", "")
    value = bare.try_cast("double")
    return F.when(F.trim(cell).rlike(r"^[△▲−-]?[\d,]+(\.\d+)?$"), F.when(F.trim(cell).rlike("^[△▲−-]"), -value).otherwise(value))
