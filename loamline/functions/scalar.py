"""Scalar functions of retrieval and indexing, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of trust labels; any other label counts 1.
TRUST = {"gov": 1.0, "government": 1.0, "implementing_agency": 0.95, "agency": 0.95, "ngo": 0.8, "news": 0.6}
# Query parameters that only track.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; there is no built-in, so this is an Arrow UDF. ASCII texts pass as they are."""

    @F.pandas_udf("string")
    def composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")

    return composed(text)


def squeeze(text: Column) -> Column:
    """Each run of white space (Unicode) becomes one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def canonical_text(text: Column, compose: bool = True) -> Column:
    return squeeze(nfkc(text) if compose else text)


def text_key(text: Column, compose: bool = True) -> Column:
    """Digest by which passages count as the same text; empty for null and empty texts."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", "").otherwise(F.sha2(squeeze(F.lower(nfkc(text) if compose else text)), 256))


def similarity(distance: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(1.0), F.lit(1.0) + distance.cast("double")), F.lit(0.0))


def trust_weight(level: Column, fallback: Column) -> Column:
    """level, or where that is null or empty, fallback."""
    label = F.lower(F.coalesce(F.nullif(level, F.lit("")), fallback, F.lit("")))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TRUST.items() for x in kv))[label], F.lit(1.0))


def l2_distance(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def html_region(start: Column, end: Column, total: Column) -> Column:
    """Part of a document that the middle of a token range falls in."""
    at = F.try_divide((start + end) / 2.0, total)
    return F.when(total <= 0, "unknown").when(at < 0.10, "intro").when(at < 0.30, "early").when(at < 0.75, "middle").when(at < 0.95, "late").otherwise("footer")


def pdf_region(before: Column, tokens: Column, total: Column, page: Column, last_page: Column) -> Column:
    at = F.try_divide(before + tokens / 2.0, total)
    by_page = F.when(page == 1, "intro").when(page == last_page, "footer").otherwise("middle")
    return F.when(total <= 0, by_page).when(at < 0.10, "intro").when(at < 0.30, "early").when(at < 0.70, "middle").when(at < 0.90, "late").otherwise("footer")


def sentences(text: Column) -> Column:
    """Sentences of a canonical text, each with its end marks."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?s).+?[.?!\n]+|.+?$"), F.lit(0)), lambda s: F.trim(s))
    return F.filter(found, lambda s: s != "")


def reflow(text: Column) -> Column:
    """Text lifted from page layout: control characters and line ends become spaces, runs of space one space."""
    return squeeze(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " "))


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@|:\d*$", ""))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, default scheme http and path /, sorted parameters without tracking ones, no fragment, one trailing slash less."""
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    netloc = F.lower(F.regexp_extract(rest, "^//([^/?]*)", 1))
    path = F.regexp_extract(F.regexp_replace(rest, "^//[^/?]*", ""), "^([^?;]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, "=(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~(p["k"].startswith("utm_") | p["k"].isin(*TRACKING)))
    params = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    whole = F.concat(F.coalesce(F.nullif(scheme, F.lit("")), F.lit("http")), F.lit("://"), netloc, F.coalesce(F.nullif(path, F.lit("")), F.lit("/")), F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))
    return F.regexp_replace(whole, "/$", "")


def url_name(url: Column) -> Column:
    """The last part of a URL's path."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), "([^/]*)/*$", 1)


def extension(url: Column, content_type: Column) -> Column:
    name = F.lower(url_name(url))
    kind = F.lower(F.trim(F.regexp_extract(content_type, "^([^;]*)", 1)))
    by_type = F.when(kind == "application/pdf", "pdf").when(kind.contains("word"), "doc").when(kind.startswith("text/html"), "html").when(kind.contains("json"), "json").when(kind.startswith("image/"), F.regexp_extract(kind, "/(.*)$", 1))
    return F.when(name.contains("."), F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise(F.coalesce(by_type, F.lit("bin")))


def safe_name(url: Column, ext: Column) -> Column:
    name = F.coalesce(F.nullif(url_name(url), F.lit("")), F.concat(F.lit("response."), ext))
    return F.substring(F.regexp_replace(name, r"(?U)[^\p{L}\p{N}_.-]", ""), 1, 240)


def bare_etag(etag: Column) -> Column:
    """Without the quotes around it; null if empty."""
    return F.regexp_replace(F.trim(F.nullif(etag, F.lit(""))), '^"(.*)"$', "$1")


def comparable_etag(etag: Column) -> Column:
    """Without weak mark, quotes and 0x, in lower case."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(etag, F.lit(""))), "^W/", ""), '"', "")), "^0x", "")


def base64_hex(x: Column) -> Column:
    return F.lower(F.hex(F.try_to_binary(x, F.lit("base64"))))


def https_source(url: Column) -> Column:
    """s3://bucket/key as an https address; anything else as it is."""
    return F.regexp_replace(url, r"^s3://([^/]*)/?(.*)$", "https://$1.s3.amazonaws.com/$2")


def source_label(url: Column) -> Column:
    """The host of an http address, another source as it is, null for none."""
    return F.when(url.startswith("http") & (F.size(F.split(url, "/")) > 2), F.element_at(F.split(url, "/"), 3)).otherwise(F.nullif(url, F.lit("")))


def padded(n: Column) -> Column:
    return F.format_string("%04d", n)


def safe_rel(path: Column) -> Column:
    """A relative path: slashes only, none in front."""
    return F.regexp_replace(F.regexp_replace(path, r"\\\\", "/"), "^/+", "")


def remote_path(bucket: Column, prefix: Column, rel: Column) -> Column:
    inner = F.regexp_replace(prefix, "^/+|/+$", "")
    return F.concat_ws("/", bucket, F.nullif(inner, F.lit("")), safe_rel(rel))


def token_count(text: Column) -> Column:
    """Words of a text between white space (Unicode)."""
    return F.size(F.filter(F.split(squeeze(text), " "), lambda w: w != ""))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, or else Latin-1."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))
