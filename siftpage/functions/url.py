"""URL columns: key, parts, features, listing test, fallback class, link locality.

Everything is a projection over the URL string. Parts follow the generic URI grammar, because
``parse_url`` raises on malformed input and its HOST loses user info and port.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftpage.functions.numbers import flag
from siftpage.functions.text import strip
from siftpage.functions import vocab

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
PREFIX = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?"


def cleaned_url(url: Column) -> Column:
    return F.regexp_replace(strip(url), "/+$", "")


def url_id(url: Column) -> Column:
    """The identity of a URL: all 64 hex digits of the sha256 of the cleaned URL."""
    return F.sha2(cleaned_url(url), 256)


def url_key(url: Column) -> Column:
    """For display and folder names: host part, blanks and signs as ``_``, cut to 40, plus eight hex digits
    of the sha256. Several URLs may share one; joins go by ``url_id`` or the URL."""
    cleaned = cleaned_url(url)
    host = F.split_part(F.regexp_replace(cleaned, "https?://", ""), F.lit("/"), F.lit(1))
    slug = F.left(F.regexp_replace(host, "[^a-zA-Z0-9]", "_"), F.lit(40))
    return F.concat(slug, F.lit("__"), F.substring(F.sha2(cleaned, 256), 1, 8))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, AUTHORITY, 1)


def url_path(url: Column) -> Column:
    rest = F.regexp_replace(url, PREFIX, "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_parts(url: Column) -> Column:
    """scheme, netloc, path, query, path_parts, params (names only)."""
    path, query = url_path(url), url_query(url)
    return F.struct(
        F.lower(F.regexp_extract(url, SCHEME, 1)).alias("scheme"),
        authority(url).alias("netloc"),
        path.alias("path"),
        query.alias("query"),
        F.filter(F.split(F.lower(path), "/"), lambda p: p != "").alias("path_parts"),
        F.when(query == "", F.array().cast("array<string>"))
        .otherwise(
            F.transform(
                F.split(F.lower(query), "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1))
            )
        )
        .alias("params"),
    )


def _overlap(values: Column, wanted: tuple[str, ...]) -> Column:
    return flag(F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted])))


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(part)) for part in parts])


def url_features(url: Column, parts: Column) -> dict[str, Column]:
    """The 17 URL features. ``parts`` is a column already holding ``url_parts(url)``."""
    path, query = F.lower(parts["path"]), F.lower(parts["query"])
    netloc, pieces, params = F.lower(parts["netloc"]), parts["path_parts"], parts["params"]
    depth = F.size(pieces)
    last = F.coalesce(F.try_element_at(pieces, F.lit(-1)), F.lit(""))
    has_query = flag(query != "")
    return {
        "url_path_depth": depth,
        "url_depth_normalized": F.bround(depth / F.lit(3.0), 4),
        "url_has_any_param": has_query,
        "url_has_query_params": has_query,
        "url_query_param_count": F.size(params),
        "url_has_numeric_id": flag(F.rlike(path, F.lit(r"/\d{3}"))),
        "url_has_long_slug": flag(
            F.exists(pieces, lambda p: F.rlike(p, F.lit("^[a-z]+-[a-z]+-[a-z]")))
        ),
        "url_list_token_match": _overlap(pieces, vocab.URL_LIST_TOKENS),
        "url_detail_token_match": _overlap(pieces, vocab.URL_DETAIL_TOKENS),
        "url_has_extension": flag(F.contains(last, F.lit("."))),
        "url_is_root": flag(path.isin("", "/")),
        "url_has_search_param": _overlap(params, vocab.URL_SEARCH_PARAMS),
        "url_has_filter_param": _overlap(params, vocab.URL_FILTER_PARAMS),
        "url_has_page_param": flag(
            F.array_contains(params, "page") | F.rlike(F.lower(url), F.lit(r"[?&]page=\d"))
        ),
        "is_job_board_domain": flag(_holds(netloc, vocab.URL_JOB_HOSTS)),
        "is_api_doc_domain": flag(_holds(netloc, vocab.URL_API_HOSTS)),
        "has_jobs_in_path": flag(_holds(path, ("jobs", "careers"))),
    }


def listing_url(parts: Column) -> Column:
    """Does the URL itself say search, browse or list? Five tests, any is enough."""
    path, query = F.lower(parts["path"]), F.lower(parts["query"])
    return (
        F.rlike(query, F.lit(vocab.LISTING_SEARCH_QUERY))
        | F.rlike(query, F.lit(vocab.LISTING_FILTER_QUERY))
        | F.rlike(path, F.lit(vocab.LISTING_PATH))
        | F.rlike(path, F.lit(vocab.LISTING_PATH_END))
        | F.rlike(F.lower(parts["netloc"]), F.lit(vocab.LISTING_HOST))
    )


def url_fallback(f: dict[str, Column]) -> Column:
    """Weak class from the URL features alone: struct<label, confidence>."""

    def verdict(label: str, confidence: float) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))

    return (
        F.when(
            (f["url_has_search_param"] == 1) | (f["url_has_page_param"] == 1),
            verdict("list", 0.62),
        )
        .when(f["url_has_filter_param"] == 1, verdict("list", 0.60))
        .when(
            (f["url_has_numeric_id"] == 1) & (f["url_is_root"] == 0), verdict("detail", 0.60)
        )
        .when(f["url_has_long_slug"] == 1, verdict("detail", 0.58))
        .when(f["url_is_root"] == 1, verdict("others", 0.65))
        .otherwise(verdict("others", 0.50))
    )


def with_scheme(url: Column) -> Column:
    has_scheme = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
    return F.when(has_scheme, url).otherwise(F.concat(F.lit("https://"), url))


def is_external_link(href: Column, netloc: Column) -> Column:
    """Feature rule: any authority that is not the page's own, ``//host`` links included."""
    host = authority(href)
    return (host != "") & (host != netloc)


def is_internal_link(href: Column, netloc: Column) -> Column:
    """Snapshot rule: only absolute http links can be external."""
    absolute = F.startswith(href, F.lit("http://")) | F.startswith(href, F.lit("https://"))
    return ~absolute | (authority(href) == netloc)
