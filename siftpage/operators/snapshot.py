"""Page snapshot: title, meta, Open Graph, links, images, forms, headings, schema types, counts.

The snapshot looks at the page as it is: scripts are counted, noscript parts are read. One parsed row
gives one nested record, without a shuffle; the flat tables below explode its arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpage.functions.jsonld import parsed_blocks
from siftpage.functions.text import strip, words
from siftpage.functions.url import authority, is_internal_link, url_id, url_path, url_query
from siftpage.operators.html import exploded, first_of, nodes_of, parse_raw, spaced_text_of, text_of


def _attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def last_wins(pairs: Column) -> Column:
    """array<struct<k,v>> -> map, the last of equal keys kept."""
    placed = F.sort_array(
        F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    )
    # equal keys are neighbours now, the last one at the end
    kept = F.transform(
        F.array(placed),
        lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["k"] != x["k"], F.lit(True))),
    )
    return F.map_from_entries(
        F.transform(F.get(kept, F.lit(0)), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))
    )


def meta_pairs() -> Column:
    def pair(e: Column) -> Column:
        name = F.coalesce(
            _filled(_attr(e, "name")), _filled(_attr(e, "property")), _filled(_attr(e, "itemprop"))
        )
        return F.struct(name.alias("k"), _attr(e, "content").alias("v"))

    return F.filter(
        F.transform(nodes_of("meta"), pair), lambda p: p["k"].isNotNull() & (p["v"] != "")
    )


def open_graph_pairs() -> Column:
    found = F.filter(
        nodes_of("meta"), lambda e: F.startswith(_attr(e, "property"), F.lit("og:"))
    )
    return F.transform(
        found,
        lambda e: F.struct(
            _attr(e, "property").alias("k"), _or_empty(_attr(e, "content")).alias("v")
        ),
    )


def canonical() -> Column:
    found = F.filter(
        nodes_of("link"),
        lambda e: F.array_contains(F.split(_attr(e, "rel"), r"\s+"), "canonical"),
    )
    return F.try_element_at(found, F.lit(1))["attrs"]["href"]


def heading_texts(level: str) -> Column:
    return F.filter(F.transform(nodes_of(level), text_of), lambda t: t != "")


def rel_links() -> Column:
    """Next and previous links; one entry per matching rel word."""

    def of_link(e: Column) -> Column:
        kinds = F.transform(
            F.split(F.lower(_attr(e, "rel")), r"\s+"),
            lambda r: F.when(r == "next", "next").when(r.isin("prev", "previous"), "prev"),
        )
        return F.transform(
            F.filter(kinds, lambda k: k.isNotNull()),
            lambda k: F.struct(k.alias("rel"), _or_empty(_attr(e, "href")).alias("href")),
        )

    rels = F.filter(nodes_of("link"), lambda e: F.map_contains_key(e["attrs"], "rel"))
    return F.flatten(F.transform(rels, of_link))


def page_links() -> Column:
    def entry(e: Column) -> Column:
        href = strip(_attr(e, "href"))
        return F.struct(
            spaced_text_of(e).alias("text"),
            href.alias("href"),
            is_internal_link(href, F.col("domain")).alias("is_internal"),
            F.trim(F.regexp_replace(_or_empty(_attr(e, "rel")), r"\s+", " ")).alias("rel"),
        )

    def wanted(e: Column) -> Column:
        href = strip(_attr(e, "href"))
        return ~href.isin("", "#") & ~F.startswith(href, F.lit("javascript:"))

    return F.transform(F.filter(nodes_of("a"), wanted), entry)


def page_images() -> Column:
    def source(e: Column) -> Column:
        found = F.coalesce(
            _filled(_attr(e, "src")), _filled(_attr(e, "data-src")),
            _filled(_attr(e, "data-lazy-src")), F.lit(""),
        )
        return strip(found)

    def entry(e: Column) -> Column:
        return F.struct(
            source(e).alias("src"),
            strip(_or_empty(_attr(e, "alt"))).alias("alt"),
            *[_or_empty(_attr(e, n)).alias(n) for n in ("width", "height", "loading")],
        )

    return F.transform(F.filter(nodes_of("img"), lambda e: source(e) != ""), entry)


def page_forms() -> Column:
    def field(e: Column) -> Column:
        return F.struct(
            F.coalesce(_attr(e, "type"), e["tag"]).alias("type"),
            _or_empty(_attr(e, "name")).alias("name"),
            _or_empty(_attr(e, "placeholder")).alias("placeholder"),
            F.map_contains_key(e["attrs"], "required").alias("required"),
        )

    def entry(form: Column) -> Column:
        inside = F.filter(
            "fields", lambda e: (e["src"] > form["src"]) & (e["src"] < form["stop"])
        )
        return F.struct(
            _or_empty(_attr(form, "action")).alias("action"),
            F.lower(F.coalesce(_attr(form, "method"), F.lit("get"))).alias("method"),
            F.transform(inside, field).alias("inputs"),
        )

    return F.transform(nodes_of("form"), entry)


def snapshot(pages: DataFrame, at: Column | None = None) -> DataFrame:
    """One nested record per page, page_id first. ``at`` is the time to stamp the record with."""
    base = parse_raw(pages).withColumns(
        {
            "domain": authority(F.col("url")),
            "fields": nodes_of("input", "select", "textarea"),
        }
    )
    parts = base.withColumns(
        {
            "links": page_links(),
            "images": page_images(),
            "forms": page_forms(),
            "rel_links": rel_links(),
            **{h: heading_texts(h) for h in ("h1", "h2", "h3", "h4")},
            "title": _or_empty(text_of(first_of("title"))),
            "meta": last_wins(meta_pairs()),
            "open_graph": last_wins(open_graph_pairs()),
            "canonical": canonical(),
            "scripts": F.size(F.filter("nodes", lambda e: e["tag"] == "script")),
        }
    )
    stamp = at if at is not None else F.lit(None).cast("timestamp")
    has = lambda rel: F.exists("rel_links", lambda r: r["rel"] == rel)
    counts = F.struct(
        F.size("links").alias("links"),
        F.size("images").alias("images"),
        F.size("forms").alias("forms"),
        F.col("scripts"),
        *[F.size(h).alias(h) for h in ("h1", "h2", "h3", "h4")],
        F.length("visible").alias("body_text_chars"),
        F.size(words(F.col("visible"))).alias("body_text_words"),
    )
    return parts.select(
        "page_id",
        "url",
        "title",
        "domain",
        url_path(F.col("url")).alias("path"),
        url_query(F.col("url")).alias("query"),
        stamp.alias("scraped_at"),
        "html_length",
        F.lit("success").alias("status"),
        F.lit(True).alias("rebuilt_from_html"),
        "meta",
        "open_graph",
        "canonical",
        F.struct(
            parsed_blocks(F.col("jsonld")).alias("raw"),
            F.col("jsonld_types").alias("types_found"),
        ).alias("schema_org"),
        counts.alias("counts"),
        F.struct("h1", "h2", "h3", "h4").alias("headings"),
        F.struct(
            has("next").alias("has_next"), has("prev").alias("has_prev"), F.col("rel_links")
        ).alias("pagination"),
        "forms",
        "links",
        "images",
        F.col("visible").alias("body_text"),
    )


def pick_snapshots(folders: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Pages to rebuild: with a URL, and without a snapshot that already lists its links.

    Snapshots are told apart by the identity of their URL. Old ones that carry only the short key stand
    for a page where no other page has that key; pages that share one are rebuilt.
    """
    known = folders.filter(F.coalesce("url", F.lit("")) != "")
    if force:
        return known
    done = stored.filter(F.col("links").isNotNull())
    if "url" in stored.columns:
        named = known.withColumn("_id", url_id(F.col("url")))
        ids = done.select(url_id(F.col("url")).alias("_id")).distinct()
        return named.join(ids, "_id", "left_anti").select(*known.columns)
    owners = known.groupBy("key").agg(F.min("url").alias("_a"), F.max("url").alias("_b"))
    single = owners.filter("_a = _b").join(done.select("key").distinct(), "key", "left_semi").select("key")
    return known.join(single, "key", "left_anti")


# ---- the record as plain columns -------------------------------------------------------------


def _lines(array: str, *fields: str) -> Column:
    """An array of structs as text: a line for each item, its fields parted by bars."""
    item = lambda x: F.concat_ws("|", *(F.coalesce(x[f].cast("string"), F.lit("")) for f in fields))
    return F.array_join(F.transform(array, item), "\n")


def _entries(column: str) -> Column:
    pairs = F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.array_join(pairs, "\n")


def record_table(snapshots: DataFrame) -> DataFrame:
    """The whole record with a column of text for each nested part, for stores without nested types."""
    forms = F.transform(
        "forms",
        lambda f: F.concat_ws(
            "|",
            f["action"],
            f["method"],
            F.array_join(
                F.transform(
                    f["inputs"],
                    lambda i: F.concat_ws(",", i["type"], i["name"], i["placeholder"], i["required"].cast("int").cast("string")),
                ),
                ";",
            ),
        ),
    )
    return snapshots.select(
        "page_id", "url", "title", "domain", "path", "query", "html_length", "status",
        F.col("rebuilt_from_html").cast("int").alias("rebuilt_from_html"),
        _entries("meta").alias("meta"),
        _entries("open_graph").alias("open_graph"),
        "canonical",
        F.array_join(F.transform("schema_org.raw", lambda v: F.to_json(v)), "\n").alias("schema_raw"),
        F.array_join("schema_org.types_found", ",").alias("schema_types"),
        "counts.*",
        *[F.array_join(f"headings.{h}", "\n").alias(f"{h}_texts") for h in ("h1", "h2", "h3", "h4")],
        F.col("pagination.has_next").alias("has_next"),
        F.col("pagination.has_prev").alias("has_prev"),
        _lines("pagination.rel_links", "rel", "href").alias("rel_links"),
        F.array_join(forms, "\n").alias("form_lines"),
        F.md5(_lines("links", "text", "href", "is_internal", "rel")).alias("links_md5"),
        F.md5(_lines("images", "src", "alt", "width", "height", "loading")).alias("images_md5"),
        F.md5("body_text").alias("body_md5"),
    )


# ---- flat tables ----------------------------------------------------------------------------


def _flat(snapshots: DataFrame, array: str) -> DataFrame:
    rows = exploded(snapshots.select("page_id", F.col(array).alias("items")), "items", "pos", "i")
    return rows.select("page_id", "pos", "i.*")


def links_table(snapshots: DataFrame) -> DataFrame:
    return _flat(snapshots, "links")


def images_table(snapshots: DataFrame) -> DataFrame:
    return _flat(snapshots, "images")


def forms_table(snapshots: DataFrame) -> DataFrame:
    """One row per form field, forms without fields kept with nulls."""
    rows = exploded(snapshots.select("page_id", "forms"), "forms", "form", "f")
    return rows.select(
        "page_id", "form", "f.action", "f.method", F.posexplode_outer("f.inputs").alias("pos", "i")
    ).select("page_id", "form", "action", "method", "pos", "i.*")


def headings_table(snapshots: DataFrame) -> DataFrame:

    def entries(level: str) -> Column:
        return F.transform(
            f"headings.{level}",
            lambda text, i: F.struct(
                F.lit(level).alias("level"), i.alias("pos"), text.alias("text")
            ),
        )

    listed = F.flatten(F.array(*[entries(h) for h in ("h1", "h2", "h3", "h4")]))
    rows = snapshots.select("page_id", listed.alias("items"))
    return exploded(rows, "items", "n", "i").select("page_id", "i.*")


def map_table(snapshots: DataFrame, column: str) -> DataFrame:
    """(page_id, key, value) of ``meta`` or ``open_graph``."""
    rows = snapshots.select("page_id", F.map_entries(column).alias("items"))
    return exploded(rows, "items", "n", "i").select("page_id", "i.key", "i.value")


def schema_types_table(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.select("page_id", F.col("schema_org.types_found").alias("items"))
    return exploded(rows, "items", "pos", "type")
