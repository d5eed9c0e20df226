"""Feature columns read from the element list of a parsed page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftpage.functions import vocab
from siftpage.functions.numbers import flag, log_count, ratio
from siftpage.functions.reuse import built_once
from siftpage.functions.text import strip
from siftpage.functions.url import is_external_link
from siftpage.operators.html import attr, first_of, has_attr, nodes_of, spaced_text_of, text_of

SEPARATOR = " \x01 "


@built_once
def subsets() -> dict[str, Column]:
    """Small arrays and strings cut from ``nodes`` once, for all later tests.

    Class and id values are joined to one string per page with a separator no pattern can cross, so
    that "does any class match" is a single regular expression outside of any lambda.
    """
    anchors = F.filter("nodes", lambda e: (e["tag"] == "a") & has_attr(e, "href"))
    classed = F.transform(
        F.filter("nodes", lambda e: has_attr(e, "class")), lambda e: attr(e, "class")
    )

    def line(name: str) -> Column:
        values = F.transform(
            F.filter("nodes", lambda e: has_attr(e, name)), lambda e: attr(e, name)
        )
        return F.array_join(values, SEPARATOR)

    return {
        "anchors": F.transform(
            anchors,
            lambda e: F.struct(
                e["src"].alias("src"),
                attr(e, "href").alias("href"),
                F.lower(text_of(e)).alias("text"),
            ),
        ),
        "classes": classed,
        "class_line": F.array_join(classed, SEPARATOR),
        "id_line": line("id"),
        "label_line": line("aria-label"),
        "metas": F.transform(nodes_of("meta"), lambda e: e["attrs"]),
        "links": F.transform(nodes_of("link"), lambda e: e["attrs"]),
        "inputs": F.transform(nodes_of("input"), lambda e: e["attrs"]),
        "images": F.transform(nodes_of("img"), lambda e: e["attrs"]),
        "nav": first_of("nav"),
        "tags": F.col("nodes.tag"),
        "tag_line": F.concat(F.lit(" "), F.array_join("nodes.tag", "  "), F.lit(" ")),
    }


def tag_count(tag: str) -> Column:
    """Elements of one kind, counted in the line of all tag names: some 35 counts without a lambda."""
    gone = f"length(tag_line) - length(replace(tag_line, ' {tag} ', ''))"
    return F.expr(f"int(({gone}) / {len(tag) + 2})")


def any_class(pattern: str) -> Column:
    return F.rlike("class_line", F.lit(f"(?iU){pattern}"))


def any_id(pattern: str) -> Column:
    return F.rlike("id_line", F.lit(f"(?iU){pattern}"))


def count_class(pattern: str) -> Column:
    return F.size(F.filter("classes", lambda c: F.rlike(c, F.lit(f"(?iU){pattern}"))))


def first_meta(key: str, value: str) -> Column:
    """Lower-cased content of the first meta whose ``key`` attribute is ``value``; '' without one."""
    found = F.try_element_at(F.filter("metas", lambda m: m[key] == value), F.lit(1))
    return F.coalesce(F.lower(found["content"]), F.lit(""))


def rel_tokens(link: Column) -> Column:
    return F.split(F.lower(link["rel"]), r"\s+")


def any_link(test) -> Column:
    return flag(F.exists("links", test))


def repeated_containers(tags: tuple[str, ...], field: str, least: int) -> Column:
    """Containers with at least ``least`` children of one kind."""
    return F.size(F.filter(nodes_of(*tags), lambda e: e[field] >= least))


def feed_link() -> Column:
    def test(link: Column) -> Column:
        kind = F.lower(link["type"])
        return F.array_contains(rel_tokens(link), "alternate") & (
            F.contains(kind, F.lit("rss")) | F.contains(kind, F.lit("atom"))
        )

    return any_link(test)


def has_time() -> Column:
    return flag(
        F.array_contains("tags", "time") | F.exists("nodes", lambda e: has_attr(e, "datetime"))
    )


@built_once
def counts() -> dict[str, Column]:
    """First stage: counts and flags that need nothing but the subsets."""
    out: dict[str, Column] = {f"tag_{t}_count": tag_count(t) for t in vocab.COUNTED_TAGS}
    in_body = F.filter("nodes", lambda e: e["depth"] >= 0)
    depth_sum = F.aggregate(
        in_body, F.lit(0).cast("bigint"), lambda total, e: total + e["depth"].cast("bigint")
    )
    nav_hrefs = F.transform(
        F.filter(
            "anchors",
            lambda a: (a["src"] > F.col("nav.src")) & (a["src"] < F.col("nav.stop")),
        ),
        lambda a: a["href"],
    )
    rich = F.transform(
        F.filter("nodes", lambda e: (e["tag"] == "p") & (e["len"] > 40)), lambda e: e["len"]
    )
    root = F.coalesce(first_of("main"), first_of("body"))
    blocks = F.filter(
        "nodes",
        lambda e: (e["parent"] == F.col("root.eid"))
        & e["tag"].isin("section", "div", "article")
        & (e["len"] > 50),
    )
    crumb = F.coalesce(
        F.try_element_at(
            F.filter("nodes", lambda e: F.rlike(attr(e, "class"), F.lit("(?iU)breadcrumb"))),
            F.lit(1),
        ),
        F.try_element_at(
            F.filter("nodes", lambda e: F.rlike(attr(e, "aria-label"), F.lit("(?iU)breadcrumb"))),
            F.lit(1),
        ),
    )
    netloc = F.col("parts.netloc")
    out |= {
        "x_body": F.size(in_body),
        "x_depth_sum": depth_sum,
        "dom_max_depth": F.coalesce(
            F.array_max(F.transform(in_body, lambda e: e["depth"])), F.lit(0)
        ),
        "x_grid": count_class(vocab.GRID_CLASS),
        "x_rule_grid": count_class(vocab.RULE_GRID_CLASS),
        "x_cards": count_class(vocab.CARD_CLASS),
        "x_siblings": repeated_containers(vocab.SIBLING_CONTAINERS, "same_kids", 4),
        "x_repeated": repeated_containers(vocab.SIBLING_CONTAINERS, "same_kids", 4),
        "x_rule_repeated": repeated_containers(vocab.SIBLING_CONTAINERS, "same_kids", 5),
        "x_article_groups": repeated_containers(("ul", "div", "section"), "article_kids", 4),
        "total_links": F.size("anchors"),
        "external_links": F.size(
            F.filter("anchors", lambda a: is_external_link(a["href"], netloc))
        ),
        "x_nav_hrefs": nav_hrefs,
        "x_anchor_kinds": F.size(
            F.array_distinct(
                F.filter(F.transform("anchors", lambda a: a["text"]), lambda t: t != "")
            )
        ),
        "internal_anchor_links": F.size(
            F.filter("anchors", lambda a: F.startswith(a["href"], F.lit("#")))
        ),
        "x_rich": rich,
        "root": root,
        "x_blocks": blocks,
        "deep_content_blocks": F.size(
            F.filter(nodes_of("article", "main", "section"), lambda e: e["len"] > 200)
        ),
        "x_longest": F.array_max(
            F.transform(nodes_of("div", "article", "section", "main"), lambda e: e["len"])
        ),
        "x_content_blocks": F.size(nodes_of("article", "section", "main")),
        "image_count": F.size("images"),
        "images_with_alt": F.size(F.filter("images", lambda m: strip(m["alt"]) != "")),
        "gallery_image_count": F.size(
            F.filter(
                "images",
                lambda m: F.rlike(
                    F.concat_ws("] ", m["class"], m["id"]), F.lit(f"(?iU){vocab.GALLERY_CLASS}")
                ),
            )
        ),
        "has_video": flag(F.array_contains("tags", "video") | F.array_contains("tags", "iframe")),
        "figure_count": tag_count("figure"),
        "figcaption_count": tag_count("figcaption"),
        "x_paging_markup": any_class("pag(e|ination)")
        | F.rlike("label_line", F.lit("(?i)pagination")),
        "x_rule_paging_markup": any_class(r"\bpaginat")
        | F.rlike("label_line", F.lit("(?i)pagination")),
        "x_filter_markup": any_class(vocab.FILTER_CLASS) | any_id(vocab.FILTER_CLASS),
        "x_rule_filter_markup": any_class(r"\b(filter|facet|refine)\b")
        | any_id(r"\b(filter|facet)\b"),
        "page_number_links": F.size(
            F.filter("anchors", lambda a: F.rlike(a["href"], F.lit(r"(?i)[?&]page=\d")))
        ),
        "has_compare_checkboxes": flag(
            F.size(F.filter("inputs", lambda m: m["type"] == "checkbox")) >= 3
        ),
        "crumb": crumb,
        "x_time": has_time(),
        "x_toc_markup": any_class(vocab.TOC_PATTERN) | any_id(vocab.TOC_PATTERN),
        "x_spec_markup": any_class(vocab.SPEC_CLASS),
        "has_hero_section": flag(any_class(vocab.HERO_CLASS) | any_id(vocab.HERO_CLASS)),
        "og_type": first_meta("property", "og:type"),
        "card_type": first_meta("name", "twitter:card"),
        "x_robots": first_meta("name", "robots"),
        "x_duration_markup": F.exists(
            "metas",
            lambda m: m["property"].isin("video:duration", "music:duration")
            | (m["itemprop"] == "duration"),
        ),
        "form_count": tag_count("form"),
        "has_search_form": flag(
            F.exists(
                "inputs",
                lambda m: (m["type"] == "search")
                | F.rlike(m["placeholder"], F.lit("(?i)search")),
            )
        ),
        "has_login_form": flag(F.exists("inputs", lambda m: m["type"] == "password")),
        "button_count": tag_count("button"),
        "select_count": tag_count("select"),
        "range_input_count": F.size(F.filter("inputs", lambda m: m["type"] == "range")),
        "has_tabs": flag(
            F.exists("nodes", lambda e: attr(e, "role") == "tablist") | any_class(r"\btab\b")
        ),
        "has_microdata": flag(F.exists("nodes", lambda e: has_attr(e, "itemtype"))),
        "has_canonical": flag(
            F.exists(
                "links", lambda m: F.array_contains(F.split(m["rel"], r"\s+"), "canonical")
            )
        ),
        "page_lang_is_english": flag(
            F.startswith(F.lower(first_of("html")["attrs"]["lang"]), F.lit("en"))
        ),
        "rel_has_next": any_link(lambda m: F.array_contains(rel_tokens(m), "next")),
        "rel_has_prev": any_link(
            lambda m: F.array_contains(rel_tokens(m), "prev")
            | F.array_contains(rel_tokens(m), "previous")
        ),
        "has_rss_feed": feed_link(),
        "x_h1_text": F.coalesce(F.lower(text_of(first_of("h1"))), F.lit("")),
        "x_li_texts": F.filter(
            F.transform(nodes_of("li"), lambda e: F.lower(text_of(e))),
            lambda t: t != "",
        ),
        "x_footer_text": F.lower(
            F.concat(
                F.coalesce(spaced_text_of(first_of("footer")), F.lit("")),
                F.coalesce(F.concat(F.lit(" "), spaced_text_of(F.col("nav"))), F.lit("")),
            )
        ),
    }
    return out


@built_once
def derived() -> dict[str, Column]:
    """Second stage: features computed from the counts."""
    c = F.col
    tag_sum = sum((c(f"tag_{t}_count") for t in vocab.COUNTED_TAGS), F.lit(0))
    links = c("total_links")
    rich = F.size("x_rich")
    rich_sum = F.aggregate("x_rich", F.lit(0).cast("bigint"), lambda s, n: s + n.cast("bigint"))
    # each navigation target comes just before the anchors with the same one
    merged = F.sort_array(
        F.concat(
            F.transform(
                F.array_distinct("x_nav_hrefs"), lambda h: F.struct(h.alias("h"), F.lit(0).alias("k"))
            ),
            F.transform("anchors", lambda a: F.struct(a["href"].alias("h"), F.lit(1).alias("k"))),
        )
    )
    nothing = F.struct(F.lit(None).cast("string").alias("h"), F.lit(0).alias("n"))
    nav_links = F.aggregate(
        merged,
        nothing,
        lambda s, x: F.struct(
            F.when(x["k"] == 0, x["h"]).otherwise(s["h"]).alias("h"),
            (
                s["n"]
                + F.coalesce((x["k"] == 1) & (x["h"] == s["h"]), F.lit(False)).cast("int")
            ).alias("n"),
        ),
        lambda s: s["n"],
    )
    crumbs = F.size(
        F.filter(
            "nodes",
            lambda e: e["tag"].isin("li", "span", "a")
            & (e["src"] > c("crumb.src"))
            & (e["src"] < c("crumb.stop")),
        )
    )
    chars = F.greatest(c("char_count"), F.lit(1))
    word_floor = F.greatest(c("word_count"), F.lit(1))
    items = F.size("x_li_texts")
    kinds = F.size(F.array_distinct("x_li_texts"))
    out = {
        "li_density": ratio(c("tag_li_count"), F.greatest(tag_sum, F.lit(1))),
        "article_section_ratio": ratio(c("tag_article_count"), c("tag_section_count") + 1),
        "dom_nesting_avg": F.when(
            c("x_body") > 0, F.bround(c("x_depth_sum") / c("x_body"), 4)
        ).otherwise(F.lit(0.0)),
        "has_data_table": flag((c("tag_table_count") > 0) & (c("tag_td_count") > 6)),
        "grid_class_count": c("x_grid"),
        "has_grid_layout": flag(c("x_grid") >= 3),
        "sibling_repeat_count": c("x_siblings"),
        "log_total_links": log_count(links),
        "internal_links": links - c("external_links"),
        "nav_links": F.greatest(nav_links, F.lit(0)),
        "external_link_ratio": ratio(c("external_links"), links),
        "anchor_text_diversity": ratio(c("x_anchor_kinds"), F.greatest(links, F.lit(1))),
        "link_to_word_ratio": ratio(links, word_floor),
        "has_internal_anchors": flag(c("internal_anchor_links") >= 3),
        "heading_hierarchy_score": c("tag_h1_count") * 4
        + c("tag_h2_count") * 3
        + c("tag_h3_count") * 2
        + c("tag_h4_count"),
        "single_h1": flag(c("tag_h1_count") == 1),
        "rich_paragraph_count": rich,
        "log_rich_paragraph_count": log_count(rich),
        "avg_paragraph_length": F.when(rich > 0, F.bround(rich_sum / rich, 2)).otherwise(
            F.lit(0.0)
        ),
        "has_main_content_element": flag(c("tag_main_count") > 0),
        "has_article_element": flag(c("tag_article_count") > 0),
        "content_block_count": F.greatest(F.size("x_blocks"), F.lit(0)),
        "text_concentration_ratio": F.coalesce(ratio(c("x_longest"), chars), F.lit(0.0)),
        "content_density": ratio(c("char_count"), F.greatest(c("clean_len"), F.lit(1))),
        "log_image_count": log_count(c("image_count")),
        "alt_text_ratio": ratio(c("images_with_alt"), F.greatest(c("image_count"), F.lit(1))),
        "has_image_gallery": flag(c("gallery_image_count") >= 3),
        "media_density": ratio(
            c("image_count") + c("has_video"), F.greatest(c("x_content_blocks"), F.lit(1))
        ),
        "has_page_param_links": flag(c("page_number_links") >= 2),
        "repeated_sibling_containers": c("x_repeated"),
        "has_repeated_blocks": flag(c("x_repeated") >= 2),
        "card_count": c("x_cards"),
        "has_card_elements": flag(c("x_cards") >= 3),
        "links_per_1k_words": ratio(links * 1000, word_floor),
        "breadcrumb_depth": F.when(c("crumb").isNotNull(), crumbs).otherwise(F.lit(0)),
        "og_type_is_video": flag(F.contains(c("og_type"), F.lit("video"))),
        "og_type_is_article": flag(F.contains(c("og_type"), F.lit("article"))),
        "og_type_is_product": flag(F.contains(c("og_type"), F.lit("product"))),
        "og_type_is_website": flag(c("og_type").isin(*vocab.OG_PLAIN)),
        "has_twitter_player": flag(F.contains(c("card_type"), F.lit("player"))),
        "has_twitter_summary_large": flag(F.contains(c("card_type"), F.lit("summary_large"))),
        "robots_noindex": flag(F.contains(c("x_robots"), F.lit("noindex"))),
        "li_text_diversity": F.when(items > 4, F.bround(kinds / items, 4)).otherwise(F.lit(0.0)),
        "low_variation_li": flag((items > 4) & (kinds / items < 0.4)),
        "article_sibling_containers": c("x_article_groups"),
        "has_article_grid": flag(c("x_article_groups") >= 1),
    }
    for level in ("h1", "h2", "h3", "h4"):
        out[f"{level}_count"] = c(f"tag_{level}_count")
    prefixes = vocab.OG_CONTENT_PREFIXES
    starts = F.startswith(c("og_type"), F.lit(prefixes[0]))
    for prefix in prefixes[1:]:
        starts = starts | F.startswith(c("og_type"), F.lit(prefix))
    out["og_numeric"] = (
        F.when(starts, 2).when(c("og_type").isin(*vocab.OG_PLAIN), 1).otherwise(0)
    )
    return out
