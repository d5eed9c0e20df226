"""Scores and signals that combine features of several pillars.

The composite scores are fixed before the later pillars exist, so the terms that would read a later
pillar (long link lists, browse, academic and job vocabulary, article grids, many years) are zero
there and are left out here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftpage.functions import vocab
from siftpage.functions.jsonld import lowered, top_types
from siftpage.functions.numbers import flag, ratio
from siftpage.functions.reuse import built_once
from siftpage.functions.text import count_words, has_text, occurrences, words
from siftpage.operators.features.wording import either

LISTING_WEIGHTS = {
    "has_pagination": 3, "has_filter_ui": 2, "has_result_count": 2, "has_repeated_blocks": 1.5,
    "grid_class_count": 0.04, "url_list_token_match": 1, "has_schema_list_type": 3,
    "list_cue_word_hits": 0.3, "url_has_filter_param": 1, "url_has_page_param": 1,
    "title_has_list_cue": 1, "anchor_text_diversity": 1.5, "sibling_repeat_count": 0.1,
}
DETAIL_WEIGHTS = {
    "has_buy_cta": 3, "has_price": 2, "has_author": 2, "has_publish_date": 2, "has_toc": 2,
    "single_h1": 2, "has_spec_section": 2, "has_rating": 1, "url_detail_token_match": 1,
    "has_schema_detail_type": 3, "detail_cue_word_hits": 0.3, "url_has_numeric_id": 1,
    "url_has_long_slug": 1, "has_share_buttons": 1, "has_comments_section": 1,
    "og_type_is_video": 4, "has_twitter_player": 3, "has_duration_meta": 2,
    "url_signals_single_item": 2, "has_engagement_metrics": 1,
}


def path_matches(pattern: str) -> Column:
    return F.rlike("path", F.lit(pattern))


@built_once
def mixed() -> dict[str, Column]:
    """Flags fed by both markup and text, and the schema types."""
    c = F.col
    trimmed = F.regexp_replace("path", "^/+|/+$", "")
    flat = lowered(top_types(c("jsonld")))
    deep = lowered(c("jsonld_types"))

    def known(types: Column, wanted: tuple[str, ...]) -> Column:
        return F.arrays_overlap(types, F.array(*[F.lit(t) for t in wanted]))

    hinted = vocab.HINT_LIST_TYPES + vocab.HINT_DETAIL_TYPES
    hint = F.try_element_at(F.filter(deep, lambda t: t.isin(*hinted)), F.lit(1))
    return {
        "content_links": F.greatest(F.lit(0), c("internal_links") - c("nav_links")),
        "text_to_html_ratio": c("content_density"),
        "has_pagination": flag(c("x_paging_text") | F.coalesce(c("x_paging_markup"), F.lit(False))),
        "has_filter_ui": flag(c("x_filter_text") | F.coalesce(c("x_filter_markup"), F.lit(False))),
        "has_breadcrumb": flag(c("breadcrumb_depth") > 0),
        "has_publish_date": flag(c("x_date_text") | (c("x_time") == 1)),
        "has_toc": flag(c("x_toc_text") | c("x_toc_markup")),
        "has_spec_section": flag(c("x_spec_text") | c("x_spec_markup")),
        "has_duration_meta": flag(
            c("x_duration_text") | F.coalesce(c("x_duration_markup"), F.lit(False))
        ),
        "url_signals_single_item": flag(
            F.rlike("url", F.lit(f"(?i){vocab.SINGLE_ITEM_URL}"))
        ),
        "has_schema_list_type": flag(known(flat, vocab.LIST_TYPES)),
        "has_schema_detail_type": flag(known(flat, vocab.DETAIL_TYPES)),
        "schema_type_count": F.size(flat),
        "pre_hint_schema": F.when(hint.isin(*vocab.HINT_LIST_TYPES), 1)
        .when(hint.isNotNull(), 2)
        .otherwise(0),
        "is_root_url": flag(
            trimmed.isin(*vocab.ROOT_PATHS)
            | F.rlike(trimmed, F.lit(r"^[a-z]{2}(-[a-z]{2})?/?$"))
        ),
        "others_path_signal": flag(
            F.rlike(F.concat(F.lit("/"), trimmed, F.lit("/")), F.lit(vocab.OTHERS_PATH))
        ),
        "is_browse_path": flag(path_matches(vocab.BROWSE_PATH)),
        "is_academic_domain": flag(F.rlike("netloc", F.lit(vocab.ACADEMIC_HOST))),
        "has_search_in_path": flag(path_matches(r"/(search|results?|find)/")),
        "has_type_query_param": flag(has_text("query", ("type=", "category="))),
        "article_byline_signal": flag(
            c("x_byline") & (c("x_year_text") | (c("x_time") == 1))
        ),
        "x_footer_others": count_words("x_footer_spaced", vocab.FOOTER_FLAGS),
        "x_entity": _entity_repetition(),
        "job_posting_signals": c("x_job_text")
        + flag(path_matches("/(job|jobs|vacancy|vacancies|career|careers)/")),
        "forum_thread_signals": c("x_forum_text")
        + flag(path_matches("/(thread|topic|discussion)/[a-z0-9-]")),
    }


def _entity_repetition() -> Column:
    """How often the first h1 comes back in the text: as a phrase, or as a word if it is one word."""
    name = F.col("x_h1_text")
    name_words = F.size(words(name))
    single = F.size(F.filter("words", lambda w: w == name))
    return (
        F.when((F.length(name) <= 3) | (name_words == 0), F.lit(0))
        .when(name_words >= 2, occurrences(F.col("lower"), name))
        .otherwise(single)
    )


def _weighted(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = out + F.col(name) * F.lit(float(weight))
    return out


@built_once
def scores() -> dict[str, Column]:
    c = F.col
    para = c("avg_paragraph_length")
    steps = (
        F.when(para > 200, 2).when(para > 100, 1).otherwise(0)
        + flag(c("reading_time_estimate") > 3)
        + flag(c("unique_word_ratio") > 0.5)
    )
    return {
        "composite_listing_score": F.bround(_weighted(LISTING_WEIGHTS), 4),
        "composite_detail_score": F.bround(_weighted(DETAIL_WEIGHTS) + steps, 4),
        "url_bias_corrected_listing": flag(
            (
                (c("url_list_token_match") == 1)
                | (c("url_has_search_param") == 1)
                | (c("url_has_page_param") == 1)
            )
            & (
                (c("has_repeated_blocks") == 1)
                | (c("has_result_count") == 1)
                | (c("anchor_text_diversity") > 0.6)
            )
        ),
        "single_entity_strong": flag(
            (c("h1_count") == 1)
            & (c("word_count") > 150)
            & (para > 80)
            & (c("rich_paragraph_count") >= 2)
            & (c("repeated_sibling_containers") < 8)
        ),
        "single_entity_weak": flag(
            (c("h1_count") == 1)
            & (c("word_count") > 80)
            & (c("repeated_sibling_containers") < 12)
        ),
        "entity_name_repetition": c("x_entity"),
        "entity_is_repeated": flag(c("x_entity") >= 3),
        "struct_list_score": c("has_repeated_blocks")
        + c("has_pagination")
        + c("has_filter_ui")
        + flag(c("grid_class_count") >= 4),
        "content_list_score": c("has_result_count")
        + flag(c("anchor_text_diversity") > 0.75)
        + flag(c("link_to_word_ratio") > 0.20)
        + c("title_has_list_cue")
        + flag(c("list_cue_word_hits") >= 3),
        "x_struct_detail": flag(c("dom_max_depth") > 8)
        + c("has_article_element")
        + c("has_data_table")
        + flag(c("deep_content_blocks") >= 2),
        "x_content_detail": flag(para > 150)
        + flag(c("rich_paragraph_count") >= 4)
        + c("has_author")
        + c("has_publish_date")
        + c("has_buy_cta")
        + flag(c("detail_cue_word_hits") >= 3),
        "numeric_id_with_single_h1": flag(
            (c("url_has_numeric_id") == 1) & (c("h1_count") == 1)
        ),
        "pre_hint_has_schema": flag(c("pre_hint_schema") > 0),
        "article_in_product_site": flag(
            (c("has_author") == 1)
            & (c("rich_paragraph_count") >= 3)
            & (para > 100)
            & (c("form_count") >= 1)
        ),
        "landing_page_score": F.bround(
            c("cta_signal_count") * 0.5
            + c("has_hero_section") * 1.5
            + c("has_pricing_section") * 1.0
            + c("has_testimonials") * 0.5
            + c("is_root_url") * 2.0,
            4,
        ),
        "navigation_density_ratio": ratio(
            c("nav_links"), F.greatest(c("total_links"), F.lit(1))
        ),
        "content_section_count": c("content_block_count"),
        "academic_listing_signal": flag(
            (
                (c("is_academic_domain") == 1)
                | has_text("netloc", ("arxiv", "pubmed"))
            )
            & (c("publication_list_signal") == 1)
            & (c("x_years") >= 3)
        ),
        "high_link_no_pagination": flag(
            (c("content_links") >= 20)
            & (c("has_pagination") == 0)
            & (c("anchor_text_diversity") > 0.55)
        ),
        "others_vocab_footer_ratio": ratio(
            c("x_footer_others"), F.greatest(c("x_body_others"), F.lit(1))
        ),
        "others_vocab_is_boilerplate": flag(
            (c("x_footer_others") >= 3) & (c("x_footer_others") >= c("x_body_others") * 0.7)
        ),
    }


@built_once
def finals() -> dict[str, Column]:
    c = F.col
    gap = F.abs(c("composite_listing_score") - c("composite_detail_score"))
    sl, cl = c("struct_list_score"), c("content_list_score")
    sd, cd = c("x_struct_detail"), c("x_content_detail")
    return {
        "composite_others_score": F.bround(
            F.greatest(F.lit(0.0), F.lit(5.0) - gap) * 0.5
            + c("og_type_is_website")
            + c("has_login_form")
            + c("url_is_root") * 2
            + flag(c("content_density") < 0.05),
            4,
        ),
        "listing_structure_without_content": flag((sl >= 2) & (cl == 0)),
        "detail_alignment_score": F.least(sd, cd),
        "listing_alignment_score": F.least(sl, cl),
        "alignment_conflict": flag(((sl >= 2) & (cd >= 2)) | ((sd >= 2) & (cl >= 2))),
        "directory_detail_signals": either(
            path_matches(r"/\d{7,}/"),
            path_matches(r"/[a-z0-9-]{3,}/[a-z0-9-]{3,}$"),
            c("numeric_id_with_single_h1") == 1,
            c("x_contact") == 1,
            c("x_story") == 1,
        ),
    }
