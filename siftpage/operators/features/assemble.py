"""Pages -> 211 feature columns, as a chain of narrow projections.

No stage needs a shuffle. Each stage is its own projection, so an array or text used by many
expressions is computed once and the generated code stays in small methods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpage.functions import vocab
from siftpage.functions.reuse import built_once
from siftpage.functions.text import (
    flat,
    flat_words,
    fold,
    fold_flat,
    seen_words,
    spaced,
    word_kinds,
)
from siftpage.functions.url import url_features, url_parts
from siftpage.operators.features import composite, markup, wording
from siftpage.operators.html import carries, notice, page_title, parse

# Names and order of the feature columns, a contract with stored models.
FEATURE_COLUMNS = tuple(
    """
    content_available
    tag_div_count tag_section_count tag_article_count tag_ul_count tag_ol_count tag_li_count
    tag_table_count tag_tr_count tag_td_count tag_span_count tag_p_count tag_h1_count tag_h2_count
    tag_h3_count tag_h4_count tag_aside_count tag_nav_count tag_header_count tag_footer_count
    tag_main_count li_density article_section_ratio dom_max_depth dom_nesting_avg has_data_table
    grid_class_count has_grid_layout sibling_repeat_count
    total_links log_total_links internal_links external_links nav_links content_links
    external_link_ratio anchor_text_diversity link_to_word_ratio internal_anchor_links
    has_internal_anchors
    word_count log_word_count char_count unique_word_ratio h1_count h2_count h3_count h4_count
    heading_hierarchy_score single_h1 rich_paragraph_count log_rich_paragraph_count
    avg_paragraph_length sentence_count avg_sentence_length reading_time_estimate
    deep_content_blocks has_main_content_element has_article_element content_block_count
    text_concentration_ratio content_density text_to_html_ratio boilerplate_ratio
    image_count log_image_count images_with_alt alt_text_ratio gallery_image_count
    has_image_gallery has_video figure_count figcaption_count media_density
    has_pagination page_number_links has_page_param_links has_filter_ui has_result_count
    repeated_sibling_containers has_repeated_blocks has_compare_checkboxes card_count
    has_card_elements links_per_1k_words breadcrumb_depth has_breadcrumb
    price_mention_count has_price has_buy_cta has_author has_publish_date has_rating has_toc
    has_spec_section has_share_buttons has_comments_section has_related_section og_type_is_video
    has_twitter_player has_duration_meta url_signals_single_item has_engagement_metrics
    form_count has_search_form has_login_form button_count select_count range_input_count has_tabs
    og_type_is_article og_type_is_product og_type_is_website has_twitter_summary_large
    has_schema_list_type has_schema_detail_type schema_type_count has_microdata has_canonical
    robots_noindex page_lang_is_english
    list_cue_word_hits detail_cue_word_hits list_vs_detail_cue_ratio detail_vs_list_cue_ratio
    numeric_token_density title_word_count title_has_list_cue title_has_detail_cue
    title_has_question title_has_count_in_parens
    url_path_depth url_depth_normalized url_has_any_param url_has_query_params
    url_query_param_count url_has_numeric_id url_has_long_slug url_list_token_match
    url_detail_token_match url_has_extension url_is_root url_has_search_param url_has_filter_param
    url_has_page_param is_job_board_domain is_api_doc_domain has_jobs_in_path
    composite_listing_score composite_detail_score composite_others_score
    url_bias_corrected_listing
    single_entity_strong single_entity_weak entity_name_repetition entity_is_repeated
    listing_structure_without_content struct_list_score content_list_score detail_alignment_score
    listing_alignment_score alignment_conflict numeric_id_with_single_h1 directory_detail_signals
    li_text_diversity low_variation_li pre_hint_schema pre_hint_has_schema og_numeric
    event_listing_signals single_event_signals job_posting_signals article_in_product_site
    forum_thread_signals
    cta_signal_count legal_signal_count info_signal_count faq_signal_count has_hero_section
    has_pricing_section has_testimonials is_root_url landing_page_score navigation_density_ratio
    content_section_count rel_has_next rel_has_prev has_rss_feed purchase_funnel_signal
    article_byline_signal job_posting_signal_combined title_signals_listing title_signals_detail
    others_path_signal others_content_signal
    is_browse_path browse_vocab_signal year_mention_count has_many_years publication_list_signal
    is_academic_domain academic_listing_signal has_search_in_path has_type_query_param
    job_listing_vocab is_job_listing_page high_link_no_pagination article_sibling_containers
    has_article_grid others_vocab_footer_ratio others_vocab_is_boilerplate
    """.split()
)
META_COLUMNS = ("_title", "_body_text_length")


def with_text_views(df: DataFrame) -> DataFrame:
    """Adds lower, folded, spaced, their words and what is seen of the vocabulary, for the text column ``body``, one projection each."""
    return (
        df.withColumn("lower", F.lower("body"))
        .withColumn("flat", flat(F.col("lower")))
        .withColumns({"folded": fold_flat(F.col("flat")), "words": flat_words(F.col("flat"))})
        .withColumns(
            {
                "spaced": spaced(F.col("folded")),
                "kinds": word_kinds(F.col("words")),
                "x_figures": F.rlike("folded", F.lit(r"\d")),
            }
        )
        .withColumn("spaced_seen", seen_words(F.col("spaced")))
    )


def prepare(
    pages: DataFrame,
    jsonld: bool = False,
    stored_title: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Parsed pages with text views, URL parts and all first-stage counts.

    Features and rules both start here, so a page is parsed once for the two of them.
    ``stored_title`` names a column with the title of an older snapshot, used when the page has none;
    ``keep`` names further columns of the pages that stay.
    """
    keep = (*keep, stored_title) if stored_title else keep
    parsed = parse(pages, jsonld, keep)
    own = page_title()
    title = own
    if stored_title:
        title = F.coalesce(F.nullif(own, F.lit("")), F.col(stored_title), F.lit(""))
    base = parsed.withColumns(
        {
            "parts": url_parts(F.col("url")),
            "own_title": own,
            "title": title,
            **markup.subsets(),
        }
    ).withColumns(
        {
            "path": F.lower("parts.path"),
            "query": F.lower("parts.query"),
            "netloc": F.lower("parts.netloc"),
            "x_notice": notice(),
            "x_challenge": carries(vocab.CHALLENGE_MARKS),
        }
    )
    counted = base.withColumns(markup.counts()).drop(
        "tags", "tag_line", "texts", "joined", "classes"
    )
    viewed = (
        with_text_views(counted)
        .withColumn("x_footer_spaced", spaced(fold(F.col("x_footer_text"))))
        .withColumn("x_footer_spaced_seen", seen_words(F.col("x_footer_spaced")))
    )
    return viewed.withColumns(wording.counts())


@built_once
def url_columns() -> dict:
    return url_features(F.col("url"), F.col("parts"))


def features_of(prepared: DataFrame) -> DataFrame:
    """Prepared pages with every feature column added."""
    return (
        prepared.withColumns(
            {
                **markup.derived(),
                **wording.derived(),
                **url_columns(),
            }
        )
        .withColumns({**wording.cue_ratios(), **composite.mixed()})
        .withColumns(composite.scores())
        .withColumns(composite.finals())
    )


def features(pages: DataFrame, jsonld: bool = False, stored_title: str | None = None) -> DataFrame:
    """page_id, url, the 211 features in contract order, _title, _body_text_length.

    JSON-LD types count only with ``jsonld``; by default the five features fed by them are 0.
    """
    full = features_of(prepare(pages, jsonld, stored_title))
    return full.select(
        "page_id",
        "url",
        *FEATURE_COLUMNS,
        F.col("title").alias("_title"),
        F.length("body").alias("_body_text_length"),
    )


def text_features(df: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """The text-only features of any text column, one row per ``key``."""
    given = F.coalesce(F.col(title), F.lit("")) if title else F.lit("")
    based = df.select(
        key,
        F.coalesce(F.col(text), F.lit("")).alias("body"),
        given.alias("title"),
        given.alias("own_title"),
    )
    out = (
        with_text_views(based)
        .withColumns(wording.counts())
        .withColumns(wording.derived())
        .withColumns(wording.cue_ratios())
    )
    names = [
        name
        for stage in (wording.counts(), wording.derived(), wording.cue_ratios())
        for name in stage
        if name in FEATURE_COLUMNS
    ]
    return out.select(key, *sorted(names, key=FEATURE_COLUMNS.index))
