"""Feature columns read from text alone; they work on any text column.

Expected columns: ``body`` (text), ``lower`` (lower case), ``folded``, ``spaced``, ``spaced_seen``,
``words``, ``kinds``, ``title`` and ``own_title``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftpage.functions import vocab
from siftpage.functions.numbers import flag, log_count, ratio
from siftpage.functions.reuse import built_once
from siftpage.functions.text import (
    count_text,
    count_words,
    distinct_letter_words,
    fold,
    has_text,
    has_word,
    number_words,
    text_length_of,
    word_kinds,
    words,
)


def matches(pattern: str, column: str | Column = "folded") -> Column:
    return F.rlike(column, F.lit(pattern))


def mentions(*parts: str) -> Column:
    """Cheap precondition of a pattern: one of the parts occurs in some word of the text."""
    return has_text("kinds", parts)


def figures() -> Column:
    """Precondition of a pattern that asks for a digit."""
    return F.col("x_figures")


def says(phrases: tuple[str, ...], column: str = "spaced") -> Column:
    return has_word(column, phrases)


def either(*tests: Column) -> Column:
    out = F.lit(0)
    for test in tests:
        out = out + flag(test)
    return out


@built_once
def counts() -> dict[str, Column]:
    """First stage: plain measures and flags of the text."""
    lower, folded = F.col("lower"), F.col("folded")
    sample = F.lower(F.concat("title", F.lit(" "), F.col("body")))
    # The words of the text serve the sample too, unless lower-casing moved its characters.
    same = F.length("lower") == F.length("body")
    title_words, anew = words(F.lower("title")), words(sample)
    return {
        "word_count": F.size("words"),
        "char_count": F.length("body"),
        "x_letter_words": distinct_letter_words(F.col("kinds")),
        "sentence_count": F.greatest(F.lit(1), F.regexp_count("body", F.lit("[.!?]+"))),
        "x_boilerplate": text_length_of("lower", vocab.BOILERPLATE, "kinds"),
        "x_sample": sample,
        "x_sample_words": F.when(same, F.concat(title_words, "words")).otherwise(anew),
        # a word of the title may stand in it twice
        "x_sample_kinds": F.when(same, F.concat_ws(" ", word_kinds(title_words), "kinds")).otherwise(word_kinds(anew)),
        "x_price_text": mentions(*vocab.CURRENCY_SIGNS) & matches(vocab.PLAIN_PRICE_PATTERN),
        "x_prices": F.when(
            mentions(*vocab.CURRENCY_SIGNS, *vocab.CURRENCY_CODES),
            F.regexp_count(folded, F.lit(vocab.PRICE_PATTERN)),
        ).otherwise(0),
        "x_paging_text": (mentions("page", "more", "all") & matches(vocab.PAGING_PATTERN))
        | (figures() & mentions("of") & matches(vocab.PAGE_OF_PATTERN)),
        "x_filter_text": says(("filter", "refine"))
        | (says(("sort by",)) & F.contains(lower, F.lit("sort by"))),
        "has_result_count": flag(
            figures() & mentions(*vocab.RESULT_COUNT_STEMS) & matches(vocab.RESULT_COUNT_PATTERN)
        ),
        "has_buy_cta": flag(says(vocab.BUY_WORDS)),
        "has_author": flag(says(vocab.AUTHOR_WORDS)),
        "x_date_text": mentions("date", "posted", "published", "modified")
        & matches(vocab.PUBLISH_DATE_PATTERN),
        "has_rating": flag(says(vocab.RATING_WORDS) | (figures() & mentions("out", "/") & matches(vocab.SCORE_PATTERN))),
        "x_toc_text": mentions("toc", "contents") & matches(vocab.TOC_PATTERN, folded),
        "x_spec_text": mentions(*vocab.SPEC_STEMS) & matches(vocab.SPEC_CLASS, folded),
        "has_share_buttons": flag(says(vocab.SHARE_WORDS)),
        "has_comments_section": flag(says(vocab.COMMENT_WORDS)),
        "has_related_section": flag(says(vocab.RELATED_WORDS)),
        "x_duration_text": mentions("duration", "runtime") & matches(vocab.DURATION_PATTERN, folded),
        "has_engagement_metrics": flag(
            figures() & mentions(*vocab.ENGAGEMENT_STEMS) & matches(vocab.ENGAGEMENT_PATTERN)
        ),
        "title_word_count": F.size(words(F.col("title"))),
        "title_has_list_cue": flag(has_text("lower(title)", vocab.LIST_CUES)),
        "title_has_detail_cue": flag(has_text("lower(title)", vocab.DETAIL_CUES)),
        "title_has_question": flag(F.contains("title", F.lit("?"))),
        "title_has_count_in_parens": flag(F.rlike("title", F.lit(r"(?U)\(\d+\)"))),
        "title_signals_listing": flag(has_text("lower(own_title)", vocab.TITLE_LIST_WORDS)),
        "title_signals_detail": flag(has_text("lower(own_title)", vocab.TITLE_DETAIL_WORDS)),
        "x_contact": flag(says(vocab.CONTACT_WORDS)),
        "x_story": flag(says(vocab.STORY_WORDS) | (mentions("est") & matches(vocab.EST_PATTERN))),
        "event_listing_signals": either(
            says(vocab.EVENT_LIST_WORDS),
            mentions("event") & matches(vocab.FIND_EVENTS_PATTERN),
            mentions("event") & matches(vocab.COUNT_EVENTS_PATTERN),
        ),
        "single_event_signals": count_words("spaced", 
            (vocab.TICKET_WORDS, vocab.VENUE_WORDS, vocab.ACT_WORDS)
        ),
        "x_job_text": count_words("spaced", 
            (vocab.APPLY_WORDS, vocab.PAY_WORDS, vocab.DUTY_WORDS, vocab.DEADLINE_WORDS)
        ),
        "x_forum_text": either(says(vocab.REPLY_WORDS), mentions("joined", "member", "post") & matches(vocab.MEMBER_PATTERN)),
        "cta_signal_count": count_words("spaced", vocab.CTA_FLAGS),
        "legal_signal_count": count_words("spaced", vocab.LEGAL_FLAGS),
        "info_signal_count": count_words("spaced", vocab.INFO_FLAGS),
        "faq_signal_count": count_words("spaced", vocab.FAQ_FLAGS),
        "has_pricing_section": flag(says(vocab.PRICING_WORDS)),
        "has_testimonials": flag(says(vocab.TESTIMONIAL_WORDS)),
        "x_cart_text": says(vocab.CART_WORDS),
        "x_byline": (says(("by", "written by")) | mentions("author"))
        & (has_text("body", ("author", "written")) | F.rlike("body", F.lit("by[^a-zA-Z0-9_]+[A-Z]")))
        & matches(vocab.BYLINE_PATTERN, fold(F.col("body"))),
        "x_year_text": mentions("date", "posted", "published")
        & matches(vocab.PUBLISH_YEAR_PATTERN),
        "job_posting_signal_combined": flag(
            says(vocab.APPLY_JOB_WORDS) & says(vocab.JOB_VOCAB_WORDS)
        ),
        "others_content_signal": flag(says(vocab.MISSION_WORDS)),
        "browse_vocab_signal": flag(says(vocab.BROWSE_WORDS)),
        "x_years": F.when(figures(), F.regexp_count(folded, F.lit(vocab.YEAR_PATTERN))).otherwise(0),
        "publication_list_signal": flag(says(vocab.PUBLICATION_WORDS)),
        "job_listing_vocab": either(
            mentions("time", "remote", "hybrid", "site") & matches(vocab.WORK_MODE_PATTERN),
            figures() & mentions(*vocab.JOB_COUNT_STEMS) & matches(vocab.JOB_COUNT_PATTERN),
            says(vocab.JOB_FILTER_WORDS),
            says(vocab.JOB_NEWS_WORDS),
        ),
        "x_body_others": count_words("spaced", vocab.FOOTER_FLAGS),
    }


@built_once
def derived() -> dict[str, Column]:
    """Second stage: features computed from the measures."""
    c = F.col
    count = c("word_count")
    return {
        "content_available": flag(c("char_count") >= vocab.MIN_TEXT_LENGTH),
        "log_word_count": log_count(count),
        "unique_word_ratio": ratio(c("x_letter_words"), F.greatest(count, F.lit(1))),
        "avg_sentence_length": F.bround(count / c("sentence_count"), 4),
        "reading_time_estimate": F.bround(count / F.lit(200.0), 4),
        "boilerplate_ratio": ratio(
            c("x_boilerplate"), F.greatest(c("char_count"), F.lit(1))
        ),
        "list_cue_word_hits": count_text("x_sample", vocab.LIST_CUES, "x_sample_kinds"),
        "detail_cue_word_hits": count_text("x_sample", vocab.DETAIL_CUES, "x_sample_kinds"),
        "x_numbers": number_words(c("x_sample_words")),
        "price_mention_count": c("x_prices"),
        "has_price": flag(c("x_prices") > 0),
        "purchase_funnel_signal": flag(c("x_price_text") & c("x_cart_text")),
        "year_mention_count": c("x_years"),
        "has_many_years": flag(c("x_years") >= 5),
        "is_job_listing_page": flag(c("job_listing_vocab") >= 2),
    }


@built_once
def cue_ratios() -> dict[str, Column]:
    c = F.col
    return {
        "list_vs_detail_cue_ratio": ratio(c("list_cue_word_hits"), c("detail_cue_word_hits") + 1),
        "detail_vs_list_cue_ratio": ratio(c("detail_cue_word_hits"), c("list_cue_word_hits") + 1),
        "numeric_token_density": ratio(
            c("x_numbers"), F.greatest(F.size("x_sample_words"), F.lit(1))
        ),
    }
