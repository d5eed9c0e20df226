"""Rule classifier: eight ordered rules, the first that fires gives the verdict.

All signals are columns of the prepared page; the rules are one ``coalesce`` of nullable structs, so
a page without a verdict simply carries NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpage.functions import vocab
from siftpage.functions.jsonld import lowered, microdata_type
from siftpage.functions.numbers import flag
from siftpage.functions.reuse import built_once
from siftpage.functions.text import count_words, has_text, has_word, strip
from siftpage.functions.url import listing_url
from siftpage.operators.features import prepare
from siftpage.operators.features.wording import figures, matches, mentions
from siftpage.operators.html import carries, notice, page_title, parse

ERROR_TEXT = "(?dU)" + "|".join(vocab.ERROR_PATTERNS)


def _verdict(label, method: str, reason, confidence: float, error: bool = False) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_column(label).alias("label"),
        F.lit(confidence).alias("confidence"),
        F.lit(method).alias("method"),
        as_column(reason).alias("reason"),
        F.lit(error).alias("is_error_page"),
    )


def _holds(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = _holds(text, parts[0])
    for part in parts[1:]:
        out = out | _holds(text, part)
    return out


def error_page(status: Column | None) -> Column:
    """Title, headings and brief pages are read, and marks of a challenge; not scripts, nor the prose of a page
    that has something to say."""
    seen = (has_text("x_notice", vocab.ERROR_PARTS) & F.rlike("x_notice", F.lit(ERROR_TEXT))) | F.col("x_challenge")
    if status is not None:
        seen = seen | F.coalesce(status >= 400, F.lit(False))
    return F.when(seen, _verdict("others", "error_page", "page_error_or_blocked", 0.97, True))


def schema_type() -> Column:
    micro = F.transform(
        F.filter("nodes", lambda e: F.map_contains_key(e["attrs"], "itemtype")),
        lambda e: microdata_type(e["attrs"]["itemtype"]),
    )
    types = F.concat(lowered(F.col("jsonld_types")), micro)
    mapped = vocab.RULE_DETAIL_TYPES + vocab.RULE_LIST_TYPES
    first = F.try_element_at(F.filter(types, lambda t: t.isin(*mapped)), F.lit(1))
    label = F.when(first.isin(*vocab.RULE_LIST_TYPES), F.lit("list")).otherwise(F.lit("detail"))
    return F.when(
        first.isNotNull(),
        _verdict(label, "schema_org", F.concat(F.lit("schema_type="), first), 0.96),
    )


def feed() -> Column:
    return F.when(
        ~F.col("x_listing_url") & (F.col("has_rss_feed") == 1),
        _verdict("list", "rss_feed", "page_has_rss_or_atom_feed_link", 0.93),
    )


def open_graph() -> Column:
    kind = strip(F.col("og_type"))
    label = F.lit(None).cast("string")
    for prefix, target in reversed(vocab.OG_RULE_PREFIXES):
        hit = F.startswith(kind, F.lit(prefix)) | (kind == prefix.rstrip("."))
        label = F.when(hit, F.lit(target)).otherwise(label)
    fires = ~F.col("x_listing_url") & ~kind.isin(*vocab.OG_PLAIN) & label.isNotNull()
    return F.when(
        fires, _verdict(label, "open_graph", F.concat(F.lit("og:type="), kind), 0.93)
    )


def twitter_player() -> Column:
    return F.when(
        strip(F.col("card_type")) == "player",
        _verdict("detail", "twitter_card", "twitter:card=player", 0.93),
    )


def listing_signals() -> Column:
    """Five structural listing signals, counted."""
    c = F.col
    return (
        flag(
            (mentions("page", "more", "showing") & matches(vocab.RULE_PAGING_PATTERN))
            | c("x_rule_paging_markup")
        )
        + flag(figures() & mentions(*vocab.RULE_RESULT_STEMS) & matches(vocab.RULE_RESULT_PATTERN))
        + flag(c("x_rule_filter_markup"))
        + flag(c("x_rule_repeated") >= 2)
        + flag(c("x_rule_grid") >= 4)
    )


def strong_listing() -> Column:
    return F.when(
        F.col("x_listing_signals") >= 3,
        _verdict("list", "strong_listing", "multi_signal_listing_dom", 0.90),
    )


def domain_rules() -> Column:
    """Six site rules in order: job boards, API docs, arXiv, Wikipedia, social sites, browse paths."""
    url, method = F.lower("url"), "domain_specific"
    conf = vocab.RULE_CONFIDENCE
    rules = []
    board = F.lit(None).cast("string")
    for host in reversed(vocab.JOB_BOARDS):
        board = F.when(_holds(url, host), F.lit(host)).otherwise(board)
    rules.append(
        F.when(
            board.isNotNull() & (_any(url, vocab.JOB_PATHS) | _any(url, vocab.JOB_HOSTS)),
            _verdict("list", method, F.concat(F.lit("job_board_domain="), board), conf["job_board"]),
        )
    )
    docs = F.lit(None).cast("string")
    for host, name, marker in reversed(vocab.API_DOCS):
        docs = F.when(_holds(url, host) & _holds(url, marker), F.lit(name)).otherwise(docs)
    rules.append(
        F.when(
            docs.isNotNull() & has_word("spaced", vocab.RULE_API_WORDS),
            _verdict(
                "detail", method, F.concat(F.lit("api_doc_platform="), docs), conf["api_docs"]
            ),
        )
    )
    rules.append(
        F.when(
            _holds(url, "arxiv.org") & F.rlike(url, F.lit("/(year|list|search|find)/")),
            _verdict("list", method, "arxiv_listings", conf["arxiv"]),
        )
    )
    article = F.split_part(url, F.lit("/wiki/"), F.lit(2))
    rules.append(
        F.when(
            _holds(url, "wikipedia.org")
            & _holds(url, "/wiki/")
            & ~(_holds(article, ":") & _holds(article, "/")),
            _verdict("detail", method, "wikipedia_article", conf["wikipedia"]),
        )
    )
    site = F.lit(None).cast("string")
    for part, name in reversed(vocab.SOCIAL_BROWSE):
        site = F.when(_holds(url, part), F.lit(name)).otherwise(site)
    rules.append(
        F.when(
            site.isNotNull(),
            _verdict("list", method, F.concat(F.lit("social_browse="), site), conf["social"]),
        )
    )
    path = F.col("parts.path")
    rules.append(
        F.when(
            F.rlike(path, F.lit(vocab.RULE_BROWSE_PATH)) & (F.col("total_links") >= 15),
            _verdict("list", method, F.concat(F.lit("browse_path="), path), conf["browse"]),
        )
    )
    return F.coalesce(*rules)


def others_counts() -> dict[str, Column]:
    """Signals of a marketing page and the guards that rule one out."""
    byline = mentions("by", "author", "published") & matches(vocab.RULE_BYLINE_PATTERN)
    price = mentions(*vocab.CURRENCY_SIGNS, *vocab.CURRENCY_CODES, "price")
    rating = figures() & mentions("out", "/", "review", "rating", "star") | mentions("customer")
    return {
        "x_info": F.col("legal_signal_count")
        + count_words("spaced", vocab.RULE_INFO_FLAGS)
        + F.col("faq_signal_count"),
        "x_marketing": count_words("spaced", vocab.MARKETING_FLAGS),
        "x_guarded": (price & matches(vocab.RULE_PRICE_PATTERN))
        | has_word("spaced", vocab.RULE_BUY_WORDS)
        | (rating & matches(vocab.RULE_RATING_PATTERN))
        | has_word("spaced", vocab.RULE_SPEC_WORDS)
        | ((F.col("x_time") == 1) & byline),
    }


def others_signals() -> Column:
    info, cta, marketing = F.col("x_info"), F.col("cta_signal_count"), F.col("x_marketing")
    fires = (
        ~F.col("x_listing_url")
        & ~F.col("x_guarded")
        & (info >= 3)
        & (cta >= 2)
        & (marketing >= 1)
    )
    reason = F.format_string("marketing_page: info=%d, cta=%d, marketing=%d", info, cta, marketing)
    return F.when(fires, _verdict("others", "others_signals", reason, 0.90))


@built_once
def rule_signals() -> dict[str, Column]:
    return {
        "x_listing_url": listing_url(F.col("parts")),
        "x_listing_signals": listing_signals(),
        **others_counts(),
    }


@built_once
def rules_after_errors() -> tuple[Column, ...]:
    return (
        schema_type(),
        feed(),
        open_graph(),
        twitter_player(),
        strong_listing(),
        domain_rules(),
        others_signals(),
    )


def with_verdict(prepared: DataFrame, status: str | None = None) -> DataFrame:
    """Prepared pages plus ``verdict``; ``status`` names an HTTP status column, if there is one."""
    signals = prepared.withColumns(rule_signals())
    verdict = F.coalesce(error_page(F.col(status) if status else None), *rules_after_errors())
    return signals.withColumn("verdict", F.when(~F.col("x_empty"), verdict))


def pre_classify(pages: DataFrame, jsonld: bool = False) -> DataFrame:
    """page_id, url, verdict (NULL when no rule fires or the page is empty)."""
    return with_verdict(prepare(pages, jsonld)).select("page_id", "url", "verdict")


def rule_distribution(verdicts: DataFrame) -> DataFrame:
    """Pages per method and label; pages without a verdict count as ``no_rule``."""
    return verdicts.groupBy(
        F.coalesce("verdict.method", F.lit("no_rule")).alias("method"),
        F.coalesce("verdict.label", F.lit("-")).alias("label"),
    ).agg(F.count("*").alias("pages"))


def blocked_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and ``blocked``: does the page look like a block or challenge page?"""
    parsed = parse(pages).withColumn("own_title", page_title())
    return parsed.select(
        "page_id", "url", (_any(notice(), vocab.BLOCK_PHRASES) | carries(vocab.CHALLENGE_MARKS)).alias("blocked")
    )
