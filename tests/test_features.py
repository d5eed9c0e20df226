"""Hand-worked feature values, invariants and independence of the partitioning."""

from pyspark.sql import functions as F

from siftpage.operators.features import FEATURE_COLUMNS, features, text_features
from siftpage.sources.decorated import decorated_pages
from siftpage.functions import vocab
from siftpage.functions.text import fold
from siftpage.operators.features.assemble import prepare
from siftpage.operators.rules import with_verdict

DEEP = "<body><div>" + "<b>k</b>" * 20 + "<i><u><s>deep</s></u></i></div></body>"
MANY = "<body>" + "<div></div>" * 149 + "<ul><li><li><li><li></ul><ol><li><li><li><li></ol></body>"
PAGES = {
    1: ("http://x/", ""),
    2: ("http://x/a", DEEP),
    3: ("http://x/b", MANY),
    4: (
        "http://u:p@h:80/p",
        '<body><nav><a href="/n">n</a></nav><a href="/n">n</a><a href="http://o/1">o</a>'
        '<a href="//o/2">o</a><a href="http://u:p@h:80/i">i</a><a href="#a">x</a><a href="#b">y</a>'
        '<a href="#c">z</a></body>',
    ),
    5: ("http://x/c", "<body>published\non 2024 and stock $5 or 7 € or 1,000.50 $</body>"),
    6: ("http://x/d", "<body><h1>Spark</h1>Spark spark, sparks SPARK</body>"),
    7: ("http://x/e", "<body><h1>Big Spark</h1>big spark big spark. Big  Spark</body>"),
    8: ("http://x/f", "<body><ul><li>a<li>a<li>b<li>c</ul></body>"),
    9: ("http://x/g", "<body><ul><li>a<li>a<li>b<li>c<li>a</ul></body>"),
    10: ("http://x/h", '<head><meta property="og:type" content="VIDEO.movie"></head><body>x</body>'),
    11: ("http://x/en-us/", '<link rel="next prev" href="/2"><body>éby author été</body>'),
}


def run(spark, pages=None):
    rows = [(k, u, h) for k, (u, h) in (pages or PAGES).items()]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r.page_id: r for r in features(df).collect()}


def test_contract():
    assert len(FEATURE_COLUMNS) == 211 == len(set(FEATURE_COLUMNS))


def test_golden_values(spark):
    f = run(spark)
    assert len(f) == len(PAGES)
    assert f[1].word_count == 0 and f[1].og_type_is_website == 1 and f[1].url_is_root == 1
    # The deep branch is the 21st child.
    assert f[2].dom_max_depth == 4 and f[2].dom_nesting_avg == round((1 + 21 * 2 + 3 + 4) / 25, 4)
    # Containers 150 and 151 count like any other.
    assert f[3].sibling_repeat_count == 2 and f[3].repeated_sibling_containers == 2
    assert (f[4].total_links, f[4].external_links, f[4].internal_links) == (8, 2, 6)
    assert f[4].nav_links == 2 and f[4].content_links == 4
    assert f[4].internal_anchor_links == 3 and f[4].has_internal_anchors == 1
    # The date is on the next line, "stock" holds "toc", prices stand on both sides.
    assert f[5].has_publish_date == 0 and f[5].has_toc == 1 and f[5].price_mention_count == 3
    assert f[6].entity_name_repetition == 3 and f[6].entity_is_repeated == 1
    assert f[7].entity_name_repetition == 3
    assert f[8].li_text_diversity == 0.0 and f[9].li_text_diversity == 0.6
    assert f[10].og_type_is_video == 1 and f[10].og_numeric == 2
    assert f[11].rel_has_next == 1 and f[11].rel_has_prev == 1 and f[11].is_root_url == 1
    assert f[11].has_author == 1
    without = run(spark, {1: ("http://x/q", "<body>éby é</body>")})
    assert without[1].has_author == 0


def test_invariants(spark, folder):
    df = features(decorated_pages(spark, folder)).collect()
    assert len(df) == len({r.page_id for r in df}) == 50
    for r in df:
        assert r.h1_count == r.tag_h1_count
        for name in ("li_density", "anchor_text_diversity", "unique_word_ratio", "content_density"):
            assert 0.0 <= r[name] <= 1.0
        assert all(r[name] is not None for name in FEATURE_COLUMNS)


def test_same_for_any_partitioning(spark, folder):
    pages = decorated_pages(spark, folder)

    def digest(n):
        columns = [F.col(c).cast("string") for c in FEATURE_COLUMNS]
        hashed = features(pages.repartition(n)).select("page_id", F.xxhash64(*columns).alias("h"))
        return sorted(map(tuple, hashed.collect()))

    assert digest(1) == digest(7)


def test_text_features(spark):
    df = spark.createDataFrame([(1, "Buy now.  Privacy\npolicy 2020 2021"), (2, None)], "k int, t string")
    out = {r.k: r for r in text_features(df, "k", "t").collect()}
    assert out[1].has_buy_cta == 1 and out[1].legal_signal_count == 1
    assert out[1].year_mention_count == 2 and out[2].word_count == 0


def test_jsonld_flag(spark):
    html = '<script type="application/ld+json">[{"@type":["ItemList","Thing"]},{"a":1}]</script><body>x'
    df = spark.createDataFrame([(1, "http://x", html)], "page_id int, url string, html string")
    off, on = features(df).first(), features(df, jsonld=True).first()
    assert (off.schema_type_count, off.pre_hint_schema) == (0, 0)
    assert (on.schema_type_count, on.has_schema_list_type, on.pre_hint_schema) == (3, 1, 1)


def test_text_views_of_odd_blanks_and_signs(spark):
    """The patterns of the text views against their plain definitions."""
    import random
    import re

    from pyspark.sql import functions as F

    from siftpage.functions import text as X

    draw = random.Random(5)
    parts = [*X.BLANKS, "  ", "\n\n ", ".", ", ", "--", "a", "Zb", "9", "_x", "\u00e9", "\u0663", "\u65e5", "\U0001f600", "\x01", "$1,299.00"]
    texts = ["", " ", "a", "a b a", *("".join(draw.choices(parts, k=draw.randint(1, 40))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = X.flat_words(F.col("flat"))
    rows = df.withColumn("flat", X.flat(F.col("t"))).select(
        "*", X.spaced(F.col("flat")).alias("spaced"), words.alias("words"),
        X.distinct_letter_words(X.word_kinds(words)).alias("letters"),
    ).collect()
    table = str.maketrans({b: " " for b in X.BLANKS if b != "\n"})
    for r in rows:
        assert r["flat"] == r["t"].translate(table)
        marked = re.sub(r"[^a-zA-Z0-9_ \t\n\x0b\f\r]+", f" {X.MARK} ", r["flat"])
        assert r["spaced"] == " " + re.sub(r"[ \t\n\x0b\f\r]+", " ", marked) + " "
        assert r["words"] == [w for w in re.split("[ \n]", r["flat"]) if w]
        assert r["letters"] == sum(w.isalpha() for w in set(r["words"]))


def test_tag_report_reads_written_elements(spark, folder):
    from siftpage.plans.queries import tag_nesting

    plan = tag_nesting(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "nest(" not in plan


def test_patterns_that_are_tested_after_their_word_parts_miss_nothing(spark):
    """Every pair of pieces that patterns are made of, in both orders, against the patterns alone."""
    parts = [
        *vocab.CURRENCY_SIGNS, *vocab.CURRENCY_CODES, *vocab.RESULT_COUNT_STEMS, *vocab.RULE_RESULT_STEMS, *vocab.SPEC_STEMS,
        *vocab.ENGAGEMENT_STEMS, *vocab.JOB_COUNT_STEMS, "items found", "next\npage", "load more", "showing", "of 3", "out of 5", "/ 5",
        "table of contents", "toc", "duration:", "runtime -", "2024", "on-site", "full time", "remote", "price:", "customer rating",
        "stars", "By Jane", "by Jane", "written by", "author:", "published", "Köln", "٣", "7,",
    ]
    rows = [(f"{a}{gap}{b}",) for a in parts for b in parts for gap in (" ", "", "s ")]
    rows = [(i, "http://x/", f"<body><p>{t}</p></body>") for i, (t,) in enumerate([*rows, ("",), ("nothing",)])]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(8)
    plain = {
        "x_price_text": vocab.PLAIN_PRICE_PATTERN, "has_result_count": vocab.RESULT_COUNT_PATTERN, "x_toc_text": vocab.TOC_PATTERN,
        "x_spec_text": vocab.SPEC_CLASS, "x_duration_text": vocab.DURATION_PATTERN, "has_engagement_metrics": vocab.ENGAGEMENT_PATTERN,
    }
    wrong = [F.col(name).cast("int") != F.rlike("folded", F.lit(pattern)).cast("int") for name, pattern in plain.items()]
    wrong += [F.col("x_prices") != F.regexp_count("folded", F.lit(vocab.PRICE_PATTERN))]
    wrong += [F.col("x_years") != F.regexp_count("folded", F.lit(vocab.YEAR_PATTERN))]
    wrong += [F.rlike("folded", F.lit(vocab.SCORE_PATTERN)) & (F.col("has_rating") == 0)]
    wrong += [F.rlike("folded", F.lit(vocab.PAGE_OF_PATTERN)) & ~F.col("x_paging_text")]
    wrong += [F.rlike("folded", F.lit(f"{vocab.WORK_MODE_PATTERN}|{vocab.JOB_COUNT_PATTERN}")) & (F.col("job_listing_vocab") == 0)]
    guards = f"{vocab.RULE_PRICE_PATTERN}|{vocab.RULE_RATING_PATTERN}"
    wrong += [F.rlike("folded", F.lit(guards)) & ~F.col("x_guarded")]
    wrong += [F.rlike("folded", F.lit(vocab.RULE_RESULT_PATTERN)) & (F.col("x_listing_signals") == 0)]
    wrong += [F.rlike("folded", F.lit(vocab.RULE_PAGING_PATTERN)) & (F.col("x_listing_signals") == 0)]
    wrong += [F.rlike(fold(F.col("body")), F.lit(vocab.BYLINE_PATTERN)) != F.col("x_byline")]
    seen = with_verdict(prepare(pages)).select(*[F.count_if(w).alias(f"w{i}") for i, w in enumerate(wrong)], F.count_if(F.col("x_prices") > 0))
    *missed, found = seen.first()
    assert missed == [0] * len(wrong) and found > 100
