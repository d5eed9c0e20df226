import re

import pytest
from pyspark.sql import functions as F

from siftpage.functions import vocab
from siftpage.functions.text import distinct_letter_words, number_words
from siftpage.operators.decide import decide
from siftpage.operators.rules import pre_classify

LISTING = (
    "<body><div class='filters filter'></div><div class='pagination'></div>25 results found"
    "<ul><li>1<li>2<li>3<li>4<li>5</ul><ul><li>1<li>2<li>3<li>4<li>5</ul></body>"
)
FEED = '<link rel="alternate" type="application/atom+xml" href="/f">'
CASES = {
    "http://x/a": ("<title>404 Not Found</title>", "error_page"),
    "http://x/b": ("<script>captcha</script>", None),  # code says nothing about the page
    "http://x/c": ("<body>" + "x" * 3000 + " captcha</body>", "error_page"),  # the whole of a brief page is read
    "http://x/d": ('<div itemtype="http://schema.org/Recipe/">r</div>', "schema_org"),
    "http://x/e": (FEED + "<body>x</body>", "rss_feed"),
    "http://x/search?q=1": (FEED + "<body>x</body>", None),
    "http://x/f": ('<meta property="og:type" content="Video"><body>x</body>', "open_graph"),
    "http://x/g": ('<meta property="og:type" content="article"><body>x</body>', None),
    "http://x/h": ('<meta name="twitter:card" content=" Player "><body>x</body>', "twitter_card"),
    "http://x/i": (LISTING, "strong_listing"),
    "https://en.wikipedia.org/wiki/A:B": ("<body>x</body>", "domain_specific"),
    "https://en.wikipedia.org/wiki/A:B/C": ("<body>x</body>", None),
    "https://x.org/shows": ("<body>" + "<a href='/1'>1</a>" * 15 + "</body>", "domain_specific"),
    "https://x.org/shows/": ("<body>" + "<a href='/1'>1</a>" * 14 + "</body>", None),
    "http://x/j": (
        "<body>Privacy policy. About us. FAQ. Get started. Sign up. Pricing</body>", "others_signals",
    ),
    "http://x/k": (
        "<body>Privacy policy. About us. FAQ. Get started. Sign up. Pricing $5</body>", None,
    ),
    "http://x/l": ("", None),
}


def test_rules(spark):
    rows = [(i, u, h) for i, (u, (h, _)) in enumerate(CASES.items())]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.url: r.verdict.method if r.verdict else None for r in pre_classify(df).collect()}
    assert got == {u: m for u, (_, m) in CASES.items()}


def _grid(spark):
    """Every combination of rule label, rule confidence, model label and model confidence."""
    rows = []
    for label in (None, "list", "detail"):
        for conf in (0.85, 0.88, 0.90, 0.93, 0.96):
            for ml in ("list", "detail", "others"):
                for mc in (0.49, 0.59, 0.60, 0.69, 0.70, 0.99):
                    verdict = (label, conf, "m", "r", False) if label else None
                    rows.append((verdict, ml, mc, "ml_model", {ml: mc}, False, True))
    schema = (
        "verdict struct<label:string,confidence:double,method:string,reason:string,"
        "is_error_page:boolean>, ml_label string, ml_confidence double, ml_method string, "
        "probabilities map<string,double>, fallback_used boolean, content_available boolean"
    )
    return spark.createDataFrame(rows, schema)


def test_tiebreak_truth_table(spark):
    out = decide(_grid(spark)).collect()
    assert len(out) == 270
    for r in out:
        if r.pre_label is None:
            assert r.tiebreaker == "ml_only"
        elif r.pre_confidence >= 0.95:
            assert r.tiebreaker == "absolute_rule" and r.ml_label is None
        elif r.pre_label == r.ml_label:
            assert r.tiebreaker == "agreement" and r.confidence == r.pre_confidence
        else:
            wins = r.ml_confidence >= (0.70 if r.pre_confidence >= 0.90 else 0.60)
            assert r.tiebreaker == ("ml_wins" if wins else "pre_wins")
            assert r.predicted_label == (r.ml_label if wins else r.pre_label)


def test_rules_first(spark):
    for r in decide(_grid(spark), "rules_first").collect():
        if r.pre_label:
            assert r.predicted_label == r.pre_label and r.probabilities == {}


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        decide(_grid(spark), "other")


def test_every_error_pattern_asks_for_one_of_the_parts_that_are_tested_first():
    samples = (
        "404 the page was not found", "page not found", "404 error", "not found 404", "this page doesn't exist", "this page does not exist",
        "page has been removed", "page removed", "no longer available", "file not found", "500 internal server error", "service unavailable",
        "access denied", "forbidden", "403 forbidden", "captcha", "just a moment", "checking your browser", "ddos-guard",
        "cf-browser-verification", "are you a robot", "verify you are human",
    )
    for pattern in vocab.ERROR_PATTERNS:
        hits = [s for s in samples if re.search(pattern, s)]
        assert hits and all(any(part in s for part in vocab.ERROR_PARTS) for s in hits), pattern


def test_figures_among_words_are_counted_as_each_word_by_itself(spark):
    words = ["1", "$2", "3,4", "5.", "6.7", "x8", "9x", "$", ",", "$,", "1.2.3", "٣", "٣.٤", "$$1", "é", "", "1", "--", "12,"]
    alone = [w for w in words if re.search(r"^\$?[\d,]+\.?\d*$", w)]
    row = spark.createDataFrame([(words, " ".join(words))], "w array<string>, k string")
    assert row.select(number_words(F.col("w")), distinct_letter_words(F.lit("é ab a1 Ünï 2 z"))).first()[:] == (len(alone), 4)
    empty = spark.createDataFrame([([], "")], "w array<string>, k string")
    assert empty.select(number_words(F.col("w")), distinct_letter_words(F.col("k"))).first()[:] == (0, 0)
    assert "filter(" not in str(number_words(F.col("w")))
