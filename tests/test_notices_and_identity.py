"""Error and challenge pages, JSON-LD blocks, and URLs that share a short key."""

import pytest
from pyspark.sql import functions as F

from siftpage.functions.url import url_id, url_key
from siftpage.operators.ledger import url_of_key
from siftpage.operators.rules import blocked_pages, pre_classify
from siftpage.operators.snapshot import pick_snapshots, snapshot
from siftpage.sources.files import with_urls

PAGE = "page_id bigint, url string, html string"
PROSE = "<p>" + "A long article about gardens and their history. " * 50 + "</p>"
#: html, error page by the rules, blocked
NOTICES = [
    (f'<title>Garden</title><script>var k="captcha";</script>{PROSE}', False, False),
    (f"<title>Garden</title>{PROSE}<p>Smoking is forbidden here. Access denied, said the guard.</p>", False, False),
    (f"<title>Garden</title><!-- captcha access denied -->{PROSE}", False, False),
    ("<title>403 Forbidden</title><h1>403 Forbidden</h1><hr>nginx", True, True),
    ("<title>Oops</title><body><p>The page has been removed.</p>", True, False),
    (f"<title>404 - Page not found</title>{PROSE}", True, False),
    (f"<title>Shop</title><h2>Sorry, this item is no longer available</h2>{PROSE}", True, False),
    ("<title>Just a moment...</title><p>Checking your browser before you go on. Ray ID: 1</p>", True, True),
    (f'<title>Check</title><form id="Challenge-Form" action="/x"></form>{PROSE}', True, True),
    (f'<title>Check</title><div class="x cf-browser-verification y"></div>{PROSE}', True, True),
    ("", False, False),
    (None, False, False),
]


def test_error_and_challenge_pages(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, (h, *_) in enumerate(NOTICES)], PAGE)
    verdicts = {r["page_id"]: r["verdict"] for r in pre_classify(pages).collect()}
    blocked = {r["page_id"]: r["blocked"] for r in blocked_pages(pages).collect()}
    for i, (_, error, block) in enumerate(NOTICES):
        assert bool(verdicts[i] and verdicts[i]["is_error_page"]) == error, NOTICES[i]
        assert bool(blocked[i]) == block, NOTICES[i]


def test_jsonld_blocks_are_those_of_real_scripts(spark):
    block = '<script type="application/ld+json">{"@type":"%s","b":{"z":1,"a":[{"@type":"In"}]}}</script>'
    html = (
        f"<!-- {block % 'Hidden'} --><div title='{block % 'Quoted'}'>x</div>{block % 'Seen'}"
        f"<noscript>{block % 'Off'}</noscript><script type='application/ld+json'>{{broken</script>"
    )
    row = snapshot(spark.createDataFrame([(1, "http://x", html)], PAGE)).select(
        "schema_org.types_found",
        F.transform("schema_org.raw", lambda v: F.to_json(v)).alias("raw"),
        F.expr("variant_get(schema_org.raw[0], '$.b.a[0][\"@type\"]', 'string')").alias("deep"),
    ).first()
    assert row["types_found"] == ["Seen", "In", "Off", "In"] and row["deep"] == "In"
    assert row["raw"][0] == '{"@type":"Seen","b":{"a":[{"@type":"In"}],"z":1}}' and len(row["raw"]) == 2


@pytest.fixture
def twins(spark):
    """Two URLs of one host that share a short key: made equal here, as finding a real pair takes long."""
    rows = [("k1", "http://h/a"), ("k1", "http://h/b"), ("k2", "http://h/c")]
    return spark.createDataFrame(rows, "key string, url string")


def test_identity_is_the_whole_hash(spark):
    df = spark.createDataFrame([(" http://h/a// ",), ("http://h/a",)], "url string")
    ids = [r[0] for r in df.select(url_id(F.col("url"))).collect()]
    assert ids[0] == ids[1] and len(ids[0]) == 64
    assert df.select(url_key(F.col("url"))).first()[0].endswith(ids[0][:8])


def test_pages_that_share_a_key(spark, twins):
    stored = spark.createDataFrame([("k1", "http://h/a", ["l"]), ("k2", "http://h/c", ["l"])], "key string, url string, links array<string>")
    assert [r["url"] for r in pick_snapshots(twins, stored).collect()] == ["http://h/b"]
    # snapshots without a URL: who shares a key is rebuilt, who has it alone is not
    old = stored.drop("url")
    assert sorted(r["url"] for r in pick_snapshots(twins, old).collect()) == ["http://h/a", "http://h/b"]
    assert pick_snapshots(twins, stored, force=True).count() == 3
    found = sorted(tuple(r) for r in url_of_key(spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string"), twins).collect() if r[1])
    assert found == [("k1", "http://h/a", True), ("k1", "http://h/b", True), ("k2", "http://h/c", False)]
    raw = spark.createDataFrame([("k1", "x"), ("k2", "y"), ("k3", "z")], "key string, html string")
    looked = sorted(tuple(r) for r in with_urls(raw, twins).select("key", F.coalesce("url", F.lit("")), "ambiguous").collect())
    assert looked == [("k1", "", True), ("k2", "http://h/c", False), ("k3", "", False)]


def test_first_source_that_knows_a_key(spark, twins):
    keys = spark.createDataFrame([("k1",), ("k2",), ("k4",)], "key string")
    first = spark.createDataFrame([("k1", "http://h/a"), ("k2", None)], "key string, url string")
    found = sorted((r["key"], r["url"] or "", r["ambiguous"]) for r in url_of_key(keys, first, twins).collect())
    assert found == [("k1", "http://h/a", False), ("k2", "http://h/c", False), ("k4", "", False)]
