"""Real-world HTML, hostile input, whole texts, repeated keys, stores and boosted models."""

import time

import pytest
from pyspark.sql import functions as F

from siftpage.functions.jsonld import types_of
from siftpage.operators import model as model_operators
from siftpage.operators import nesting
from siftpage.operators.features import FEATURE_COLUMNS, features
from siftpage.operators.html import page_text
from siftpage.operators.ledger import ledger_upsert
from siftpage.operators.model import (
    fit_boosted,
    forest,
    fit,
    importance,
    load_model,
    misclassified_test,
    permutation_importance,
    save_model,
    score,
    split,
    training_report,
)
from siftpage.operators.reports import feature_lookup, url_list, warnings
from siftpage.operators.decide import skip_done
from siftpage.operators.snapshot import snapshot
from siftpage.session import checkpoint_dir
from siftpage.sources import files
from siftpage.sources.decorated import decorated_pages

PAGE = "page_id bigint, url string, html string"


@pytest.mark.parametrize(
    ("html", "body"),
    [
        ("<!-- <script> old --><p>Visible one</p><script>x</script><p>two</p>", "Visible one two"),
        ("<p>A</p><!-- <noscript> --><p>kept text</p>", "A kept text"),
        ('<p title="<style>">attr</p><p>after</p>', "attr after"),
        ("<!-- <div><script>1</script> --><p>a</p><noscript><p>off</p></noscript><p>b</p>", "a b"),
        ("<p>a</p><script>if (a < b) { '</p>' }</script><scripted>b</scripted>", "a b"),
        ("<p>a</p><style>never closed", "a"),
    ],
)
def test_code_is_found_where_it_begins(spark, html, body):
    page = spark.createDataFrame([(1, "http://x/", html)], PAGE)
    assert page_text(page).first()["body"] == body
    assert snapshot(page).first()["body_text"].split() == body.split()


def test_nesting_is_linear():
    codes = ["b"] * 100_000 + ["/i"] * 100_000
    start = time.process_time()
    nesting._nest_page(codes, [0] * len(codes), {name: [] for name in nesting.NODE_FIELDS})
    assert time.process_time() - start < 10


def test_whole_texts(spark):
    late = "word " * 12_000 + "per page view all results"
    links = "".join(f'<a href="/{i}{"x" * 600}">{"t" * 300}{i}</a>' for i in range(3))
    html = f"<body><p>{late}</p>{links}</body>"
    page = spark.createDataFrame([(1, "http://x/a/b/c/d/e", html)], PAGE)
    row = features(page).first()
    assert row["list_cue_word_hits"] > 0 and row["url_path_depth"] == 5
    snap = snapshot(page).first()
    assert len(snap["body_text"]) > 60_000 and len(snap["links"][0]["href"]) == 602
    assert len(snap["links"][0]["text"]) == 301


def test_jsonld_walk():
    assert types_of('{"a":{"@type":"In"},"@type":"Out"}') == ["Out", "In"]
    assert types_of('[{"@type":["A","B"]},{"x":[{"@type":"\\u0043"}]}]') == ["A", "B", "C"]
    assert types_of("{broken") == [] and types_of("3") == []


def test_repeated_updates(spark):
    ledger = spark.createDataFrame([("a", "x", None)], "url string, label string, last_updated timestamp")
    updates = spark.sql(
        "SELECT * FROM VALUES ('a', 'y', timestamp'2024-01-01'), ('a', 'z', timestamp'2024-01-02'),"
        " ('a', NULL, timestamp'2024-01-03'), ('b', 'n', timestamp'2024-01-01') AS t(url, label, last_updated)"
    )
    assert {(r["url"], r["label"]) for r in ledger_upsert(ledger, updates).collect()} == {("a", "z"), ("b", "n")}
    assert ledger_upsert(ledger, updates).count() == 2
    assert ledger_upsert(ledger, updates.drop("last_updated")).count() == 2


def test_split_keeps_keys_together(spark):
    rows = [(f"k{i % 40}", "list") for i in range(400)]
    sides = split(spark.createDataFrame(rows, "key string, label string")).groupBy("key").agg(
        F.countDistinct("is_test", "fold").alias("n"), F.countDistinct("is_test").alias("s")
    )
    assert sides.filter("s > 1").count() == 0


def test_reports(spark):
    rows = [(f"u{i}", "k", "list" if i % 7 else "rare", "success", "success") for i in range(70)]
    ledger = spark.createDataFrame(
        rows, "url string, key string, label string, scrape_status string, extract_status string"
    )
    listed = [(r["label"], r["url"]) for r in url_list(ledger).collect()]
    assert listed == sorted(listed) and len(listed) == 70
    assert {(r["issue"], r["n"]) for r in warnings(ledger, low=11).collect()} == {("class_imbalance", 60), ("few_samples", 10)}


def test_skip_by_url_not_by_short_key(spark):
    urls = spark.createDataFrame([("k", "u1"), ("k", "u2")], "key string, url string")
    done = spark.createDataFrame([("k", "u1", "success")], "key string, url string, status string")
    assert [r["url"] for r in skip_done(urls, done, ("success",)).collect()] == ["u2"]


def test_checkpoint_folder_must_be_shared():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_stores(spark, folder, tmp_path):
    for label, key in (("list", "k1"), ("detail", "k2")):
        (tmp_path / "raw" / label / key).mkdir(parents=True)
        (tmp_path / "raw" / label / key / "raw.html").write_text(f"<p>{key}</p>")
    (tmp_path / "raw" / "list" / "k1" / "page.json").write_text("{}")
    known = spark.createDataFrame([("k1", "http://x/1")], "key string, url string")
    got = {(r["key"], r["label"], r["url"]) for r in files.predicted_pages(spark, str(tmp_path / "raw"), known).collect()}
    assert got == {("k1", "list", "http://x/1"), ("k2", "detail", None)}
    stored = {(r["key"], tuple(r["files"])) for r in files.stored_files(spark, str(tmp_path / "raw")).collect()}
    assert stored == {("k1", ("page.json", "raw.html")), ("k2", ("raw.html",))}
    snaps = snapshot(decorated_pages(spark, folder))
    for as_json in (False, True):
        path = str(tmp_path / f"snap-{as_json}")
        files.write_snapshots(snaps, path, as_json)
        back = files.read_snapshots(spark, path, snaps.schema if as_json else None)
        assert back.count() == snaps.count() == 50
        assert back.filter("size(links) > 0 AND counts.links = size(links)").count() > 0
    rows = spark.createDataFrame([("u", "list", "detail", 0.4)], "url string, actual string, predicted string, confidence double")
    files.write_misclassified(rows, str(tmp_path / "wrong"))
    assert spark.read.option("header", True).csv(str(tmp_path / "wrong" / "by_class")).first()["actual"] == "list"
    done = spark.createDataFrame([("u", "list")], "url string, predicted_label string")
    files.write_predictions(done, str(tmp_path / "predictions"))
    assert spark.read.parquet(str(tmp_path / "predictions")).first()["predicted_label"] == "list"


def test_feature_lookup(spark):
    ledger = spark.createDataFrame([("http://x/1", "k1", "list")], "url string, key string, label string")
    stored = spark.createDataFrame([("k1", 7)], "key string, word_count int")
    predicted = spark.createDataFrame([("k9", 8)], "key string, word_count int")
    assert feature_lookup("http://x/1", ledger, stored, predicted).first()["word_count"] == 7
    assert feature_lookup("http://x/2", ledger, stored, predicted).count() == 0


@pytest.fixture(scope="module")
def samples(spark):
    rows = [
        (i, f"http://x/{i}", f"k{i}", ("detail", "list", "others")[i % 3], float(i % 3) + (i % 5) / 50, float(i % 7), 1)
        for i in range(120)
    ]
    df = spark.createDataFrame(
        rows,
        "page_id int, url string, key string, label string, word_count double, total_links double, content_available int",
    )
    return split(df).cache()


USED = ("word_count", "total_links", "content_available")


def test_boosted(spark, samples, tmp_path):
    model = fit_boosted(samples.filter("not is_test"), USED, rounds=5, depth=2)
    scored = score(samples.filter("is_test"), model)
    assert scored.filter("ml_label = label").count() == scored.count() > 0
    sums = scored.select(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert sums.filter("abs(s - 1) > 0.001").count() == 0
    losses = {r["feature"]: r["importance"] for r in permutation_importance(samples.filter("is_test"), model).collect()}
    assert set(losses) == set(USED) and losses["word_count"] > 0.3 and losses["content_available"] == 0
    report = training_report(samples, scored, model)
    save_model(model, str(tmp_path / "saved"), report | {"importance": importance(model, spark)})
    back, tables = load_model(spark, str(tmp_path / "saved"), ("per_class", "parameters", "importance", "top_features"))
    assert tables["per_class"].count() == 3 and tables["parameters"].filter("name = 'maxDepth'").first()["value"] == "2"
    assert score(samples, back).filter("ml_label <> label").count() == score(samples, model).filter("ml_label <> label").count()


def test_a_forest_loses_by_permutation_what_its_own_predictions_lose(spark, samples, monkeypatch):
    used = (*USED, "noise")
    noisy = samples.withColumn("noise", (F.col("page_id") * 7 % 11).cast("double"))
    model = fit(noisy.filter("not is_test"), used, classifier=forest(trees=15, depth=4))
    whole = noisy.withColumn("label", F.when(F.col("page_id") % 10 > 0, F.col("label")).otherwise("list"))
    monkeypatch.setattr(model_operators, "_swapped", lambda *_: pytest.fail("every pair was scored by every tree"))
    fast = {r["feature"]: r["importance"] for r in permutation_importance(whole, model).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(model_operators, "forest_arrays", lambda *_: None)
    plain = {r["feature"]: r["importance"] for r in permutation_importance(whole, model).collect()}
    assert fast == plain and fast["word_count"] > 0.2 and set(fast) == set(used)


def test_fallback_and_misclassified(spark, samples):
    model = fit(samples.filter("not is_test"), USED, classifier=forest(trees=3, depth=1))
    weak = samples.withColumns({"content_available": F.lit(0), "word_count": F.lit(1.5), "url": F.lit("http://x/search?q=1")})
    fell = score(weak, model).filter("fallback_used")
    assert fell.filter("ml_method <> 'ml_model_url_fallback'").count() == 0
    wrong = misclassified_test(score(samples, model))
    assert wrong.columns == ["url", "actual", "predicted", "confidence"]
    assert wrong.filter("actual = predicted").count() == 0


def test_features_with_jsonld(spark):
    html = '<body><script type="application/ld+json">{"a":{"@type":"Person"},"@type":"Recipe"}</script>x</body>'
    page = spark.createDataFrame([(1, "http://x/", html)], PAGE)
    on, off = features(page, jsonld=True).first(), features(page).first()
    assert on["schema_type_count"] > 0 == off["schema_type_count"]
    assert len(FEATURE_COLUMNS) == 211
