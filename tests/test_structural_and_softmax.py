"""Structural joins, joint softmax boosting, and sinks and reports that had no test."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftpage.operators.evaluate import export_rows
from siftpage.operators.html import elements
from siftpage.operators.model import fit_boosted, purge_stale, split, stale_features, training_report
from siftpage.operators.snapshot import forms_table, snapshot
from siftpage.operators.softmax import SoftmaxTrees, fit_softmax, score_softmax
from siftpage.operators.structural import breadcrumb_items, descendants, form_fields
from siftpage.plans.views import register_views
from siftpage.sources import files

PAGE = "page_id bigint, url string, html string"


# ---- structural join ------------------------------------------------------------------------


def test_pairs_are_those_of_the_range_join(spark):
    html = [
        "<div><ul><li>a<li><div><ul><li>b</ul></div></ul></div><p>c<div>d",
        "</div></p><div></div><div><span><div><div>x</div></span></div>",
        "",
        "<div>" * 300 + "deep",
    ]
    table = elements(spark.createDataFrame([(i, "http://x", h) for i, h in enumerate(html)], PAGE)).cache()
    outer = table.filter("tag IN ('div', 'ul')")
    got = {tuple(r) for r in descendants(outer, table).select("page_id", "ancestor", "eid").collect()}
    a, d = outer.alias("a"), table.alias("d")
    on = (F.col("a.page_id") == F.col("d.page_id")) & (F.col("a.start") < F.col("d.start")) & (F.col("d.start") < F.col("a.stop"))
    want = {tuple(r) for r in a.join(d, on).select("a.page_id", F.col("a.eid").alias("ancestor"), "d.eid").collect()}
    assert got == want and len(got) > 40_000
    near = descendants(outer, table).filter("level = 1").groupBy("page_id", "eid").count().filter("count > 1")
    assert near.count() == 0
    assert descendants(outer.limit(0), table).count() == descendants(outer, table.limit(0)).count() == 0
    table.unpersist()


def test_form_fields_equal_the_snapshots(spark):
    html = [
        '<form action="/a" METHOD=Post><div><input name=q required><select><option>x</select></div></form><input name=out>',
        "<form></form><form><textarea placeholder=p></textarea><noscript><input name=n></noscript></form>",
        "<p>none</p>",
        '<form action="/open"><input type=hidden>',
    ]
    pages = spark.createDataFrame([(i, "http://x", h) for i, h in enumerate(html)], PAGE)
    want = sorted(map(tuple, forms_table(snapshot(pages)).collect()), key=str)
    assert sorted(map(tuple, form_fields(elements(pages, raw=True)).collect()), key=str) == want and len(want) >= 6


def test_breadcrumbs(spark):
    html = [
        '<nav aria-label="Breadcrumb"><a>1</a></nav><ol class="x BreadCrumbs"><li><a>a</a><li><span>b</span></ol>',
        '<nav aria-label="breadcrumb"><a>1</a><a>2</a></nav>',
        "<p>none</p>",
    ]
    pages = spark.createDataFrame([(i, "http://x", h) for i, h in enumerate(html)], PAGE)
    got = {r[0]: r[1] for r in breadcrumb_items(elements(pages)).collect()}
    assert got == {0: 4, 1: 2, 2: 0}


def test_views(spark):
    pages = spark.createDataFrame(
        [(1, "http://x/a", "<title>T</title><h1>H</h1><form><input name=q></form><a href='/b'>b</a><img src=c.png><meta name=k content=v>"), (2, "http://x/b", None)], PAGE
    )
    names = register_views(pages, "v_")
    assert len(names) == 12 and all(spark.table(n).columns for n in names)
    assert spark.sql("SELECT tag FROM v_elements WHERE page_id = 1 AND attrs['name'] = 'q'").first()[0] == "input"
    joined = spark.sql("SELECT e.tag FROM v_inside i JOIN v_elements e ON e.page_id = i.page_id AND e.eid = i.eid WHERE i.level = 1 AND e.tag = 'input'")
    assert joined.count() == 1
    counts = {n: spark.table(n).count() for n in ("v_links", "v_images", "v_forms", "v_headings", "v_meta", "v_snapshots", "v_page_text")}
    assert counts == {"v_links": 1, "v_images": 1, "v_forms": 1, "v_headings": 1, "v_meta": 1, "v_snapshots": 2, "v_page_text": 2}


# ---- joint softmax --------------------------------------------------------------------------


def samples(spark, n=200):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3)).round(3)
    label = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.4, "list", np.where(x[:, 2] > 0, "detail", "others"))
    rows = [(f"k{i}", *map(float, v), str(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))]
    return spark.createDataFrame(rows, "key string, fa double, fb double, fc double, label string")


def leaf_of(node, x):
    while isinstance(node, list):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def test_softmax_equals_numpy(spark, tmp_path):
    train = samples(spark)
    model = fit_softmax(train, str(tmp_path / "m"), ("fa", "fb", "fc"), rounds=6, depth=3, rate=0.4)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:], strict=False)) and model.losses[-1] < 0.5
    rows = train.collect()
    x = np.array([[r["fa"], r["fb"], r["fc"]] for r in rows])
    y = np.array([model.labels.index(r["label"]) for r in rows])
    m = np.log(np.bincount(y) / len(y))[None, :].repeat(len(y), 0)
    for trees, loss in zip(model.rounds, model.losses, strict=True):
        p = np.exp(m - m.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        step = np.zeros_like(m)
        for k, (node, values) in enumerate(trees):
            r = (y == k) - p[:, k]
            leaf = np.array([leaf_of(node, v) for v in x])
            for j, value in enumerate(values):
                own = leaf == j
                want = 2 / 3 * r[own].sum() / max((abs(r[own]) * (1 - abs(r[own]))).sum(), 1e-9) if own.any() else 0.0
                assert value == pytest.approx(want, rel=1e-9, abs=1e-12)
                step[own, k] = value
        m += 0.4 * step
        p = np.exp(m - m.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        assert loss == pytest.approx(-np.log(p[np.arange(len(y)), y]).mean(), rel=1e-9)
    scored = {r["key"]: r for r in score_softmax(train, model).collect()}
    for i, r in enumerate(rows):
        got = scored[r["key"]]
        assert sum(got["probabilities"].values()) == pytest.approx(1, abs=1e-5)
        assert [got["probabilities"][c] for c in model.labels] == pytest.approx(p[i].tolist(), abs=1e-6)
        assert got["ml_label"] == model.labels[int(p[i].argmax())] and got["ml_confidence"] == pytest.approx(p[i].max(), abs=1e-4)
    assert sum(scored[r["key"]]["ml_label"] == r["label"] for r in rows) > 190
    model.save(spark, str(tmp_path / "model.json"))
    again = SoftmaxTrees.load(spark, str(tmp_path / "model.json"))
    odd = spark.createDataFrame([(1, None, 0.5), (2, 3.0, None)], "id int, fa double, fb double")
    assert [tuple(r) for r in score_softmax(odd, again).collect()] == [tuple(r) for r in score_softmax(odd, model).collect()]


def test_boosted_report_names_every_learner(spark):
    train = split(samples(spark).withColumn("url", F.concat(F.lit("http://x/"), "key")).withColumn("content_available", F.lit(1)))
    model = fit_boosted(train.filter("not is_test"), ("fa", "fb", "fc"), rounds=2, depth=2)
    scored = train.withColumn("ml_label", F.col("label"))
    parameters = training_report(train, scored, model)["parameters"].collect()
    assert {r["learner"] for r in parameters} == {0, 1, 2}
    assert {r["value"] for r in parameters if r["name"] == "maxIter"} == {"2"}


# ---- sinks and upkeep without a test --------------------------------------------------------


def test_stale_features_go(spark):
    ledger = spark.createDataFrame(
        [("u1", "k", "list", "success", "success"), ("u2", "k", "list", "success", "failed"), ("u3", "k", "list", None, None), ("u4", None, "list", "failed", None)],
        "url string, key string, label string, scrape_status string, extract_status string",
    )
    features = spark.createDataFrame([(f"u{i}", i) for i in range(1, 6)] + [("u2", 22)], "url string, word_count int")
    assert sorted(r["word_count"] for r in stale_features(ledger, features).collect()) == [2, 3, 22]
    assert sorted(r["word_count"] for r in purge_stale(ledger, features).collect()) == [1, 4, 5]


def test_prediction_rows(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "list", "success"), ("u2", "others", "scrape_failed")], "url string, predicted_label string, s string")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    made = files.prediction_rows(rows, at, F.col("s")).drop("s")
    files.write_predictions(made, str(tmp_path / "p"))
    got = {r["url"]: r for r in spark.read.parquet(str(tmp_path / "p")).collect()}
    assert got["u1"]["files"] == ["raw.html", "features.json", "prediction.json"] and got["u2"]["files"] == ["prediction.json"]
    assert got["u2"]["status"] == "scrape_failed" and got["u1"]["predicted_at"].year == 2024


def test_evaluation_is_written(spark, tmp_path, folder):
    import __spark_entry__ as entry

    table = entry.queries()["evaluation_export"](spark, folder)
    files.write_csv(table, str(tmp_path / "e"))
    back = spark.read.option("header", True).csv(str(tmp_path / "e"))
    assert back.count() == table.count() > 0 and back.columns == table.columns
    assert callable(files.write_evaluation) and callable(export_rows)
    assert math.isfinite(back.count())
