"""Sources and sinks, a training run, and the stream against the batch."""

import os

from pyspark.sql import functions as F

from siftpage.operators.features import FEATURE_COLUMNS
from siftpage.operators.ledger import pick_new, register
from siftpage.operators.model import forest, importance
from siftpage.operators.rules import pre_classify
from siftpage.plans.classify import evaluate, features_and_verdict, predict, train
from siftpage.sources import files
from siftpage.sources.decorated import decorated_pages
from siftpage.streaming.pickup import classify_stream


def test_url_tables(spark, tmp_path):
    path = tmp_path / "urls.csv"
    path.write_text("url,label\n http://a , LIST\n,detail\nhttp://b,blog\nhttp://c,others\n")
    good, bad = files.labelled_urls(spark, str(path))
    assert sorted((r.url, r.label) for r in good.collect()) == [
        ("http://a", "list"), ("http://c", "others"),
    ]
    assert sorted(r.reason for r in bad.collect()) == ["empty_url", "invalid_label"]
    path.write_text("URL,x\nhttp://a,1\n  ,2\n")
    assert [r.url for r in files.batch_urls(spark, str(path)).collect()] == ["http://a"]


def test_raw_pages(spark, tmp_path):
    for label, key, data in (("list", "k1", b"<p>\xff</p>"), ("others", "k2", b"ok")):
        where = tmp_path / label / key
        where.mkdir(parents=True)
        (where / "raw.html").write_bytes(data)
        (where / "page.json").write_text("{}")
    rows = {r.key: (r.label, r.html) for r in files.raw_pages(spark, str(tmp_path)).collect()}
    assert rows == {"k1": ("list", "<p>�</p>"), "k2": ("others", "ok")}


def test_ledger_versions(spark, tmp_path):
    root = str(tmp_path / "ledger")
    empty = files.read_ledger(spark, root, None)
    urls = spark.createDataFrame([("http://a/", "list", 1), ("http://a/", "detail", 2)],
                                 "url string, label string, row int")
    assert pick_new(urls, empty).count() == 2
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    files.write_ledger(register(urls, at), root, 1)
    row = files.read_ledger(spark, root, 1).first()
    assert (row.label, row.scrape_status, row.key[:3]) == ("detail", "pending", "a__")


def test_train_predict_evaluate(spark, folder, tmp_path):
    pages = decorated_pages(spark, folder)
    stored = str(tmp_path / "features")
    both = features_and_verdict(pages)
    files.write_table(both.withColumn("url", F.concat("url", F.lit("#"), "page_id")), stored)
    features = files.read_features(spark, stored)
    label = F.element_at(F.array(F.lit("list"), F.lit("detail"), F.lit("others")),
                         (F.col("page_id") % 3 + 1).cast("int"))
    ledger = features.select(
        "url", F.col("page_id").cast("string").alias("key"), label.alias("label"),
        F.lit("success").alias("scrape_status"), F.lit("success").alias("extract_status"),
    )
    model, samples = train(ledger, features, classifier=forest(trees=5, depth=3))
    sizes = samples.groupBy("is_test").count().collect()
    assert {r.is_test: r["count"] for r in sizes} == {False: 41, True: 9}
    verdicts = evaluate(samples, model).collect()
    assert len(verdicts) == 9 and all(r.full_label for r in verdicts)
    assert importance(model, spark).count() == len(FEATURE_COLUMNS)
    model.write().overwrite().save(str(tmp_path / "model"))
    blank = spark.createDataFrame([(999, "http://blank", "  ")], "page_id bigint, url string, html string")
    out = {r.page_id: r for r in predict(pages.unionByName(blank), model).collect()}
    assert len(out) == 51 and out[999].status == "scrape_failed" and out[999].confidence == 0.0
    for r in out.values():
        if r.pre_confidence and r.pre_confidence >= 0.95:
            assert r.tiebreaker == "absolute_rule"


def test_grid_search_uses_macro_f1(spark):
    from pyspark.ml.tuning import ParamGridBuilder

    from siftpage.operators.model import fit, score, split

    rows = [(i, f"http://x/{i}", f"k{i}", ("detail", "list", "others")[i % 3], float(i % 3), 1)
            for i in range(60)]
    df = spark.createDataFrame(
        rows, "page_id int, url string, key string, label string, word_count double, content_available int"
    )
    samples = split(df)
    # a tree of depth 0 knows one class of three, so the settings can't tie
    learner = forest(trees=9, depth=2)
    grid = ParamGridBuilder().addGrid(learner.maxDepth, [0, 3]).build()
    train = samples.filter("not is_test")
    model = fit(train, ("word_count", "content_available"), grid, learner)
    low, high = model.stages[-1].grid_scores
    assert low < 0.5 < high
    assert model.stages[-1].getMaxDepth() == 3
    scored = score(samples.filter("is_test"), model)
    assert scored.filter("ml_label = label").count() == scored.count() == 12
    again = fit(train.repartition(5), ("word_count", "content_available"), grid, learner)
    assert again.stages[-1].toDebugString == model.stages[-1].toDebugString


def test_stream_equals_batch(spark, folder, tmp_path):
    pages = decorated_pages(spark, folder)
    source = str(tmp_path / "in")
    pages.repartition(6).write.parquet(source)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        classify_stream(spark, source, out, mark, pre_classify, 2).awaitTermination()

    run()
    run()  # nothing new: nothing is classified twice
    got = spark.read.parquet(out)
    batch = pre_classify(pages)
    assert got.count() == batch.count() == 50
    assert sorted(map(str, got.select("page_id", "verdict").collect())) == sorted(
        map(str, batch.select("page_id", "verdict").collect())
    )
    assert os.path.isdir(mark)


def test_full_prediction_parses_each_page_once(spark, folder, monkeypatch):
    from siftpage.operators import model as M
    from siftpage.plans import queries
    from siftpage.plans.classify import predict

    plain, fit, calls, models = queries.decorated_pages, M.fit, [], []
    monkeypatch.setattr(queries, "decorated_pages", lambda *a: calls.append(a) or plain(*a))
    monkeypatch.setattr(M, "fit", lambda train: models.append(fit(train, classifier=M.forest(5, 3))) or models[0])
    got = queries.full_prediction(spark, folder)
    assert len(calls) == 1
    whole = predict(plain(spark, folder), models[0]).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
