"""The ledger store, its filters, the stream that records in it, and the page store."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from siftpage.operators.bloom import bloom_rows, bucket_of, possible
from siftpage.operators.ledger import ledger_upsert, pick_new
from siftpage.plans import run as plans_run
from siftpage.plans.run import StoredRun
from siftpage.sources import ledger_store, page_store, shared_files
from siftpage.sources.ledger_store import LedgerStore
from siftpage.sources.page_store import PageStore
from siftpage.streaming.pickup import classified_updates, record_stream
from tools.check import compare, connect

AT = "2024-01-01 00:00:00"


def rows(spark, items):
    """(url, label, status, second) as updates."""
    df = spark.createDataFrame(items, "url string, label string, scrape_status string, s int")
    return df.withColumn("last_updated", F.lit(AT).cast("timestamp") + F.make_interval(secs="s")).drop("s")


def content(df):
    return sorted((r["url"], r["label"], r["scrape_status"]) for r in df.collect())


def stamps(root):
    return {
        f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(f"{root}/data") for n in names if n.endswith("parquet")
    }


def test_an_upsert_leaves_untouched_buckets_alone(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "l"), buckets=8)
    first = rows(spark, [(f"u{i}", "list", "pending", i) for i in range(60)])
    assert store.read().count() == 0 and store.upsert(first) == 1
    before, old = stamps(store.root), store.manifest()
    assert sum(n for _, n in old["files"].values()) == 60 and len(old["files"]) == 8
    change = rows(spark, [("u3", None, "success", 99), ("u3", "detail", None, 98), (None, "x", "y", 1), ("new", "list", "failed", 5)])
    assert store.upsert(change) == 2
    new = store.manifest()
    touched = {str(r[0]) for r in change.filter("url is not null").select(bucket_of(F.col("url"), 8)).collect()}
    assert {b for b in new["files"] if new["files"][b] != old["files"].get(b)} == touched
    after = stamps(store.root)
    assert all(after[f] == t for f, t in before.items())
    want = ledger_upsert(first, change.filter("url is not null"))
    assert content(store.read()) == content(want)
    # an older version stays readable
    assert content(store.read(1)) == content(first)
    assert store.vacuum(keep=1) == 0
    store.upsert(first)  # all buckets anew
    assert store.vacuum(keep=1) == 2 and store.read().count() == 61


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    store = LedgerStore(spark, str(tmp_path / "l"), buckets=4)
    store.upsert(rows(spark, [("a", "list", "pending", 1)]))

    def die(*_):
        raise OSError("killed")

    monkeypatch.setattr(ledger_store, "publish_json", die)
    with pytest.raises(OSError):
        store.upsert(rows(spark, [("a", "detail", "success", 2)]))
    monkeypatch.undo()
    assert store.versions() == [1] and content(store.read()) == [("a", "list", "pending")]
    assert store.upsert(rows(spark, [("a", "others", "failed", 3)])) == 2
    assert content(store.read()) == [("a", "others", "failed")]


def test_a_version_is_made_once(spark, tmp_path, monkeypatch):
    one, two = (LedgerStore(spark, str(tmp_path / "l"), buckets=4) for _ in range(2))
    one.upsert(rows(spark, [("a", "list", "pending", 1)]))
    stale = two.manifest()
    one.upsert(rows(spark, [("b", "list", "pending", 1)]))
    monkeypatch.setattr(two, "manifest", lambda version=None: stale)
    with pytest.raises(shared_files.VersionTaken):
        two.upsert(rows(spark, [("c", "list", "pending", 1)]))
    monkeypatch.undo()
    assert [r[0] for r in content(two.read())] == ["a", "b"]
    assert not [n for n in os.listdir(tmp_path / "l" / "manifest") if n.endswith(".part")]


def test_new_columns_and_empty_updates(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "l"), buckets=4)
    store.upsert(rows(spark, [("a", "list", "pending", 1)]))
    more = rows(spark, [("b", "list", "pending", 1)]).withColumn("note", F.lit("n"))
    store.upsert(more)
    assert {(r["url"], r["note"]) for r in store.read().collect()} == {("a", None), ("b", "n")}
    assert store.upsert(more.limit(0)) == 3 and store.read().count() == 2


def test_filters_let_nothing_through_that_is_there(spark):
    values = spark.range(20_000).select(F.concat(F.lit("https://x/"), "id").alias("url")).withColumn("bucket", bucket_of(F.col("url"), 4))
    sizes = values.groupBy("bucket").agg((F.ceil(F.count("*") / 32)).alias("blocks"))
    blooms = bloom_rows(values, "url", sizes).cache()
    seen = possible(values.select("url", F.lit(1).alias("w0")), "url", blooms, sizes, 4)
    assert seen.count() == seen.filter("_possible").count() == 20_000
    absent = spark.range(20_000, 60_000).select(F.concat(F.lit("https://x/"), "id").alias("url"))
    wrong = possible(absent, "url", blooms, sizes, 4).filter("_possible").count()
    assert 0 < wrong < 40_000 * 0.004
    assert possible(absent, "url", blooms.limit(0), sizes.limit(0), 4).filter("_possible").count() == 0
    blooms.unpersist()


def test_pick_up_equals_the_anti_join(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "l"), buckets=8)
    status = ("success", "failed", "skipped", "pending")
    store.upsert(rows(spark, [(f"u{i}", "list", status[i % 4], i) for i in range(800)]))
    store.upsert(rows(spark, [(f"u{i}", None, "pending", 9000) for i in range(0, 100, 4)]))  # no longer finished
    urls = spark.createDataFrame([(f"u{i}", i, 7) for i in range(700, 3000)] + [("u0", 0, 7), ("u1", 1, 7), ("u1", 1, 7), (None, 2, 7)], "url string, n int, w0 int")
    found = store.pick_new(urls)
    assert found.columns == urls.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, pick_new(urls, store.read()).collect()))
    tested = store.tested(urls)
    # of some 2,300 new URLs next to none meets the ledger
    joined = tested.filter("_possible").count()
    assert joined <= urls.count() - found.count() + 25
    empty = LedgerStore(spark, str(tmp_path / "none"))
    assert empty.pick_new(urls).count() == urls.count()


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>a</p>") for i in range(12)] + [(99, None, "x")], "page_id bigint, url string, html string")
    pages.repartition(4).write.parquet(source)
    store = LedgerStore(spark, str(tmp_path / "l"), buckets=4)
    verdict = F.struct(F.when(F.col("page_id") % 2 == 0, "list").otherwise("detail").alias("label"))
    runs = []

    def classify(batch):
        runs.append(1)
        return batch.select("page_id", "url", F.when(F.col("page_id") % 3 != 0, verdict).alias("verdict"))

    def run():
        at = F.lit(AT).cast("timestamp")
        record_stream(spark, source, store, str(tmp_path / "out"), mark, classify, at, files_per_batch=2).awaitTermination()

    run()
    assert store.versions() == [1, 2] and len(runs) == 2
    batch = classified_updates(classify(pages), F.lit(AT).cast("timestamp"))
    assert content(store.read()) == content(batch) and store.read().count() == 12
    # the last batch is not marked as done: it is run again, as after a kill, and is in the ledger already
    before = stamps(store.root)
    for name in ("1", ".1.crc"):
        if os.path.exists(f"{mark}/commits/{name}"):
            os.remove(f"{mark}/commits/{name}")
    run()
    assert len(runs) == 4 and store.versions() == [1, 2] and stamps(store.root) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 13


def test_pages_are_found_by_the_manifest(spark, tmp_path, monkeypatch):
    store = PageStore(spark, str(tmp_path / "s"))
    schema = "url string, label string, html string"
    assert store.index().count() == 0 and store.read(store.index()).count() == 0
    store.add(spark.createDataFrame([("http://a/1", "list", "<p>1"), ("http://a/2", None, None)], schema))
    store.add(spark.createDataFrame([("http://a/3", "list", "<p>3")], schema))
    done = spark.createDataFrame([("http://a/1",), ("http://a/2",)], "url string")
    wanted = store.pending(done)
    # only the second segment is opened: the first may even be gone
    first = wanted.select("place").distinct().collect()
    assert len(first) == 1
    for name in os.listdir(f"{store.root}/segments"):
        if name != first[0][0]:
            shutil.move(f"{store.root}/segments/{name}", tmp_path / name)
    assert [(r["url"], r["html"]) for r in store.read(wanted).collect()] == [("http://a/3", "<p>3")]

    listed = []
    plain = page_store.names
    monkeypatch.setattr(page_store, "names", lambda s, folder: listed.append(folder) or plain(s, folder))
    store.read(store.pending(done)).collect()
    assert {x.rpartition("/")[2] for x in listed} == {"manifest"}


def test_a_crawlers_tree_is_listed_once_for_each_label(spark, tmp_path):
    for label, key, data in (("list", "k1", b"<p>\xff</p>"), ("list", "k2", b"two"), ("others", "k3", b"three")):
        where = tmp_path / "tree" / label / key
        where.mkdir(parents=True)
        (where / "raw.html").write_bytes(data)
    known = spark.createDataFrame([("http://x/1", "k1"), ("http://x/2", "k2"), ("http://y/2", "k2")], "url string, key string")
    store, tree = PageStore(spark, str(tmp_path / "s")), str(tmp_path / "tree")
    store.adopt(tree, "list", known)
    store.adopt(tree, "others", known)
    store.adopt(tree, "list", known)  # again: in place of the first
    assert store.index().count() == 4
    got = {(r["url"], r["html"]) for r in store.read(store.pending(known.limit(0))).collect()}
    assert got == {("http://x/1", "<p>�</p>"), ("http://x/2", "two"), ("http://y/2", "two")}
    one = store.pending(spark.createDataFrame([("http://x/1",), ("http://y/2",)], "url string"))
    assert [(r["url"], r["label"]) for r in store.read(one).collect()] == [("http://x/2", "list")]


def test_steps_of_a_run_do_nothing_twice(spark, tmp_path):
    run = StoredRun(spark, str(tmp_path / "r"), F.lit(AT).cast("timestamp"), buckets=4)
    urls = spark.createDataFrame([(f"http://x/{i}", "list", i) for i in range(6)], "url string, label string, row int")
    html = "<title>A</title><p>" + "some words of a page " * 20
    results = spark.createDataFrame([(f"http://x/{i}", html if i % 3 else None, None if i % 3 else "timeout") for i in range(6)] + [("http://unknown", html, None)], "url string, html string, reason string")

    def ledger():
        return sorted((r["url"], r["scrape_status"], r["extract_status"]) for r in run.ledger.read().collect())

    run.intake(urls)
    run.fetched(results)
    run.extracted()
    once = ledger()
    assert [s for _, s, _ in once].count("failed") == 2 and [e for _, _, e in once].count("success") == 4 and len(once) == 6
    run.fetched(results)
    run.extracted()
    run.intake(urls)  # failed ones are finished too
    assert ledger() == once and run.pages.index().count() == 4 and run.features().count() == 4
    counts = {r[0]: r for r in run.status().collect()}
    assert counts


@pytest.fixture(scope="module")
def shared_urls(spark, folder, tmp_path_factory):
    """The smallest tables, where pages share URLs: with pages finished and not, of the same and of another label."""
    root = str(tmp_path_factory.mktemp("shared"))
    for name in os.listdir(folder):
        if name != "pages.parquet":
            os.symlink(f"{folder}/{name}", f"{root}/{name}")
    url = (
        F.when(F.col("page_id").isin(1, 2, 7, 16, 31), "https://x.example.com/shared/1#top")
        .when(F.col("page_id").isin(6, 21), "https://x.example.com/two/#12")
        .when(F.col("page_id") == 11, "https://x.example.com/two/")
    )
    pages = spark.read.parquet(f"{folder}/pages.parquet").withColumn("url", F.coalesce(url, "url"))
    pages.coalesce(1).write.parquet(f"{root}/written")
    part = next(n for n in os.listdir(f"{root}/written") if n.endswith(".parquet"))
    shutil.copy(f"{root}/written/{part}", f"{root}/pages.parquet")
    return root


@pytest.mark.parametrize("name", ["page_store_pickup", "stream_ledger"])
def test_pages_that_share_a_url_stay_pages_of_their_own(spark, shared_urls, name):
    assert compare(spark, connect(shared_urls), shared_urls, name).startswith("ok")


def test_a_run_predicts_from_the_features_that_it_stored(spark, tmp_path, monkeypatch):
    run = StoredRun(spark, str(tmp_path / "r"), F.lit(AT).cast("timestamp"), buckets=4)
    body = "<body><article><h1>A</h1><p>" + "some words of a page " * 20 + "</p></article></body>"
    pages = [(f"http://x/{i}", None if i == 5 else " " if i == 4 else body + str(i)) for i in range(6)]
    run.intake(spark.createDataFrame([(u, "list", i) for i, (u, _) in enumerate(pages)], "url string, label string, row bigint"))
    run.fetched(spark.createDataFrame([(u, h, None) for u, h in pages], "url string, html string, reason string"))
    run.extracted()
    given = []
    parse = plans_run.parsed_pages
    monkeypatch.setattr(plans_run, "parsed_pages", lambda p, *a, **k: (given.append(p.count()), parse(p, *a, **k))[1])

    def direct(jsonld):
        html = run.pages.read(run.pages.index()).select(F.xxhash64("url").alias("page_id"), "url", "html")
        rows = parse(html, jsonld)
        return {tuple(map(str, r)) for r in rows.collect()}, rows.columns

    for jsonld, parsed in ((False, 0), (True, 5)):
        expected, columns = direct(jsonld)
        assert {tuple(map(str, r)) for r in run.parsed(jsonld).select(*columns).collect()} == expected and len(expected) == 5
        assert given.pop() == parsed
    # a page that changed is parsed, the others are not
    run.pages.add(spark.createDataFrame([("http://x/0", "list", body + "new")], "url string, label string, html string"))
    expected, columns = direct(False)
    assert {tuple(map(str, r)) for r in run.parsed().select(*columns).collect()} == expected and len(expected) == 6
    assert given.pop() == 1
