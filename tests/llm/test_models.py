"""Language identification, quality classifier, language model, nearest neighbours: accuracy and brute force."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siftpage.llm import kneser_ney, language_id, posting_lists, pu_quality
from siftpage.llm.common import mounted, shared_folder

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = language_id.op2_language_id(spark, SF).join(docs, "doc_id")
    rows = got.filter("held_out").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("ok")).first()
    assert rows["ok"] >= 0.98 * rows["n"] > 0
    assert got.filter("score < 0 OR score > 1").count() == 0
    assert got.count() == docs.count()


def plain_grams(text):
    """The n-grams of a text: letters in lower case, runs of anything else as one blank."""
    text = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    text = re.sub(" +", " ", text)
    return {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}


def plain_kernel(a, b):
    return len(a & b) / math.sqrt(max(1, len(a))) / math.sqrt(max(1, len(b)))


def test_language_equals_plain_kernel_ridge():
    """Kernel, ridge solution and predictions against sets and dense matrices."""
    rng = random.Random(3)
    letters = {"aa": "abcdefg éÉ", "bb": "fghijklm.ß", "cc": "mnopqr 12日"}
    text = lambda lang, n: "".join(rng.choices(letters[lang], k=n))
    marks = [(lang, text(lang, 60)) for lang in letters for _ in range(4)]
    sample = [(lang, text(lang, 40)) for lang in letters for _ in range({"aa": 9, "bb": 5, "cc": 3}[lang])]
    model = language_id.Model(sorted(letters), [language_id.grams(t) for _, t in marks])
    tests = ["", "1 2", "abc fgh mno", text("bb", 500), text("cc", 3), "ßßß", *(t for _, t in sample)]
    of_marks = [plain_grams(t) for _, t in marks]
    want = np.array([[plain_kernel(plain_grams(t), g) for g in of_marks] for t in tests])
    assert np.allclose([model.kernel(language_id.grams(t)) for t in tests], want)

    square = np.array([[plain_kernel(a, b) for b in of_marks] for a in of_marks])
    rows = np.array([[plain_kernel(plain_grams(t), g) for g in of_marks] for _, t in sample])
    language_id.solve(model, square, [lang for lang, _ in sample], rows)
    # weighted ridge in the features K^(-1/2) k, by its normal equations in full
    values, vectors = np.linalg.eigh(square)
    half = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T
    phi, names = rows @ half, np.array([lang for lang, _ in sample])
    weight = np.diag([1 / (names == n).sum() for n in names])
    y = np.where(names[:, None] == np.array(model.langs), 1.0, -1.0)
    plain = half @ np.linalg.inv(phi.T @ weight @ phi + language_id.RIDGE * np.eye(len(marks))) @ phi.T @ weight @ y
    assert np.allclose(model.weights, plain, atol=1e-6)
    which, score = model.predict(tests)
    z = np.exp(language_id.SHARPNESS * (want @ plain))
    assert which.tolist() == z.argmax(1).tolist() and np.allclose(score, (z / z.sum(1, keepdims=True)).max(1))


def test_language_long_texts(spark):
    """Two made-up scripts of 3,000 signs: a text of 300,000 signs has more n-grams than any small table of bits."""
    rng = np.random.default_rng(7)
    signs = {"aa": 0x4E00 + np.arange(3_000), "bb": 0x4E00 + 3_000 + np.arange(3_000)}
    written = lambda lang, n: "".join(map(chr, rng.choice(signs[lang], n)))
    rows = [(i, written(("aa", "bb")[i % 2], 2_000), ("aa", "bb")[i % 2]) for i in range(60)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    long = [(100 + i, written(("aa", "bb")[i % 2], 300_000), ("aa", "bb")[i % 2]) for i in range(6)]
    got = language_id.predict(spark.createDataFrame(long, "doc_id bigint, text string, lang string"), model).collect()
    assert [r["lang_pred"] for r in got] == [r["lang"] for r in got]


def test_language_odd_rows(spark):
    rows = [(1, "der und die", "de", 1.0), (2, "the and of", "en", 1.0), (3, None, "en", 1.0), (4, "", "en", 1.0), (5, "12 !", "de", 1.0), (6, "the " * 60_000, None, 1.0)]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    model = language_id.train(df)
    got = [(r["doc_id"], r["lang_pred"], r["lang"]) for r in language_id.predict(df, model).collect()]
    assert sorted(got) == sorted(
        [(1, "de", "de"), (1, "de", "de"), (2, "en", "en"), (3, "und", "en"), (4, "und", "en"), (5, "und", "de"), (6, "en", None)],
    )
    assert language_id.train(df.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.predict(df, None).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).count() == 0
    alone = language_id.train(df.filter("lang = 'de'"))
    assert language_id.predict(df.filter("doc_id = 2"), alone).first()["score"] == 1.0


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = pu_quality.op10_quality_classifier(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.join(labels, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) >= 0.95 * len(rows) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_risk():
    rng = np.random.default_rng(1)
    for shift in (0.0, 3.0):
        p, u = rng.normal(shift, 1, 7), rng.normal(-shift, 1, 5)
        value, dp, du = pu_quality.risk_gradient(p, u, 0.9)
        soft = lambda z: np.logaddexp(0, z).mean()
        negative = soft(u) - 0.9 * soft(p)
        assert math.isclose(value, 0.9 * soft(-p) + max(0, negative))
        if negative >= 0:
            e = np.eye(7)[2] * 1e-6
            slope = (pu_quality.risk_gradient(p + e, u, 0.9)[0] - value) / 1e-6
            assert abs(slope - dp[2]) < 1e-4


def test_quality_fit_steps_down_the_risk(monkeypatch):
    """The first step of the fit against slopes of the whole risk taken one weight at a time; and where the
    fit ends, against the least risk that a constant score can have."""
    rng = np.random.default_rng(2)
    good, web = rng.normal(0.5, 1, (80, pu_quality.FEATURES)), rng.normal(-0.2, 1, (90, pu_quality.FEATURES))
    good, web = good[np.lexsort(good.T)], web[np.lexsort(web.T)]
    monkeypatch.setattr(pu_quality, "STEPS", 1)
    done = pu_quality.fit(good, web, 0.6, seed=9)
    draw, f, h = np.random.default_rng(9), pu_quality.FEATURES, pu_quality.HIDDEN
    p, u = done.prepared(good), done.prepared(web)
    start = [draw.normal(0, f**-0.5, (f, h)), np.zeros(h), draw.normal(0, h**-0.5, h), np.zeros(1)]
    xp, xu = p[draw.integers(0, len(p), pu_quality.BATCH)], u[draw.integers(0, len(u), pu_quality.BATCH)]

    def risk(w):
        out = [np.tanh(x @ w[0] + w[1]) @ w[2] + w[3] for x in (xp, xu)]
        soft = lambda z: np.logaddexp(0, z).mean()
        return 0.6 * soft(-out[0]) + max(0, soft(out[1]) - 0.6 * soft(out[0])) + pu_quality.DECAY / 2 * ((w[0] ** 2).sum() + (w[2] ** 2).sum())

    checked = 0
    for i, own in enumerate(start):
        for at in list(np.ndindex(own.shape))[::7]:
            step = [x.copy() for x in start]
            step[i][at] += 1e-5
            slope = (risk(step) - risk(start)) / 1e-5
            if abs(slope) > 1e-4:
                assert np.sign(done.weights[i][at] - own[at]) == -np.sign(slope)
                checked += 1
    assert checked > 40
    monkeypatch.setattr(pu_quality, "STEPS", 300)
    end = pu_quality.fit(good, web, 0.6, seed=9).weights
    constant = min(0.6 * np.logaddexp(0, -z) + max(0, (1 - 0.6) * np.logaddexp(0, z)) for z in np.linspace(-5, 5, 400))
    assert risk(end) < constant


def test_quality_odd_rows(spark):
    rows = [(i, "plain words of a text " * 20, "x") for i in range(40)] + [(100 + i, "#$% | * " * 50, "x") for i in range(8)]
    rows += [(200, None, "x"), (201, "", "x"), (202, "long " * 100_000, "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, predicted string")
    labels = spark.createDataFrame(
        [(i, int(i < 100)) for i in [*range(20), *range(100, 106)]] + [(3, 1), (4, 0), (None, 1), (5, None)], "doc_id bigint, quality int"
    )
    model = pu_quality.train(docs.drop("predicted"), labels)
    got = {r["doc_id"]: r["score"] for r in pu_quality.score(docs, model).collect()}
    assert len(got) == len(rows) - 1 and got[200] == got[201]
    assert got[30] > got[107] and got[107] < 0.5
    assert pu_quality.train(docs.drop("predicted"), labels.limit(0)) is None
    assert {r["score"] for r in pu_quality.score(docs, None).collect()} == {0.5}
    assert pu_quality.score(docs.limit(0), model).count() == 0


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\0end"]


class Plain:
    """The same model in plain Python."""

    def __init__(self, texts):
        self.words = Counter(w for t in texts for w in t)
        self.pairs = Counter(p for t in texts for p in zip(["\0start", *t[:-1]], t, strict=True))
        self.after = Counter(w for _, w in self.pairs)
        self.upper = self.discounts(self.pairs.values())
        self.lower = self.discounts(self.after.values())
        self.context = defaultdict(lambda: [0, 0.0])
        for (u, _), n in self.pairs.items():
            self.context[u][0] += n
            self.context[u][1] += self.upper[min(n, 3)]
        self.total = sum(self.after.values())
        self.rest = sum(self.lower[min(n, 3)] for n in self.after.values()) / self.total

    @staticmethod
    def discounts(counts):
        return [0.0, *kneser_ney.discounts([sum(c == k for c in counts) for k in (1, 2, 3, 4)])]

    def probability(self, u, w):
        q = max(self.after[w] - self.lower[min(self.after[w], 3)], 0) / self.total + self.rest / (len(self.words) + 1)
        if u not in self.context:
            return q
        n, rest = self.context[u]
        seen = self.pairs[(u, w)]
        return max(seen - self.upper[min(seen, 3)], 0) / n + rest / n * q


@pytest.mark.parametrize("bucket", [24_000_000, 3_000])
def test_language_model(spark, monkeypatch, bucket):
    monkeypatch.setattr(kneser_ney, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(kneser_ney, "SLICE", 20_000)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"], "k") for r in rows] + [(-1, None, "k"), (-2, "", "k"), (-3, "The THE the " * 4_000, "k"), (-3, "The THE the " * 4_000, "k"), (-4, "x" * 70_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    plain = Plain([tokens(t) for i, t, _ in rows if not held(i)])
    everything = sum(plain.words.values())
    model = kneser_ney.train(docs.filter("crc32(string(doc_id)) % 7 <> 2"))
    got = kneser_ney.score(docs.drop("n_tokens"), model).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in got:
        t = tokens(text[r["doc_id"]])
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(plain.words[w] > 0 for w in t)
        base = sum(math.log10((plain.words[w] + 1) / (everything + len(plain.words) + 1)) for w in t)
        own = sum(math.log10(plain.probability(u, w)) for u, w in zip(["\0start", *t[:-1]], t, strict=True))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], own, rel_tol=1e-9)
    total = sum(plain.probability("the", w) for w in plain.words) + plain.probability("the", "\0none")
    assert math.isclose(total, 1, rel_tol=1e-9)


def test_language_model_without_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    model = kneser_ney.train(docs.limit(0))
    assert {(r["n_tokens"], r["n_known"], r["score"]) for r in kneser_ney.score(docs, model).collect()} == {(3, 0, 0.0), (1, 0, 0.0)}
    assert kneser_ney.score(docs.limit(0), kneser_ney.train(docs)).count() == 0


def brute_nearest(ids, x, queries, top=5):
    out = {}
    for q in queries:
        v = x[ids.index(q)]
        s = (x * v).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(v))
        out[q] = [ids[k] for k in np.lexsort((ids, -s)) if ids[k] != q][:top]
    return out


@pytest.mark.parametrize("rows", [(4_000, 1_000), (40, 3)])
def test_neighbours_recall(spark, monkeypatch, rows):
    monkeypatch.setattr(posting_lists, "LIST_ROWS", rows[0])
    monkeypatch.setattr(posting_lists, "QUERY_ROWS", rows[1])
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    got = posting_lists.op9_nearest_neighbours(spark, "/root/testdata/sf0.1").toPandas()
    want = brute_nearest(e["vec_id"].tolist(), np.stack(e["embedding"]).astype(float), [i for i in e["vec_id"] if i % 50 == 0])
    assert len(got) == 5 * len(want)
    hits = sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * len(got)


def test_many_pair_buckets_take_few_file_handles(tmp_path):
    model = kneser_ney.Model(str(tmp_path))
    buckets, each = 200, 50
    keys = np.arange(buckets * each, dtype=np.uint64) * np.uint64(3) + np.uint64(1)
    model.bounds = keys[each::each].copy()
    for b, own in enumerate(np.split(keys, buckets)):
        if b == 7:
            continue  # a bucket without pairs has no files
        counts = (own % np.uint64(300)).astype(np.int64) + 1
        large = np.flatnonzero(counts > 254)
        for name, x in (("", own), ("-counts", np.minimum(counts, 255).astype(np.uint8)), ("-large", np.stack([large, counts[large]]))):
            np.save(tmp_path / f"pairs-{b}{name}.npy", x)
    for name in ("hash", "count", "rest", "places"):
        (tmp_path / name).write_bytes(b"")
    reader, before = kneser_ney.Reader(model), len(os.listdir("/proc/self/fd"))
    wanted = np.sort(np.concatenate([keys, keys + np.uint64(1)]))
    want = np.where((wanted % np.uint64(3) == 1) & (np.searchsorted(model.bounds, wanted, "right") != 7), wanted % np.uint64(300) + 1, 0)
    for _ in range(3):
        assert (reader.pair_counts(wanted) == want).all()
        assert len(os.listdir("/proc/self/fd")) - before <= 3 * kneser_ney.OPEN < 256


def unit_rows(n, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph_search_finds_the_nearest_heads():
    heads = unit_rows(3_000).astype(np.float32)
    close = heads @ heads.T
    np.fill_diagonal(close, -np.inf)
    index = posting_lists.Index(heads, posting_lists.with_ways_back(np.argsort(-close, axis=1)[:, : posting_lists.DEGREE]))
    q = unit_rows(200, 4)
    ids, far = index.search(q, 20)
    assert (np.diff(far, axis=1) >= 0).all() and all(len(set(r)) == 20 for r in ids.tolist())
    assert np.allclose(far, np.sqrt(2 - 2 * np.take_along_axis(q @ heads.T, ids, 1)), atol=1e-3)
    best = np.argsort(-(q @ heads.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(ids.tolist(), best.tolist(), strict=True)]) > 0.75  # without structure; the fit measures what is missed
    few = posting_lists.Index(heads[:1], np.full((1, 2), -1))
    assert few.search(q, 5)[0].tolist() == [[0]] * 200


@pytest.mark.parametrize("clustered", [True, False])
def test_ratio_drops_lists_where_vectors_cluster(clustered):
    """In clusters the nearest heads are much nearer than others, so that the ratio leaves few lists."""
    x = unit_rows(4_000)
    if clustered:
        x = unit_rows(100)[np.arange(4_000) % 100] + 0.05 * x
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    heads = x[::8].astype(np.float32)
    close = heads @ heads.T
    np.fill_diagonal(close, -np.inf)
    index = posting_lists.Index(heads, posting_lists.with_ways_back(np.argsort(-close, axis=1)[:, : posting_lists.DEGREE]))
    index.measure(x[np.arange(4_000) % 8 != 0], 5)
    row, _ = index.asked(x[1:400:8])
    searched = np.bincount(row).mean()
    assert searched <= index.lists and index.ratio < np.inf
    assert searched < 12 if clustered else searched > 12


@pytest.mark.parametrize("n", [10_000, 50_000])
def test_neighbours_recall_by_size(spark, tmp_path, n):
    """Vectors without any structure, the hardest case: recall against brute force."""
    x = unit_rows(n).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}), tmp_path / "e.parquet")
    got = posting_lists.nearest(spark.read.parquet(str(tmp_path / "e.parquet")), F.col("vec_id") % 200 == 0).toPandas()
    wide = x.astype(float)
    hits = 0
    for q, g in got.groupby("query_id"):
        s = wide @ wide[q]
        s[q] = -2
        hits += len(set(g["vec_id"]) & set(np.argpartition(-s, 5)[:5].tolist()))
    assert len(got) == 5 * n // 200
    assert hits >= 0.92 * len(got), hits / len(got)


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, i / 10.0], 0) for i in range(1, 8)] + [(50, [1.0, 0.3], 0), (100, [1.0, 0.3], 0), (100, [1.0, 0.3], 0)]
    rows += [(150, None, 0), (200, [nan, 1.0], 0), (250, [inf, 1.0], 0), (300, [0.0, 0.0], 0), (350, [None, 1.0], 0), (400, [], 0), (450, [1.0], 0), (None, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = posting_lists.nearest(df, F.col("vec_id") % 50 == 0).collect()
    good = sorted({(r[0], tuple(r[1])) for r in rows if r[0] and r[0] <= 100})
    want = brute_nearest([i for i, _ in good], np.array([np.float32(v) for _, v in good], np.float64), [50, 100])
    for q in (50, 100):
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [i for _, i in mine] == want[q] and [n for n, _ in mine] == [1, 2, 3, 4, 5]
    assert {r["query_id"] for r in got} == {50, 100}
    assert posting_lists.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert posting_lists.nearest(df.filter("vec_id IN (1, 50)"), F.col("vec_id") == 50).count() == 1


def test_shared_folder(spark):
    assert mounted("file:///a/b") == "/a/b" and mounted("/a") == "/a"
    with pytest.raises(ValueError):
        mounted("hdfs://x/y")
    assert shared_folder(spark) == shared_folder(spark)
