"""SimHash near-duplicates, BPE and the pipeline against brute force, exact round trips and odd input."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftpage.llm import bpe_tree, mixing, pu_quality, quality_rules, simhash_dedup
from siftpage.llm.components import components

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=4):
    """prints: {node: fingerprint}; the smallest node that each reaches."""
    nodes = sorted(prints)
    f = np.array([prints[n] for n in nodes], np.uint64)
    up = list(range(len(nodes)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(nodes)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= bits) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            up[b] = a
    return {n: nodes[root(i)] for i, n in enumerate(nodes)}


def test_simhash_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = simhash_dedup.op6_simhash_dedup(spark, SF).collect()
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: format(p, "016x") for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(prints)


@pytest.mark.parametrize(("small", "group"), [(32, 50_000), (2, 50_000), (32, 40)])
def test_simhash_links(spark, monkeypatch, small, group):
    """Dense families and chains around few centres, whatever way the groups are compared and split."""
    monkeypatch.setattr(simhash_dedup, "SMALL", small)
    rng = random.Random(small + group)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                x ^= 1 << b
            x = x if rng.random() < 0.6 else rng.choice(sorted(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    links = simhash_dedup.linked(df, group=group).collect()
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 4 for r in links)
    up = {p: p for p in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        a, b = sorted((root(r["a"]), root(r["b"])))
        up[b] = a
    families = defaultdict(set)
    for p in signed:
        families[root(p)].add(p)
    want = defaultdict(set)
    for node, least in brute_components({p: p & (1 << 64) - 1 for p in signed}).items():
        want[least].add(node)
    assert sorted(map(sorted, families.values())) == sorted(map(sorted, want.values()))


def test_pivot_tables_never_discard_a_link():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 500, np.uint64)
    b = a.copy()
    for i in range(500):
        for k in rng.choice(64, rng.integers(0, 9), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    both = np.concatenate([a, b])
    rows = simhash_dedup.distances(both, simhash_dedup.pivots())
    got = simhash_dedup.near(both, rows, np.arange(500), np.arange(500, 1000), 4)
    assert got.tolist() == np.flatnonzero(np.bitwise_count(a ^ b) <= 4).tolist()


def test_simhash_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(300))
    rows = [(9, None, 1, "x"), (8, "", 1, "x"), (7, " \n", 1, "x"), (6, same, 1, "x"), (5, same + "  ", 1, "x"), (5, same + "  ", 1, "x")]
    rows += [(4, "one two", 1, "x"), (3, "ONE two", 1, "x"), (None, same, 1, "x"), (2, "alone " + "z" * 100_000, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int, root string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash_dedup.group(docs).collect())
    want = {9: 7, 8: 7, 7: 7, 6: 5, 5: 5, 4: 3, 3: 3, None: 5, 2: 2}
    assert got == Counter((r[0], want[r[0]]) for r in rows)
    kept = simhash_dedup.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 7]
    assert simhash_dedup.keep(docs.limit(0)).count() == 0
    assert simhash_dedup.keep(docs.filter("doc_id IS NULL")).count() == 1


def shingles_of(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(rng, least, words=200):
    """A text and a copy of it with words replaced until the similarity is just above `least`."""
    base = [f"w{rng.randrange(50_000)}" for _ in range(words)]
    copy, own = list(base), shingles_of(" ".join(base))
    while True:
        at = rng.randrange(words)
        new = copy[:at] + [f"z{rng.randrange(50_000)}"] + copy[at + 1 :]
        if jaccard(own, shingles_of(" ".join(new))) < least:
            return " ".join(base), " ".join(copy)
        copy = new


def test_similar_texts_are_found(spark):
    """Recall by planted similarity, and no pair of strangers or of texts just below 0.8."""
    rng = random.Random(6)
    rows, pairs = [], {}
    for least in (0.80, 0.85, 0.90, 0.95, 0.97):
        for _ in range(60):
            a, b = planted(rng, least, rng.choice([40, 120, 300]))
            pairs.setdefault(least, []).append((len(rows), len(rows) + 1))
            rows += [a, b]
    close = []
    for _ in range(60):
        a, b = planted(rng, 0.6, 200)
        if jaccard(shingles_of(a), shingles_of(b)) < 0.8:
            close.append((len(rows), len(rows) + 1))
            rows += [a, b]
    rows += [" ".join(f"s{rng.randrange(300)}" for _ in range(100)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(5)
    root = {r["doc_id"]: r["root"] for r in simhash_dedup.group_similar(docs).collect()}
    assert len(root) == len(rows)
    for least, own in pairs.items():
        found = sum(root[a] == root[b] for a, b in own) / len(own)
        assert found >= 0.95, (least, found)
    assert all(root[a] != root[b] for a, b in close)
    together = {tuple(sorted(p)) for own in pairs.values() for p in own}
    by = defaultdict(list)
    for d, r in root.items():
        by[r].append(d)
    assert all(tuple(sorted(m)) in together for m in by.values() if len(m) > 1)


@pytest.mark.parametrize("size", [4_000, simhash_dedup.GROUP_BYTES])
def test_groups_equal_all_pairs(spark, monkeypatch, size):
    """Chains and a crowd of near copies, against all pairs; small groups too, cut into many blocks."""
    monkeypatch.setattr(simhash_dedup, "GROUP_BYTES", size)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(40):  # a crowd around one text
        own = list(base)
        own[rng.randrange(60)] = f"x{k}"
        texts.append(" ".join(own))
    step = [f"c{i}" for i in range(100)]
    for k in range(12):  # a chain: neighbours are alike, its ends are not
        step[k * 8] = f"d{k}"
        texts.append(" ".join(step))
    texts += [None, "", " \n", "one two", "One  two", "one two three", *(f"alone {i} " * 9 for i in range(20)), texts[0], texts[0].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    by = defaultdict(set)
    for r in simhash_dedup.group_similar(docs).collect():
        by[r["root"]].add(r["doc_id"])
    sets = [shingles_of(t) for t in texts]
    want, todo = [], set(range(len(texts)))
    while todo:
        part, edge = set(), {min(todo)}
        while edge:
            part |= edge
            edge = {j for j in todo - part if any(jaccard(sets[i], sets[j]) >= 0.8 for i in edge)}
        want.append(part)
        todo -= part
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want))


def test_similar_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text, 1, "a", 2), (3, text + " end", 1, "b", 2), (3, text + " end", 1, "c", 2), (None, None, 1, "d", 2), (9, "x " * 200_000, 1, None, 2)]
    schema = "doc_id bigint, text string, __hash int, `odd name.x` string, Mark int"
    for keep in (simhash_dedup.keep_similar, simhash_dedup.keep):
        docs = spark.createDataFrame(rows, schema)
        kept = keep(docs)
        assert kept.columns == docs.columns
        got = [tuple(r) for r in kept.collect()]
        assert sorted(str(r[0]) for r in got) == (["3", "9", "None"] if keep is simhash_dedup.keep_similar else sorted({str(r[0]) for r in got}))
        assert {(r[0], r[2], r[4]) for r in got} <= {(r[0], 1, 2) for r in rows}
        assert keep(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {(r["node"], r["root"]) for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    want = {(i, 0) for i in range(61)} | {(i, 100) for i in range(100, 140)} | {(300, 300), (301, 300)}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_tree.vocabulary_path())


@pytest.mark.parametrize("leaf", [3, 16, bpe_tree.LEAF])
def test_bpe_equals_library(library, leaf):
    rng = random.Random(leaf)
    some = lambda letters, n: "".join(rng.choices(letters, k=n))
    texts = ["", "a" * 5000, "ab" * 3000, some("etaoinshrdlu", 6000), some("eta", 3000), "日本語" * 400 + "かな" * 300, "!" * 3000 + "'s"]
    texts += ["é" * 999 + "ñ" * 77, " x<|endoftext|>y <|startoftext|>", "İΣςΑΣ Ω'S it's WE'RE 12345 ½²", "é 각 à́", "-=+_" * 900]
    texts += ["don't!'s \x1c\x1dx\x85y z", "ſtraße ǅ ŉ", "‍👩‍💻" * 300]
    texts += [some("abc '’éÉßñ\n\t.,!?0123日<|>", rng.randrange(300)) for _ in range(400)]
    encoder = bpe_tree.Encoder(bpe_tree.vocabulary_path(), leaf)
    assert encoder.known
    ids, counts = encoder.encode(texts)
    rows = zip(texts, np.split(ids, np.cumsum(counts)[:-1]), encoder.spelt(ids, counts), encoder.decode(ids, counts), strict=True)
    for text, own, decimals, back in rows:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.tolist() == want and decimals.decode() == " ".join(map(str, want))
        assert back.decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_forgets_and_learns_again(library, monkeypatch):
    """With room for next to nothing every slice drops words that later ones need."""
    monkeypatch.setattr(bpe_tree, "CACHED", 20_000)
    encoder, rng = bpe_tree.Encoder(bpe_tree.vocabulary_path()), random.Random(4)
    for _ in range(30):
        texts = [" ".join(rng.choices([f"word{i}" for i in range(400)], k=60)) for _ in range(3)]
        ids, counts = encoder.encode(texts)
        for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoder.weight < 120_000 and len(encoder.number) == len(encoder.ends) < 402


def change_normalizer(steps):
    steps["normalizer"] = {"type": "NFKC"}


def change_split(steps):
    steps["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{L}+|\p{N}+|\s+|[^\s\p{L}\p{N}]+"


def change_decoder(steps):
    steps["decoder"] = {"type": "BPEDecoder", "suffix": "</w>"}


def change_truncation(steps):
    steps["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}


@pytest.mark.parametrize("change", [change_normalizer, change_split, change_decoder, change_truncation])
def test_another_tokenizers_steps_are_the_librarys(spark, tmp_path, change):
    with open(bpe_tree.vocabulary_path(), encoding="utf-8") as f:
        steps = json.load(f)
    change(steps)
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(steps, f)
    other = Tokenizer.from_file(path)
    other.no_truncation()
    texts = ["It's A ﬁne day, isn't it? 123 45", "é" * 700 + " ½  x", "", "<|endoftext|> Ends"]
    assert bpe_tree.Encoder(path).known == (change is change_truncation)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in bpe_tree.decode(bpe_tree.encode(docs, path), path).collect():
        want = other.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == other.decode(want, skip_special_tokens=False)


def test_bpe_join_grows(library):
    """A join whose first window can't agree still gives the tokens of the whole."""
    encoder = bpe_tree.Encoder(bpe_tree.vocabulary_path())
    for text in ("internationalisation" * 20, "aaaa" * 50, "thththe" * 40):
        whole = encoder.tokens([text])[0]
        for cut in range(1, len(text), 7):
            left, right = encoder.tokens([text[:cut], text[cut:]])
            right = [(i, s + cut, e + cut) for i, s, e in right]
            assert bpe_tree.joined(text, left, right, lambda t: encoder.tokens([t])[0]) == whole


def test_bpe_query(spark, library):
    got = {r["doc_id"]: r for r in bpe_tree.op8_bpe_encoding(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids) and mine["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert mine["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_odd_rows(spark, library):
    rows = [(1, None, "k"), (2, "", "k"), (3, "x" * 200_000, "k"), (4, "same", "k"), (4, "same", "k"), (None, "a b " * 400_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe_tree.decode(bpe_tree.encode(docs))
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    found = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 6 and found[1]["ids"] == [] and found[1]["decoded"] == ""
    assert found[3]["ids"] == library.encode("x" * 200_000, add_special_tokens=False).ids
    assert found[4]["decoded"] == "same</w>"
    assert len(found[None]["ids"]) == 800_000
    assert bpe_tree.encode(docs.limit(0), decoded=True).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage of the pipeline against what its operator says on the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        got = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        if k == 0:
            model = pu_quality.learnt(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = pu_quality.score(docs, model).filter("predicted = 1").select("doc_id")
            assert got == Counter(r["doc_id"] for r in want.collect())
        if k == 1:
            want = quality_rules.judge(docs).filter("kept").select("doc_id")
            assert got == Counter(r["doc_id"] for r in want.collect())
        if k == 2:
            # all pairs of whole texts, five words and a similarity of 0.8
            sets = {r["doc_id"]: shingles_of(r["text"]) for r in docs.select("doc_id", "text").collect()}
            kept, todo = set(), set(sets)
            while todo:
                part, edge = set(), {min(todo)}
                while edge:
                    part |= edge
                    rest = todo - part
                    edge = {j for j in rest if any(0.8 * len(sets[i]) <= len(sets[j]) <= len(sets[i]) / 0.8 and jaccard(sets[i], sets[j]) >= 0.8 for i in edge)}
                kept.add(min(part))
                todo -= part
            assert got == Counter(kept)
        if k == 3:
            sized = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
            want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.plan(sized).collect() if r["taken"]}
            assert got == Counter(want)
        if k == 4:
            assert got == Counter(r["doc_id"] for r in docs.select("doc_id").collect())
            assert out.filter("n_tokens <> size(ids) OR decoded = ''").count() == 0
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_of_nothing(spark, tmp_path):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_part_fingerprints_a_bit_apart_are_found_by_the_pivot_tables(spark):
    words = [f"w{i}" for i in range(200)]
    texts = {"one": " ".join(words), "two": " ".join(words[:195] + ["other"]), "far": " ".join(f"v{i}" for i in range(200))}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id bigint, text string")
    named = {r["content"]: r["text"] for r in docs.select(simhash_dedup.content_of(F.col("text")).alias("content"), "text").collect()}
    # all prints differ: those of the first two texts by one bit, those of the third by at least two bits from both
    own = [(7919 * (t + 1)) << 20 for t in range(simhash_dedup.PARTS)]
    flips = {texts["one"]: 0, texts["two"]: 1 << 40, texts["far"]: 7 << 50}
    prints = spark.createDataFrame([(c, [p ^ flips[t] for p in own]) for c, t in named.items()], "content string, prints array<bigint>")
    links = simhash_dedup.similar(prints, docs, 5, 0.8).collect()
    assert {frozenset(named[x] for x in r) for r in links} == {frozenset((texts["one"], texts["two"]))}
