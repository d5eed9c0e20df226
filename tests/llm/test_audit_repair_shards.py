"""Filter audit, conversation repair and sharding: SQL counterparts, brute force, odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftpage.llm import filter_audit, label_shards, turn_repair
from tools.check import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_conversation_repair"])
def test_sql(spark, folder, name):
    assert compare(spark, connect(folder), folder, name).startswith("ok")


# ---- filter audit ---------------------------------------------------------------------------


def stored(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def brute_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    first = defaultdict(list)
    for d, t, _ in docs:
        if d is not None:
            first[t or ""].append(d)
    fails = []
    for d, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        good = any(x == d and q == 1 for x, q, _ in labels if d is not None)
        toxic = any(x == d and y == 1 for x, _, y in labels if d is not None)
        f = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and d > min(first[t]),
        }
        fails.append((part or "", f, good, toxic))
    out = set()
    for part in {p for p, *_ in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        rows, total = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                removed = [x for x in left if x[0][k]]
                left = [x for x in left if not x[0][k]]
                total[k] += len(removed)
                unique = sum(1 for x in own if [c for c in "ABCDE" if x[0][c]] == [k])
                redundant = sum(x[0][k] for x in own) - len(removed)
                rows.append((part, "".join(order), step, len(left), len(removed), redundant, unique,
                             sum(x[1] for x in removed), sum(x[2] for x in removed), k))
        out |= {(*r[:9], total[r[9]]) for r in rows}
    return out


def test_audit_of_odd_documents(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, None, None), (2, "", "en"), (3, " \t", "en"), (None, "", "en"), (4, text, "en"), (5, text, "de"), (5, text, "de"),
        (6, "same " * 200, "de"), (7, "LOUD " * 100, "de"), (8, text + " #", None), (9, text.upper(), "fr"), (None, text, "fr"),
        (10, " ".join(f"x{i}" for i in range(50_000)), "fr"),
    ]
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, None), (7, None, 1), (None, 1, 1), (8, 0, 0)]
    clash = "part string, pattern int, rows int, n int, later int, own int"
    d = spark.createDataFrame([(*x, "p", 1, 2, 3, 4, 5) for x in docs], f"doc_id bigint, text string, lang string, {clash}")
    y = spark.createDataFrame([(*x, 1) for x in labels], "doc_id bigint, quality int, toxic int, good int")
    at = stored(spark, tmp_path, documents=d, labels=y)
    found = filter_audit.op11_filter_audit(spark, at)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) == 4 * 600
    assert set(rows) == brute_audit(docs, labels)


def test_audit_of_an_empty_table(spark, tmp_path):
    at = stored(
        spark, tmp_path,
        documents=spark.createDataFrame([], "doc_id bigint, text string, lang string"),
        labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"),
    )
    assert filter_audit.op11_filter_audit(spark, at).collect() == []


def test_contractions_are_sums_over_patterns():
    rng = np.random.default_rng(3)
    for k in (1, 3, 5):
        tensor = rng.integers(0, 1 << 40, (2,) * k)
        chosen = rng.integers(0, 2, (7, k, 2))
        want = [
            sum(int(tensor[p]) * int(np.prod([c[f][p[f]] for f in range(k)])) for p in product((0, 1), repeat=k)) for c in chosen
        ]
        assert filter_audit.contract(tensor, chosen).tolist() == want


# ---- conversation repair --------------------------------------------------------------------

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def every_repair(symbols):
    """(cost, audit) of all edits with at most two inserts in a row, by exhaustion."""
    out = []

    def go(i, state, cost, audit, inserts):
        if i == len(symbols) and state in ("", "a"):
            out.append((cost, audit))
        if inserts < 2:
            for r in "ua":
                if (state, r) in NEXT:
                    go(i, NEXT[state, r], cost + 2, audit + "I", inserts + 1)
        if i < len(symbols):
            c = symbols[i]
            go(i + 1, state, cost + 3, audit + "D", 0)
            if c != "d":
                if (state, c.lower()) in NEXT:
                    go(i + 1, NEXT[state, c.lower()], cost + c.isupper(), audit + "K", 0)
                for r in "ua":
                    if (state, r) in NEXT:
                        go(i + 1, NEXT[state, r], cost + 2 + c.isupper(), audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(out)


def grammar_for(texts):
    """Re-Pair over texts, without Spark."""
    grammar = turn_repair.Grammar()
    for _ in range(6):
        pairs = Counter(p for t in texts for c in [grammar.compress(t)] for p in zip(c, c[1:], strict=False))
        if not grammar.add(sorted(((x, y, n) for (x, y), n in pairs.items() if n > 1), key=lambda r: (-r[2], r[:2])), 8):
            break
    return grammar


def test_products_of_matrices_are_the_cheapest_and_least_edits():
    rng = random.Random(5)
    texts = ["".join(rng.choice("suaauxSUAXd") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    grammar = grammar_for(texts)
    assert grammar.size > len(turn_repair.SYMBOLS)
    solver = turn_repair.Solver(grammar)
    for text in texts:
        want = every_repair(text)
        for cuts in ([], [1], [2, 3], list(range(1, len(text)))):
            edges = [0, *[c for c in cuts if c < len(text)], len(text)]
            parts = [text[a:b] for a, b in zip(edges, edges[1:], strict=False) if a < b]
            found = [solver.matrix(p) for p in parts]
            costs = [[c for line in m for c, _ in line] for m in found]
            ranks = [[sorted(a for _, a in line).index(a) for line in m for _, a in line] for m in found]
            states, cost, end = turn_repair.chain(costs, ranks)
            audit = "".join(m[x][y][1] for m, x, y in zip(found, states, states[1:], strict=False)) + end
            assert (cost, audit) == want, (text, cuts)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """The contract's row of one conversation, from its rows after damage in order."""
    seen, symbols, count = set(), [], Counter()
    for _, _, role, text in rows:
        blank, again = not WORD.search(text), (role, text) in seen
        seen.add((role, text))
        broken = not blank and not again and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
        count["blank"] += blank
        count["duplicate"] += again and not blank
        count["truncated"] += broken
        symbols.append((role[:1], blank or again, broken))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:], strict=False))
    best = {"": (0, "", ())}

    def inserting(now):
        out = dict(now)
        for _ in range(2):
            for s, (c, a, x) in list(out.items()):
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (to := NEXT.get((s, r))) is not None:
                        out[to] = min(out.get(to, (1 << 60, "", ())), (c + 2, a + "I", (*x, f"{name}:")))
        return out

    for (initial, must, broken), (_, _, role, text) in zip(symbols, rows, strict=True):
        new = {}

        def put(s, value, new=new):
            new[s] = min(new.get(s, (1 << 60, "", ())), value)

        for s, (c, a, x) in inserting(best).items():
            put(s, (c + 3, a + "D", x))
            if not must:
                if (s, initial) in NEXT:
                    put(NEXT[s, initial], (c + broken, a + "K", (*x, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (s, r) in NEXT:
                        put(NEXT[s, r], (c + 2 + broken, a + "R", (*x, f"{name}:{text}")))
        best = new
    cost, audit, said = min(v for s, v in inserting(best).items() if s in ("", "a"))
    digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest


def odd_conversations():
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"line {t}.") for t in range(60)]
    rows += [(2, None, None, None), (2, 0, "user", "a" * 200_000), (2, 1, "assistant", " \t\n"), (2, 2, "", "x!")]
    rows += [(3, 5, "user", "same?")] * 7 + [(3, t, "assistant", "same?") for t in (6, 9, 30)]
    rows += [(None, t, "user" if t % 2 else "assistant", f"text {t}") for t in range(5)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"{c} {t}" + rng.choice([".", "", "\u0085"])) for c in range(10, 40) for t in range(rng.randint(1, 9))]
    # every row of this one is dropped
    dropped = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone.")]


@pytest.mark.parametrize("chunk", [3, 1024])
def test_repair_equals_brute_force(spark, tmp_path, monkeypatch, chunk):
    rows = odd_conversations()
    clash = "symbol string, times int, chunk int, place int, h1 int"
    df = spark.createDataFrame([(*r, "s", 1, 2, 3, 4) for r in rows], f"conv_id bigint, turn bigint, role string, text string, {clash}")
    at = stored(spark, tmp_path, conversations=df.repartition(5))
    if chunk != turn_repair.CHUNK:
        plain = turn_repair.repair
        monkeypatch.setattr(turn_repair, "repair", lambda r: plain(r, chunk=chunk, rounds=3))
    found = {r[0]: tuple(r)[1:] for r in turn_repair.op12_conversation_repair(spark, at).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]]
    for r in damage(rows):
        by[r[0]].append(r)
    want = {
        c: brute_repair(sorted(own, key=lambda r: (r[1] is not None, r[1] or 0))) for c, own in by.items()
    }
    assert found == want


def test_repair_of_an_empty_table(spark, tmp_path):
    at = stored(spark, tmp_path, conversations=spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert turn_repair.op12_conversation_repair(spark, at).collect() == []


# ---- sharding -------------------------------------------------------------------------------


def check_shards(rows, docs, shards=8):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs
    )
    sizes = [0] * shards
    for k in range(shards):
        own = [r for r in rows if r["shard"] == k]
        sizes[k] = sum(r["size"] for r in own)
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return sizes


def test_shards_of_the_given_table(spark, folder):
    rows = entry.queries()["op13_label_shards"](spark, folder).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    sizes = check_shards(rows, docs)
    assert max(sizes) - min(sizes) <= max(r["size"] for r in rows)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    where = defaultdict(set)
    for r in rows:
        where[(r["size"], r["text_crc32"])].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())


def test_a_group_of_half_the_bytes_is_divided_and_others_stay_whole(spark):
    rng = random.Random(2)
    docs = [(i, "hot text") for i in range(2000)] + [(7, "hot text")] * 1000 + [(None, None), (None, None), (5001, "")]
    docs += [(10_000 + i, f"pair {i // 2} " + "x" * (i // 2 % 90)) for i in range(600)]
    docs += [(20_000 + i, "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))) for i in range(300)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id bigint, text string, shard int, slot int, row int").repartition(4)
    rows = label_shards.shard(df).collect()
    sizes = check_shards(rows, docs)
    assert max(sizes) - min(sizes) <= 200
    where = defaultdict(set)
    for r in rows:
        where[(r["size"], r["text_crc32"])].add(r["shard"])
    split = [k for k, x in where.items() if len(x) > 1]
    # the hot text has to be divided; cuts divide few others
    assert (9, zlib.crc32(b"hot text")) in split and len(split) <= 8


def test_shards_of_few_rows(spark):
    schema = "doc_id bigint, text string"
    assert label_shards.shard(spark.createDataFrame([], schema)).collect() == []
    docs = [(1, "a"), (2, "b"), (2, "b")]
    check_shards(label_shards.shard(spark.createDataFrame(docs, schema)).collect(), docs)


def test_labels_gather_linked_rows_under_quotas(spark):
    """A chain of dense clusters: rounds lower the cut, and no shard is filled far above its capacity."""
    rng = random.Random(1)
    links, size = [], {}
    for c in range(24):
        own = [c * 10 + i for i in range(10)]
        size |= {r: rng.randint(1, 9) for r in own}
        links += [(r, f"{c}-{k}") for k in range(3) for r in rng.sample(own, 6)]
        links += [(own[0], f"bridge {c}"), ((own[0] + 10) % 240, f"bridge {c}")]
    linked = spark.createDataFrame(links, "row bigint, hub string")
    start = spark.createDataFrame([(r, s, r * 7 % 4) for r, s in size.items()], "row bigint, size bigint, shard int")
    start = start.join(linked.select("row").distinct(), "row", "left_semi")
    total = start.agg(F.sum("size")).first()[0]
    done, moved = label_shards.propagate(start, linked, [total // 4 + 12] * 4)
    before, after = label_shards.cut_links(start, linked), label_shards.cut_links(done, linked)
    assert moved[0] > 0 and after < 0.6 * before
    held = [r[0] for r in done.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert done.count() == start.count() and max(held) <= 1.6 * total / 4
