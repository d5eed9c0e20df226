"""Quality rules, chat formatting, URL filters and mixing: SQL counterparts, brute force, odd input."""

import datetime
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftpage.llm import chat_format, mixing, quality_rules, url_filters
from tools.check import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, source string, n bigint, reason string"


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_chat_formatting", "op5_url_filters"])
def test_sql(spark, con, folder, name):
    assert compare(spark, con, folder, name).startswith("ok")


def test_queries_read_whole_tables(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name in ("op1_quality_rules", "op7_mixing"):
        assert entry.queries()[name](spark, folder).count() == rows


def odd_docs(spark):
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, None, "a", 1, "x"),
        (2, "", None, 2, None),
        (3, " \t\n\x0b", "a", 3, None),
        (4, long, "b", 4, None),
        (5, "same " * 80, "b", 5, None),
        (5, "same " * 80, "b", 5, None),
        (None, "a clean sentence of many words " * 3, "c", 6, None),
        (7, " ".join(f"entirely{i}x different" if i % 2 else f"alpha beta{i}y" for i in range(60)), None, 7, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_base_counts(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "a b", "a b c a b c", "x\nx\n \nx", "é#  b\x0bé# b\x0bé# b"]
    texts += ["".join(rng.choice("ab c\n#é") for _ in range(rng.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select("text", quality_rules.base_counts(F.col("text")).alias("b")).collect()
    for r in found:
        assert tuple(r["b"]) == brute_counts(r["text"])


def test_rules_on_odd_rows(spark):
    judged = quality_rules.judge(odd_docs(spark)).collect()
    assert len(judged) == 8
    by_id = defaultdict(list)
    for r in judged:
        by_id[r["doc_id"]].append((r["kept"], r["reason"]))
    assert not by_id[1][0][0] and not by_id[2][0][0] and not by_id[3][0][0]
    assert len(by_id[5]) == 2 and not by_id[5][0][0]
    assert by_id[7] == [(True, None)]
    kept = quality_rules.keep(odd_docs(spark))
    assert kept.columns == ["doc_id", "text", "source", "n", "reason"]
    assert quality_rules.keep(odd_docs(spark).limit(0)).count() == 0


def test_cascade_order(spark):
    """The most rejections per cost come first, counted among what is still in."""
    rows = [("a " * 60,)] * 50 + [("Z! " * 60,)] * 10
    rules = [r for r in quality_rules.BASE_RULES + quality_rules.RULES if r.name in ("word_length", "marks", "capitals")]
    order = quality_rules.ordered(spark.createDataFrame(rows, "text string"), rules)
    assert {r.name for r, _, _ in order} == {"word_length", "marks", "capitals"}
    assert sum(hits for _, _, hits in order) == 60
    rates = [hits / cost for _, cost, hits in order]
    assert rates[0] == max(rates)


CHAT = "conv_id bigint, turn bigint, role string, text string, rendered string"


def test_chat_takes_any_role_and_text(spark):
    """Every string of up to four of the letters that mean something, as role and as text."""
    letters = ["\\", "n", "\n", "<", "[", "s>", "/s>", "INST]"]
    strings = ["".join(x) for k in range(5) for x in itertools.product(letters, repeat=k)]
    rows = [(i, 0, x, strings[-i - 1], "r") for i, x in enumerate(strings)]
    turns = chat_format.render_turns(spark.createDataFrame(rows, CHAT).repartition(4))
    back = turns.select("role", "text", chat_format.parse(F.col("rendered")).alias("p"))
    wrong = back.filter((F.size("p") != 1) | (F.get("p", F.lit(0))["role"] != F.col("role")) | (F.get("p", F.lit(0))["text"] != F.col("text")))
    assert wrong.count() == 0 and back.count() == len(strings) > 4000


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "s>", "\n", "a", "é", "<\\/s>", "<\\\\s>", "[", "/INST]"]
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "odd\nrole", "</s>", "a\\nb", "\\n", "a\\\nb", "\\\\n\n"]), "".join(rng.choices(bits, k=rng.randrange(9))), "x")
        for c in range(20)
        for t in range(7)
    ]
    rows += [(50, None, None, None, None), (50, 1, "assistant", "", None), (51, 0, "user", "same", None), (51, 0, "user", "same", None)]
    rows += [(52, t, "assistant", f"turn {t}", None) for t in range(600)]
    df = spark.createDataFrame(rows, CHAT)
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c)
        want[c] = (
            len(turns),
            "".join(f"{x[2]}\n{x[3]}\n" for x in turns),
            "".join(x[3] for x in turns if x[2] == "assistant"),
        )
    got = {r["conv_id"]: (r["n_turns"], r["turns"], r["loss"]) for r in chat_format.read_back(chat_format.format_runs(df)).collect()}
    assert got == want
    for r in chat_format.format_chats(df).collect():
        parts = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["spans"]]
        undo = lambda x: re.sub(r"([<\[])\\(\\*)(/?(?:s>|INST\]))", r"\1\2\3", x)
        assert "".join(map(undo, parts)) == want[r["conv_id"]][2]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_planted_conversation(spark, folder):
    row = chat_format.op4_chat_formatting(spark, folder).filter("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row["loss_chars"] == len(text)


def test_url_lists(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    entries = spark.createDataFrame(
        [
            ("bad.org", day(2), "block"),
            ("bad.org", day(3), "block"),
            ("bad.org", day(5), "none"),
            ("www.bad.org/ok", day(3), "allow"),
            ("tie.org", day(1), "allow"),
            ("tie.org", day(1), "block"),
            (None, day(1), "block"),
        ],
        "key string, day timestamp, status string",
    )
    rows = [
        ("http://www.bad.org/x", day(1), False, None),
        ("http://www.bad.org/x", day(2), True, "bad.org"),
        ("http://www.bad.org/x", day(2), True, "bad.org"),
        ("http://u@WWW.bad.org:80/ok/y", day(4), False, "www.bad.org/ok"),
        ("http://www.bad.org/x", day(5), False, None),
        ("http://tie.org", day(9), True, "tie.org"),
        ("http://tie.org", None, False, None),
        ("nonsense", day(3), False, None),
        (None, day(3), False, None),
    ]
    captures = spark.createDataFrame([(u, t, "own") for u, t, _, _ in rows], "url string, fetched_at timestamp, key string")
    got = [(r["url"], r["fetched_at"], r["blocked"], r["matched_key"]) for r in url_filters.judge(captures, entries).collect()]
    assert Counter(got) == Counter(rows)
    assert url_filters.judge(captures, entries.limit(0)).filter("blocked").count() == 0
    assert url_filters.judge(captures.limit(0), entries).count() == 0


def test_url_filter_levels(spark):
    """Entries for a middle level of the host, below a suffix of two parts, and for deeper paths."""
    on = datetime.datetime(2024, 1, 1)
    keys = [("b.example.com", "block"), ("example.co.uk", "block"), ("deep.org/a/b", "block"), ("deep.org/a/b/c", "allow")]
    entries = spark.createDataFrame([(k, on, s) for k, s in keys], "key string, day timestamp, status string")
    rows = {
        "http://a.b.example.com/x": (True, "b.example.com"),
        "http://ab.example.com/x": (False, None),
        "http://www.example.co.uk": (True, "example.co.uk"),
        "http://other.co.uk/": (False, None),
        "http://deep.org/a/b?q=/c": (True, "deep.org/a/b"),
        "http://deep.org:80/a/b/d": (True, "deep.org/a/b"),
        "http://deep.org/a/b/c/d#e": (False, "deep.org/a/b/c"),
        "http://deep.org/a/bc": (False, None),
        "http://deep.org//a/b": (False, None),
    }
    captures = spark.createDataFrame([(u, on) for u in rows], "url string, fetched_at timestamp")
    got = {r["url"]: (r["blocked"], r["matched_key"]) for r in url_filters.judge(captures, entries).collect()}
    assert got == rows


def fill(sizes, weights, most):
    """Targets by sharing again and again what is above the stops."""
    goal, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        over = set()
        for s in free:
            goal[s] = left * weights[s] / sum(weights[x] for x in free)
            if goal[s] > most * sizes[s]:
                over.add(s)
        if not over:
            return goal
        capped |= over
        for s in capped:
            goal[s] = most * sizes[s]


def test_mixing_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaaaaaab") if i % 3 else rng.choice(["c", "d", None, "e"]), rng.choice([0, 1, 5, 20, 60])) for i in range(900)]
    rows += [(5000, "z", 3), (5000, "z", 3), (None, "z", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None)) + [None]
    goal = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 3)
    for slices in (50, 100_000):
        got = mixing.plan(df, slice_rows=slices).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
        assert Counter((r[0], r[1], r[2]) for r in got) == Counter(rows)
        taken = Counter()
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
            assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - goal[s]) <= 60 for s in sizes)
        assert sum(taken.values()) <= sum(sizes.values())
        if slices == 50:
            first = sorted(map(repr, got))
    assert first == sorted(map(repr, got))


def test_columns_of_any_name(spark):
    """Columns named like results or like inner names, or with dots and blanks, come through or are replaced."""
    at = datetime.datetime(2024, 1, 2)
    captures = spark.createDataFrame(
        [("http://a.b.example/x", at, True, "k", "h", 1), (None, at, None, None, None, 2)],
        "url string, fetched_at timestamp, blocked boolean, matched_key string, hit string, `a b.c` int",
    )
    entries = spark.createDataFrame([("b.example", datetime.datetime(2024, 1, 1), "block")], "key string, day timestamp, status string")
    got = url_filters.judge(captures, entries)
    assert got.columns == ["url", "fetched_at", "hit", "a b.c", "blocked", "matched_key", "listed_since"]
    assert [(r["hit"], r["a b.c"], r["blocked"]) for r in sorted(got.collect(), key=lambda r: r["a b.c"])] == [("h", 1, True), (None, 2, False)]
    names = "doc_id bigint, text string, source string, size_ int, __size int, content_ string, `a b.c` int, K_doc_id int"
    docs = spark.createDataFrame([(i, "w " * 10, "s", i, 1, "c", 2, 3) for i in range(9)] + [(5, "w " * 10, "s", 5, 1, "c", 2, 3)], names)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == 10
    assert {(r["__size"], r["content_"], r["a b.c"], r["K_doc_id"]) for r in mixed.collect()} == {(1, "c", 2, 3)}


def test_mix_rows(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [(i, text(10), "s%d" % (i % 3), 7, "k") for i in range(60)] + [(99, text(10), "s0", 7, "k")] * 3
    rows += [(100, None, "s0", 7, "k"), (None, text(4), None, 7, "k")]
    df = spark.createDataFrame(rows, DOCS)
    plan = mixing.plan(df.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size")))
    want = Counter()
    for r in plan.collect():
        if r["taken"]:
            want[r["doc_id"]] += r["taken"] // r["size"]
    got = mixing.mix(df)
    assert got.columns == df.columns
    assert Counter(r["doc_id"] for r in got.collect()) == want
    assert mixing.mix(df.limit(0)).count() == 0
