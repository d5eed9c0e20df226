"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a text. On a sample every rule's cost (seconds for the sample's texts) and its
rejections are measured; the cascade then takes, again and again, the rule with the most rejections
per cost among the texts that are still in. A text leaves at its first rejection, so that later rules
cost nothing for it. The order changes the work and the named reason, never the verdict.

Defined results: a null or empty text has no words and fails `too_short`; repeated rows are judged
each on their own; an empty table gives no rows; extra columns pass through untouched (an own column
called `reason` or `kept` is replaced).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpage.llm.common import WORD, let, table, words_of

#: Rows of the sample on which cost and selectivity are measured, and of files it is taken from.
SAMPLE_ROWS, SAMPLE_FILES = 2_000, 8

SYMBOLS = r"[#*$%&|<>]"
#: Words without a letter.
BARE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def lines_of(text: Column) -> Column:
    """Lines, cut at line feeds, that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def duplicate_lines(text: Column) -> Column:
    return let(lines_of(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text holds twice or more.

    Windows are compared by hash first: the high bits of the hash and the position share one long, and
    equal high bits are neighbours once sorted. Only such candidates are compared word by word.
    """

    def among(mask: Column) -> Column:
        packed = F.sort_array(
            F.transform(
                F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
                .bitwiseAND(mask)
                .bitwiseOR(i.cast("bigint")),
            )
        )

        def candidates(p: Column) -> Column:
            head = lambda x: x.bitwiseAND(mask)
            twice = F.filter(
                p,
                lambda x, i: (head(x) == head(F.get(p, i - 1))) | (head(x) == head(F.get(p, i + 1))),
            )
            return F.sort_array(
                F.transform(
                    F.transform(twice, lambda x: x.bitwiseAND(F.bitwise_not(mask)).cast("int")),
                    lambda i: F.struct(
                        F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("t"),
                        i.alias("i"),
                    ),
                )
            )

        def covered(c: Column) -> Column:
            equal = F.filter(
                c,
                lambda x, i: (x["t"] == F.get(c, i - 1)["t"]) | (x["t"] == F.get(c, i + 1)["t"]),
            )
            places = F.flatten(F.transform(equal, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.size(F.array_distinct(places)).cast("bigint")

        return let(packed, lambda p: let(candidates(p), covered))

    bits = F.length(F.bin(F.size(words)))
    return let(F.call_function("shiftleft", F.lit(-1).cast("bigint"), bits), among)


@dataclass(frozen=True)
class Rule:
    """`rejects` gets the text and its words and says whether the text must go."""

    name: str
    rejects: Callable[[Column, Column], Column]


def size(words: Column) -> Column:
    return F.size(words).cast("bigint")


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("bigint")


BASE_RULES = (
    Rule("too_short", lambda t, w: size(w) < 50),
    Rule("repeats_itself", lambda t, w: repeated_words(w) * 100 > size(w) * 50),
)
#: Thresholds are whole-number ratios, so that no rounding decides.
RULES = (
    Rule("word_length", lambda t, w: (word_chars(w) < size(w) * 3) | (word_chars(w) > size(w) * 10)),
    Rule("symbols", lambda t, w: count(t, SYMBOLS) * 10 > size(w)),
    Rule("same_lines", lambda t, w: duplicate_lines(t) * 2 > F.size(lines_of(t))),
    Rule("capitals", lambda t, w: count(t, r"\p{Lu}") * 2 > word_chars(w)),
    Rule("marks", lambda t, w: count(t, "[!?]") * 2 > size(w)),
    Rule("bare_words", lambda t, w: count(t, BARE) * 10 > size(w) * 3),
)


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS, files: int = SAMPLE_FILES) -> DataFrame:
    """About `rows` texts. Of a table with many files only `files` of them, evenly spaced, are read."""
    named = sorted(docs.inputFiles())
    part = docs
    if len(named) > files and "_metadata" not in docs.columns:
        part = docs.filter(F.col("_metadata.file_path").isin(named[:: -(-len(named) // files)]))
    total = part.count()
    return part.select("text").sample(fraction=min(1.0, rows / max(1, total)), seed=7)


def ordered(sample: DataFrame, rules: Sequence[Rule]) -> list[tuple[Rule, float, int]]:
    """The rules in the order of the cascade, each with its seconds and its further rejections.

    The rejections come as counts by pattern of verdicts, 2 ** len(rules) rows at most.
    """
    kept = sample.select(F.coalesce("text", F.lit("")).alias("text")).persist()

    def flag(rule: Rule) -> Column:
        return let(words_of(F.col("text")), lambda w: rule.rejects(F.col("text"), w))

    def seconds(rule: Rule | None) -> float:
        began = time.perf_counter()
        kept.agg(F.count_if(flag(rule) if rule else F.size(words_of(F.col("text"))) < 0)).collect()
        return time.perf_counter() - began

    patterns = [
        (tuple(r[:-1]), r[-1])
        for r in kept.groupBy(*(flag(r).alias(f"r{i}") for i, r in enumerate(rules))).count().collect()
    ]
    seconds(None)
    floor = min(seconds(None) for _ in range(2))
    costs = [max(1e-3, min(seconds(r) for _ in range(2)) - floor) for r in rules]
    kept.unpersist()
    out, left = [], list(range(len(rules)))
    while left:
        hits = {i: sum(n for flags, n in patterns if flags[i]) for i in left}
        best = max(left, key=lambda i: (hits[i] / costs[i], -costs[i], -i))
        out.append((rules[best], costs[best], hits[best]))
        patterns = [(flags, n) for flags, n in patterns if not flags[best]]
        left.remove(best)
    return out


def cascade(rules: Sequence[Rule], text: Column) -> Column:
    """The name of the first rule that rejects the text, null if none does. Later rules don't run."""
    filled = F.coalesce(text, F.lit(""))

    def chain(w: Column) -> Column:
        out = F.when(rules[0].rejects(filled, w), rules[0].name)
        for rule in rules[1:]:
            out = out.when(rule.rejects(filled, w), rule.name)
        return out

    return let(words_of(text), chain)


def judge(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + RULES) -> DataFrame:
    """All rows with `reason` (null: none) and `kept`, by the cascade in its measured order."""
    order = [rule for rule, _, _ in ordered(sample_of(docs), rules)]
    return docs.withColumn("reason", cascade(order, F.col("text"))).withColumn("kept", F.col("reason").isNull())


def keep(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + RULES) -> DataFrame:
    """The rows that no rule rejects, with their own columns."""
    order = [rule for rule, _, _ in ordered(sample_of(docs), rules)]
    return docs.filter(cascade(order, F.col("text")).isNull())


def base_counts(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words as a struct."""
    filled = F.coalesce(text, F.lit(""))
    return let(
        words_of(text),
        lambda w: F.struct(
            size(w).alias("n_words"),
            word_chars(w).alias("word_chars"),
            count(filled, SYMBOLS).alias("n_symbols"),
            duplicate_lines(filled).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def op1_quality_rules(spark, folder: str) -> DataFrame:
    """Base counts of every document, the base verdict, and the cascade's verdict."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    order = [rule for rule, _, _ in ordered(sample_of(docs), RULES)]
    counted = docs.select("doc_id", "text", base_counts(F.col("text")).alias("b"))
    failed = (F.col("b.n_words") < 50) | (F.col("b.n_repeat_words") * 100 > F.col("b.n_words") * 50)
    judged = counted.select("doc_id", "b", F.when(failed, "base").otherwise(cascade(order, F.col("text"))).alias("r"))
    return judged.select(
        "doc_id",
        "b.*",
        F.coalesce(F.col("r") == "base", F.lit(False)).alias("base_failed"),
        F.col("r").isNull().alias("kept"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), p AS (
  SELECT k, unnest(w) AS u, unnest(generate_series(1, len(w))) AS i FROM d
), v AS (
  SELECT k, i, u AS a, lead(u, 1) OVER o AS b, lead(u, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY k ORDER BY i)
), m AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM v WHERE c IS NOT NULL
), r AS (
  SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM m WHERE n > 1) GROUP BY k
), l AS (
  SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), s AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, len(regexp_extract_all(text, '\p{Lu}')) AS upper,
         len(regexp_extract_all(text, '[!?]')) AS marks,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS bare
  FROM d JOIN l USING (k) LEFT JOIN r USING (k)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
            OR 2 * n_dup_lines > n_lines OR 2 * upper > word_chars OR 2 * marks > n_words
            OR 10 * bare > 3 * n_words) AS kept
FROM b
"""
