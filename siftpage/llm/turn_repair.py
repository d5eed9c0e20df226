"""Conversation structure repair: a grammar-compressed dynamic program over rows of turns.

A repaired conversation's role initials are (s?(ua)+)?, read by an automaton of four states: start,
after s, after u, after a. A row may be kept (0), get another role (2) or be deleted (3); a row of user
or assistant without text may be inserted before any row and at the end (2); a truncated row that stays
costs 1 more. From a state every edit leads to one state, so the edits' initials, the audit, say
everything; of the cheapest audits the least in ASCII order counts.

All that a row's edits depend on is one of nine symbols: its role's initial (s, u, a, another) and
whether it is truncated, or that it must go. The transfer matrix of a symbol holds for each pair of
states the least cost and its audit, inserts before the row included; the matrix of a sequence is the
min-plus product. Two audits of the same rows both end with a row's edit, so neither is the beginning
of the other, and the least audit of a product is made of least audits: the product is exact, ties too.

Re-Pair learns rules over the sequences of all conversations: in each round the pairs of neighbours
are counted in Spark and the frequent ones that can't overlap each other become new symbols. Every rule
gets one matrix, the product of its two parts' matrices, bottom up; its audits are ropes, the two
parts' audits by reference, spelt out only where costs tie and at the end. All conversations share
them. Rounds and rules are limited; what the rules don't cover is multiplied symbol by symbol, so the
limits change the work and not the result.

A conversation's rows are dealt by range, so that a long one lies in many tasks, and cut into chunks
of `CHUNK` symbols. Its chunks' matrices meet in one task in order, one narrow row for each chunk, as
does the repaired text, as a stream: the result holds one audit and one hash of a whole conversation.

Defined results: null role and text are one space, and so are null numbers in the hash that damages;
rows go by turn (null first), then role, then XXH64 of the text; equal rows of one turn stand next to
each other, and all but the first are duplicates; a null conv_id is a conversation; a conversation
without rows gets zeros; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftpage.llm.common import WORD, give_back, small_batches, table, written

START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES, ENDS = 4, (START, AFTER_A)
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
INFINITE = 1 << 60
#: Where each initial is accepted, and what it leads to.
NEXT = {
    (START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A,
}
ROLE = {"u": "user", "a": "assistant"}
#: One letter for each symbol: initials, the truncated ones in capitals, x another role, d must go.
SYMBOLS = "suaxSUAXd"
CHUNK, ROUNDS, RULES_A_ROUND = 1024, 10, 256

Rope = str | tuple
#: (cost, audit) for each pair of states, from first.
Matrix = list[list[tuple[int, Rope]]]


# ---- edits as matrices ----------------------------------------------------------------------


def spelt(rope: Rope) -> str:
    """A rope's letters, from left to right."""
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += (x[1], x[0])
    return "".join(out)


def lesser(a: tuple[int, Rope], b: tuple[int, Rope]) -> tuple[int, Rope]:
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[0] >= INFINITE or spelt(a[1]) <= spelt(b[1]) else b


def product(x: Matrix, y: Matrix) -> Matrix:
    """Min-plus product; audits as ropes of the two."""
    out = []
    for row in x:
        line = []
        for j in range(STATES):
            best: tuple[int, Rope] = (INFINITE, "")
            for k in range(STATES):
                cost = row[k][0] + y[k][j][0]
                if cost < INFINITE and cost <= best[0]:
                    best = lesser(best, (cost, (row[k][1], y[k][j][1])))
            line.append(best)
        out.append(line)
    return out


def inserted(state: int) -> list[tuple[int, int, str, str]]:
    """(state, cost, audit, initials) of what inserts lead to; a longer run would visit a state again."""
    out, seen = [(state, 0, "", "")], {state}
    todo = list(out)
    while todo:
        at, cost, audit, letters = todo.pop()
        for role in "ua":
            to = NEXT.get((at, role))
            if to is not None and to not in seen:
                seen.add(to)
                todo.append((to, cost + INSERT, audit + "I", letters + role))
                out.append(todo[-1])
    return out


def row_edits(state: int, symbol: str) -> list[tuple[int, int, str]]:
    """(state, cost, letter) of the edits of one row."""
    out = [(state, DELETE, "D")]
    if symbol != "d":
        more = BROKEN * symbol.isupper()
        if (to := NEXT.get((state, symbol.lower()))) is not None:
            out.append((to, KEEP + more, "K"))
        out += [(NEXT[(state, r)], REROLE + more, "R") for r in "ua" if (state, r) in NEXT]
    return out


def symbol_matrix(symbol: str) -> Matrix:
    out: Matrix = [[(INFINITE, "")] * STATES for _ in range(STATES)]
    for i in range(STATES):
        for mid, cost, audit, _ in inserted(i):
            for j, more, letter in row_edits(mid, symbol):
                out[i][j] = lesser(out[i][j], (cost + more, audit + letter))
    return out


def end_costs() -> list[tuple[int, str]]:
    """(cost, audit) of the inserts that complete a conversation from each state."""
    return [min((c, a) for to, c, a, _ in inserted(i) if to in ENDS) for i in range(STATES)]


# ---- the grammar ----------------------------------------------------------------------------


class Grammar:
    """Rules by round: a pair of symbols becomes a new one. Symbols are numbers, terminals first."""

    def __init__(self) -> None:
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.size = len(SYMBOLS)

    def add(self, counted: Sequence[tuple[int, int, int]], most: int = RULES_A_ROUND) -> int:
        """A round from counted pairs (left, right, count), most frequent first.

        No symbol is both a left and a right part in a round (but for a pair of equal ones, that has its
        symbol for itself), so occurrences of different pairs never overlap.
        """
        rules: dict[tuple[int, int], int] = {}
        left: set[int] = set()
        right: set[int] = set()
        for x, y, _ in counted:
            if len(rules) < most and x not in right and y not in left and (x != y or x not in left | right):
                rules[(x, y)] = self.size + len(rules)
                left.add(x)
                right.add(y)
        self.rounds.append(rules)
        self.size += len(rules)
        return len(rules)

    def compress(self, text: str) -> list[int]:
        now = [SYMBOLS.index(c) for c in text]
        for rules in self.rounds:
            out, i, n = [], 0, len(now)
            while i < n:
                new = rules.get((now[i], now[i + 1])) if i + 1 < n else None
                out.append(now[i] if new is None else new)
                i += 1 if new is None else 2
            now = out
        return now

    def matrices(self) -> list[Matrix]:
        """One for each symbol, bottom up."""
        out = [symbol_matrix(c) for c in SYMBOLS]
        for rules in self.rounds:
            out += [product(out[x], out[y]) for x, y in rules]
        return out


def transfer(text: str, grammar: Grammar, matrices: Sequence[Matrix]) -> Matrix:
    """The matrix of a sequence, its symbols' matrices multiplied two by two; audits spelt out."""
    parts = [matrices[s] for s in grammar.compress(text)]
    while len(parts) > 1:
        pairs = [product(x, y) for x, y in zip(parts[::2], parts[1::2], strict=False)]
        parts = pairs + ([parts[-1]] if len(parts) % 2 else [])
    return [[(c, spelt(a)) for c, a in row] for row in parts[0]]


def learn(sequences: DataFrame, rounds: int = ROUNDS, most: int = RULES_A_ROUND) -> Grammar:
    """Re-Pair over a written table of different sequences (symbols string, times bigint)."""
    grammar = Grammar()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            for text, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now, skip = grammar.compress(text), False
                for x, y in zip(now, now[1:], strict=False):
                    # of a run of equal symbols every second pair counts
                    skip = x == y and not skip
                    if x != y or skip:
                        found[(x, y)] += times
        columns = [pa.array([k[i] for k in found], pa.int32()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], ["x", "y", "n"])

    for _ in range(rounds):
        counted = sequences.select("symbols", "times").mapInArrow(pairs, "x int, y int, n bigint").groupBy("x", "y")
        best = counted.agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "x", "y").limit(4 * most)
        if not grammar.add([tuple(r) for r in best.collect()], most):
            break
    return grammar


# ---- rows -----------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with nulls as one space, dropped, emptied, cut, repeated and rerolled by their hash."""
    blank = F.lit(" ")
    number = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
        (F.crc32(F.concat_ws(":", *number)) % 20).alias("_kind"),
    )
    kind = F.col("_kind")
    changed = rows.filter(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("_times"),
    )
    return changed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_copy")


def matching(a: DataFrame, b: DataFrame, keys: Iterable[str]) -> Column:
    """a's keys equal b's, which are named with a leading underscore; nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_{k}"])
    return out


KEY = ("conv_id", "turn", "role", "h1", "h2")


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def marked_turns(rows: DataFrame) -> DataFrame:
    """One row for each different row: KEY, symbol (of its first) and times; without text.

    Rows that repeat meet as counts; the first of a role and text in a conversation is a merged minimum.
    """
    text = F.col("text")
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    narrow = keyed(rows.select("*", (~text.rlike(WORD)).alias("blank"), (~last.rlike("[.!?]")).alias("broken")))
    each = narrow.groupBy(*KEY, "blank", "broken").agg(F.count("*").alias("times"))
    each = written(each.withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn")), "turns")
    said = ("conv_id", "role", "h1", "h2")
    first = each.groupBy(*said).agg(F.min("at").alias("least")).select(*(F.col(k).alias(f"_{k}") for k in said), "least")
    joined = each.join(first, matching(each, first, said))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(F.col("broken"), F.upper(letter)).otherwise(letter)
    return joined.select(
        *KEY,
        "times",
        "blank",
        F.when(F.col("blank") | ~F.col("at").eqNullSafe(F.col("least")), "d").otherwise(letter).alias("symbol"),
    )


CHUNKS = (
    "chunk bigint, symbols string, turns array<bigint>, roles array<string>, h1s array<bigint>, h2s array<bigint>, "
    "firsts string, head string, tail string, illegal bigint"
)
#: Neighbouring role initials that may stand.
LEGAL = ("su", "ua", "au")


def cut(rows: Iterable[tuple], size: int) -> Iterator[tuple]:
    """Rows (part, KEY, times, symbol) in order as chunks of conv_id and CHUNKS."""
    made = 0

    def chunk(conv: object, part: int, letters: list, keys: list, firsts: list, head: str, tail: str, illegal: int) -> tuple:
        columns = [list(c) for c in zip(*keys, strict=True)] if keys else [[], [], [], []]
        return conv, part << 40 | made, "".join(letters), *columns, "".join(firsts), head, tail, illegal

    for conv, own in groupby(rows, key=lambda r: r[1]):
        letters, keys, firsts, head, before, illegal, part = [], [], [], "", None, 0, 0
        for part, _, turn, role, h1, h2, times, symbol in own:  # noqa: B007
            initial = role[:1]
            for k in range(times):
                if len(letters) == size:
                    yield chunk(conv, part, letters, keys, firsts, head, before, illegal)
                    made += 1
                    letters, keys, firsts, before, illegal = [], [], [], None, 0
                if before is None:
                    head = initial
                else:
                    illegal += before + initial not in LEGAL
                before = initial
                stays = k == 0 and symbol != "d"
                letters.append(symbol if stays else "d")
                firsts.append("01"[stays])
                if stays:
                    keys.append((turn, role, h1, h2))
        yield chunk(conv, part, letters, keys, firsts, head, before, illegal)
        made += 1


def chunks_of(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """conv_id and CHUNKS: the rows in order, cut into chunks of at most `size` symbols.

    chunk rises with the order within a conversation. firsts: "1" where a symbol may stay; the keys in
    the arrays (one for each "1") are those of its text. head and tail: the first and last role initial;
    illegal: pairs of neighbours within that may not stand.
    """
    schema = extended(turns.schema["conv_id"].dataType, CHUNKS)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    tasks = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = turns.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    numbered = ranged.select(F.spark_partition_id().alias("part"), *KEY, "times", "symbol")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(cut(rows_in(batches), size), schema, 500)

    return numbered.mapInArrow(each, schema)


# ---- solving --------------------------------------------------------------------------------


def chain(costs: Sequence[Sequence[int]], ranks: Sequence[Sequence[int]]) -> tuple[list[int], int, str]:
    """States before each chunk and after the last, the whole cost and the audit of the inserts at the end.

    costs and ranks (of the audits from one state) are flat, by pairs of states. Costs to go are added up
    from the end; then from the start each chunk takes the state that keeps the least cost, among equals
    the one of the least audit.
    """
    ends = end_costs()
    ahead = [[c for c, _ in ends]]
    for m in reversed(costs):
        ahead.append([min(m[STATES * i + j] + ahead[-1][j] for j in range(STATES)) for i in range(STATES)])
    ahead.reverse()
    states = [START]
    for m, rank, to_go in zip(costs, ranks, ahead[1:], strict=True):
        at = STATES * states[-1]
        least = min(m[at + j] + to_go[j] for j in range(STATES))
        states.append(min((rank[at + j], j) for j in range(STATES) if m[at + j] + to_go[j] == least)[1])
    return states, ahead[0][START], ends[states[-1]][1]


def applied(state: int, audit: str, symbols: str, firsts: str) -> Iterator[tuple[str, int]]:
    """What stays or comes in, as (role or "" for its own, which of the keys or -1), by the edits of an audit."""
    row = key = 0
    for edit in audit:
        if edit == "I":
            role = "u" if (state, "u") in NEXT else "a"
            state = NEXT[(state, role)]
            yield ROLE[role], -1
            continue
        if edit == "K":
            state = NEXT[(state, symbols[row].lower())]
            yield "", key
        elif edit == "R":
            role = "u" if (state, "u") in NEXT else "a"
            state = NEXT[(state, role)]
            yield ROLE[role], key
        key += firsts[row] == "1"
        row += 1


class Solver:
    """A worker's matrices: those of the grammar's symbols, and of sequences met before (bounded)."""

    def __init__(self, grammar: Grammar, most: int = 500_000):
        self.grammar, self.matrices, self.most = grammar, grammar.matrices(), most
        self.known: dict[str, Matrix] = {}
        self.weight = 0

    def matrix(self, symbols: str) -> Matrix:
        if symbols not in self.known:
            if self.weight > self.most:
                self.known.clear()
                self.weight = 0
            self.known[symbols] = transfer(symbols, self.grammar, self.matrices)
            self.weight += len(symbols)
        return self.known[symbols]


def extended(conv_id: T.DataType, fields: str) -> T.StructType:
    """conv_id of the given type, then the fields."""
    return T.StructType([T.StructField("conv_id", conv_id), *T._parse_datatype_string(fields).fields])


def batches_of(rows: Iterable[tuple], schema: T.StructType, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches, an empty one at least."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields, held = list(to_arrow_schema(schema)), []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) if held else [()] * len(fields)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema.names)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
    yield batch()
    give_back()


def rows_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a conversation in one task, in order."""
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", *order)


def costed(chunks: DataFrame, grammar: Grammar) -> DataFrame:
    """conv_id, chunk, costs and ranks of the matrix, head and tail."""
    schema = extended(chunks.schema["conv_id"].dataType, "chunk bigint, costs array<bigint>, ranks array<int>, head string, tail string")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver(grammar)

        def rows() -> Iterator[tuple]:
            for conv, number, symbols, head, tail in rows_in(batches):
                m = solver.matrix(symbols)
                ranks = [sorted(a for _, a in line).index(a) for line in m for _, a in line]
                yield conv, number, [c for line in m for c, _ in line], ranks, head, tail

        yield from batches_of(rows(), schema)

    return chunks.select("conv_id", "chunk", "symbols", "head", "tail").mapInArrow(each, schema)


def chained(matrices: DataFrame) -> DataFrame:
    """conv_id, chunk, the states before and after it, cost (of all, at the last chunk), across (whether the
    chunk begins with an illegal pair) and the audit of the inserts after it."""
    schema = extended(matrices.schema["conv_id"].dataType, "chunk bigint, before int, after int, cost bigint, across bigint, end string")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv, own in groupby(rows_in(batches), key=lambda r: r[0]):
                parts = list(own)
                states, cost, end = chain([p[2] for p in parts], [p[3] for p in parts])
                tail = None
                for n, (_, number, _, _, head, own_tail) in enumerate(parts):
                    last = n == len(parts) - 1
                    across = int(tail is not None and tail + head not in LEGAL)
                    tail = own_tail
                    yield conv, number, states[n], states[n + 1], cost if last else 0, across, end if last else ""

        yield from batches_of(rows(), schema)

    return in_order(matrices, "chunk").mapInArrow(each, schema)


def edited(chunks: DataFrame, states: DataFrame, grammar: Grammar) -> DataFrame:
    """Rows of two kinds: for each chunk its audit (place null), and one for each row of what is repaired:
    its role, its place in the chunk and the key of its text (null: inserted, without text)."""
    fields = "chunk bigint, audit string, place bigint, named string, turn bigint, role string, h1 bigint, h2 bigint"
    schema = extended(chunks.schema["conv_id"].dataType, fields)
    named = states.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "chunk")), "before", "after", "end")
    both = chunks.join(named, matching(chunks, named, ("conv_id", "chunk")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver(grammar)

        def rows() -> Iterator[tuple]:
            for conv, number, symbols, firsts, before, after, end, *keys in rows_in(batches):
                audit = solver.matrix(symbols)[before][after][1] + end
                yield conv, number, audit, None, None, None, None, None, None
                for place, (role, k) in enumerate(applied(before, audit, symbols, firsts)):
                    key = tuple(column[k] for column in keys) if k >= 0 else (None,) * 4
                    yield conv, number, None, place, role or key[1], *key

        yield from batches_of(rows(), schema)

    return both.select(
        "conv_id", "chunk", "symbols", "firsts", "before", "after", "end", "turns", "roles", "h1s", "h2s"
    ).mapInArrow(each, schema)


def digests(items: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of items (conv_id, chunk, place, role, text): one stream in order."""
    schema = extended(items.schema["conv_id"].dataType, "repaired_sha256 string")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv, own in groupby(rows_in(batches), key=lambda r: r[0]):
                digest, between = hashlib.sha256(), ""
                for _, role, text in own:
                    digest.update(f"{between}{role}:{text}".encode("utf-8", "replace"))
                    between = "\n"
                yield conv, digest.hexdigest()

        yield from batches_of(rows(), schema)

    small_batches(items.sparkSession)
    return in_order(items, "chunk", "place").select("conv_id", "role", "text").mapInArrow(each, schema)


def repair(rows: DataFrame, chunk: int = CHUNK, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns, edits, items) of conversations (conv_id, turn, role, text; no null role or text).

    turns: KEY, times, blank and symbol of each different row. edits: conv_id, chunk, cost, illegal and
    audit; a conversation's costs and illegal pairs add up, its audits join in the order of the chunks.
    items: conv_id, chunk, place, role and text of the repaired conversations' rows.
    """
    turns = written(marked_turns(rows), "marked")
    chunks = written(chunks_of(turns, chunk), "chunks")
    sequences = written(chunks.groupBy("symbols").agg(F.count("*").alias("times")), "sequences")
    grammar = learn(sequences, rounds)
    states = written(chained(costed(chunks, grammar)), "states")
    out = written(edited(chunks, states, grammar), "edited")
    told = states.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "chunk")), "cost", "across")
    told = chunks.select("conv_id", "chunk", "illegal").join(told, matching(chunks, told, ("conv_id", "chunk")))
    audits = out.filter("place is null").select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "chunk")), "audit")
    told = told.select("conv_id", "chunk", "cost", (F.col("illegal") + F.col("across")).alias("illegal"))
    edits = told.join(audits, matching(told, audits, ("conv_id", "chunk"))).drop("_conv_id", "_chunk")

    items = out.filter("place is not null")
    texts = keyed(rows).groupBy(*KEY).agg(F.first("text").alias("text")).select(*(F.col(k).alias(f"_{k}") for k in KEY), "text")
    kept = items.filter("role is not null")
    said = kept.join(texts, matching(kept, texts, KEY)).select("conv_id", "chunk", "place", F.col("named").alias("role"), "text")
    new = items.filter("role is null").select("conv_id", "chunk", "place", F.col("named").alias("role"), F.lit("").alias("text"))
    return turns, edits, said.unionByName(new)


def op12_conversation_repair(spark, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turns, edits, items = repair(damaged(given))
    # a blank row is blank each time it stands there; of the others all but the first are duplicates
    times, gone = F.col("times"), F.col("symbol") == "d"
    copies = F.when(F.col("blank"), 0).when(gone, times).otherwise(times - 1)
    faults = turns.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), times).otherwise(0)).alias("blank"),
        F.sum(copies).alias("duplicate"),
        F.sum((~gone & (F.col("symbol") == F.upper("symbol"))).cast("int")).alias("truncated"),
    )
    span = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    pieces = F.sort_array(F.collect_list(F.struct("chunk", "audit")))
    told = edits.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"),
    )
    out = given.select("conv_id").distinct()
    for more in (span, faults, told, digests(items)):
        named = more.withColumnRenamed("conv_id", "_conv_id")
        out = out.join(named, out["conv_id"].eqNullSafe(named["_conv_id"]), "left").drop("_conv_id")
    return out.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


OP12_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), bits AS (
  SELECT b, list_reduce([b::UINTEGER, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UINTEGER) ELSE x >> 1 END) AS crc
  FROM range(256) t(b)
), crcs AS (SELECT list(crc ORDER BY b) AS crcs FROM bits), hashed AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_concat([4294967295::UINTEGER], list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::UINTEGER)),
               lambda x, y: xor(x >> 8, crcs[(xor(x, y) & 255) + 1])), 4294967295::UINTEGER) % 20 AS kind
  FROM c, crcs
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (VALUES (1), (2)) t(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM damaged
), judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         coalesce(NOT regexp_matches(regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1), '[.!?]'), false) AS broken
  FROM numbered
), rows_ AS (
  SELECT conv_id, i, role, text, initial, blank OR again AS must, (broken AND NOT blank AND NOT again)::INT AS broken FROM judged
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (broken AND NOT blank AND NOT again) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
), next(s, letter, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins(s, t, cost, audit, said) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']),
         (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
         (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:'])
), walk AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} AS best FROM counts
  UNION ALL
  SELECT conv_id, i, s, min(best) FROM (
    SELECT w.conv_id, w.i + 1 AS i, e.t AS s,
           {'cost': w.best.cost + x.cost + e.cost, 'audit': w.best.audit || x.audit || e.letter,
            'said': list_concat(w.best.said, list_concat(x.said, e.said))} AS best
    FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i JOIN ins x ON x.s = w.s,
    LATERAL (
      SELECT x.t AS t, 3 AS cost, 'D' AS letter, []::VARCHAR[] AS said
      UNION ALL SELECT n.t, r.broken, 'K', [r.role || ':' || r.text] FROM next n WHERE n.s = x.t AND n.letter = r.initial AND NOT r.must
      UNION ALL SELECT n.t, 2 + r.broken, 'R', [CASE n.letter WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text]
                FROM next n WHERE n.s = x.t AND n.letter IN ('u', 'a') AND NOT r.must
    ) e
  ) GROUP BY conv_id, i, s
), ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + x.cost, 'audit': w.best.audit || x.audit, 'said': list_concat(w.best.said, x.said)}) AS best
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.n + 1 JOIN ins x ON x.s = w.s AND x.t IN (0, 3)
  GROUP BY w.conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
