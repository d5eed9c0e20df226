"""SimHash near-duplicates with pivot distance tables.

Words (ASCII letters lower-cased) form shingles; a bit of the fingerprint is set where it is set in over
half of the shingles' XXH64 hashes. Equal fingerprints are one from here on. To find all pairs at
most `bits` apart, the fingerprint is cut into blocks; two such fingerprints agree in at least
blocks - bits of them, so each fingerprint is dealt to a group for every choice of that many blocks.
In a group the distances of each fingerprint to `PIVOTS` reference fingerprints are tabled first. Two
fingerprints are never nearer than the largest difference of their table rows: pairs with a difference
above `bits` are discarded by the tables, and the survivors verified on the fingerprints. Links that
only tie what is tied already in the same partition are not put out.

Groups with more than `GROUP` fingerprints are split into blocks of members, and every pair of blocks
is a group of its own. Links meet as connected components in Spark.

Defined results: null and empty texts, and such without a word, have fingerprint zero and link like any
other; a text with fewer words than a shingle is one shingle; repeated rows stay rows of their own with
the same component; an empty table gives no rows; a null doc_id never is a component's id unless the
component has no other. `keep` and `keep_similar` return one row of each component: smallest doc_id,
nulls last; other columns may have any name.

`keep_similar` finds all texts whose sets of shingles have a Jaccard similarity of `least` or more. One
fingerprint of 64 bits can't: at 0.8 its bits differ in some ten places, as those of many strangers do.
So a text has `PARTS` fingerprints, each the SimHash of the `PART` shingles that come first in an order
of its own. Two texts have the same first shingles in an order with a chance of about similarity ** PART,
so of twelve fingerprints one at least is equal for 99.8 % of the pairs at 0.8 and more beyond. All
fingerprints at most `NEAR` bits apart are found by the pivot tables, as above, and tied. Texts with tied
ones are compared exactly, shingle by shingle, within groups that are split like those above; only what
is `least` similar is linked. Texts without a word are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpage.llm.common import free, give_back, quoted, small_batches, table, written
from siftpage.llm.components import components
from siftpage.llm.kneser_ney import mixed, token_slices

SHINGLE, BITS = 4, 4
#: Of `keep_similar`: fingerprints of a text, shingles of each, and bytes of shingles in one group.
PARTS, PART, GROUP_BYTES = 12, 4, 48_000_000
#: Of `keep_similar` too: bits between fingerprints of parts, and the blocks that these are cut into. Two
#: blocks of 32 bits make two small groups for each fingerprint, as there are twelve for each text.
NEAR, HALVES = 1, 2
PIVOTS, GROUP = 16, 50_000
#: Groups up to this size are compared in columns, all at once.
SMALL = 32
#: Blocks by the number of different fingerprints: more blocks, longer keys, smaller groups.
BLOCKS = ((1 << 26, 6), (1 << 31, 7), (1 << 63, 8))

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """As an unsigned number of 64 bits."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(whole, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    hashes = np.array([digest(whole[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, content (hash of the text) and fp (signed) for each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("content"), pa.array(found.view(np.int64))], ["doc_id", "content", "fp"]
            )
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("content"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, content bigint, fp bigint")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: a fixed stream of well mixed numbers."""
    z = (np.arange(1, count + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot table: one row for each fingerprint, one column for each reference."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)


def near(prints, rows, a, b, bits) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) survive the pivot tables and are at most `bits` apart."""
    alive = np.flatnonzero(np.abs(rows[a] - rows[b]).max(1) <= bits)
    return alive[np.bitwise_count(prints[a[alive]] ^ prints[b[alive]]) <= bits]


def links_of_groups(starts: np.ndarray, prints: np.ndarray, references: np.ndarray, bits: int = BITS):
    """Linked pairs, as positions, of sorted groups that begin at `starts`; all that is needed to tie
    what is linked in a group, for small groups every link."""
    rows = distances(prints, references)
    sizes = np.diff(np.append(starts, len(prints)))
    end = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, int(min(SMALL, sizes.max(initial=0)))):
        a = np.flatnonzero(small & (np.arange(len(prints)) + step < end))
        hit = a[near(prints, rows, a, a + step, bits)]
        yield hit, hit + step
    for g in np.flatnonzero(sizes > SMALL):
        # those next to be compared leave the rest, so that a dense group costs little more than its size
        rest = np.arange(starts[g], starts[g] + sizes[g])
        rest = rest[np.argsort(rows[rest, 0], kind="stable")]
        todo: list[int] = []
        while len(rest):
            if not todo:
                todo, rest = [int(rest[0])], rest[1:]
            x = todo.pop()
            low, high = np.searchsorted(rows[rest, 0], (rows[x, 0] - bits, rows[x, 0] + bits + 1))
            b = rest[low:high]
            hit = near(prints, rows, np.full(len(b), x), b, bits)
            if len(hit):
                yield np.full(len(hit), x), b[hit]
                todo += b[hit].tolist()
                rest = np.delete(rest, low + hit)


def blocks_for(count: int) -> int:
    return next(b for most, b in BLOCKS if count <= most)


def masks(blocks: int, bits: int = BITS) -> list[int]:
    """A mask for every choice of blocks - bits blocks, as signed numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    chosen = [sum(c) for c in combinations(each, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def linked(prints: DataFrame, bits: int = BITS, group: int = GROUP, blocks: int | None = None) -> DataFrame:
    """a, b: links between different fingerprints (fp, each once) that tie all that is within reach.

    Of the pairs at most `bits` apart some are left out whose ends the others tie together. blocks: more
    than bits; by default by the number of fingerprints.
    """
    count = prints.count()
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks(blocks or blocks_for(count), bits)))
    dealt = prints.select("fp", F.posexplode(keys).alias("t", "key"))
    large = dealt.groupBy("t", "key").count().filter(F.col("count") > group)
    parts = large.select("t", "key", F.ceil(F.col("count") / (group // 2)).cast("int").alias("parts"))
    placed = dealt.join(parts, ["t", "key"], "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))))
    others = F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)).cast("bigint") - 1)
    pairs = F.transform(others, lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    spread = placed.select("fp", "t", "key", F.explode(pairs).alias("p")).select(
        F.xxhash64("t", "key", "p.i", "p.j").alias("g"), "t", "key", "p.i", "p.j", "fp"
    )
    tasks = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // 200_000)
    order = ["g", "t", "key", "i", "j"]
    sorted_ = spread.repartition(tasks, "g").sortWithinPartitions(*order, "fp")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = pivots()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def found(marks: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            if len(values):
                starts = np.append(0, np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1)
                for x, y in links_of_groups(starts, values, references, bits):
                    for u, v in zip(values[x].view(np.int64).tolist(), values[y].view(np.int64).tolist(), strict=True):
                        ru, rv = root(u), root(v)
                        if ru != rv:
                            parent[max(ru, rv)] = min(ru, rv)
                            a.append(u)
                            b.append(v)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        marks, values = np.zeros((0, len(order)), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            marks = np.concatenate([marks, np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in order], 1)])
            values = np.concatenate([values, np.asarray(batch.column("fp")).view(np.uint64)])
            if len(marks):
                # the last group may go on in the next batch
                last = int(np.flatnonzero((marks != marks[-1]).any(1))[-1] + 1) if (marks != marks[-1]).any() else 0
                yield found(marks[:last], values[:last])
                marks, values = marks[last:], values[last:]
        yield found(marks, values)
        give_back()

    return sorted_.mapInArrow(each, "a bigint, b bigint")


def group(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, content, fp, root and component_id for each row of docs (doc_id, text)."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    each = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ties = components(linked(each.select("fp"), bits))
    rooted = each.join(ties.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    tied = rooted.filter("root <> fp").select("root").distinct()
    # only components of several fingerprints need a minimum over them
    several = rooted.join(tied, "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(several, "root", "left").select("fp", "root", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named, "fp")


def one_of_each(docs: DataFrame, content: Column, members: DataFrame) -> DataFrame:
    """One row of docs for each root, with all columns: smallest doc_id (nulls last), then content.

    members: doc_id, content and root of each row. Rows that are equal in doc_id and content are merged:
    the repeated ones first by both, so that a row which stands a million times meets as one.
    """
    own = docs.columns
    mark, who, what = (free(n, own) for n in ("mark", "who", "what"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "content")
    chosen = members.groupBy("root").agg(F.min(order).alias("m"))
    names = chosen.select(F.col("m.doc_id").alias(who), F.col("m.content").alias(what))
    marked = docs.withColumn(mark, content)
    kept = marked.join(names, marked["doc_id"].eqNullSafe(names[who]) & (marked[mark] == names[what]), "left_semi")
    repeated = (
        members.groupBy("doc_id", "content").count().filter("count > 1")
        .select(F.col("doc_id").alias(who), F.col("content").alias(what))
    )
    same = kept["doc_id"].eqNullSafe(repeated[who]) & (kept[mark] == repeated[what])
    others = [c for c in own if c != "doc_id"]
    single = kept.join(repeated, same, "left_anti").select(*quoted(own))
    merged = kept.join(repeated, same, "left_semi").groupBy("doc_id", mark)
    # as one struct: the columns of a merged row come from one of the rows
    merged = merged.agg(F.first(F.struct(*quoted(others))).alias(what))
    return single.unionByName(merged.select("doc_id", *(F.col(what)[c].alias(c) for c in others)).select(*quoted(own)))


def keep(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of docs for each component of fingerprints that are at most `bits` apart."""
    return one_of_each(docs, F.xxhash64("text"), group(docs, shingle, bits))


# ---- at a stated similarity -----------------------------------------------------------------


def shingle_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Slices of a batch, and for each of their rows its number and its different shingles' hashes in order."""
    factors = mixed(np.arange(2, shingle + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for tokens, counts, part in token_slices(batches):
        ends = np.cumsum(counts)
        for i, (start, end) in enumerate(zip((ends - counts).tolist(), (ends - 1).tolist(), strict=True)):
            words = tokens[start:end]
            n = max(1, len(words) - shingle + 1) if len(words) else 0
            sums = np.zeros(n, np.uint64)
            for k in range(min(shingle, len(words))):
                sums += words[k : k + n] * factors[k]
            yield part, i, np.unique(mixed(sums))


def part_fingerprints(shingles: np.ndarray, parts: int = PARTS, part: int = PART) -> np.ndarray:
    """The SimHash of the `part` first shingles in each of `parts` orders."""
    first = np.zeros((parts, min(part, len(shingles))), np.uint64)
    for t in range(parts if len(shingles) else 0):
        place = mixed(shingles ^ np.uint64((t + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        first[t] = shingles[np.argpartition(place, part - 1)[:part]] if len(shingles) > part else shingles
    counts = np.unpackbits(first.astype("<u8").view(np.uint8).reshape(parts, -1, 8), axis=2).sum(1, dtype=np.int64)
    return np.packbits(counts * 2 > first.shape[1], axis=1).view("<i8").ravel()


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, content (MD5 of the text) and prints (array) for each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        for part, i, shingles in shingle_sets(batches, shingle):
            rows.append(part_fingerprints(shingles))
            if i == part.num_rows - 1:
                flat = pa.array(np.concatenate(rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * PARTS), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("content"), lists], ["doc_id", "content", "prints"])
                rows = []
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", content_of(F.col("text")).alias("content"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, content string, prints array<bigint>")


def content_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def similar(prints: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """a, b: links between contents that are `least` similar, enough to tie all that the search finds.

    prints: content (each once) and prints.
    """
    parts_ = prints.select("content", F.posexplode("prints").alias("t", "print"))
    each_print = written(parts_.select(F.col("print").alias("fp")).distinct(), "prints")
    tied = components(linked(each_print, NEAR, blocks=HALVES)).select(F.col("node").alias("print"), F.col("root").alias("tie"))
    dealt = parts_.join(tied, "print", "left").select(F.xxhash64("t", F.coalesce("tie", "print")).alias("bucket"), "content")
    mark = F.xxhash64("content")
    several = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(38,0)")).alias("s"))
    # most buckets of a group of copies have the same members: one of them is enough
    chosen = several.filter("n > 1").groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = written(dealt.join(chosen, "bucket", "left_semi"), "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[bytes] = []
        for part, i, shingles in shingle_sets(batches, shingle):
            found.append(shingles.tobytes())
            if i == part.num_rows - 1:
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(found, pa.binary())], ["content", "shingles"])
                found = []
        give_back()

    wanted = members.select("content").distinct()
    texts = docs.select(content_of(F.col("text")).alias("content"), "text").join(wanted, "content", "left_semi")
    arrays = written(texts.groupBy("content").agg(F.first("text").alias("text")).mapInArrow(sets, "content string, shingles binary"), "sets")
    size = F.octet_length("shingles")
    sizes = arrays.select("content", size.alias("bytes"))
    parts = F.greatest(F.lit(1), F.ceil(2 * F.sum("bytes") / GROUP_BYTES)).cast("int")
    blocks = members.join(sizes, "content").groupBy("bucket").agg(parts.alias("parts"))
    # a group above its bytes is split into blocks of members, and each pair of blocks is a group
    placed = members.join(blocks, "bucket").withColumn("mine", F.pmod(F.xxhash64(F.lit(5), "content"), "parts").cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j"))
    )
    spread = placed.select("bucket", "content", F.explode(pairs).alias("p")).select("bucket", "p.i", "p.j", "content")
    rows = spread.join(arrays, "content")
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = ["bucket", "i", "j"]
    sorted_ = rows.repartition(tasks, *key).sortWithinPartitions(*key, size, "content")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (*key, "content", "shingles")), strict=True))
        for _, own in groupby(rows, key=lambda r: r[:3]):
            group_ = list(own)
            a, b = [], []
            for x, y in links_of_sets([np.frombuffer(r[4], "<u8") for r in group_], least):
                u, v = group_[x][3], group_[y][3]
                if (ru := root(u)) != (rv := root(v)):
                    parent[max(ru, rv)] = min(ru, rv)
                    a.append(u)
                    b.append(v)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())] * 2, ["a", "b"])
        give_back()

    return sorted_.select(*key, "content", "shingles").mapInArrow(each, "a string, b string")


def links_of_sets(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Pairs (positions) of sets whose Jaccard similarity is `least` or more, enough to tie all such pairs.

    sets: sorted, by rising size. What is linked leaves the rest, so that a dense group costs little more
    than its size; one set is compared with all others of a fitting size at once.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    rest = np.arange(len(sets))
    todo: list[int] = []
    while len(rest):
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
        x = todo.pop()
        low = int(np.searchsorted(sizes[rest], least * sizes[x] - 1e-9, "left"))
        high = int(np.searchsorted(sizes[rest], sizes[x] / least + 1e-9, "right"))
        near_ = rest[low:high]
        if not len(near_):
            continue
        if sizes[x]:
            every = np.concatenate([sets[i] for i in near_])
            at = np.minimum(np.searchsorted(sets[x], every), sizes[x] - 1)
            owner = np.repeat(np.arange(len(near_)), sizes[near_])
            shared = np.bincount(owner, sets[x][at] == every, len(near_))
            hit = np.flatnonzero(shared >= least * (sizes[near_] + sizes[x] - shared) - 1e-9)
        else:
            hit = np.arange(len(near_))
        for i in near_[hit].tolist():
            yield x, i
        todo += near_[hit].tolist()
        rest = np.delete(rest, low + hit)


def group_similar(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, content and root for each row of docs (doc_id, text); equal roots: one group."""
    rows = written(sketches(docs, shingle), "sketches")
    prints = rows.groupBy("content").agg(F.first("prints").alias("prints"))
    ties = components(similar(prints, docs, shingle, least)).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = rows.join(ties, rows["content"] == ties["_node"], "left")
    return joined.select("doc_id", "content", F.coalesce("_root", "content").alias("root"))


def keep_similar(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of docs for each group of texts that similar pairs tie together."""
    members = written(group_similar(docs.select("doc_id", "text"), shingle, least), "groups")
    return one_of_each(docs, content_of(F.col("text")), members)


def op6_simhash_dedup(spark, folder: str) -> DataFrame:
    members = group(table(spark, folder, "documents").select("doc_id", "text"))
    return members.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
