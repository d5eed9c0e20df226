"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Tokens are words (ASCII letters lower-cased) and one end per text; the first token's context is a
start. Spark counts in three rounds, each a map that adds up in the task, a shuffle of sorted count
arrays, and a merge per bucket:

1. words, by hash: the vocabulary, a sorted hash array; a word's place in it is its number;
2. pairs of numbers (context, word), by ranges of the pair: sorted key arrays with counts. A context
   that holds more than a bucket's share of the tokens is cut into ranges of its words;
3. for each word: in how many contexts it stands, and for each context how many words follow it once,
   twice and more often.

    p(w | u) = max(c(u w) - D, 0) / c(u) + g(u) * q(w)
    q(w)     = max(n(w) - D', 0) / n + g' / (V + 1)

with three discounts on each level from the counts of counts; an unknown word has n(w) = 0, and an
unknown context gives q(w). Workers map the arrays from files into memory and look up a slice of texts
at a time, in sorted order.

The arrays are files below spark.checkpoint.dir, which must lie on a file system that all machines
mount; a task writes under another name first, so a repeated task does no harm. All counts cover
all training texts, and buckets are added as the texts grow.

Defined results: null and empty texts have the end as their only token; repeated rows count and are
scored each; without training texts every probability is 1 and every score 0; an empty table gives no
rows; other columns of the table are not read.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpage.llm.common import fold_of, give_back, mounted, scratch, table, written

#: Bytes of training text for each bucket, bytes of text hashed at once, counts held before a merge.
BUCKET_BYTES, SLICE, HELD = 24_000_000, 4_000_000, 3_000_000
#: Pair buckets that a worker has mapped at once, three handles each.
OPEN = 32
END = np.uint64(0x5851F42D4C957F2D)

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be undone
UNDO = pow(BASE, -1, 1 << 64)
WINDOW = 1 << 20


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: A random number for each byte.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of all words of a buffer at once, from running sums of bytes times powers."""

    def __init__(self):
        self.up, self.down = powers(BASE, WINDOW + 1), powers(UNDO, WINDOW + 1)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            # as many words as fit in a window, one at least
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + WINDOW, "right")))
            low, high = int(starts[at]), int(ends[to - 1])
            up, down = self.up, self.down
            if high - low > WINDOW:
                up, down = powers(BASE, high - low + 1), powers(UNDO, high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(BYTE[data[low:high]] * up[: high - low], out=sums[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = mixed((sums[e] - sums[s]) * down[s] ^ (e - s).astype(np.uint64))
            at = to
        return out


def token_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Token hashes, the number of tokens of each text, and the rows, for slices of about `SLICE` bytes."""
    hasher = Hasher()
    for batch in batches:
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0)).astype(np.int64)
        if not len(lengths):
            continue
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // SLICE)) + 1
        for rows in np.split(np.arange(len(lengths)), cuts):
            part = batch.slice(int(rows[0]), len(rows))
            texts = part.column("text").fill_null("")
            data = LOWER[np.frombuffer(b"".join(pa.array(texts, pa.binary()).to_pylist()), np.uint8)]
            edges = np.append(0, np.cumsum(lengths[rows]))
            full = lengths[rows] > 0
            word = ~SPACES[data]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            first[edges[:-1][full]] = word[edges[:-1][full]]
            last[edges[1:][full] - 1] = word[edges[1:][full] - 1]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            text_of = np.searchsorted(edges, starts, "right") - 1
            counts = np.bincount(text_of, minlength=len(rows)) + 1
            tokens = np.full(len(starts) + len(rows), END, np.uint64)
            tokens[np.arange(len(starts)) + text_of] = hasher.words(data, starts, ends)
            yield tokens, counts, part


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with its sum."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(counts, at, axis=0)


class Held:
    """Counts of a task, merged whenever many have come together."""

    def __init__(self):
        self.parts, self.size, self.limit = [], 0, HELD

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > self.limit:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))]
            self.size = len(self.parts[0][0])
            self.limit = max(HELD, 2 * self.size)
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def packed(keys: np.ndarray) -> bytes:
    """Differences of sorted numbers, low bytes first and high bytes last, which compress to nothing."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T)
    return np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64)


ROW = "bucket bigint, keys binary, counts binary"


def rows_of(buckets, keys, counts) -> pa.RecordBatch:
    kinds = [pa.array(buckets, pa.int64()), pa.array([packed(k) for k in keys], pa.binary())]
    return pa.RecordBatch.from_arrays(
        kinds + [pa.array([np.asarray(c).astype("<u4").tobytes() for c in counts], pa.binary())], ["bucket", "keys", "counts"]
    )


def dealt(keys: np.ndarray, counts: np.ndarray, bucket_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each bucket; buckets rise with the keys."""
    for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(bucket_of)) + 1) if len(keys) else []:
        yield rows_of([int(bucket_of[part[0]])], [keys[part]], [counts[part]])


def merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([unpacked(k.as_py()) for k in group.column("keys")])
    counts = np.concatenate([np.frombuffer(c.as_py(), "<u4") for c in group.column("counts")])
    return summed(keys, counts.astype(np.int64))


def saved(path: str, values: np.ndarray) -> None:
    """Under another name first: a task may run twice, or stop halfway."""
    own = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(own, "wb") as f:
        np.save(f, values)
    os.replace(own, path)


def mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


def slice_of(path: str, kind: str, at: int, values: np.ndarray) -> None:
    """Write values at their place in a file of fixed size."""
    if len(values):
        with open(path, "r+b") as f:
            f.seek(at * np.dtype(kind).itemsize)
            f.write(np.ascontiguousarray(values, kind).tobytes())


def whole(path: str, kind: str) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


def hash_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def discounts(n: list[int]) -> np.ndarray:
    """For counts 1, 2 and above, from how many counts are 1, 2, 3 and 4; kept within what they discount."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return np.array([0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(raw, 0.05, [1.0, 2.0, 3.0])


def found(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted number, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_, wanted), max(0, len(sorted_) - 1))
    return at, (sorted_[at] == wanted if len(sorted_) else np.zeros(len(wanted), bool))


def numbered(tokens: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and whether they are known; each different hash is looked up once, in order."""
    different, back = np.unique(tokens, return_inverse=True)
    at, known = found(vocabulary, different)
    return at.astype(np.uint64)[back], known[back]


def contexts_of(numbers: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    """The number before each token, `start` before the first of each text."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[np.append(0, np.cumsum(counts)[:-1])] = start
    return out


class Model:
    """Where the arrays lie, and the few numbers that all of them share."""

    def __init__(self, folder: str):
        self.folder, self.words, self.tokens, self.texts = folder, 0, 0, 0
        self.bounds = np.zeros(0, np.uint64)
        self.upper = self.lower = np.zeros(3)
        self.continuations, self.lower_rest = 1, 1.0


def train(docs: DataFrame) -> Model:
    """Count docs (text) and write the model's arrays; only training texts may be given."""
    spark = docs.sparkSession
    model = Model(mounted(scratch(spark, "kneser-ney")))
    folder = model.folder
    os.makedirs(folder)
    texts = docs.select("text")
    size, model.texts = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if not model.texts:
        return model
    buckets = max(4, -(-size // BUCKET_BYTES))

    def count_words(batches):
        held = Held()
        for tokens, _, _ in token_slices(batches):
            held.add(tokens)
        keys, counts = held.merge()
        yield from dealt(keys, counts, hash_bucket(keys, buckets))
        give_back()

    # words of more than a part of a bucket's share are told to the driver: a few for each bucket
    share = size / 6 / buckets / 4

    def keep_words(group: pa.Table) -> pa.Table:
        keys, counts = merged(group)
        b = group.column("bucket")[0].as_py()
        saved(f"{folder}/words-{b}.npy", keys)
        saved(f"{folder}/words-{b}-counts.npy", counts)
        hot = np.flatnonzero(counts > share)
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (hot, counts[hot])]
        return pa.table({"bucket": [b], "n": [len(keys)], "total": [int(counts.sum())], "hot": lists[0], "times": lists[1]})

    kind = "bucket bigint, n bigint, total bigint, hot array<bigint>, times array<bigint>"
    told = texts.mapInArrow(count_words, ROW).groupBy("bucket").applyInArrow(keep_words, kind).collect()
    told = sorted(told, key=lambda r: r["bucket"])
    first = dict(zip([r["bucket"] for r in told], np.append(0, np.cumsum([r["n"] for r in told]))[:-1].tolist(), strict=True))
    words = model.words = sum(r["n"] for r in told)
    model.tokens = sum(r["total"] for r in told)
    if words >= 1 << 31:
        raise ValueError("the vocabulary has more words than numbers of 32 bits")
    for name, kind, n in (("hash", "<u8", words), ("count", "<i8", words), ("rest", "<f8", words + 1), ("places", "<i8", words + 1)):
        with open(f"{folder}/{name}", "wb") as f:
            f.truncate(n * np.dtype(kind).itemsize)

    def place_words(batches):
        for batch in batches:
            for b in batch.column("id").to_pylist():
                if b in first:
                    slice_of(f"{folder}/hash", "<u8", first[b], mapped(f"{folder}/words-{b}.npy"))
                    slice_of(f"{folder}/count", "<i8", first[b], mapped(f"{folder}/words-{b}-counts.npy"))
            yield batch

    spark.range(0, buckets, 1, buckets).mapInArrow(place_words, "id bigint").count()

    # pair ranges: equal numbers of contexts; a frequent context is cut by its words
    bounds = {(words * k // buckets) << 32 for k in range(1, buckets)}
    frequent = [(first[r["bucket"]] + i, c) for r in told for i, c in zip(r["hot"], r["times"], strict=True)]
    for h, c in [*frequent, (words, model.texts)]:
        parts = max(1, int(c / (4 * share)) + 1)
        bounds |= {(h << 32) + words * k // parts for k in range(parts)} | {(h + 1) << 32}
    model.bounds = np.array(sorted(bounds), np.uint64)
    edges = model.bounds

    def count_pairs(batches):
        vocabulary, held = whole(f"{folder}/hash", "<u8"), Held()
        for tokens, counts, _ in token_slices(batches):
            numbers, _ = numbered(tokens, vocabulary)
            held.add(contexts_of(numbers, counts, words) << np.uint64(32) | numbers)
        keys, counts = held.merge()
        yield from dealt(keys, counts, np.searchsorted(edges, keys, "right"))
        give_back()

    def keep_pairs(group: pa.Table) -> pa.Table:
        keys, counts = merged(group)
        b = group.column("bucket")[0].as_py()
        saved(f"{folder}/pairs-{b}.npy", keys)
        large = np.flatnonzero(counts > 254)
        saved(f"{folder}/pairs-{b}-counts.npy", np.minimum(counts, 255).astype(np.uint8))
        saved(f"{folder}/pairs-{b}-large.npy", np.stack([large, counts[large]]))
        # counts of counts to bucket -1; contexts by kind 0 to 2 and words by kind 3 to ranges of numbers
        out = [rows_of([-1], [np.arange(1, 5, dtype=np.uint64)], [[int((counts == k).sum()) for k in (1, 2, 3, 4)]])]
        heads, tails = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        for kind, who in ((0, heads[counts == 1]), (1, heads[counts == 2]), (2, heads[counts > 2]), (3, tails)):
            who, times = np.unique(who, return_counts=True)
            out += [
                rows_of([int(x["bucket"][0].as_py()) * 4 + kind], [unpacked(x["keys"][0].as_py())], [np.frombuffer(x["counts"][0].as_py(), "<u4")])
                for x in dealt(who, times, who * np.uint64(buckets) // np.uint64(words + 1))
            ]
        return pa.Table.from_batches(out)

    paired = texts.mapInArrow(count_pairs, ROW).groupBy("bucket").applyInArrow(keep_pairs, ROW)
    paired = written(paired, "pairs")
    ones = [np.frombuffer(r["counts"], "<u4").astype(np.int64) for r in paired.filter("bucket = -1").collect()]
    model.upper = discounts(reduce(np.add, ones).tolist())
    upper = model.upper
    texts_in = model.texts

    def keep_stats(group: pa.Table) -> pa.Table:
        r = group.column("range")[0].as_py()
        # numbers n with n * buckets // (words + 1) = r
        low, high = -(-r * (words + 1) // buckets), -(-(r + 1) * (words + 1) // buckets)
        kinds = np.zeros((4, high - low), np.int64)
        for bucket, keys, counts in zip(group["bucket"].to_pylist(), group["keys"], group["counts"], strict=True):
            kinds[bucket % 4, unpacked(keys.as_py()).astype(np.int64) - low] += np.frombuffer(counts.as_py(), "<u4")
        slice_of(f"{folder}/places", "<i8", low, kinds[3])
        times = np.maximum(1, whole(f"{folder}/count", "<i8")[low:high].astype(np.float64))
        times = times if high <= words else np.append(times, texts_in)
        slice_of(f"{folder}/rest", "<f8", low, (kinds[:3].T @ upper) / times)
        return pa.table({"sum": [int(kinds[3].sum())]} | {f"n{k}": [int((kinds[3] == k).sum())] for k in (1, 2, 3, 4)} | {"n3m": [int((kinds[3] > 2).sum())]})

    ranges = paired.filter("bucket >= 0").withColumn("range", F.expr("bucket div 4"))
    schema = "sum bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, n3m bigint"
    sums = ranges.groupBy("range").applyInArrow(keep_stats, schema).groupBy().sum().first()
    model.continuations = sums[0]
    model.lower = discounts(list(sums[1:5]))
    # what the lower discounts leave to all words alike
    model.lower_rest = float(model.lower @ np.array([sums[1], sums[2], sums[5]])) / sums[0]
    return model


class Reader:
    """The arrays of a model, mapped into a worker's memory as they are asked for.

    A map holds a file handle, so that of the pair buckets those asked for last stay mapped, `OPEN` at most:
    a slice of texts asks in the order of the buckets, and each is mapped once for it.
    """

    def __init__(self, model: Model):
        self.model = model
        self.pairs: OrderedDict[int, list[np.ndarray] | None] = OrderedDict()
        self.hash, self.count, self.rest, self.places = (
            whole(f"{model.folder}/{n}", k) for n, k in (("hash", "<u8"), ("count", "<i8"), ("rest", "<f8"), ("places", "<i8"))
        )

    def bucket(self, b: int) -> list[np.ndarray] | None:
        """The keys, counts and large counts of a bucket; None if it has none."""
        if b in self.pairs:
            self.pairs.move_to_end(b)
        else:
            while len(self.pairs) >= OPEN:
                self.pairs.popitem(last=False)
            path = f"{self.model.folder}/pairs-{b}"
            there = os.path.exists(f"{path}.npy")
            self.pairs[b] = [mapped(f"{path}{x}.npy") for x in ("", "-counts", "-large")] if there else None
        return self.pairs[b]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """How often each pair was seen; keys in order."""
        out = np.zeros(len(keys), np.int64)
        bucket = np.searchsorted(self.model.bounds, keys, "right")
        for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(bucket)) + 1) if len(keys) else []:
            b = int(bucket[part[0]])
            maps = self.bucket(b)
            if maps is None:
                continue
            known, counts, large = maps
            at, there = found(known, keys[part])
            value = np.where(there, counts[at], 0).astype(np.int64)
            many = np.flatnonzero(value == 255)
            value[many] = large[1][np.searchsorted(large[0], at[many])]
            out[part] = value
        return out

    def logs(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token its count, log10 of the base probability and log10 of the model's."""
        m = self.model
        numbers, known = numbered(tokens, self.hash)
        safe = np.where(known, numbers, 0).astype(np.int64)
        times = np.where(known, self.count[safe], 0)
        base = np.log10((times + 1) / (m.tokens + m.words + 1))
        off = np.append(0.0, m.lower)
        places = np.where(known, self.places[safe], 0)
        q = np.maximum(places - off[np.minimum(places, 3)], 0) / m.continuations + m.lower_rest / (m.words + 1)
        # a text's first context is the start, whose number follows the words'
        context = contexts_of(np.where(known, numbers, np.uint64(0xFFFFFFFF)), counts, m.words)
        seen = context != np.uint64(0xFFFFFFFF)
        c = np.where(seen, context, 0).astype(np.int64)
        pairs = np.zeros(len(tokens), np.int64)
        both = np.flatnonzero(seen & known)
        keys, back = np.unique(context[both] << np.uint64(32) | numbers[both], return_inverse=True)
        pairs[both] = self.pair_counts(keys)[back]
        total = np.where(c == m.words, m.texts, self.count[np.minimum(c, m.words - 1)])
        upper = np.append(0.0, m.upper)
        p = np.maximum(pairs - upper[np.minimum(pairs, 3)], 0) / np.maximum(1, total) + self.rest[c] * q
        return times, base, np.log10(np.where(seen, p, q))


RESULT = "n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens, n_known, base_score and score of each row of docs (text and `keep`).

    Perplexity is 10 ** (-score / n_tokens).
    """
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model) if model.texts else None
        for tokens, counts, rows in token_slices(batches):
            text_of = np.repeat(np.arange(len(counts)), counts)
            zero = np.zeros(len(tokens))
            times, base, own = reader.logs(tokens, counts) if reader else (zero, zero, zero)
            add = lambda x: np.bincount(text_of, x, len(counts))
            values = [counts.astype(np.int64), add(times > 0).astype(np.int64), add(base), add(own)]
            names = [*keep, "n_tokens", "n_known", "base_score", "score"]
            yield pa.RecordBatch.from_arrays([rows.column(n) for n in keep] + [pa.array(v) for v in values], names)
        give_back()

    return docs.select(*keep, "text").mapInArrow(each, f"{schema}, {RESULT}")


def op3_lm_scoring(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out: Column = fold_of(F.col("doc_id"), 7) == 2
    model = train(docs.filter(~held_out))
    return score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
