"""BPE encoding and decoding, with tree concatenation for long unsplit text.

A text is normalised and cut into pieces as the tokenizer file says; BPE never merges across pieces, nor
pieces across blanks, so each different word is encoded once and kept. A file with other steps than those
known here is left to the library's own, long texts too.
Pieces up to `LEAF` symbols are encoded directly. A longer piece is
a long unsplit text: it is halved down to leaves, the leaves are encoded in one parallel batch, and
the halves are joined from the bottom up. At a join a window of tokens around the cut is encoded
again. It is grown until it holds a token that the left half has too, and after it one that the right
half has too; the left half up to the first, the window between and the right half from the second
are the result. A sequence of tokens is the encoding of its text exactly if each two neighbours are
the encoding of theirs, and every two neighbours of the result stand side by side in the left half,
in the window or in the right half; so the joined tokens equal those of the whole piece.

Defined results: null is encoded as the empty text, to no tokens; special tokens in a text get their
ids, as the tokenizer does; repeated rows are encoded alike; an empty table gives no rows; other
columns pass through (own columns `ids` and `decoded` are replaced). Nothing is truncated or padded.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftpage.llm.common import give_back, quoted, small_batches, table

LEAF = 256
#: Tokens on each side of a join in the first window.
WINDOW = 4
#: Bytes of words and their encodings that a worker keeps, characters of text in one slice of work, and
#: pieces in one call of the library, whose results are large.
CACHED, SLICE, AT_ONCE = 112 << 20, 500_000, 2_000
VOCABULARY = "word_bpe_49k.json"

Token = tuple[int, int, int]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def joined(text: str, left: list[Token], right: list[Token], encode: Callable[[str], list[Token]]) -> list[Token]:
    """Tokens (id, start, end) of text from those of its two parts."""
    size = WINDOW
    while True:
        a, b = left[-size:], right[:size]
        start, end = a[0][1], b[-1][2]
        window = [(i, s + start, e + start) for i, s, e in encode(text[start:end])]
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        if whole_left and whole_right:
            return window
        in_left = {t: k for k, t in enumerate(a, len(left) - len(a))}
        in_right = {t: k for k, t in enumerate(b)}
        first = 0 if whole_left else next((k for k, t in enumerate(window) if t in in_left), None)
        last = len(window) if whole_right else next((k for k in range(len(window) - 1, -1, -1) if window[k] in in_right), None)
        if first is not None and last is not None and first < last:
            head = [] if whole_left else left[: in_left[window[first]]]
            tail = [] if whole_right else right[in_right[window[last]] :]
            return head + window[first:last] + tail
        size *= 2


def tree(text: str, encode_all: Callable[[list[str]], list[list[Token]]], leaf: int = LEAF) -> list[Token]:
    """Tokens of one unsplit text: leaves in one batch, then joins level by level."""
    cuts = [(0, len(text))]
    while max(e - s for s, e in cuts) > leaf:
        cuts = [c for s, e in cuts for c in (((s, (s + e) // 2), ((s + e) // 2, e)) if e - s > 1 else ((s, e),))]
    parts = [
        [(i, a + s, b + s) for i, a, b in tokens]
        for (s, _), tokens in zip(cuts, encode_all([text[s:e] for s, e in cuts]), strict=True)
    ]
    encode = lambda t: encode_all([t])[0]
    while len(parts) > 1:
        pairs = [joined(text, x, y, encode) for x, y in zip(parts[::2], parts[1::2], strict=False)]
        parts = pairs + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


#: The steps before and after the model for which pieces are cut here.
KNOWN_STEPS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
#: Bytes of UTF-8 that only occur in characters below U+0240 (or continue them), without U+001C to U+001F.
PLAIN_BYTES = bytes([*range(0x1C), *range(0x20, 0x80), *range(0x80, 0xC9)])

Word = str | tuple[str, ...]


def segments(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of segments of a buffer, one segment after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


class Spelling:
    """The strings of all ids in one buffer, each with a blank behind it."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join([s + b" " for s in strings]), np.uint8)
        self.lengths = np.array([len(s) + 1 for s in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def join(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """For each text (so many ids) the strings of its ids, joined by blanks."""
        lengths = self.lengths[ids]
        data = self.data[segments(self.starts[ids], lengths)].tobytes()
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(ends, ends[1:], strict=False)]


class Encoder:
    """One worker's tokenizer: whole texts by way of words, whose ids are kept from text to text and from
    task to task, up to `CACHED` bytes; beyond, the half that was met least goes."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        #: the model alone: what it is given is one piece
        self.bare = Tokenizer(self.full.model)
        self.leaf = leaf
        self.names = {i: t for t, i in self.full.get_vocab(True).items()}
        added = self.full.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        steps = json.loads(self.full.to_str())
        plain_tokens = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added.values())
        #: whether the file has the steps for which pieces are cut here; any other is left to the library
        self.known = plain_tokens and all(steps.get(k) == v for k, v in KNOWN_STEPS.items()) and steps["model"]["type"] == "BPE"
        most = max(self.names, default=-1) + 1
        self.decimals = Spelling([str(i).encode() for i in range(most)])
        self.strings = Spelling([self.names.get(i, "").encode() for i in range(most)])
        #: words by number; the ids of all, one word after the other, and where each word's end
        self.number: dict[Word, int] = {}
        self.ids, self.ends, self.weight = np.zeros(0, np.int32), np.zeros(0, np.int64), 0
        #: how often each word was met
        self.uses = np.zeros(0, np.int64)
        self.letters = byte_letters()
        # In this range a text is in normal form already and lower-casing is by character, so that
        # the cut into pieces can be made here; others go through the tokenizer's own steps.
        plain = [chr(c) for c in range(0x250) if c not in (0x85, 0x130) and not 0x1C <= c <= 0x1F]
        kind = lambda k: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == k)
        letters, numbers, space = kind("L"), kind("N"), "\\t\\n\\x0b\\x0c\\r \\xa0"
        self.odd = re.compile("[^" + "".join(re.escape(c) for c in plain) + "]")
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")

    def is_plain(self, text: str) -> bool:
        if not text.encode("utf-8", "replace").translate(None, PLAIN_BYTES):
            return "\x85" not in text and "\u0130" not in text
        return not self.odd.search(text)

    def words_of(self, text: str) -> list[Word]:
        """The words of a plain text, lower-cased, else its pieces (in letters that stand for bytes), as tuples.

        No piece lies across a blank, so a word's pieces are the same wherever it stands.
        """
        if self.is_plain(text):
            return text.lower().split()
        normal = self.full.normalizer.normalize_str(text) if self.full.normalizer else text
        return [(p,) for p, _ in self.full.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces_of(self, word: str) -> list[str]:
        found, letters = self.cut.findall(word), self.letters
        if word.isascii():
            return found
        return [p if p.isascii() else "".join([letters[b] for b in p.encode()]) for p in found]

    def tokens(self, texts: list[str]) -> list[list[Token]]:
        return [
            [(i, s, e) for i, (s, e) in zip(x.ids, x.offsets, strict=True)]
            for x in self.bare.encode_batch(texts, add_special_tokens=False)
        ]

    def encoded(self, pieces: list[str]) -> list[list[int]]:
        """The ids of pieces."""
        out: list[list[int]] = []
        for at in range(0, len(pieces), AT_ONCE):
            part = pieces[at : at + AT_ONCE]
            if max(map(len, part)) <= self.leaf:
                out += [x.ids for x in self.bare.encode_batch_fast(part, add_special_tokens=False)]
            else:
                out += [[t[0] for t in tree(p, self.tokens, self.leaf)] for p in part]
        return out

    def learn(self, words: list[Word]) -> None:
        """Encode words that are not known yet and number them."""
        cut = [
            [w] if isinstance(w, str) and w.isascii() and w.isalpha() else [w[0]] if isinstance(w, tuple) else self.pieces_of(w)
            for w in words
        ]
        pieces = list({p for own in cut for p in own})
        long = [len(p) > self.leaf for p in pieces]
        order = [p for p, far in zip(pieces, long, strict=True) if not far], [p for p, far in zip(pieces, long, strict=True) if far]
        ids_of = dict(zip(chain(*order), chain(*map(self.encoded, order)), strict=True))
        found = [ids_of[own[0]] if len(own) == 1 else list(chain.from_iterable([ids_of[p] for p in own])) for own in cut]
        self.keep(words, found)

    def keep(self, words: list[Word], found: list[list[int]]) -> None:
        first = len(self.number)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + len(self.ids)
        new = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]) - len(self.ids) if len(ends) else 0)
        self.ids, self.ends = np.concatenate([self.ids, new]), np.concatenate([self.ends, ends])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.weight += 4 * len(new) + 220 * len(words) + sum(map(len, words))

    def forget(self) -> None:
        """Keep the half of the words that was met most often; older meetings weigh less each time."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: len(self.number) // 2])
        words = list(self.number)
        self.number = {words[n]: i for i, n in enumerate(keep.tolist())}
        starts = np.append(0, self.ends)[keep]
        lengths = self.ends[keep] - starts
        self.ids, self.ends, self.uses = self.ids[segments(starts, lengths)], np.cumsum(lengths), self.uses[keep] // 2
        self.weight //= 2

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        if not self.known:
            found = [x.ids for x in self.full.encode_batch(texts, add_special_tokens=False)]
            counts = np.array([len(f) for f in found], np.int64)
            return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts
        if self.weight > CACHED:
            self.forget()
        for name, i in self.special.items():
            if (name, "") not in self.number:
                self.keep([(name, "")], [[i]])
        words: list[Word] = []
        upto = [0]
        for text in texts:
            if self.split and any(s in text for s in self.special):
                for part in self.split.split(text):
                    words += [(part, "")] if part in self.special else self.words_of(part)
            else:
                words += self.words_of(text)
            upto.append(len(words))
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(numbers < 0)):
            self.learn(list(dict.fromkeys([words[i] for i in new.tolist()])))
            numbers[new] = [self.number[words[i]] for i in new.tolist()]
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        starts = np.append(0, self.ends)[numbers]
        lengths = self.ends[numbers] - starts
        counts = np.diff(np.append(0, np.cumsum(lengths))[upto])
        return self.ids[segments(starts, lengths)], counts

    def spelt(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """For each text its ids in decimal, joined by blanks."""
        return self.decimals.join(ids, counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts that the ids stand for, in UTF-8."""
        if self.known:
            return self.strings.join(ids, counts)
        each = np.split(ids, np.cumsum(counts)[:-1])
        return [self.full.decode(x.tolist(), skip_special_tokens=False).encode() for x in each]


def encoder(path: str, leaf: int = LEAF) -> Encoder:
    """This process's encoder for a file: loading one takes longer than many a task."""
    kept = sys.modules.setdefault("_siftpage_encoders", types.ModuleType("_siftpage_encoders")).__dict__
    if (path, leaf) not in kept:
        kept[(path, leaf)] = Encoder(path, leaf)
    return kept[(path, leaf)]


def coded(batch: pa.RecordBatch, tokenizer: Encoder) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in slices of some text, each with the ids of its texts and their counts."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0))
    slices = np.cumsum(lengths, dtype=np.int64) // SLICE
    for at in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(slices)) + 1) if len(lengths) else []:
        part = batch.slice(int(at[0]), len(at))
        yield part, *tokenizer.encode([t or "" for t in part.column("text").to_pylist()])


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, decoded: bool = False) -> DataFrame:
    """All rows of docs with `ids` and, on request, `decoded`, the ids turned back into text."""
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)
    own = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    new = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path, leaf)
        for batch in batches:
            for part, ids, counts in coded(batch, tokenizer):
                ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                columns = [part.column(f.name) for f in own] + [pa.ListArray.from_arrays(ends, pa.array(ids))]
                columns += [pa.array(tokenizer.decode(ids, counts), pa.binary()).cast(pa.string())] * decoded
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in own + new])
        give_back()

    return docs.select(*quoted([f.name for f in own])).mapInArrow(each, T.StructType(own + new))


def digests(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens and the sha256 of the ids (decimal, joined by a blank) and of the decoded text, made
    where the text is encoded: neither ids nor decoded texts leave the worker."""
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path, leaf)
        for batch in batches:
            for part, ids, counts in coded(batch, tokenizer):
                texts = tokenizer.spelt(ids, counts), tokenizer.decode(ids, counts)
                hashes = [pa.array([hashlib.sha256(t).hexdigest() for t in own], pa.string()) for own in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), *hashes], names)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """All rows with `decoded`, from their `ids`; null ids give the empty text."""
    path = path or vocabulary_path()

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = encoder(path)
        for ids in batches:
            own = [np.array(x or [], np.int32) for x in ids.to_pylist()]
            counts = np.array([len(x) for x in own], np.int64)
            flat = np.concatenate([np.zeros(0, np.int32), *own])
            yield pa.array(tokenizer.decode(flat, counts) if len(own) else [], pa.binary()).cast(pa.string())

    return rows.withColumn("decoded", texts("ids"))


def op8_bpe_encoding(spark, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents").select("doc_id", "text"))
