"""Language identification by string kernels.

Texts are compared by the blended-spectrum presence kernel: the number of character n-grams, of all
lengths from 1 to 3, that two texts share, each counted once, divided by the root of the product of
the texts' own numbers. Landmark texts give the Nyström approximation of that kernel, and one ridge
regression against the rest for each language is solved in the landmarks' feature space. The different
n-grams of a text are looked up among those of the landmarks and counted for each landmark; these counts,
normalised by the text's own number of different n-grams, times weights are its score.

An n-gram of at most three code points is one number of 63 bits, so nothing is hashed and the kernel is
exact however long a text or large its script is. Letters are lower-cased and runs of other characters
count as one blank, so that symbols and digits say nothing.

The fit uses a sample bounded by `FIT_ROWS` rows for each language, chosen by hash; the n-grams of the
landmark texts are held in memory. Prediction reads every whole text, `STEP` characters at a time.

Defined results: a text that is null or has no letter is `und` with score 0; without training rows all
texts are `und`; with one language all others get it with score 1; repeated rows are predicted alike;
an empty table gives no rows; other columns pass through (own columns `lang_pred` and `score` are
replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpage.llm.common import fold_of, free, give_back, small_batches, table, written

LENGTHS = (1, 2, 3)
#: Bounds of the fit: expected sample rows for each language, landmarks over all languages.
FIT_ROWS, LANDMARKS = 400, 96
RIDGE, SHARPNESS = 1e-3, 4.0
#: Texts scored at once, and places of a text whose n-grams are sorted at once.
CHUNK, STEP = 64, 1 << 20

BLANK = 32


def _folded() -> np.ndarray:
    """For each code point its lower-case code point if it is a letter, else a blank."""
    out = np.full(0x110000, BLANK, np.uint32)
    for c in range(len(out)):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


FOLDED = _folded()


def grams(text: str) -> np.ndarray:
    """The different n-grams of a text, sorted. No folded point is 0, so the lengths share no number."""
    points = FOLDED[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if len(points) > 1:
        blank = points == BLANK
        points = points[np.append(True, ~(blank[1:] & blank[:-1]))]
    out = []
    for n in LENGTHS:
        found = np.zeros(0, np.int64)
        for at in range(0, len(points) - n + 1, STEP):
            part = points[at : at + STEP + n - 1].astype(np.int64)
            key = part[: len(part) - n + 1].copy()
            for k in range(1, n):
                key |= part[k : len(part) - n + 1 + k] << (21 * k)
            key = np.unique(key)
            found = np.union1d(found, key) if len(found) else key
        out.append(found)
    return np.concatenate(out)


class Model:
    """Languages, the landmarks' n-grams (each with the landmarks that have it), and the weights of each
    language for the landmarks."""

    def __init__(self, langs: list[str], landmarks: list[np.ndarray]):
        self.langs, self.weights = langs, None
        self.sizes = np.array([len(g) for g in landmarks])
        flat = np.concatenate(landmarks)
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(landmarks), dtype=np.int32), self.sizes)[order]
        self.keys, counts = np.unique(flat, return_counts=True)
        self.offsets = np.append(0, np.cumsum(counts))

    def kernel(self, own: np.ndarray) -> np.ndarray:
        """The kernel of a text, given its n-grams, and each landmark."""
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at = at[self.keys[at] == own]
        starts, lengths = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        places = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        shared = np.bincount(self.owners[places], minlength=len(self.sizes))
        return shared / (np.sqrt(max(1, len(own))) * np.sqrt(np.maximum(1, self.sizes)))

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of the language and a score from 0 to 1 for each text."""
        z = SHARPNESS * (np.stack([self.kernel(grams(t)) for t in texts]) @ self.weights)
        e = np.exp(z - z.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        return e.argmax(1), e.max(1)


def solve(model: Model, marks: np.ndarray, langs: list[str], rows: np.ndarray) -> None:
    """The weights, from the kernel of the landmarks, and the language and kernel row of each sample row.

    With K the kernel of the landmarks, the features of a text are K^(-1/2) times its kernel row; the
    ridge solution is folded back onto kernel rows.
    """
    order = np.lexsort([*rows.T, np.array(langs)])
    langs, rows = np.array(langs)[order], rows[order]
    values, vectors = np.linalg.eigh(marks)
    root = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T
    phi = rows @ root
    y = np.where(langs[:, None] == np.array(model.langs)[None, :], 1.0, -1.0)
    # languages weigh alike, whatever their rows
    counts = {n: int((langs == n).sum()) for n in model.langs}
    weight = np.array([1 / counts[n] for n in langs])[:, None]
    solved = np.linalg.solve(phi.T @ (phi * weight) + RIDGE * np.eye(len(marks)), phi.T @ (y * weight))
    model.weights = root @ solved


def train(docs: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """The model from docs (doc_id, text, lang); None without a usable row. Hold out before.

    Landmarks are drawn evenly from the languages, by hash.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))))
    chosen = usable.filter(F.xxhash64(F.lit(3), "doc_id") / F.lit(2.0**64) + 0.5 <= share[F.col("lang")])
    small_batches(docs.sparkSession)
    chosen = written(chosen.select("lang", "text", F.xxhash64(F.lit(5), "doc_id", "text").alias("place")), "sample")
    places: dict[str, set[int]] = {}
    for r in chosen.select("lang", "place").collect():
        places.setdefault(r["lang"], set()).add(r["place"])
    if not places:
        return None
    names = sorted(places)
    most = max(1, LANDMARKS // len(names))
    drawn = [(n, p) for n in names for p in sorted(places[n])[:most]]

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, place, text in zip(b["lang"], b["place"], b["text"], strict=True):
                yield pd.DataFrame({"lang": [lang], "place": [place], "grams": [grams(text).tobytes()]})

    marked = chosen.filter(F.col("place").isin([p for _, p in drawn]))
    found = marked.mapInPandas(own, "lang string, place bigint, grams binary").collect()
    held = {(r["lang"], r["place"]): np.frombuffer(r["grams"], np.int64) for r in found}
    landmarks = [held[d] for d in drawn]
    model = Model(names, landmarks)

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"].tolist(), "k": [model.kernel(grams(t)) for t in b["text"]]})

    sample = chosen.select("lang", "text").mapInPandas(kernels, "lang string, k array<double>").toPandas()
    solve(model, np.stack([model.kernel(g) for g in landmarks]), sample["lang"].tolist(), np.stack(sample["k"]))
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All rows of docs with `lang_pred` and `score`."""

    @F.arrow_udf("lang string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [], []
            for at in range(0, len(texts), CHUNK):
                which, score = model.predict([t or "" for t in texts.slice(at, CHUNK).to_pylist()])
                names += [model.langs[k] for k in which]
                scores += score.tolist()
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"]
            )
        give_back()

    und = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    readable = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    name = free("found", docs.columns)
    out = docs.withColumn(name, predicted(readable) if model else und)
    return out.withColumns(
        {
            "lang_pred": F.when(readable.isNull(), "und").otherwise(F.col(name)["lang"]),
            "score": F.when(readable.isNull(), 0.0).otherwise(F.col(name)["score"]),
        }
    ).drop(name)


def op2_language_id(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = train(docs.filter(~held_out))
    return predict(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
