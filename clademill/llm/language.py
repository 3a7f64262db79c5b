"""Language identification by n-gram filters whose slots hold bitmasks of languages.

Each language learns the letter n-grams that enough of its sample documents have. All languages share one Bloom filter,
sliced by bits: a slot is a mask of languages, and the AND of an n-gram's slots is the set of languages that have it. A
text counts each language's n-grams; the count is corrected for the share of foreign n-grams that the filter takes for
the language's own, and the language with the largest corrected share is the answer.

The labelled sample has about PER_LANGUAGE rows of each language, those with the lowest hash of their id. Languages, id
and source never enter a prediction. Null texts and texts without a letter are `und` with score 0. Equal shares go to
the language that sorts first. Repeated rows get equal answers. An empty table gives an empty result. Columns other than
those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZES, PROBES, SLOTS, PER_LANGUAGE, MIN_SHARE, MIN_DOCS = (2, 3, 4), 3, 1 << 20, 600, 0.01, 2
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """A 64-bit key for each n-gram of the lower-case text, in which one blank stands for whatever isn't a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    points = np.concatenate([[32], np.where(is_letter, points, 32), [32]]).astype(np.uint64)
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    out = []
    for n in SIZES:
        key = np.full(max(0, len(points) - n + 1), n, np.uint64)
        for k in range(n):
            key = (key ^ points[k : k + len(key)]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out.append(key)
    return np.concatenate(out)


def slots(keys: np.ndarray, size: int = SLOTS) -> list[np.ndarray]:
    """The slots of each key, one array for each probe."""
    second = (keys >> np.uint64(32)) | np.uint64(1)
    return [((keys + np.uint64(k) * second) & np.uint64(size - 1)).astype(np.int64) for k in range(PROBES)]


@dataclass
class Filters:
    languages: list[str]
    masks: np.ndarray  # slots x words of 64 languages

    def __post_init__(self):
        n = len(self.languages)
        full = [(self.masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() if len(self.masks) else 0.0 for k in range(n)]
        self.false = np.array(full) ** PROBES  # share of foreign n-grams that pass

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """For each language, how many of the n-grams it may contain."""
        at = slots(keys, len(self.masks))
        found = self.masks[at[0]]
        for other in at[1:]:
            found &= self.masks[other]
        if len(self.languages) <= 12:
            seen = np.bincount(found[:, 0].astype(np.int64), minlength=1 << len(self.languages))
            which = np.arange(len(seen))
            return np.array([seen[which >> k & 1 > 0].sum() for k in range(len(self.languages))])
        return np.array([int((found[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).sum()) for k in range(len(self.languages))])

    def predict(self, text: str | None) -> tuple[str, float]:
        keys = grams(text)
        if not keys.size or not self.languages:
            return UNKNOWN, 0.0
        share = np.maximum(self.counts(keys) / keys.size - self.false, 0) / np.maximum(1 - self.false, 1e-9)
        best = int(share.argmax())
        total = float(share.sum())
        return self.languages[best], min(1.0, float(share[best]) * float(share[best]) / total) if total else 0.0


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Filters:
    """Filters from about `per_language` rows of each language among those for which `learn` holds."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return Filters([], np.zeros((SLOTS, 1), np.uint64))
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    number = F.create_map(*(F.lit(x) for i, k in enumerate(languages) for x in (k, i)))
    sample = rows.where(draw < F.element_at(share, F.col("lang"))).select(F.element_at(number, F.col("lang")).alias("language"), "text")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[int, list[np.ndarray]] = {}
            for language, text in zip(*(c.to_pylist() for c in batch.columns)):
                own.setdefault(language, []).append(np.unique(grams(text)))
            for language, keys in own.items():
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), language, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["language", "key", "n"])

    least = F.create_map(*(F.lit(x) for i, k in enumerate(languages) for x in (i, max(min(MIN_DOCS, sizes[k]), int(MIN_SHARE * min(per_language, sizes[k]))))))
    kept = common.python(sample, found, "language int, key long, n long").groupBy("language", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= F.element_at(least, F.col("language"))).select("language", "key")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, language = batch.column(1).to_numpy().view(np.uint64), batch.column(0).to_numpy()
            for at in slots(keys):
                word, bit = language // 64, np.left_shift(np.uint64(1), (language % 64).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(word.astype(np.int32)), pa.array(bit.view(np.int64))], names=["slot", "word", "mask"])

    masks = np.zeros((SLOTS, -(-len(languages) // 64)), np.uint64)
    table = common.python(kept, placed, "slot int, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # a row a slot at most
    masks[table["slot"].to_numpy(), table["word"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    return Filters(languages, masks)


def predicted(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of every text."""
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return common.python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = common.remainder("doc_id", 4) == 2
    filters = fit(docs, ~held_out)
    return predicted(docs, filters).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
