"""Language identification by rank order of character n-grams.

The n-grams (1 to 3 characters) of each language are counted over all training documents; its profile is the list of the
most frequent ones by rank. A document's own most frequent n-grams are listed the same way, and the language whose profile
has them least out of place is the prediction: each n-gram counts the difference of its two ranks, or the length of a profile if the profile
lacks it. The score is 1 minus that sum as a share of the largest possible one.

Texts are lower-cased; runs of anything but letters and their marks become one space, which n-grams may hold as the edge of a word. N-grams
are 63-bit numbers made of their code points, so profiles hold the n-grams themselves, not hashes. Long texts are counted piece by piece.

Profiles reach the tasks in packs of languages of bounded size (``PACK_LANGUAGES``); each pack is one pass over the texts.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and for all if nothing can be learned;
training rows with a null language, a null text or no letter teach nothing; equal counts rank by code points; of languages equally
near, the first by code points is predicted; rows are judged one by one, so that repeated rows and null doc_ids are nothing
special; other columns pass untouched unless they have the name of a result column (``lang_pred``, ``score``), which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from segloom.llm import tokens
from segloom.llm.tables import cut

#: Ranks of a language's profile, and n-grams of a document that are compared with it.
PROFILE = 1000
DOCUMENT = 400
#: Languages whose profiles are carried together.
PACK_LANGUAGES = 200
#: Characters of a text that are counted at a time.
PIECE = 1 << 18
UNKNOWN = "und"
_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def _codes(text: str) -> np.ndarray:
    """All n-grams of a normalised text as numbers: three code points of 21 bits, the first ones 0 in shorter n-grams."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[c != 32], two, three])


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(codes, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, counts)
    return distinct, total


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text, ascending, and how often it has each."""
    if not _LETTER.search(text or ""):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = " " + _NO_LETTERS.sub(" ", text.lower()).strip() + " "
    if len(text) <= PIECE:
        return np.unique(_codes(text), return_counts=True)
    parts = []
    for at in range(0, len(text) - 2, PIECE):
        piece = text[at : at + PIECE + 2]
        parts.append(np.unique(_codes(piece), return_counts=True))
        if at + PIECE + 2 < len(text):  # what the next piece begins with counts there
            twice = np.array([*(ord(c) for c in piece[-2:] if c != " "), (ord(piece[-2]) << 21) | ord(piece[-1])], np.int64)
            parts.append((twice, np.full(len(twice), -1)))
    return _summed(*(np.concatenate(x) for x in zip(*parts)))


def most_frequent(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` most frequent n-grams by rank; equal counts by code points."""
    return codes[np.lexsort((codes, -counts))[:k]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of each language in a block of texts."""
    for block in tokens.blocks(batches):
        grams: dict[str, list] = {}
        for lang, text in zip(block.column("lang").to_pylist(), block.column("text").to_pylist()):
            codes, counts = gram_counts(text)
            if len(codes):
                grams.setdefault(lang, []).append((codes, counts))
        for lang, parts in grams.items():
            codes, counts = _summed(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])


def language_profiles(training: DataFrame, size: int = PROFILE) -> DataFrame:
    """``lang, gram, rank`` (from 0): the ``size`` most frequent n-grams of each language of ``training`` (``lang, text``)."""
    rows = training.select(F.col("lang").cast("string").alias("lang"), "text").filter("lang is not null and text is not null")
    counts = rows.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    """Profiles of some languages as one table of ranks."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.langs = sorted({lang for lang, _, _ in rows})
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([g for _, g, _ in rows], np.int64))
        self.size = size
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int32)
        at = np.searchsorted(self.grams, np.array([g for _, g, _ in rows], np.int64))
        self.ranks[at, [place[lang] for lang, _, _ in rows]] = [r for _, _, r in rows]

    def nearest(self, grams: np.ndarray) -> tuple[str, float]:
        """Language least out of place for a document's n-grams by rank, and its score."""
        at = np.searchsorted(self.grams, grams)
        known = np.flatnonzero(self.grams[np.minimum(at, len(self.grams) - 1)] == grams)
        ranks = self.ranks[at[known]]
        apart = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - known[:, None]), self.size)).sum(axis=0)
        distance = apart + self.size * (len(grams) - len(known))
        best = int(np.argmin(distance))
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(grams))


def _judged(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    profiles = shared.value
    for block in tokens.blocks(batches, text="__text"):
        found, seen = [], {}
        for text in block.column("__text").to_pylist():
            if text not in seen:
                grams = most_frequent(*gram_counts(text), k)
                seen[text] = profiles.nearest(grams) if len(grams) else (UNKNOWN, 0.0)
            found.append(seen[text])
        names = [c for c in block.schema.names if c != "__text"]
        yield pa.RecordBatch.from_arrays(
            [*(block.column(c) for c in names), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
            [*names, "lang_pred", "score"],
        )


def predict_languages(docs: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE, k: int = DOCUMENT) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, by the profiles of ``language_profiles``; of its columns only ``text`` is looked at."""
    spark, kept = docs.sparkSession, cut(profiles)
    langs = kept.select("lang").distinct()
    packs = -(-langs.count() // PACK_LANGUAGES)
    place = F.pmod(F.xxhash64("lang"), F.lit(max(packs, 1)))
    out = docs.drop("lang_pred", "score")
    names = out.columns
    if not packs:
        return out.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    for i in range(packs):
        rows = [(r.lang, r.gram, r.rank) for r in kept.filter(place == i).collect()]
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(Profiles(rows, size))
        held = out.withColumn("__text", F.col(text))
        schema = StructType([*out.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
        judged = held.mapInArrow(lambda batches, shared=shared: _judged(batches, shared, k), schema)
        if "__lang" in out.columns:
            better = (F.col("score") > F.col("__score")) | ((F.col("score") == F.col("__score")) & (F.col("lang_pred") < F.col("__lang")))
            judged = judged.withColumns({
                "lang_pred": F.when(better, F.col("lang_pred")).otherwise(F.col("__lang")), "score": F.greatest("score", "__score"),
            }).drop("__lang", "__score")
        out = judged.withColumnsRenamed({"lang_pred": "__lang", "score": "__score"})
    return out.select(*names, F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def held_out(doc_id: Column | str) -> Column:
    """One document in three, by the checksum of its number; a null number counts as training."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
