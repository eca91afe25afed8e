"""Language identification by character trigrams learnt from labelled documents."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.functions import values as V
from segloom.operators import automaton as A
from segloom.plans.cut import cut

GRAM = 3
#: A profile of up to so many rows (gram and language) goes to every task.
MAX_PROFILE = 500_000


def gram_counts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Trigrams of space-padded lower-case words per key: ``keys, gram, n``.

    Words are counted first, so grams are only cut from distinct words.
    """
    counted = texts.select(*keys, F.explode(_words(F.col(text))).alias("word")).filter("word <> ''").groupBy(*keys, "word").agg(
        F.count(F.lit(1)).alias("c")
    )
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    return counted.select(*keys, "c", F.explode(T.char_grams(padded, GRAM)).alias("gram")).groupBy(*keys, "gram").agg(
        F.sum("c").alias("n")
    )


def language_profile(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Trigram counts per language: ``lang, gram, n``."""
    return gram_counts(docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")), ["lang"], "text")


def deck_samples(segments: DataFrame, first: int = 50, chars: int = 500) -> DataFrame:
    """Opening text of each deck: the first 50 segments without notes, 500 characters."""
    rows = segments.filter(F.col("idx") < first).groupBy("deck_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_note"), F.struct("idx", "original_text")))).alias("l")
    )
    return rows.select("deck_id", F.substring(T.strip(F.array_join("l.original_text", "\n")), 1, chars).alias("sample"))


def _weights(profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gains of each gram (``gram, ws``), and the size each language is measured by (``lang, den``)."""
    sizes = profile.groupBy("lang").agg(F.sum("n").alias("total"))
    vocabulary = profile.agg(F.count_distinct("gram").alias("v")).scalar()
    base = sizes.select("lang", (F.col("total") + vocabulary).alias("den"))
    return profile.join(base, "lang").select(
        "gram", F.struct("lang", (F.ln(F.col("n") + 1)).alias("gain")).alias("w")
    ).groupBy("gram").agg(F.collect_list("w").alias("ws")), base


class _Carried(NamedTuple):
    """A profile that goes to every task: its languages with the logarithm of their sizes, and its grams."""

    langs: list[tuple[str, float]]
    grams: A.Shared


def _carried(profile: DataFrame) -> _Carried | None:
    """The profile (a written one), if it has been measured and is small enough."""
    if profile.count() > MAX_PROFILE:
        return None
    weights, base = _weights(profile)
    langs = [tuple(r) for r in base.select("lang", F.ln("den")).filter("lang is not null").orderBy("lang").collect()]
    place = {lang: i for i, (lang, _) in enumerate(langs)}
    grams = {r.gram: [(place[w.lang], w.gain) for w in r.ws] for r in weights.collect()}
    return _Carried(langs, A.share(profile.sparkSession, [len(langs), grams]))


def _gains(carried: _Carried, words: Column) -> Column:
    """Of the words of a text: the summed gain of each language, then the number of grams."""

    def build(value: list) -> tuple[dict[str, int], np.ndarray]:
        n, grams = value
        gains = np.zeros((len(grams) + 1, n + 1))
        gains[:, n] = 1
        for row, ws in enumerate(grams.values()):
            for lang, gain in ws:
                gains[row, lang] = gain
        return {gram: row for row, gram in enumerate(grams)}, gains

    def run(lists: pa.Array) -> pa.Array:
        index, gains = A.kept(carried.grams, build)
        coded = lists.flatten().dictionary_encode()
        known = [f" {w} " if w else "" for w in coded.dictionary.to_pylist()]
        rows = [index.get(w[i : i + GRAM], -1) for w in known for i in range(len(w) - GRAM + 1)]
        cuts = np.cumsum([0] + [max(len(w) - GRAM + 1, 0) for w in known])
        per_word = _sums(gains[rows], cuts)
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        out = _sums(per_word[coded.indices.to_numpy(zero_copy_only=False)], np.concatenate([[0], np.cumsum(sizes)]))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * gains.shape[1], pa.int32()), pa.array(out.ravel()))

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<double>")(words)


def _sums(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the stretches of ``rows`` between neighbouring cuts; empty ones give zeros."""
    out = np.zeros((len(cuts) - 1, rows.shape[1]))
    full = cuts[1:] > cuts[:-1]
    if full.any():
        out[full] = np.add.reduceat(rows, cuts[:-1][full], axis=0)
    return out


def _best(langs: list[tuple[str, float]], gains: Column) -> Column:
    """Language of the highest score among those that know a gram; null if none does."""
    if not langs:
        return F.lit(None).cast("string")
    grams = gains[len(langs)]
    return F.array_max(F.array(*[
        F.when(gains[i] > 0, F.struct(F.round(gains[i] - grams * F.lit(size), 6).alias("score"), F.lit(lang).alias("lang")))
        for i, (lang, size) in enumerate(langs)
    ]))["lang"]


def _words(text) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def code_of(profile: DataFrame, text: Column) -> Column | None:
    """``detect_code`` as a column that is computed where the text is; None if the profile is too large to go to every task."""
    carried = _carried(cut(profile))
    return None if carried is None else T.let(_gains(carried, _words(text)), lambda g: _best(carried.langs, g))


def detect_code(texts: DataFrame, profile: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Most likely language code per text (naive Bayes, add-one); none for texts without letters.

    A profile that can go to every task is looked up where the texts are: one small row per text is exchanged. Beyond that
    grams are counted per text before they meet the profile, and the profile holds one row per
    gram with the scores of all languages, so the join moves small rows and emits one per gram.
    """
    profile = cut(profile)  # small, and read by several branches
    carried = _carried(profile)
    if carried is not None:
        n = len(carried.langs) + 1
        rows = texts.select(*keys, _gains(carried, _words(F.col(text))).alias("g"))
        summed = rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("g")[i]) for i in range(n)]).alias("g"))
        return summed.select(*keys, _best(carried.langs, F.col("g")).alias("code")).filter("code is not null")
    return code_by_join(texts, profile, keys, text)


def code_by_join(texts: DataFrame, profile: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``detect_code`` for a written profile of any size."""
    weights, base = _weights(profile)
    counted = gram_counts(texts, keys, text).withColumnRenamed("n", "c")
    gains = counted.join(weights, "gram").select(*keys, "c", F.explode("ws").alias("w")).groupBy(*keys, "w.lang").agg(
        F.sum(F.col("c") * F.col("w.gain")).alias("gain")
    )
    totals = counted.groupBy(*keys).agg(F.sum("c").alias("grams"))
    scored = gains.join(base, "lang").join(totals, keys).withColumn("score", F.col("gain") - F.col("grams") * F.ln("den"))
    return scored.groupBy(*keys).agg(F.max_by("lang", F.struct(F.round("score", 6), "lang")).alias("code"))


def detect_language(texts: DataFrame, profile: DataFrame, *, text: str = "original_text", decks: DataFrame | None = None) -> DataFrame:
    """Display language of each deck by all its ``texts``; one without letters falls back to the default.

    Grams are counted where the texts are and summed per deck, so no deck is ever one text. ``deck_samples`` gives the
    short form that only looks at the opening. ``decks`` names decks that must have a row though they may have no text.
    """
    codes = detect_code(texts, profile, ["deck_id"], text)
    return (texts if decks is None else decks).select("deck_id").distinct().join(codes, "deck_id", "left").select(
        "deck_id", F.coalesce(T.map_lang_code("code"), F.lit(V.DEFAULT_LANGUAGE)).alias("language")
    )
