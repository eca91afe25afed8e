"""Repeated segments: find them once, work on one of each, scatter results back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.plans.skew import attach, attach_weighted


def repeat_counts(segments: DataFrame) -> DataFrame:
    """Texts that occur more than once in a deck, with their number of occurrences."""
    clean = segments.select("deck_id", T.clean_text("original_text").alias("text")).filter("text <> ''")
    return clean.groupBy("deck_id", "text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def repetition_plan(segments: DataFrame) -> DataFrame:
    """Add ``canonical`` (first position with the same text, null if blank), ``is_unique`` and
    ``repeat_count``.

    Counts are pre-aggregated and attached with hot texts salted, so a line that fills a third of
    the corpus does not land in one task. Blank rows get keys of their own to spread them. Texts meet
    by their digests.
    """
    clean = T.clean_text("original_text")
    keyed = segments.withColumn(
        "__text", F.when(clean == "", F.concat(F.lit("\0"), F.col("idx").cast("string")).cast("binary")).otherwise(T.digest(clean))
    )
    firsts = (
        keyed.filter(clean != "")
        .groupBy("deck_id", "__text")
        .agg(F.min("idx").alias("canonical"), F.count(F.lit(1)).alias("__rows"))
        .withColumn("repeat_count", F.col("__rows"))
    )
    joined = attach(keyed, firsts, ["deck_id", "__text"], "__rows", how="left", spread=["idx"])
    return joined.select(
        *segments.columns,
        "canonical",
        F.coalesce(F.col("canonical") == F.col("idx"), F.lit(False)).alias("is_unique"),
        F.coalesce("repeat_count", F.lit(1).cast("long")).alias("repeat_count"),
    )


def expand_repeats(plan: DataFrame, unique_results: DataFrame) -> DataFrame:
    """Give every occurrence the result of its canonical segment; blanks and gaps get ''."""
    results = unique_results.select("deck_id", F.col("idx").alias("canonical"), F.col("target"))
    uniques = plan.filter("is_unique").select("deck_id", "canonical", "repeat_count")
    per_text = uniques.join(results, ["deck_id", "canonical"], "left")
    # a blank row has no canonical: a negative key of its own keeps such rows apart
    rows = plan.select("deck_id", "idx", "repeat_count", F.coalesce("canonical", -1 - F.col("idx")).alias("canonical"))
    out = attach_weighted(rows, per_text, ["deck_id", "canonical"], "repeat_count", how="left", spread=["idx"])
    return out.select("deck_id", "idx", F.coalesce("target", F.lit("")).alias("target"))


def identical_segments(plan: DataFrame, requested: DataFrame) -> DataFrame:
    """Members of the repeat group of each requested position (a blank only matches itself).

    ``requested`` has ``deck_id, idx``; several requests for one group are answered once per
    request group, named by its ``canonical``, so no pairs of members are formed.
    """
    asked = plan.join(requested.select("deck_id", "idx"), ["deck_id", "idx"], "left_semi")
    groups = asked.filter("canonical is not null").select("deck_id", "canonical", "repeat_count").distinct()
    members = attach_weighted(
        plan.filter("canonical is not null").select("deck_id", "canonical", "idx", "repeat_count"),
        groups, ["deck_id", "canonical"], "repeat_count", spread=["idx"],
    ).select("deck_id", "canonical", "idx")
    alone = asked.filter("canonical is null").select("deck_id", F.col("idx").alias("canonical"), "idx")
    return members.unionByName(alone)
