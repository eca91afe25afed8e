"""Batches for an expensive text function, and safe reassembly of its indexed replies."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.operators.matching import apply_glossary, enforce_glossary
from segloom.operators.repetition import expand_repeats, repetition_plan
from segloom.plans.cut import cut
from segloom.plans.ordering import position, running

_BATCH = ["deck_id", "batch_no"]
STYLE_BATCH = 8


def assign_batches(segments: DataFrame, size: int | Column) -> DataFrame:
    """Consecutive batches by position among the given rows: ``batch_no`` and 0-based ``item``."""
    ranked = position(segments, ["deck_id"], "idx", "__rank")
    size = F.lit(size) if isinstance(size, int) else size
    return ranked.withColumns({
        "batch_no": F.floor(F.col("__rank") / size).cast("long"),
        "item": (F.col("__rank") % size).cast("int"),
    }).drop("__rank")


def batch_size(
    counts: DataFrame, n: str = "n", *, batch: int = 80, min_batch: int = 40, max_batch: int = 100,
    target_batches: int = 5, concurrency: int = 8, wave: float = 1.2,
) -> DataFrame:
    """Batch size per deck that keeps ``concurrency`` lanes busy without tiny tails.

    The wanted number of batches is two waves over all lanes, or more if asked for. Sizes stay within the bounds; a
    size below the usual one grows towards it while every lane still gets a batch (unless more batches were asked
    for); a last batch under half the lower bound is spread over the others.
    """
    least = max(1, min_batch)
    most = max(least, max_batch)
    usual = sorted((least, batch, most))[1]
    lanes = max(1, concurrency)
    waves = max(lanes, math.ceil(2 * lanes * max(1.0, wave)))
    total = F.col(n).cast("long")

    def bounded(c: Column) -> Column:
        return F.greatest(F.lit(least), F.least(F.lit(most), c)).cast("long")

    by_target = bounded(F.ceil(total / max(waves, target_batches)))
    growth = F.least(F.lit(usual), F.ceil(total / lanes)) if target_batches <= waves else F.lit(0)
    size = F.when(by_target < usual, F.greatest(by_target, growth)).otherwise(by_target)
    sized = counts.withColumn("__size", size)
    parts = F.ceil(total / F.col("__size"))
    tail = total - (parts - 1) * F.col("__size")
    short = (parts > 1) & tail.between(1, max(1, least // 2) - 1)
    final = F.when(short, bounded(F.ceil(total / (parts - 1)))).otherwise(F.col("__size"))
    return sized.withColumn("batch_size", F.greatest(F.lit(1), F.least(total, final)).cast("int")).drop("__size")


def safe_concurrency(batches: DataFrame, tokens: str = "tokens", max_concurrency: int = 8, tpm: int = 30000) -> DataFrame:
    """Parallel calls per deck that the token budget allows, judged by its first batch."""
    first = batches.groupBy("deck_id").agg(F.min_by(tokens, "batch_no").alias("__t"))
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(tpm) / F.greatest(F.col("__t"), F.lit(1))))
    return first.select(
        "deck_id", F.greatest(F.lit(1).cast("long"), F.least(F.lit(max_concurrency).cast("long"), room)).cast("int").alias("concurrency")
    )


def batch_payload(batched: DataFrame, pct: int | None = None, text: str = "original_text") -> DataFrame:
    """One row per batch: numbered lines, per-item limits, expected count and 1-based range.

    Input carries ``batch_no`` and 0-based ``item``; a batch is at most ``batch_size`` rows.
    """
    number = (F.col("item") + 1).cast("string")
    cleaned = T.clean_text(text)
    line = F.concat(number, F.lit(". "), F.when(cleaned == "", "[EMPTY]").otherwise(cleaned))
    limit = F.lit("None") if pct is None else F.when(
        F.col("is_note"), F.concat(number, F.lit(". no length limit (speaker note)"))
    ).otherwise(F.concat(
        number, F.lit(". maximum "), T.char_limit("original_text", pct).cast("string"), F.lit(" target characters")
    ))
    rows = batched.select(*_BATCH, "item", line.alias("line"), limit.alias("limit"))
    agg = rows.groupBy(*_BATCH).agg(
        F.array_sort(F.collect_list(F.struct("item", "line", "limit"))).alias("l"), F.count(F.lit(1)).alias("n")
    )
    return agg.select(
        *_BATCH,
        F.array_join("l.line", "\n").alias("texts"),
        (F.lit("None") if pct is None else F.array_join("l.limit", "\n")).alias("item_length_limits"),
        F.col("n").cast("int").alias("expected_count"),
    )


def batch_ranges(payloads: DataFrame) -> DataFrame:
    """Add ``start_idx`` and ``end_idx`` (1-based among the batched rows of the deck)."""
    placed = running(payloads, ["deck_id"], "batch_no", {"end_idx": ("sum", F.col("expected_count").cast("long"))})
    return placed.withColumns({
        "end_idx": F.col("end_idx").cast("int"), "start_idx": (F.col("end_idx") - F.col("expected_count") + 1).cast("int")
    })


def _reply_stats(batches: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per batch and attempt: is every index in range and used once, and are all there?"""
    sized = outputs.join(batches.select(*_BATCH, "expected_count"), _BATCH)
    i = F.col("item_index")
    stats = sized.groupBy(*_BATCH, "attempt", "expected_count").agg(
        F.count(i).alias("n"), F.count_distinct(i).alias("distinct"), F.min(i).alias("lo"), F.max(i).alias("hi")
    )
    usable = (F.col("n") == F.col("distinct")) & (F.col("lo") >= 1) & (F.col("hi") <= F.col("expected_count"))
    return stats.select(
        *_BATCH, "attempt", usable.alias("usable"), (usable & (F.col("n") == F.col("expected_count"))).alias("full")
    )


def _sizes(batched: DataFrame) -> DataFrame:
    return batched.groupBy(*_BATCH).agg(F.count(F.lit(1)).alias("expected_count"))


def align_outputs(batched: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies placed by their reported index: ``(slots, attempts)``.

    ``batched`` has ``batch_no`` and 1-based ``item``. An attempt with an index out of range or
    used twice is not usable at all; gaps are kept as null slots.
    """
    attempts = _reply_stats(_sizes(batched), outputs)
    usable = attempts.filter("usable").select(*_BATCH, "attempt")
    slots = batched.select(*_BATCH, "item", "idx").join(usable, _BATCH).join(
        outputs.select(*_BATCH, "attempt", F.col("item_index").alias("item"), "text"), [*_BATCH, "attempt", "item"], "left"
    )
    return slots, attempts


def resolve_outputs(batched: DataFrame, outputs: DataFrame) -> DataFrame:
    """Final text per segment from the first reply and one retry; never empty, never shifted.

    A complete first attempt wins, then a complete retry, then the first attempt with its gaps
    filled from the source. If the first attempt's indices are unusable its texts are taken in
    index order, padded with source or trimmed.
    """
    return batched.join(_placed(batched, outputs), [*_BATCH, "item"], "left").select(
        "deck_id", "idx", F.coalesce("text", "original_text").alias("target")
    )


def _placed(batched: DataFrame, outputs: DataFrame) -> DataFrame:
    """The replies that count, with the ``item`` of their batch they belong to."""
    attempts = _reply_stats(_sizes(batched), outputs)
    state = attempts.groupBy(*_BATCH).agg(
        F.bool_or((F.col("attempt") == 1) & F.col("full")).alias("first_full"),
        F.bool_or((F.col("attempt") == 2) & F.col("full")).alias("second_full"),
        F.bool_or((F.col("attempt") == 1) & ~F.col("usable")).alias("first_bad"),
    )
    mode = (
        F.when(F.col("first_full"), "indexed1").when(F.col("second_full"), "indexed2")
        .when(F.col("first_bad"), "positional").otherwise("indexed1")
    )
    chosen = state.select(*_BATCH, mode.alias("mode"))
    by_reply = Window.partitionBy(*_BATCH, "attempt").orderBy("item_index", "seq")
    replies = outputs.withColumn("__nth", F.row_number().over(by_reply)).join(chosen, _BATCH)
    wanted = F.when(F.col("mode") == "indexed2", 2).otherwise(1)
    slot = F.when(F.col("mode") == "positional", F.col("__nth")).otherwise(F.col("item_index"))
    return replies.filter(F.col("attempt") == wanted).select(*_BATCH, slot.alias("item"), "text")


def align_styled_outputs(styled_segments: DataFrame, outputs: DataFrame, size: int = STYLE_BATCH) -> DataFrame:
    """Style replies per batch of 8; a batch counts only if its 0-based ids are complete and unique."""
    batched = assign_batches(styled_segments, size)
    sizes = _sizes(batched)
    i = F.col("item_id")
    good = outputs.join(sizes, _BATCH).groupBy(*_BATCH, "expected_count").agg(
        F.count(i).alias("n"), F.count_distinct(i).alias("d"), F.min(i).alias("lo"), F.max(i).alias("hi")
    ).filter("n = expected_count and d = expected_count and lo >= 0 and hi < expected_count").select(*_BATCH)
    kept = outputs.join(good, _BATCH, "left_semi").withColumnRenamed("item_id", "item")
    return batched.select(*_BATCH, "item", "idx").join(kept, [*_BATCH, "item"]).drop("item")


def retry_set(batched: DataFrame, outputs: DataFrame) -> DataFrame:
    """Batches to send again: no reply yet, or not every item covered."""
    sizes = _sizes(batched)
    done = _reply_stats(sizes, outputs).filter("full").select(*_BATCH).distinct()
    return sizes.join(done, _BATCH, "left_anti")


def translate_batches(
    batched: DataFrame, fn: Callable[[list[str]], list[str]], text: str = "original_text", attempt: int = 1
) -> DataFrame:
    """Call ``fn`` once per batch, list of texts in, list of texts out.

    ``batched`` carries 1-based ``item``. Batches are packed into rows first, so a call never sees
    a partial batch and the calls spread over the cluster.
    """
    cleaned = T.clean_text(text)
    packed = batched.groupBy(*_BATCH).agg(
        F.array_sort(F.collect_list(F.struct("item", F.when(cleaned == "", "[EMPTY]").otherwise(cleaned).alias("t")))).alias("l")
    ).select(*_BATCH, F.col("l.item").alias("items"), F.col("l.t").alias("texts"))

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                replies = fn(list(row.texts))
                if not len(replies):  # nothing came back: the batch is in the retry set
                    continue
                yield pd.DataFrame({
                    "deck_id": row.deck_id, "batch_no": row.batch_no, "attempt": attempt,
                    "item_index": range(1, len(replies) + 1), "seq": range(1, len(replies) + 1), "text": replies,
                })

    return packed.mapInPandas(
        call, "deck_id string, batch_no bigint, attempt int, item_index int, seq int, text string"
    )


def localise(
    segments: DataFrame, fn: Callable[[list[str]], list[str]], glossary: DataFrame | None = None,
    *, size: int = 80, retry_fn: Callable[[list[str]], list[str]] | None = None,
) -> DataFrame:
    """Whole flow: substitute terms, work on one of each repeat, reassemble, expand, enforce.

    Batches whose replies are not complete are sent once more (to ``retry_fn`` if given) and only those; what is
    still missing then keeps its source. Plan, batches and the choice of replies are made by position; texts move to
    their batch, and replies from there to their segments. The replies, the expensive part, are written once.
    """
    key = ["deck_id", "idx"]
    texts = segments.select(*key, "original_text")
    prepared = texts.withColumn("prepared_text", F.col("original_text")) if glossary is None else apply_glossary(texts, glossary)
    prepared = prepared.select(*key, "prepared_text")
    plan = cut(repetition_plan(texts).drop("original_text"))
    batched = cut(assign_batches(plan.filter("is_unique").select(*key, "repeat_count"), size).withColumn("item", F.col("item") + 1))
    outputs = cut(translate_batches(batched.join(prepared, key), fn, "prepared_text"))
    again = cut(retry_set(batched, outputs).select(*_BATCH))
    if not again.isEmpty():
        broken = batched.join(again, _BATCH, "left_semi").join(prepared, key)
        outputs = outputs.unionByName(cut(translate_batches(broken, retry_fn or fn, "prepared_text", attempt=2)))
    replies = outputs.withColumn("text", F.when(F.col("text").isNotNull(), F.struct("attempt", "seq")))
    chosen = cut(batched.join(_placed(batched, replies), [*_BATCH, "item"], "left").select(
        *key, "batch_no", "repeat_count", "text.attempt", "text.seq"
    ))
    resolved = chosen.join(outputs.select(*_BATCH, "attempt", "seq", F.col("text").alias("target")), [*_BATCH, "attempt", "seq"], "left")
    lost = chosen.filter("seq is null").select(*key)
    if not lost.isEmpty():
        sources = texts.join(lost, key, "left_semi")
        resolved = resolved.join(sources, key, "left").withColumn("target", F.coalesce("target", "original_text"))
    once = resolved.filter("repeat_count = 1").select(*key, F.coalesce("target", F.lit("")).alias("target"))
    more = expand_repeats(plan.filter("repeat_count > 1 or canonical is null"), resolved.filter("repeat_count > 1"))
    targets = once.unionByName(more)
    pairs = segments.join(targets, ["deck_id", "idx"])
    return pairs if glossary is None else enforce_glossary(pairs, glossary)


def progress_series(completions: DataFrame, totals: DataFrame) -> DataFrame:
    """Progress after each finished batch, in completion order.

    ``completions``: ``deck_id, done_at`` (integer order), ``size``. ``totals``: ``deck_id,
    total_batches, total_sentences``.
    """
    run = running(completions, ["deck_id"], "done_at", {
        "batches": ("sum", F.lit(1).cast("long")), "sentences": ("sum", F.col("size").cast("long")),
    })
    # totals has one row per deck; Spark chooses the join from its size
    done = run.join(totals, "deck_id")
    finished = F.least("batches", "total_batches")
    return done.select(
        *completions.columns,
        finished.alias("current_batch"),
        F.least("sentences", "total_sentences").alias("current_sentence"),
        F.when(F.col("total_batches") <= 0, F.lit(10)).otherwise(
            (F.lit(10) + F.floor(finished / F.col("total_batches") * 70)).cast("int")
        ).alias("percent"),
    )


def run_summary(plan: DataFrame, batches: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Totals of a run per deck: segments, unique ones, batches, findings."""
    out = plan.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("total_segments"), F.count_if("is_unique").alias("unique_segments")
    ).join(batches.groupBy("deck_id").agg(F.count_distinct("batch_no").alias("batch_count")), "deck_id", "left")
    if findings is not None:
        out = out.join(findings.groupBy("deck_id").agg(F.count(F.lit(1)).alias("finding_count")), "deck_id", "left")
        out = out.withColumn("finding_count", F.coalesce("finding_count", F.lit(0).cast("long")))
    return out.withColumn("batch_count", F.coalesce("batch_count", F.lit(0).cast("long")))
