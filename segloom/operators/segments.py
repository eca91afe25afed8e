"""Segments of a deck: extraction from documents, alignment, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.plans.ordering import neighbours, running


def container_id(
    slide, shape, *, groups: Column | None = None, row: Column | None = None,
    col: Column | None = None, is_note: Column | None = None,
) -> Column:
    """Path of a text frame: ``s1/sh2``, ``s1/sh2/g0``, ``s1/sh2/r0c1`` or ``s1/notes``."""
    s, sh = (F.col(c) if isinstance(c, str) else c for c in (slide, shape))
    parts = [F.concat(F.lit("s"), s.cast("string")), F.concat(F.lit("sh"), sh.cast("string"))]
    if groups is not None:
        path = F.array_join(F.transform(groups, lambda g: F.concat(F.lit("g"), g.cast("string"))), "/")
        parts.append(F.nullif(path, F.lit("")))
    if row is not None and col is not None:
        parts.append(F.concat(F.lit("r"), row.cast("string"), F.lit("c"), col.cast("string")))
    path = F.concat_ws("/", *parts)
    if is_note is None:
        return path
    return F.when(is_note, F.concat(parts[0], F.lit("/notes"))).otherwise(path)


def segments_from_documents(
    docs: DataFrame,
    *,
    deck: str = "source",
    order: str = "doc_id",
    text: Column | str = "text",
    is_note: Column | None = None,
    kind: Column | None = None,
    keep: tuple[str, ...] = ("lang",),
) -> DataFrame:
    """One row per non-blank line, numbered 0.. along the deck in document order.

    Blank lines vanish but keep their ``paragraph_index``. The deck position of a line is its
    place among the kept lines of its document plus a running total of kept lines per document,
    so the only ordered computation runs over documents and is range-chunked.
    """
    text = F.col(text) if isinstance(text, str) else text
    note = F.lit(False) if is_note is None else is_note
    lines = F.transform(
        F.split(text, "\n"),
        lambda line, i: F.struct(i.alias("paragraph_index"), line.alias("original_text")),
    )
    kept = F.filter(lines, lambda s: T.strip(s["original_text"]) != "")
    per_doc = docs.select(
        F.col(deck).alias("deck_id"),
        F.col(order).cast("long").alias("slide_index"),
        note.alias("is_note"),
        (F.lit("textbox") if kind is None else kind).alias("container_kind"),
        *keep,
        kept.alias("__kept"),
    ).withColumn("__n", F.size("__kept"))
    placed = running(
        per_doc, ["deck_id"], "slide_index", {"__before": ("sum", F.col("__n"))}, exclusive=True, bits=12
    )
    exploded = placed.select(
        "*", F.element_at("__kept", F.when(F.col("__n") > 0, 1).otherwise(None))["original_text"].alias("slide_title"),
        F.posexplode("__kept").alias("__place", "__line"),
    )
    shape = F.when(F.col("is_note"), F.lit(-1)).otherwise(F.lit(0))
    return exploded.select(
        "deck_id",
        (F.col("__before") + F.col("__place")).cast("long").alias("idx"),
        "slide_index",
        shape.cast("int").alias("shape_index"),
        F.col("__line.paragraph_index").cast("int").alias("paragraph_index"),
        F.col("__line.original_text").alias("original_text"),
        "slide_title",
        "is_note",
        container_id("slide_index", shape, is_note=F.col("is_note")).alias("container_id"),
        "container_kind",
        *keep,
    )


def align_bitext(segments: DataFrame, targets: DataFrame) -> DataFrame:
    """Pair every segment with its target by position; a missing target is empty."""
    return segments.join(targets.select("deck_id", "idx", "target"), ["deck_id", "idx"], "left").withColumn(
        "target", F.coalesce("target", F.lit(""))
    )


def global_context(segments: DataFrame, max_n: int = 80, max_chars: int = 2000) -> DataFrame:
    """Opening lines of each deck as one short text; notes inside the first ``max_n`` are dropped."""
    line = F.concat(
        F.lit("Slide "), (F.col("slide_index") + 1).cast("string"), F.lit(" - "),
        F.when(F.coalesce("slide_title", F.lit("")) == "", "Untitled").otherwise(F.col("slide_title")),
        F.lit(": "), F.translate(T.strip("original_text"), "\n", " "),
    )
    opening = segments.filter(F.col("idx") < max_n).groupBy("deck_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_note"), F.struct("idx", line.alias("line"))))).alias("lines")
    )
    return opening.select(
        "deck_id", F.substring(F.array_join(F.col("lines.line"), "\n"), 1, max_chars).alias("context")
    )


def context_window(segments: DataFrame, w: int = 2) -> DataFrame:
    """Each segment with its neighbours up to ``w`` places away, as ``[n] text`` lines."""
    line = F.concat(F.lit("["), (F.col("idx") + 1).cast("string"), F.lit("] "), T.strip("original_text"))
    spread, by_range = neighbours(segments.withColumn("__line", line), ["deck_id"], "idx", w)
    return (
        spread.withColumn(
            "window_text", F.array_join(F.collect_list("__line").over(by_range.rowsBetween(-w, w)), "\n")
        )
        .filter("__home")
        .select(*segments.columns, "window_text")
    )
