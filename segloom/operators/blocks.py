"""Review blocks: wrapped lines merged back, ranked, summarised, with fixes proposed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.functions import values as V

_FRAME = ["deck_id", "container_id"]


def merge_blocks(segments: DataFrame, cap: int = V.MAX_BLOCK_SIZE) -> DataFrame:
    """Add ``block_id`` (position of the block's first segment), ``block_pos`` and the pairwise
    ``refusal`` (why a segment did not join its predecessor; null when it did).

    Whether two neighbours belong together does not depend on block size, so runs of joined
    neighbours are numbered inside their text frame and then cut every ``cap`` lines. Frames are
    small, so no window spans a deck. Texts are judged before they move, and move only if the caller reads them.
    """
    by_frame = Window.partitionBy(*_FRAME).orderBy("idx")
    said = T.strip("original_text")
    flagged = segments.withColumns({
        "__lower": T.lstrip("original_text").rlike(r"^\p{Ll}"), "__mid": said.rlike(V.MID_CLAUSE_END), "__closed": said.rlike(V.SENTENCE_END),
    })
    prev_mid, prev_closed = (F.lag(c).over(by_frame) for c in ("__mid", "__closed"))
    prev_par = F.lag("paragraph_index").over(by_frame)
    reason = (
        F.when(F.lag("idx").over(by_frame).isNull() | (F.lag("idx").over(by_frame) != F.col("idx") - 1), "container")
        .when(F.col("paragraph_index") != prev_par + 1, "gap")
        .when(F.col("container_kind").isin(V.SOLITARY_KINDS), "kind")
        .when(~F.col("__lower") & ~prev_mid, "not_continuation")
        .when(prev_closed, "sentence_end")
    )
    paired = flagged.withColumn("__reason", reason)
    island = F.sum(F.col("__reason").isNotNull().cast("int")).over(by_frame.rowsBetween(Window.unboundedPreceding, 0))
    by_island = Window.partitionBy(*_FRAME, "__island").orderBy("idx")
    placed = paired.withColumn("__island", island).withColumn("__place", F.row_number().over(by_island) - 1)
    block = F.col("idx") - F.col("__place") % cap
    full = F.col("__place").isNotNull() & (F.col("__place") > 0) & (F.col("__place") % cap == 0)
    return placed.select(
        *segments.columns,
        block.cast("long").alias("block_id"),
        (F.col("__place") % cap).cast("int").alias("block_pos"),
        F.when(full, "cap").otherwise(F.col("__reason")).alias("refusal"),
        (F.col("__place") % cap == cap - 1).alias("__full"),
    )


def block_refusal_reason(segments: DataFrame, cap: int = V.MAX_BLOCK_SIZE) -> DataFrame:
    """Why each block stopped growing: the first failing test of the segment after it, else ``end``.

    ``cap`` comes before the text tests when the block is already full.
    """
    merged = merge_blocks(segments, cap)
    by_frame = Window.partitionBy(*_FRAME).orderBy("idx")
    nxt = F.lead("refusal").over(by_frame)
    follows = F.lead("idx").over(by_frame) == F.col("idx") + 1
    last = segments.groupBy("deck_id").agg(F.max("idx").alias("last_idx"))
    tail = merged.select(
        "deck_id", "block_id", "block_pos", "idx", "__full", nxt.alias("next_refusal"), follows.alias("follows")
    ).filter((F.col("next_refusal").isNotNull()) | F.col("follows").isNull() | ~F.col("follows"))
    text_reasons = F.col("next_refusal").isin("not_continuation", "sentence_end", "cap")
    reason = (
        F.when(F.coalesce("follows", F.lit(False)), F.when(F.col("__full") & text_reasons, "cap").otherwise(F.col("next_refusal")))
        .when(F.col("idx") == F.col("last_idx"), "end")
        .otherwise("container")
    )
    # one row per deck: small, and joined by size-checked broadcast or shuffle as Spark sees fit
    return tail.join(last, "deck_id").select(
        "deck_id", "block_id", (F.col("block_pos") + 1).alias("size"), reason.alias("reason")
    )


def block_summary(merged: DataFrame) -> DataFrame:
    """One row per block: slide, container, size, first title."""
    return merged.groupBy("deck_id", "block_id").agg(
        F.min("slide_index").alias("slide_index"), F.min("container_id").alias("container_id"),
        F.min("container_kind").alias("container_kind"), F.min("slide_title").alias("slide_title"),
        F.count(F.lit(1)).alias("size"),
    )


def fragment_summary(segments: DataFrame) -> DataFrame:
    """Merge statistics per deck: counts, lengths, containers, block sizes and refusals."""
    n = F.length(T.strip("original_text"))
    sized = segments.withColumns({"__n": n, "__bucket": T.length_bucket(n)})
    labels = [label for label, _ in V.LENGTH_BUCKETS] + [V.LENGTH_BUCKET_LAST]
    base = sized.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("paragraphs"),
        F.count_if(F.col("__n") < 10).alias("under_10_chars"),
        F.count_if(F.col("__n") < 20).alias("under_20_chars"),
        *[F.count_if(F.col("__bucket") == label).alias(f"len_{label}") for label in labels],
        *[F.count_if(F.col("container_kind") == k).alias(f"kind_{k}") for k in ("title", "body", "textbox", "placeholder", "table_cell", "notes")],
    )
    frames = segments.groupBy(*_FRAME).agg(F.count(F.lit(1)).alias("n")).groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("containers"), F.count_if(F.col("n") > 1).alias("split_containers")
    )
    blocks = block_refusal_reason(segments)
    reasons = ["container", "gap", "kind", "cap", "not_continuation", "sentence_end", "end"]
    shape = blocks.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("review_items"),
        F.count_if(F.col("size") > 1).alias("merged_blocks"),
        F.sum(F.when(F.col("size") > 1, F.col("size") - 1).otherwise(0)).alias("paragraphs_absorbed"),
        F.max("size").alias("max_paragraphs"),
        *[F.count_if(F.col("size") == k).alias(f"blocks_of_{k}") for k in range(1, V.MAX_BLOCK_SIZE + 1)],
        *[F.count_if(F.col("reason") == r).alias(f"blocked_by_{r}") for r in reasons],
    )
    out = base.join(frames, "deck_id").join(shape, "deck_id")
    pct = F.lit(100.0)
    return out.withColumns({
        "reduction_pct": F.round((1 - F.col("review_items") / F.col("paragraphs")) * pct, 1),
        "pct_under_20": F.round(F.col("under_20_chars") / F.col("paragraphs") * pct, 1),
        "pct_of_containers": F.round(F.col("split_containers") / F.col("containers") * pct, 1),
    })


def block_findings(merged: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings with the block that holds their segment."""
    return findings.join(merged.select("deck_id", "idx", "block_id"), ["deck_id", "idx"])


def primary_finding(merged: DataFrame, findings: DataFrame) -> DataFrame:
    """The finding a block is shown for: worst severity, then first in block order."""
    rank = T.severity_rank("severity")
    known = block_findings(merged, findings).withColumn("rank", rank).filter(F.col("rank") < V.NO_SEVERITY_RANK)
    return known.groupBy("deck_id", "block_id").agg(
        F.min_by(F.struct("idx", "ordinal", "type", "severity", "rank"), F.struct("rank", "idx", "ordinal")).alias("f")
    ).select("deck_id", "block_id", "f.*")


def review_queue(
    merged: DataFrame, findings: DataFrame, resolved: DataFrame | None = None, pinned: DataFrame | None = None
) -> DataFrame:
    """Blocks that need or got a decision, worst first, then slide, then position.

    ``resolved`` and ``pinned`` hold ``deck_id, block_id``.
    """
    flagged = block_findings(merged, findings).groupBy("deck_id", "block_id").agg(
        F.min(T.severity_rank("severity")).alias("rank"), F.count(F.lit(1)).alias("findings")
    )
    chosen = flagged.select("deck_id", "block_id")
    for extra in (resolved, pinned):
        if extra is not None:
            chosen = chosen.unionByName(extra.select("deck_id", "block_id"))
    queue = block_summary(merged).join(chosen, ["deck_id", "block_id"], "left_semi").join(
        flagged, ["deck_id", "block_id"], "left"
    )
    return queue.withColumns({
        "rank": F.coalesce("rank", F.lit(V.NO_SEVERITY_RANK)), "findings": F.coalesce("findings", F.lit(0).cast("long")),
    }).orderBy("rank", "slide_index", "block_id", "deck_id")


def top_merged_blocks(merged: DataFrame, n: int = 40) -> DataFrame:
    """The ``n`` largest merged blocks (a report limit, not a sample)."""
    return block_summary(merged).filter("size > 1").orderBy(F.col("size").desc(), "deck_id", "block_id").limit(n)


def still_flagged(resolved: DataFrame, flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applied blocks a fresh sweep flags again (reopened), and those it does not (finished)."""
    keys = ["deck_id", "block_id"]
    applied = resolved.filter("outcome = 'applied'").select(*keys)
    return applied.intersect(flagged.select(*keys)), applied.exceptAll(flagged.select(*keys).distinct())


def slide_progress(queue: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open blocks per slide with the first one's title, and the number of finished slides per deck."""
    keys = ["deck_id", "block_id"]
    done = resolved.select(*keys).withColumn("__done", F.lit(True))
    marked = queue.join(done, keys, "left")
    is_open = F.col("__done").isNull()
    per_slide = marked.groupBy("deck_id", "slide_index").agg(
        F.count_if(is_open).alias("remaining"),
        F.min_by("slide_title", F.when(is_open, F.struct("rank", "block_id"))).alias("title"),
    )
    finished = per_slide.groupBy("deck_id").agg(F.count_if(F.col("remaining") == 0).alias("done_slides"))
    return per_slide.filter("remaining > 0").orderBy("deck_id", "slide_index"), finished


def _splice(target: Column, start: Column, end: Column, fix: Column) -> Column:
    return F.concat(F.substring(target, F.lit(1), start), fix, F.substring(target, end + 1, F.length(target)))


def suggest_fix(findings: DataFrame) -> DataFrame:
    """Where a required term should go: ``start, stop, confidence, new_target``.

    Input has ``deck_id, idx, ordinal, type, target, suggested_fix, term_source``. Certain: the
    untranslated source term, or the required term in another case or spacing. Otherwise the word
    run most like the term (bigram Dice of at least one half) as an estimate. Findings without a
    locatable span give no row.
    """
    fix, src = T.strip("suggested_fix"), T.strip(F.coalesce("term_source", F.lit("")))
    rows = findings.filter(F.col("type").startswith("terminology.")).withColumns({"fix": fix, "src": src}).filter(
        (F.coalesce("fix", F.lit("")) != "") & (F.col("target") != "") & ~F.contains(F.col("target"), F.col("fix"))
    )
    at = F.when(F.col("src") != "", F.instr(F.lower("target"), F.lower("src"))).otherwise(F.lit(0))
    quoted = F.transform(
        F.split(F.col("fix"), r"\s+"), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    )
    variant = F.regexp_substr(F.col("target"), F.concat(F.lit("(?iu)"), F.array_join(quoted, "\\s*")))
    found = rows.withColumns({"__at": at, "__variant": variant})
    v_at = F.instr(F.col("target"), F.col("__variant"))
    certain = found.filter((F.col("__at") > 0) | F.col("__variant").isNotNull()).withColumn(
        "start", F.when(F.col("__at") > 0, F.col("__at") - 1).otherwise(v_at - 1)
    ).withColumn(
        "stop", F.col("start") + F.when(F.col("__at") > 0, F.length("src")).otherwise(F.length("__variant"))
    ).withColumn("confidence", F.lit("certain"))
    guessed = _similar_span(found.filter((F.col("__at") == 0) & F.col("__variant").isNull()))
    cols = ["deck_id", "idx", "ordinal", "target", "fix", "start", "stop", "confidence"]
    both = certain.select(*cols).unionByName(guessed.select(*cols))
    return both.withColumn("new_target", _splice(F.col("target"), F.col("start"), F.col("stop"), F.col("fix")))


def _similar_span(rows: DataFrame) -> DataFrame:
    """Best-scoring word run per finding, scored where it stands: no rows per candidate."""
    key = T.norm_text
    fix_key = key("fix")
    fix_words = F.split(F.col("fix_key"), " ")
    words = F.regexp_extract_all("target", F.lit(r"(?U)\S+"), F.lit(0))
    gaps = F.split("target", r"(?U)\S+", -1)
    base = rows.withColumns({"fix_key": fix_key, "__words": words, "__gaps": gaps}).withColumn(
        "__tokens",
        F.aggregate(
            F.arrays_zip(F.col("__words").alias("w"), F.slice("__gaps", 1, F.size("__words")).alias("g")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("t")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["g"]) + F.length(x["w"])).alias("at"),
                F.concat(acc["t"], F.array(F.struct(
                    (acc["at"] + F.length(x["g"])).alias("s"), (acc["at"] + F.length(x["g"]) + F.length(x["w"])).alias("e")
                ))).alias("t"),
            ),
            lambda acc: acc["t"],
        ),
    )
    tokens = F.col("__tokens")
    long_fix_words = F.filter(fix_words, lambda w: F.length(w) >= 2)
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    spans = F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.size(fix_words) + 1, F.size(tokens) - i)),
        lambda n: F.struct(F.get(tokens, i)["s"].alias("s"), F.get(tokens, i + n - 1)["e"].alias("e")),
    )))

    def text_of(s: Column, e: Column) -> Column:
        return F.substring(F.col("target"), s + 1, e - s)

    def shares_word(span_key: Column) -> Column:
        return F.exists(long_fix_words, lambda w: F.contains(span_key, w)) | F.exists(
            F.split(span_key, " "), lambda w: (F.length(w) >= 2) & F.contains(F.col("fix_key"), w)
        )

    sharing = F.filter(spans, lambda x: shares_word(key(text_of(x["s"], x["e"]))))
    # the span as it is, then cut to the term's length (glued-on particles lower the plain score)
    variants = F.flatten(F.transform(sharing, lambda x: F.when(
        x["e"] - x["s"] > F.length("fix"),
        F.array(x, F.struct(x["s"].alias("s"), (x["s"] + F.length("fix")).alias("e"))),
    ).otherwise(F.array(x))))
    scored = F.transform(variants, lambda x: F.struct(
        T.bigram_dice(key(text_of(x["s"], x["e"])), F.col("fix_key")).alias("score"), x["s"].alias("s"), x["e"].alias("e")
    ))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))
    best = F.aggregate(
        scored, none, lambda acc, x: F.when((x["score"] >= 0.5) & (x["score"] > acc["score"]), x).otherwise(acc)
    )
    return base.withColumn("__best", best).filter("__best.s >= 0").withColumns({
        "start": F.col("__best.s"), "stop": F.col("__best.e"), "confidence": F.lit("estimated"),
    })
