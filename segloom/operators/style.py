"""Style runs: grouping, offsets, status, audits, deterministic splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.functions import values as V
from segloom.plans.cut import cut

_PARAGRAPH = ["deck_id", "idx"]


def run_offsets(runs: DataFrame) -> DataFrame:
    """Character span of each non-empty run inside its paragraph, and the paragraph's length."""
    w = Window.partitionBy(*_PARAGRAPH)
    ordered = w.orderBy("run_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.length("text")
    return runs.filter("text <> ''").withColumns({
        "end": F.sum(n).over(ordered), "text_length": F.sum(n).over(w)
    }).withColumn("start", F.col("end") - n)


# Run attributes that do not change how text looks.
NON_VISUAL = ["lang", "altLang", "dirty", "err", "noProof", "smtClean", "bmk"]
_DIGIT = r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"


def visual_key(attributes: Column) -> Column:
    """Format key of a run from its attribute map, order-free and without invisible attributes."""
    seen = F.map_filter(attributes, lambda k, v: ~k.isin(NON_VISUAL))
    return F.to_json(F.array_sort(F.map_entries(seen)))


def format_groups(runs: DataFrame, fmt: str = "color") -> DataFrame:
    """Adjacent runs of equal format: ``group_index, fmt, text, length, neutral``."""
    w = Window.partitionBy(*_PARAGRAPH).orderBy("run_no")
    starts = F.coalesce((F.lag(fmt).over(w) != F.col(fmt)).cast("int"), F.lit(0))
    marked = runs.withColumn("__new", starts).withColumn(
        "group_index", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    )
    grouped = marked.groupBy(*_PARAGRAPH, "group_index").agg(
        F.min(fmt).alias("fmt"), F.array_join(F.array_sort(F.collect_list(F.struct("run_no", "text")))["text"], "").alias("text"),
        F.sum(F.length("text")).alias("length"),
    )
    return grouped.withColumn("neutral", T.is_neutral_color("fmt"))


def style_status(groups: DataFrame, styled: DataFrame) -> DataFrame:
    """How well each paragraph's emphasis survived: single_style, dropped, partial or preserved.

    ``styled`` has ``deck_id, idx, group_index`` of the target segments; unknown groups are skipped.
    """
    need = groups.groupBy(*_PARAGRAPH).agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set(F.when(~T.is_blank("text"), F.col("group_index"))).alias("shown"),
    )
    used = styled.groupBy(*_PARAGRAPH).agg(F.collect_set("group_index").alias("used"))
    status = (
        F.when(F.col("n") <= 1, "single_style").when(F.col("used").isNull(), "dropped")
        .when(F.size(F.array_except("shown", "used")) == 0, "preserved").otherwise("partial")
    )
    return need.join(used, _PARAGRAPH, "left").select(*_PARAGRAPH, status.alias("status"))


def fallback_group(groups: DataFrame) -> DataFrame:
    """Group to format a whole paragraph with: longest plain one, else longest, first on ties."""
    order = F.struct((~F.col("neutral")).alias("a"), (-F.col("length")).alias("b"), "group_index")
    return groups.groupBy(*_PARAGRAPH).agg(F.min_by("group_index", order).alias("group_index"))


def rule_based_style_split(groups: DataFrame, bitext: DataFrame) -> DataFrame:
    """Split a target in two when a number-like group text stands at its end or start."""
    pair = groups.groupBy(*_PARAGRAPH).agg(
        F.array_sort(F.collect_list(F.struct("group_index", "text"))).alias("g")
    ).filter(F.size("g") == 2)
    rows = pair.join(bitext.select(*_PARAGRAPH, "target"), _PARAGRAPH)
    target = F.col("target")

    def segment(text: Column, group: int) -> Column:
        return F.struct(text.alias("text"), F.lit(group).alias("group_index"))

    split = None
    for anchor_group in (0, 1):
        other = 1 - anchor_group
        anchor = T.strip(F.col("g")[anchor_group]["text"])
        fits = (F.length(anchor) >= 2) & anchor.rlike(f"[{_DIGIT}$%€£¥#@&+]")
        before = F.substring(target, F.lit(1), F.length(target) - F.length(anchor))
        after = F.substring(target, F.length(anchor) + 1, F.length(target))
        for condition, parts in (
            (F.endswith(target, anchor), F.array(segment(before, other), segment(anchor, anchor_group))),
            (F.startswith(target, anchor), F.array(segment(anchor, anchor_group), segment(after, other))),
        ):
            split = (F if split is None else split).when(fits & condition, parts)
    return rows.select(*_PARAGRAPH, F.posexplode(split).alias("seg_no", "s")).select(
        *_PARAGRAPH, "seg_no", "s.text", "s.group_index"
    )


def validate_styled_segments(styled: DataFrame, bitext: DataFrame, n_groups: DataFrame) -> DataFrame:
    """Accept styled segments that spell the target, repairing whitespace at the two ends.

    ``styled``: ``deck_id, idx, seg_no, text, group_index``; ``n_groups``: ``deck_id, idx, n_groups``.
    Returns ``valid`` and the accepted ``texts``.
    """
    packed = styled.groupBy(*_PARAGRAPH).agg(
        F.array_sort(F.collect_list(F.struct("seg_no", "text", "group_index"))).alias("s")
    )
    rows = bitext.select(*_PARAGRAPH, "target").join(n_groups, _PARAGRAPH).join(packed, _PARAGRAPH, "left")
    plain = F.transform(F.col("s.text"), T.normalize_ws)
    in_range = F.forall("s", lambda x: (x["group_index"] >= 0) & (x["group_index"] < F.col("n_groups")))
    rows = rows.withColumns({"__p": plain, "__t": T.normalize_ws("target"), "__ok": F.coalesce((F.size("s") > 0) & in_range, F.lit(False))})
    rows = rows.withColumn("__j", F.array_join("__p", ""))

    def lead(c: str) -> Column:
        return F.length(c) - F.length(T.lstrip(c))

    def trail(c: str) -> Column:
        return F.length(c) - F.length(T.rstrip(c))

    filled = F.transform("__p", lambda x: T.strip(x) != "")
    rows = rows.withColumns({
        "__lead": lead("__j") - lead("__t"), "__trail": trail("__j") - trail("__t"),
        "__first": F.array_position(filled, F.lit(True)).cast("int"),
        "__last": (F.size("__p") + 1 - F.nullif(F.array_position(F.reverse(filled), F.lit(True)), F.lit(0))).cast("int"),
    })

    def edit_at(parts: str, at: Column, new) -> Column:
        return F.concat(
            F.slice(parts, F.lit(1), at - 1), F.array(new(F.get(parts, at - 1))),
            F.slice(parts, at + 1, F.greatest(F.lit(0), F.size(parts) - at)),
        )

    one, n = F.lit(1), F.size("__p")
    head = F.when((F.col("__lead") > 0) & (F.col("__first") > 0), edit_at(
        "__p", F.greatest(one, F.col("__first")), lambda x: F.substring(x, F.col("__lead") + 1, F.length(x))
    )).when(F.col("__lead") < 0, edit_at("__p", one, lambda x: F.concat(F.repeat(F.lit(" "), -F.col("__lead")), x))).otherwise(F.col("__p"))
    rows = rows.withColumn("__h", head)
    last = F.coalesce("__last", one)
    tail = F.when(F.col("__trail") > 0, edit_at(
        "__h", last, lambda x: F.substring(x, one, F.length(x) - F.col("__trail"))
    )).when(F.col("__trail") < 0, edit_at(
        "__h", F.greatest(one, n), lambda x: F.concat(x, F.repeat(F.lit(" "), -F.col("__trail")))
    )).otherwise(F.col("__h"))
    rows = rows.withColumn("__r", F.when(F.col("__ok"), tail))
    exact = F.col("__ok") & (F.col("__j") == F.col("__t"))
    mended = F.col("__ok") & (T.strip("__j") == T.strip("__t")) & (F.array_join("__r", "") == F.col("__t"))
    return rows.select(
        *_PARAGRAPH, (exact | mended).alias("valid"),
        F.when(exact, F.col("s.text")).when(mended, F.col("__r")).alias("texts"),
    )


def _paragraph_places(runs: DataFrame) -> DataFrame:
    """``deck_id, idx, para_no`` of the paragraphs with runs; no text is needed for that."""
    from segloom.plans.ordering import position

    return cut(position(cut(runs.filter("text <> ''").select(*_PARAGRAPH).distinct()), ["deck_id"], "idx", "para_no"))


def _pack_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring runs of one paragraph with successive numbers as one row: the first number, their joined text and their ``sizes``."""
    for batch in batches:
        if not len(batch):
            continue
        keys = [batch[c].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in _PARAGRAPH]
        numbers = batch["run_no"].to_numpy(zero_copy_only=False)
        change = numbers[1:] != numbers[:-1] + 1
        for x in keys:
            change |= x[1:] != x[:-1]
        first = np.concatenate([[0], np.flatnonzero(change) + 1])
        offsets = pa.array(np.append(first, len(batch)).astype(np.int32))
        sizes = pc.add(pc.multiply(pc.utf8_length(batch["text"]), pa.scalar(2, pa.int32())), batch["strong"].cast(pa.int32()))
        said = pc.binary_join(pa.ListArray.from_arrays(offsets, batch["text"]), "")
        yield pa.RecordBatch.from_arrays(
            [*[batch[c].take(pa.array(first)) for c in (*_PARAGRAPH, "run_no")], said, pa.ListArray.from_arrays(offsets, sizes)],
            [*_PARAGRAPH, "no", "said", "sizes"],
        )


def _apart(lots: Column) -> Column:
    """Lots of runs as lots of one run each, in order; needed only where run numbers repeat, so that lots overlap."""
    half = lambda n: F.floor(n / 2).cast("int")
    return F.array_sort(F.flatten(F.transform(lots, lambda lot: F.transform(lot["sizes"], lambda n, i: F.struct(
        (lot["no"] + i).alias("no"),
        F.substring(lot["said"], 1 + F.aggregate(F.slice(lot["sizes"], F.lit(1), i), F.lit(0), lambda at, m: at + half(m)), half(n)).alias("said"),
        F.array(n).alias("sizes"),
    )))))


def _paragraph_texts(runs: DataFrame) -> DataFrame:
    """``deck_id, idx, text, length, spots`` of each paragraph.

    Runs are packed where they are, so a paragraph's words are exchanged as one text with a number per word.
    """
    strong = ~T.is_neutral_color("color") & ~T.is_blank("text")
    given = runs.filter("text <> ''").select(
        *_PARAGRAPH, F.col("run_no").cast("long").alias("run_no"), "text", F.coalesce(strong, F.lit(False)).alias("strong")
    )
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    keys = ", ".join(f"{c} {kinds[c]}" for c in _PARAGRAPH)
    lots = given.mapInArrow(_pack_runs, f"{keys}, no long, said string, sizes array<int>")
    met = lots.groupBy(*_PARAGRAPH).agg(F.array_sort(F.collect_list(F.struct("no", "said", "sizes"))).alias("l"))
    overlap = F.exists(
        F.sequence(F.lit(1), F.size("l")), lambda i: F.get("l", i)["no"] < F.get("l", i - 1)["no"] + F.size(F.get("l", i - 1)["sizes"])
    )
    packed = met.withColumn("l", F.when(overlap, _apart(F.col("l"))).otherwise(F.col("l"))).select(
        *_PARAGRAPH, F.array_join("l.said", "").alias("text"), F.flatten("l.sizes").alias("sizes")
    ).withColumn("length", F.length("text").cast("long"))
    spots = F.aggregate(
        "sizes", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("s")),
        lambda seen, n: F.struct(
            (seen["at"] + F.floor(n / 2)).alias("at"),
            F.when(n % 2 == 1, F.array_union(seen["s"], F.array(
                T.relative_position(seen["at"], seen["at"] + F.floor(n / 2), F.col("length"))
            ))).otherwise(seen["s"]).alias("s"),
        ),
        lambda seen: seen["s"],
    )
    return packed.select(*_PARAGRAPH, "text", "length", F.array_compact(spots).alias("spots"))


def paragraphs_of(runs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """One row per paragraph with runs: its ordinal in the deck, text, and where emphasis sits."""
    return _paragraph_texts(runs).join(_paragraph_places(runs) if places is None else places, _PARAGRAPH)


def style_audit_join(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source and target paragraphs side by side by ordinal, as far as both reach."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("deck_id", "para_no", *[F.col(c).alias(f"{tag}_{c}") for c in ("idx", "text", "length", "spots")])

    return side(source, "src").join(side(target, "tgt"), ["deck_id", "para_no"])


def style_audit(src_runs: DataFrame, tgt_runs: DataFrame) -> DataFrame:
    """Suspicious highlight changes per paragraph, and one row per deck whose counts differ."""
    src_places, tgt_places = _paragraph_places(src_runs), _paragraph_places(tgt_runs)
    # written, so that the packed runs of one side are gone before those of the other are exchanged
    src, tgt = cut(paragraphs_of(src_runs, src_places)), cut(paragraphs_of(tgt_runs, tgt_places))
    pairs = style_audit_join(src, tgt)
    had, has = F.size("src_spots") > 0, F.size("tgt_spots") > 0
    kind = (
        F.when(~had & has, "target_added_highlight").when(had & ~has, "dropped_highlight")
        .when(had & has & F.arrays_overlap("src_spots", "tgt_spots"), "position_like_highlight")
    )
    severity = (
        F.when(F.col("kind") == "target_added_highlight", "medium").when(F.col("kind") == "dropped_highlight", "low")
        .when(F.col("src_length") != F.col("tgt_length"), "high").otherwise("medium")
    )
    found = pairs.withColumn("kind", kind).filter("kind is not null").select(
        "deck_id", F.col("para_no").alias("index"), "kind", severity.alias("severity"),
        F.col("src_text").alias("source_text"), F.col("tgt_text").alias("target_text"),
    )

    def count(places: DataFrame, tag: str) -> DataFrame:
        return places.groupBy("deck_id").agg(F.count(F.lit(1)).cast("int").alias(f"{tag}_n"), F.max("idx").alias(f"{tag}_at"))

    def last(paragraphs: DataFrame, differ: DataFrame, tag: str) -> DataFrame:
        ends = differ.select("deck_id", F.col(f"{tag}_at").alias("idx"))
        return paragraphs.join(ends, _PARAGRAPH, "left_semi").select("deck_id", F.col("text").alias(f"{tag}_last"))

    zero, blank = F.lit(0), F.lit("")
    differ = cut(count(src_places, "src").join(count(tgt_places, "tgt"), "deck_id", "full").withColumns(
        {"s": F.coalesce("src_n", zero), "t": F.coalesce("tgt_n", zero)}
    ).filter("s <> t"))
    counts = differ.join(last(src, differ, "src"), "deck_id", "left").join(last(tgt, differ, "tgt"), "deck_id", "left").select(
        "deck_id", "s", "t", F.coalesce("src_last", blank).alias("source_text"), F.coalesce("tgt_last", blank).alias("target_text"),
    )
    mismatch = counts.select(
        "deck_id", F.least("s", "t").alias("index"), F.lit("paragraph_count_mismatch").alias("kind"),
        F.lit("high").alias("severity"), "source_text", "target_text",
    )
    return found.unionByName(mismatch)


# Theme slots that stand for others when a theme does not define them.
THEME_ALIASES = [("tx1", "dk1"), ("tx2", "dk2"), ("bg1", "lt1"), ("bg2", "lt2")]


def resolve_theme_color(runs: DataFrame, theme_colors: DataFrame) -> DataFrame:
    """Display colour of a run: its RGB, else its scheme slot looked up in the deck's theme.

    ``runs``: ``rgb`` (6 hex digits or null) and ``scheme``; ``theme_colors``: ``deck_id, name, value``.
    """
    from segloom.plans.skew import attach

    slots = theme_colors.filter(F.coalesce("value", F.lit("")) != "").select("deck_id", "name", "value", F.lit(0).alias("r"))
    for alias, real in THEME_ALIASES:
        slots = slots.unionByName(
            slots.filter((F.col("name") == real) & (F.col("r") == 0)).withColumns({"name": F.lit(alias), "r": F.lit(1)})
        )
    theme = slots.groupBy("deck_id", F.col("name").alias("scheme")).agg(F.min_by("value", "r").alias("__theme"))
    by_name = runs.filter("rgb is null and scheme is not null").groupBy("deck_id", "scheme").agg(F.count(F.lit(1)).alias("__n"))
    used = by_name.join(theme, ["deck_id", "scheme"])
    spread = [c for c in ("idx", "run_no") if c in runs.columns]
    return attach(runs, used, ["deck_id", "scheme"], "__n", how="left", spread=spread).withColumn(
        "color", F.coalesce(F.concat(F.lit("#"), F.upper("rgb")), F.when(F.col("rgb").isNull(), F.col("__theme")))
    ).drop("__theme")
