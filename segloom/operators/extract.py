"""Pages and slides to ordered blocks and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.plans.cut import cut

_SLIDE = ["deck_id", "slide_index"]
_MARK, _SEP = "\x01", "\x02"
# Tags that end a block without starting one of ours.
_OTHER_BLOCKS = "div|nav|article|section|header|footer|main|aside|table|tr|td|th|body|html|head|br"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _marked(html: Column) -> Column:
    """HTML with invisible parts removed and every block boundary written as mark, kind, separator."""
    c = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?i)<(?:ul|ol)(?:\s[^>]*)?>", f"{_MARK}+{_SEP}")
    c = F.regexp_replace(c, r"(?i)</(?:ul|ol)>", f"{_MARK}-{_SEP}")
    c = F.regexp_replace(c, r"(?i)<(title|h[1-6]|p|li)(?:\s[^>]*)?>", f"{_MARK}$1{_SEP}")
    return F.regexp_replace(c, rf"(?i)</?(?:title|h[1-6]|p|li|{_OTHER_BLOCKS})(?:\s[^>]*)?/?>", f"{_MARK}{_SEP}")


def blocks_from_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Ordered blocks of each page: ``pos, kind, level, text``.

    Kinds are title, heading, paragraph and list_item; the level is the heading depth or the list
    nesting. Unclosed tags end where the next block starts.
    """
    pieces = pages.select(id_col, F.posexplode(F.split(_marked(F.col(html_col)), _MARK)).alias("raw_pos", "piece"))
    tag = F.lower(F.substring_index("piece", _SEP, 1))
    body = F.when(F.contains("piece", F.lit(_SEP)), F.substring("piece", F.length(tag) + 2, F.length("piece")))
    text = F.regexp_replace(body, r"<[^>]*>", "")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    parsed = pieces.withColumns({"tag": F.when(F.contains("piece", F.lit(_SEP)), tag), "text": T.strip(T.collapse_ws(text))})
    page = Window.partitionBy(id_col).orderBy("raw_pos")
    step = F.when(F.col("tag") == "+", 1).when(F.col("tag") == "-", -1).otherwise(0)
    depth = F.sum(step).over(page.rowsBetween(Window.unboundedPreceding, 0))
    kind = (
        F.when(F.col("tag") == "title", "title").when(F.col("tag").rlike("^h[1-6]$"), "heading")
        .when(F.col("tag") == "p", "paragraph").when(F.col("tag") == "li", "list_item")
    )
    level = (
        F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
        .when(F.col("tag") == "li", F.greatest(F.lit(0), F.col("depth") - 1).cast("int")).otherwise(0)
    )
    kept = parsed.withColumn("depth", depth).withColumn("kind", kind).filter("kind is not null and text <> ''")
    return kept.select(
        id_col, (F.row_number().over(page) - 1).alias("pos"), "kind", level.alias("level"), "text"
    )


def reading_order(shapes: DataFrame) -> DataFrame:
    """Visual order per slide: top, then left, unplaced shapes last, drawing order on ties.

    ``shapes``: ``shape_id, top, left, z`` and optionally ``parent_id`` for members of a group; a
    group stands where its own box is and its members are ordered inside it, at any depth. Groups themselves
    are not returned. A parent that the slide does not have, or that closes a ring, counts as none.
    """
    own = F.struct(
        F.col("top").isNull().alias("a"), F.coalesce("top", F.lit(0)).alias("b"),
        F.col("left").isNull().alias("c"), F.coalesce("left", F.lit(0)).alias("d"), F.col("z").alias("e"),
    )
    placed = shapes.withColumn("__path", F.array(own))
    if "parent_id" in shapes.columns:
        members = shapes.filter("parent_id is not null").select(*_SLIDE, F.col("parent_id").alias("shape_id")).distinct()
        paths = _paths_from_top(shapes.select(*_SLIDE, "shape_id", "parent_id", F.array(own).alias("__path")))
        placed = shapes.join(members, [*_SLIDE, "shape_id"], "left_anti").join(paths, [*_SLIDE, "shape_id"])
    by_slide = Window.partitionBy(*_SLIDE).orderBy("__path")
    return placed.withColumn("reading_pos", F.row_number().over(by_slide) - 1).drop("__path")


def _paths_from_top(links: DataFrame) -> DataFrame:
    """``shape_id`` with the boxes from its outermost group down, by pointer doubling: each round doubles the levels climbed."""
    known = links.select(*_SLIDE, F.col("shape_id").alias("parent_id")).distinct()
    now = links.filter("parent_id is null").unionByName(
        links.join(known, [*_SLIDE, "parent_id"], "left_semi")
    ).unionByName(links.filter("parent_id is not null").join(known, [*_SLIDE, "parent_id"], "left_anti").withColumn("parent_id", F.lit(None)))
    now = cut(now.select(*_SLIDE, "shape_id", "parent_id", "__path"))
    single, climbed = now, 1
    while not (open_ := now.filter("parent_id is not null")).isEmpty():
        if climbed > (open_.groupBy(*_SLIDE).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]):
            # more levels than shapes: what is still open hangs in a ring
            rings = open_.select(*_SLIDE, "shape_id").join(single.drop("parent_id"), [*_SLIDE, "shape_id"])
            return now.filter("parent_id is null").drop("parent_id").unionByName(rings)
        up = now.select(*_SLIDE, F.col("shape_id").alias("parent_id"), F.col("parent_id").alias("__next"), F.col("__path").alias("__above"))
        now = cut(now.join(up, [*_SLIDE, "parent_id"], "left").select(
            *_SLIDE, "shape_id", F.col("__next").alias("parent_id"),
            F.when(F.col("__above").isNull(), F.col("__path")).otherwise(F.concat("__above", "__path")).alias("__path"),
        ))
        climbed *= 2
    return now.drop("parent_id")


def slide_title(shapes: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Title per slide and the lines that remain for its body.

    ``shapes`` (ordered, with ``reading_pos`` and ``kind`` title/textbox/...) and ``lines``
    (``shape_id, line_no, text``). A title shape with text gives the title and is used up. Else
    the first non-blank line of the first text box that has one; only the lines up to it go. Else
    ``Slide n``.
    """
    full = lines.join(shapes.select(*_SLIDE, "shape_id", "kind", "reading_pos"), [*_SLIDE, "shape_id"])
    filled = ~T.is_blank("text")
    titled = full.filter("kind = 'title'").groupBy(*_SLIDE, "shape_id", "reading_pos").agg(
        T.strip(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "text")))["text"], "\n")).alias("title")
    ).filter("title <> ''").groupBy(*_SLIDE).agg(F.min_by(F.struct("shape_id", "title"), "reading_pos").alias("t"))
    boxed = full.filter((F.col("kind") == "textbox") & filled).groupBy(*_SLIDE).agg(
        F.min_by(F.struct("shape_id", "line_no", T.strip("text").alias("title")), F.struct("reading_pos", "line_no")).alias("b")
    )
    titles = shapes.select(*_SLIDE).distinct().join(titled, _SLIDE, "left").join(boxed, _SLIDE, "left").select(
        *_SLIDE,
        F.coalesce("t.title", "b.title", F.concat(F.lit("Slide "), (F.col("slide_index") + 1).cast("string"))).alias("title"),
        F.coalesce("t.shape_id", "b.shape_id").alias("title_shape"),
        F.when(F.col("t").isNull(), F.col("b.line_no")).alias("title_line"),
    )
    rest = full.join(titles, _SLIDE).filter(
        F.col("title_shape").isNull() | (F.col("shape_id") != F.col("title_shape")) | (F.col("line_no") > F.col("title_line"))
    )
    return titles, rest.select(*lines.columns)


def slides_subset(slides: DataFrame, wanted: list[int]) -> DataFrame:
    """Slides whose 1-based number is asked for."""
    return slides.filter((F.col("slide_index") + 1).isin(wanted))


def _pipes(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, T.md_escape), " | "), F.lit(" |"))


def _rule(n: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))


def chart_value(v: Column) -> Column:
    """Whole numbers without decimals, nothing for a missing value."""
    return F.when(v.isNull(), "").when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def block_to_markdown(
    blocks: DataFrame, *, table_header: bool = True, figures: str = "placeholder", charts: str = "labels"
) -> DataFrame:
    """Add ``markdown`` (with the blank line after the block); null when the block shows nothing.

    Blocks are one wide table: ``kind`` (text, table, chart, figure, note) with ``lines,
    indent_levels, rows, title, categories, series, figure_type``.
    """
    line_at = F.transform(
        "lines",
        lambda line, i: F.when(line != "", F.concat(
            F.repeat(F.lit("  "), F.coalesce(F.get("indent_levels", i), F.lit(0))), F.lit("- "), line
        )),
    )
    text = F.concat(F.array_compact(line_at), F.array(F.lit("")))
    body = F.transform("rows", _pipes)
    if table_header:
        table = F.concat(
            F.slice(body, 1, 1), F.array(_rule(F.size(F.get("rows", F.lit(0))))),
            F.slice(body, F.lit(2), F.greatest(F.lit(0), F.size("rows") - 1)), F.array(F.lit("")),
        )
    else:
        table = F.concat(body, F.array(F.lit("")))
    table = F.when(F.size("rows") > 0, table)
    width = F.size("categories")
    header = F.concat(F.array(F.lit("구분")), F.col("categories"))
    series_rows = F.transform("series", lambda s: _pipes(F.concat(
        F.array(s["name"]),
        F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(chart_value(F.get(s["values"], i)), F.lit(""))),
    )))
    has_title = F.coalesce("title", F.lit("")) != ""
    chart = F.concat(
        F.array(F.when(has_title, F.concat(F.lit("[Chart: "), "title", F.lit("]"))).otherwise("[Chart]")),
        F.array(_pipes(header), _rule(width + 1)), series_rows, F.array(F.lit("")),
    )
    is_image = F.col("figure_type") == "image"
    shown = F.when(
        is_image & F.lit(figures == "placeholder"),
        F.concat(F.lit("[Figure: "), F.when(has_title, F.col("title")).otherwise("Image"), F.lit("]")),
    ).when(
        (F.col("figure_type") == "chart") & F.lit(charts == "labels"),
        F.concat(F.lit('[Figure: Chart, title="'), F.when(has_title, F.col("title")).otherwise("Chart"), F.lit('"]')),
    ).when((F.col("figure_type") == "chart") & F.lit(charts == "placeholder"), F.lit("[Figure: Chart]"))
    figure = F.array_compact(F.array(shown, F.lit("")))
    note = F.array(F.concat(F.lit("> NOTE: "), T.strip(F.translate(F.element_at("lines", 1), "\n", " "))), F.lit(""))
    rendered = (
        F.when(F.col("kind") == "text", text).when(F.col("kind") == "table", table)
        .when(F.col("kind") == "chart", chart).when(F.col("kind") == "figure", figure).when(F.col("kind") == "note", note)
    )
    return blocks.withColumn("markdown", F.array_join(rendered, "\n"))


def slides_to_markdown(slides: DataFrame, rendered: DataFrame) -> DataFrame:
    """One Markdown text per deck: a heading per slide, then its blocks in order.

    ``slides``: ``deck_id, slide_index, title``; ``rendered``: blocks with ``pos`` and ``markdown``.
    A deck here is one document; its slides are put together first, then the deck.
    """
    bodies = rendered.filter("markdown is not null").groupBy(*_SLIDE).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "markdown")))["markdown"], "\n").alias("body")
    )
    chunk = F.concat(
        F.lit("## Slide "), (F.col("slide_index") + 1).cast("string"), F.lit(" - "), "title", F.lit("\n\n"),
        T.strip(F.coalesce("body", F.lit(""))), F.lit("\n"),
    )
    pages = slides.join(bodies, _SLIDE, "left").select(*_SLIDE, chunk.alias("chunk"))
    return pages.groupBy("deck_id").agg(
        F.concat(T.rstrip(F.array_join(F.array_sort(F.collect_list(F.struct("slide_index", "chunk")))["chunk"], "\n")), F.lit("\n")).alias("markdown")
    )
