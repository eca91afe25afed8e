"""Glossary tables: merge, dedupe, upsert, salvage, export guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.functions import values as V
from segloom.operators.sweep import holders
from segloom.plans.cut import cut


def _keyed(entries: DataFrame) -> DataFrame:
    """Trimmed entries with their term key; blank ones dropped."""
    trimmed = entries.withColumns({"source": T.strip("source"), "target": T.strip("target")})
    return trimmed.filter("source <> '' and target <> ''").withColumn("term_key", T.term_key("source"))


def merge_glossaries(glossaries: DataFrame, active: list[str] | None = None) -> DataFrame:
    """The first active glossary wins per term key; order is (priority, pos).

    ``active`` lists glossary ids by precedence; without it the stored priority is used. Entries
    are reduced per spelling before the key is computed, so only distinct terms are normalised.
    """
    if active is not None:
        rank = F.array_position(F.lit(active), F.col("glossary_id"))
        glossaries = glossaries.filter(rank > 0).withColumn("priority", rank.cast("int"))
    order = F.struct("priority", "pos")
    entry = F.struct("glossary_id", "priority", "pos", "source", "target")
    per_spelling = (
        glossaries.filter(~T.is_blank("source"))
        .groupBy(T.strip("source").alias("spelling"))
        .agg(F.min_by(entry, order).alias("e"))
    )
    per_key = per_spelling.groupBy(T.term_key("spelling").alias("term_key")).agg(
        F.min_by("e", F.struct("e.priority", "e.pos")).alias("e")
    )
    return per_key.select("e.*", "term_key")


def dedupe_glossary(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One entry per glossary and term key: the last value at the first place.

    Returns the clean entries and the limit violations (``glossary_id, pos, rule``).
    """
    keyed = _keyed(entries)
    order = F.col("pos")
    clean = keyed.groupBy("glossary_id", "term_key").agg(
        F.min("pos").alias("pos"),
        F.max_by(F.struct("source", "target", "notes"), order).alias("e"),
    ).select("glossary_id", "term_key", "pos", "e.*")
    too_long = keyed.select(
        "glossary_id", F.col("pos").cast("long").alias("pos"),
        F.when(F.length("source") > V.MAX_TERM_CHARS, "source_too_long")
        .when(F.length("target") > V.MAX_TERM_CHARS, "target_too_long")
        .when(F.length("notes") > V.MAX_NOTES_CHARS, "notes_too_long").alias("rule"),
    ).filter("rule is not null")
    too_many = clean.groupBy("glossary_id").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > V.MAX_GLOSSARY_ENTRIES
    ).select("glossary_id", F.lit(None).cast("long").alias("pos"), F.lit("too_many_entries").alias("rule"))
    return clean, too_long.unionByName(too_many)


def upsert_glossary(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incoming entries replace existing ones of the same key; notes survive when not replaced.

    Returns the merged entries and one row of counts. A key that comes in repeatedly is inserted
    once and then updated.
    """
    cols = ["term_key", "pos", "source", "target", "notes"]
    old = _keyed(existing).select(*cols, F.lit(0).alias("side"))
    new = _keyed(incoming).select(*cols, F.lit(1).alias("side"))
    order = F.struct("side", "pos")
    is_new = F.col("side") == 1
    merged = old.unionByName(new).groupBy("term_key").agg(
        F.max_by(F.struct("source", "target"), order).alias("e"),
        F.max_by(F.when(is_new, F.col("notes")), F.when(is_new & F.col("notes").isNotNull(), F.col("pos"))).alias("new_notes"),
        F.max_by(F.when(~is_new, F.col("notes")), F.when(~is_new, F.col("pos"))).alias("old_notes"),
        F.count_if(is_new).alias("incoming"),
        F.count_if(~is_new).alias("existing"),
    )
    fresh = (F.col("existing") == 0).cast("long")
    entries = merged.select(
        "term_key", "e.source", "e.target", F.coalesce("new_notes", "old_notes").alias("notes"),
        F.col("existing").cast("boolean").alias("existed"),
    )
    counts = merged.agg(
        F.coalesce(F.sum(fresh), F.lit(0)).alias("inserted"),
        F.coalesce(F.sum(F.col("incoming") - fresh), F.lit(0)).alias("updated"),
    )
    return entries, counts


_LIBRARY = (
    "glossaries array<struct<id string, name string, entries array<struct<id string, source string, "
    "target string, notes string>>>>, activeGlossaryIds array<string>, activeGlossaryId string"
)


def salvage_glossary_library(libraries: DataFrame, id_col: str, json_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repair stored glossary libraries: ``(entries, rejected, active)``.

    The first glossary of an id counts, invalid entries go to ``rejected``, the last value of a
    term key wins but keeps the id and place of the first, and only known glossaries stay active.
    """
    parsed = libraries.select(id_col, F.from_json(json_col, _LIBRARY).alias("lib"))
    boxes = parsed.select(id_col, F.posexplode("lib.glossaries").alias("gpos", "g")).select(
        id_col, "gpos",
        F.coalesce(F.when(~T.is_blank("g.id"), F.col("g.id")), F.concat(F.lit("glossary_"), F.col("gpos").cast("string"))).alias("glossary_id"),
        F.col("g.name").alias("name"), F.col("g.entries").alias("entries"),
    )
    first = boxes.groupBy(id_col, "glossary_id").agg(
        F.min_by(F.struct("gpos", "name", "entries"), "gpos").alias("b")
    ).select(id_col, "glossary_id", "b.*")
    name = T.strip(F.coalesce("name", F.lit("")))
    named = first.withColumn(
        "name",
        F.when((name == "") | (F.length(name) > V.MAX_NAME_CHARS), F.lit(V.DEFAULT_GLOSSARY_NAME)).otherwise(name),
    )
    rows = named.select(id_col, "glossary_id", "gpos", "name", F.posexplode("entries").alias("pos", "x")).select(
        id_col, "glossary_id", "gpos", "name", "pos",
        F.coalesce(F.nullif("x.id", F.lit("")), F.concat(F.lit("term_"), F.col("pos").cast("string"))).alias("entry_id"),
        T.strip(F.coalesce("x.source", F.lit(""))).alias("source"),
        T.strip(F.coalesce("x.target", F.lit(""))).alias("target"),
        F.nullif(T.strip("x.notes"), F.lit("")).alias("notes"),
    )
    ok = (
        (F.col("source") != "") & (F.col("target") != "")
        & (F.length("source") <= V.MAX_TERM_CHARS) & (F.length("target") <= V.MAX_TERM_CHARS)
        & (F.length(F.coalesce("notes", F.lit(""))) <= V.MAX_NOTES_CHARS)
    )
    entries = rows.filter(ok).groupBy(id_col, "glossary_id", T.term_key("source").alias("term_key")).agg(
        F.min("pos").alias("pos"), F.min_by("entry_id", "pos").alias("entry_id"),
        F.max_by(F.struct("name", "source", "target", "notes"), "pos").alias("e"),
    ).select(id_col, "glossary_id", "term_key", "pos", "entry_id", "e.*")
    rejected = rows.filter(~ok).select(id_col, "glossary_id", "pos", "source", "target")
    asked = parsed.select(
        id_col,
        F.posexplode(F.coalesce("lib.activeGlossaryIds", F.array("lib.activeGlossaryId"))).alias("apos", "glossary_id"),
    ).filter("glossary_id is not null")
    active = asked.groupBy(id_col, "glossary_id").agg(F.min("apos").alias("apos")).join(
        first.select(id_col, "glossary_id"), [id_col, "glossary_id"], "left_semi"
    )
    return entries, rejected, active


def spreadsheet_safe(c) -> Column:
    """Values a spreadsheet would run as a formula get a leading tab."""
    cell = F.col(c) if isinstance(c, str) else c
    return F.concat(F.when(F.left(cell, F.lit(1)).isin("=", "+", "-", "@"), F.lit("\t")).otherwise(F.lit("")), cell)


def duplicate_terms(glossary: DataFrame) -> DataFrame:
    return _keyed(glossary).groupBy("term_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def glossary_hits_first(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """All terms for each segment, those that occur in it first, otherwise in glossary order.

    The hits of a segment come from the substring search of the sweep, which takes any glossary; the whole list is one row.
    """
    terms = cut(glossary.select(F.col("pos").cast("long").alias("pos"), "source").filter("source is not null"))
    found = holders(
        segments.select("deck_id", "idx", F.lower("original_text").alias("__lower")), "__lower",
        terms.select(F.lower("source").alias("n"), "pos", "source").filter("n <> ''"), ["pos", "source"],
    )
    entry = F.struct("pos", "source")
    hits = found.groupBy("deck_id", "idx").agg(F.array_sort(F.collect_list(F.struct("__t.pos", "__t.source"))).alias("h"))
    everything = terms.groupBy(F.lit(0).alias("__one")).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    listed = segments.select("deck_id", "idx", F.lit(0).alias("__one")).join(hits, ["deck_id", "idx"], "left").join(everything, "__one", "left")
    none = F.array().cast("array<struct<pos:bigint,source:string>>")
    split = listed.select("deck_id", "idx", F.coalesce("h", none).alias("h"), F.coalesce("all", none).alias("all"))
    others = F.array_except("all", "h")
    return split.select(
        "deck_id", "idx", F.col("h.source").alias("hits"), others["source"].alias("others"),
        F.concat(F.col("h.source"), others["source"]).alias("terms"),
    )
