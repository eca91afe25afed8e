"""Consistency checks over aligned segments. Each returns findings; none changes a text.

Findings carry sort keys (``check_rank, k1, k2, k3``) that say where the check would have
reported them; ``assign_ordinals`` turns those into the per-deck ordinal.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from segloom.functions import text as T
from segloom.functions import values as V
from segloom.operators import automaton as A
from segloom.plans.cut import cut
from segloom.plans.ordering import position2, running
from segloom.plans.skew import attach

FINDING_COLUMNS = [
    "deck_id", "idx", "type", "severity", "description", "location", "segment",
    "suggested_fix", "term_source", "related_location", "check_rank", "k1", "k2", "k3",
]
#: Locked terms of a segment come after all its glossary terms.
_AFTER_GLOSSARY = 1 << 40
_DIVERGENCE_RANK = 2


def _location() -> Column:
    """1-based slide, as readers count; shape and paragraph as stored."""
    return F.struct(
        (F.col("slide_index") + 1).alias("slide"),
        F.col("shape_index").alias("shape"),
        F.col("paragraph_index").alias("paragraph"),
    )


def _no_location() -> Column:
    return F.lit(None).cast("struct<slide:bigint,shape:int,paragraph:int>")


def _finding(
    df: DataFrame, kind: str, severity: str, description: Column, rank: int, *,
    fix: Column | None = None, term: Column | None = None, related: Column | None = None,
    k1="idx", k2=None, k3=None,
) -> DataFrame:
    def key(c) -> Column:
        return (F.lit(0) if c is None else F.col(c)).cast("long")

    return df.select(
        "deck_id",
        "idx",
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        description.alias("description"),
        _location().alias("location"),
        F.struct(F.col("original_text").alias("source"), F.col("target").alias("output")).alias("segment"),
        (F.lit(None).cast("string") if fix is None else fix).alias("suggested_fix"),
        (F.lit(None).cast("string") if term is None else term).alias("term_source"),
        (_no_location() if related is None else related).alias("related_location"),
        F.lit(rank).alias("check_rank"),
        key(k1).alias("k1"),
        key(k2).alias("k2"),
        key(k3).alias("k3"),
    )


def with_norms(bitext: DataFrame) -> DataFrame:
    """Bitext plus its matching forms; compute once and share between checks."""
    return bitext.withColumns({"src_n": T.norm_text("original_text"), "tgt_n": T.norm_text("target")})


def _normed(bitext: DataFrame) -> DataFrame:
    return bitext if "src_n" in bitext.columns else with_norms(bitext)


def _spoken(bitext: DataFrame) -> DataFrame:
    """Rows with text on both sides (blankness is cheaper to see than an empty matching form)."""
    return _normed(bitext.filter(~T.is_blank("original_text") & ~T.is_blank("target")))


def _prepared_terms(glossary: DataFrame) -> DataFrame:
    """Terms with matching forms; entries equal in spelling keep the last target at the first place."""
    terms = glossary.groupBy("source").agg(
        F.min("pos").cast("long").alias("pos"), F.max_by("target", "pos").alias("target")
    )
    return terms.select(
        "pos", "source", "target", T.norm_text("source").alias("n"), T.norm_text("target").alias("tn")
    ).filter("n <> ''")


def _prepared_locked(locked: DataFrame) -> DataFrame:
    return locked.select(
        F.col("pos").cast("long").alias("pos"), F.col("rule_id").cast("string").alias("source"),
        F.col("term").alias("target"), T.norm_text("term").alias("n"),
    ).filter("n <> ''")


def holders(rows: DataFrame, text: str, terms: DataFrame, said: list[str], missing: tuple[str, str] | None = None) -> DataFrame:
    """``rows`` joined with every term (columns ``said`` as struct ``__t``) whose ``n`` is a substring of ``text``.

    With ``missing`` (a column of the terms, one of the rows) only terms count whose column does not occur in that of the row.
    Terms are looked up where the texts are: in one pass if all can be carried, else a pack of them at a time. No text moves.
    """
    written = cut(terms)
    listed = A.carried(written)
    if listed is None:
        return in_packs(rows, text, written, said, missing)
    spark, column = rows.sparkSession, missing and missing[0]
    shared = A.share(spark, [(r["n"], r[column]) if column else r["n"] for r in listed])
    found = rows.withColumn("__no", F.explode(A.held(shared, F.col(text), F.col(missing[1]) if column else None)))
    return found.join(F.broadcast(_numbered(spark, listed, written)), "__no").drop("__no")


def _numbered(spark: SparkSession, listed: list[Row], terms: DataFrame) -> DataFrame:
    """A carried term table as ``__no, __t``."""
    return spark.createDataFrame(
        list(enumerate(listed)), T_.StructType([T_.StructField("__no", T_.IntegerType()), T_.StructField("__t", terms.schema)])
    )


def in_packs(rows: DataFrame, text: str, terms: DataFrame, said: list[str], missing: tuple[str, str] | None = None) -> DataFrame:
    """``holders`` for any number of written terms: one pass over the texts per pack, and nothing is exchanged but the terms."""
    kept, column = terms.select(*said), missing and missing[0]
    found = [
        rows.withColumn("__t", F.explode(A.held_terms(
            A.share(rows.sparkSession, pack), kept.schema, F.col(text), F.col(missing[1] if missing else text), column
        ))) for pack in A.packs(terms)
    ]
    return reduce(DataFrame.unionAll, found) if found else rows.withColumn("__t", F.lit(None).cast(kept.schema)).limit(0)


def term_violation_join(bitext: DataFrame, glossary: DataFrame) -> DataFrame:
    """Source holds a term (plain substring) but the target lacks its translation."""
    found = holders(_spoken(bitext), "src_n", _prepared_terms(glossary), ["pos", "source", "target"], ("tn", "tgt_n"))
    return _finding(
        found.withColumn("__pos", F.col("__t.pos")), "terminology.violation", "major",
        F.format_string(V.TERM_MESSAGE, F.col("__t.source"), F.col("__t.target")), 1,
        fix=F.col("__t.target"), term=F.col("__t.source"), k3="__pos",
    )


def locked_term_join(bitext: DataFrame, locked: DataFrame) -> DataFrame:
    """Target has a locked term in another case or spacing but not its exact spelling.

    ``locked`` has ``rule_id, term, pos``.
    """
    near = holders(_spoken(bitext), "tgt_n", _prepared_locked(locked), ["pos", "source", "target"], ("target", "target"))
    return _finding(
        near.withColumn("__pos", F.col("__t.pos") + F.lit(_AFTER_GLOSSARY)), "terminology.violation", "major",
        F.format_string(V.LOCKED_MESSAGE, F.col("__t.source"), F.col("__t.target")), 1,
        fix=F.col("__t.target"), k3="__pos",
    )


def check_terminology(bitext: DataFrame, glossary: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    found = term_violation_join(bitext, glossary)
    return found if locked is None else found.unionByName(locked_term_join(bitext, locked))


def check_divergence(bitext: DataFrame, min_len: int = 4) -> DataFrame:
    """The same source translated in more than one way: every variant after the first is reported.

    Variants and groups are plain aggregates over digests of the matching forms, whatever the length of the texts. Only
    the positions of the few reported variants and their anchors are joined back to the texts.
    """
    rows = _normed(bitext)
    others = _anchored(_divergent(rows.select("deck_id", "idx", *_forms(min_len))), bitext)
    texts = bitext.select("deck_id", "idx", "slide_index", "shape_index", "paragraph_index", "original_text", "target")
    return _finding(
        others.join(texts, ["deck_id", "idx"]), "consistency.phrase", "major", _divergence_message(), _DIVERGENCE_RANK,
        related=F.col("__anchor"), k1="group_idx", k2="idx",
    )


def _divergence_message() -> Column:
    return F.format_string(
        V.DIVERGENCE_MESSAGE, F.col("original_text"), F.col("__anchor.slide"), F.col("__said"),
        F.col("slide_index") + 1, F.col("target"),
    )


def _forms(min_len: int = 4) -> list[Column]:
    """Digests of the matching forms (``src`` is null where the source is too short to be compared)."""
    return [
        F.when(F.length("src_n") >= min_len, T.digest(F.col("src_n"))).alias("src"), T.digest(F.col("tgt_n")).alias("tgt"),
        (F.col("tgt_n") != "").alias("spoken"),
    ]


def _divergent(forms: DataFrame) -> DataFrame:
    """Positions of the reported variants: ``deck_id, idx, group_idx, anchor_idx``.

    One aggregate finds the sources said in more than one way; only the rows of these are looked at again.
    """
    compared, said = forms.filter("src is not null"), F.when(F.col("spoken"), F.col("tgt"))
    groups = cut(compared.groupBy("deck_id", "src").agg(
        F.min("idx").alias("group_idx"), F.min(F.when(F.col("spoken"), F.col("idx"))).alias("anchor_idx"),
        F.min(said).alias("__least"), F.max(said).alias("__most"), F.count(F.lit(1)).alias("__rows"),
    ).filter("__least <> __most").drop("__least", "__most"))
    members = attach(compared.filter("spoken").select("deck_id", "src", "tgt", "idx"), groups, ["deck_id", "src"], "__rows", spread=["idx"])
    firsts = members.groupBy("deck_id", "src", "tgt", "group_idx", "anchor_idx").agg(F.min("idx").alias("idx"))
    return cut(firsts.filter("idx <> anchor_idx").select("deck_id", "idx", "group_idx", "anchor_idx"))


def _anchored(others: DataFrame, bitext: DataFrame) -> DataFrame:
    """``_divergent`` with place and target of the anchor (``__anchor, __said``)."""
    anchors = bitext.select(
        "deck_id", F.col("idx").alias("anchor_idx"), _location().alias("__anchor"), F.col("target").alias("__said")
    )
    needed = others.groupBy("deck_id", "anchor_idx").agg(F.count(F.lit(1)).alias("__uses"))
    anchor_texts = needed.join(anchors, ["deck_id", "anchor_idx"])
    return attach(others, anchor_texts, ["deck_id", "anchor_idx"], "__uses", spread=["idx"]).drop("anchor_idx")


def check_untranslated(
    bitext: DataFrame, source_lang: str, target_lang: str, detected: DataFrame | Column | None = None
) -> DataFrame:
    """Segments left in the source language.

    The unchanged-text test is a filter. ``detected`` (``deck_id, idx, code``: language code of
    each target; or that code as a column of ``bitext``, which moves no text) adds the second test for changed texts of 12 or
    more characters.
    """
    rows = _spoken(bitext)
    unchanged, doubtful = _untranslated(source_lang)
    if isinstance(detected, Column):
        # asked in a step of its own, so that the code is not worked out where the first test decides
        flagged = rows.withColumns({"__unchanged": unchanged, "__doubtful": doubtful}).filter("__unchanged or __doubtful")
        foreign = (detected == V.LANGUAGE_ISO[source_lang]) if _detectable(source_lang, target_lang) else F.lit(False)
        rows, unchanged, detected = flagged, F.col("__unchanged") | F.col("__doubtful") & foreign, None
    if detected is not None and _detectable(source_lang, target_lang):
        # only positions meet the codes; texts move once, to the rows found
        flags = rows.select("deck_id", "idx", unchanged.alias("unchanged"), doubtful.alias("doubtful")).filter("unchanged or doubtful")
        left = _left(flags, source_lang, detected)
        return _finding(bitext.join(left, ["deck_id", "idx"]), "accuracy.omission", "critical", F.lit(V.UNTRANSLATED_MESSAGE), 3)
    return _finding(
        rows.filter(unchanged), "accuracy.omission", "critical", F.lit(V.UNTRANSLATED_MESSAGE), 3
    )


def _detectable(source_lang: str, target_lang: str) -> bool:
    src_iso = V.LANGUAGE_ISO.get(source_lang)
    return bool(src_iso) and src_iso != V.LANGUAGE_ISO.get(target_lang)


def _untranslated(source_lang: str) -> tuple[Column, Column]:
    """Is the text left as it was? And if not: is it worth asking for its language?"""
    if source_lang in V.CJK_LANGUAGES:
        left_as_is = T.has_cjk("original_text")
    else:
        words = T.letter_words("original_text")
        closed = T.rstrip("original_text").rlike(r"[.!?]\z") & (words >= 4)
        left_as_is = (words >= 3) & (T.has_function_word("src_n") | closed)
    # the cheap equality comes first; patterns only run on the rows it leaves
    same = F.col("src_n") == F.col("tgt_n")
    return same & T.has_letters("original_text") & left_as_is, ~same & (F.length("tgt_n") >= 12) & T.has_letters("original_text")


def _left(flags: DataFrame, source_lang: str, detected: DataFrame) -> DataFrame:
    """Positions left in the source language, of rows with ``unchanged`` and ``doubtful``."""
    foreign = detected.filter(F.col("code") == V.LANGUAGE_ISO[source_lang]).select("deck_id", "idx")
    doubted = flags.filter("doubtful").select("deck_id", "idx").join(foreign, ["deck_id", "idx"], "left_semi")
    return flags.filter("unchanged").select("deck_id", "idx").unionByName(doubted)


def check_overflow(bitext: DataFrame, budgets: DataFrame) -> DataFrame:
    """Target longer than the box budget (``deck_id, idx, budget``; null budget is unlimited)."""
    rows = bitext.join(
        budgets.filter("budget is not null").select("deck_id", "idx", "budget"), ["deck_id", "idx"]
    ).filter(F.length("target") > F.col("budget"))
    return _finding(
        rows, "fit.overflow", "major",
        F.format_string(V.OVERFLOW_MESSAGE, F.length("target"), F.col("budget")), 4,
    )


def check_length_limit(bitext: DataFrame, pct: int) -> DataFrame:
    """Target longer than ``pct`` percent of its source; notes are free."""
    limit = T.char_limit("original_text", pct)
    rows = bitext.withColumn("__limit", limit).filter(
        ~F.col("is_note") & (F.length("target") > F.col("__limit"))
    )
    return _finding(
        rows, "fit.length_limit", "major",
        F.format_string(V.LENGTH_LIMIT_MESSAGE, F.length("target"), F.col("__limit"), F.lit(pct)), 5,
    )


def check_style_mapping(bitext: DataFrame, style_status: DataFrame, dismissals: DataFrame | None = None) -> DataFrame:
    """Emphasis lost or only partly kept, unless a reviewer dismissed it."""
    lost = style_status.filter(F.col("status").isin("dropped", "partial")).select("deck_id", "idx")
    rows = bitext.join(lost, ["deck_id", "idx"], "left_semi")
    if dismissals is not None:
        muted = dismissals.filter(F.col("type") == "style.mapping_dropped").select("deck_id", "idx")
        rows = rows.join(muted, ["deck_id", "idx"], "left_anti")
    return _finding(rows, "style.mapping_dropped", "minor", F.lit(V.STYLE_MESSAGE), 6)


def findings_union(*findings: DataFrame) -> DataFrame:
    out = findings[0]
    for more in findings[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def assign_ordinals(findings: DataFrame) -> DataFrame:
    """Number the findings of each deck 1..N in reporting order, without a deck-wide window.

    Findings are exchanged once, by ranges of their places (``check_rank``, ``k1``). Only those of divergence, which all
    stand at the place of their text's first segment, get places of their own before.
    """
    shared, ties = F.col("check_rank") == _DIVERGENCE_RANK, [F.col("k3"), F.col("idx"), F.col("type")]
    apart = position2(findings.filter(shared), ["deck_id"], "k1", "k2", "__place", tie=ties)
    placed = findings.filter(~shared).withColumn("__place", F.col("k1")).unionByName(apart)
    placed = placed.withColumn("__place", F.col("check_rank") * F.lit(1 << 40) + F.col("__place"))
    one = {"ordinal": ("sum", F.lit(1).cast("long"))}
    return running(placed, ["deck_id"], "__place", one, tie=[F.col("k2"), *ties], bits=12).drop("__place")


def run_sweep(
    bitext: DataFrame,
    glossary: DataFrame | None = None,
    locked: DataFrame | None = None,
    *,
    source_lang: str = "",
    target_lang: str = "",
    detected: DataFrame | None = None,
    fit: DataFrame | None = None,
) -> DataFrame:
    """All checks of a deck, numbered. Findings are not merged with one another."""
    notes, others = _noted(bitext, glossary, locked, source_lang, target_lang, detected, fit)
    return _told(assign_ordinals(notes), bitext, others)


def sweep_notes(
    bitext: DataFrame,
    glossary: DataFrame | None = None,
    locked: DataFrame | None = None,
    *,
    source_lang: str = "",
    target_lang: str = "",
    detected: DataFrame | None = None,
) -> DataFrame:
    """The findings of ``run_sweep``, each with position, keys, type, severity, fix and term, but without texts, places and numbers.

    For callers that count findings, or number them with ``assign_ordinals``, and need no text of theirs: none moves.
    """
    return _noted(bitext, glossary, locked, source_lang, target_lang, detected, None)[0].drop("description", "related_location")


def _noted(
    bitext: DataFrame, glossary: DataFrame | None, locked: DataFrame | None, source_lang: str, target_lang: str,
    detected: DataFrame | None, fit: DataFrame | None,
) -> tuple[DataFrame, DataFrame]:
    """Findings by position, and the positions of divergence with their anchors."""
    lists = []
    if glossary is not None:
        lists.append(_TermList("src_n", "tgt_n", cut(_glossary_terms(glossary))))
    if locked is not None:
        lists.append(_TermList("tgt_n", "target", cut(_locked_terms(locked))))
    carried = [A.carried(x.terms) for x in lists]
    # one pass over the texts leaves positions, digests and numbers of terms; a glossary beyond the bound needs the forms once more
    rows = with_norms(bitext)
    if any(c is None for c in carried):
        rows = cut(rows)
    spark, both = bitext.sparkSession, ~T.is_blank("original_text") & ~T.is_blank("target")
    broken = [
        A.held(A.share(spark, [(r["n"], r["other"]) for r in c]), F.when(both, F.col(x.text)), F.col(x.other)).alias(f"t{i}")
        for i, (x, c) in enumerate(zip(lists, carried)) if c is not None
    ]
    unchanged, doubtful = (both & flag for flag in _untranslated(source_lang))
    seen = cut(rows.select("deck_id", "idx", *_forms(), unchanged.alias("unchanged"), doubtful.alias("doubtful"), *broken))
    notes = []
    for i, (x, c) in enumerate(zip(lists, carried)):
        if c is None:
            found = in_packs(_spoken(rows), x.text, x.terms, ["pos", "description", "fix", "term"], ("other", x.other))
        else:
            found = seen.select("deck_id", "idx", F.explode(f"t{i}").alias("__no")).join(F.broadcast(_numbered(spark, c, x.terms)), "__no")
        notes.append(_note(found, "terminology.violation", "major", F.col("__t.description"), 1, fix="__t.fix", term="__t.term", k3="__t.pos"))
    others = _divergent(seen.select("deck_id", "idx", "src", "tgt", "spoken"))
    notes.append(_note(others, "consistency.phrase", "major", None, _DIVERGENCE_RANK, k1="group_idx", k2="idx"))
    if detected is not None and _detectable(source_lang, target_lang):
        left = _left(seen, source_lang, detected)
    else:
        left = seen.filter("unchanged")
    notes.append(_note(left, "accuracy.omission", "critical", F.lit(V.UNTRANSLATED_MESSAGE), 3))
    if fit is not None:
        notes.append(fit.select(*FINDING_COLUMNS))
    return findings_union(*notes), others


class _TermList(NamedTuple):
    """Terms (``n`` to be found in column ``text``, ``other`` then missed in column ``other``) and what a finding of each says."""

    text: str
    other: str
    terms: DataFrame


def _glossary_terms(glossary: DataFrame) -> DataFrame:
    return _prepared_terms(glossary).select(
        "n", F.col("tn").alias("other"), "pos", F.format_string(V.TERM_MESSAGE, F.col("source"), F.col("target")).alias("description"),
        F.col("target").alias("fix"), F.col("source").alias("term"),
    )


def _locked_terms(locked: DataFrame) -> DataFrame:
    return _prepared_locked(locked).select(
        "n", F.col("target").alias("other"), (F.col("pos") + F.lit(_AFTER_GLOSSARY)).alias("pos"),
        F.format_string(V.LOCKED_MESSAGE, F.col("source"), F.col("target")).alias("description"),
        F.col("target").alias("fix"), F.lit(None).cast("string").alias("term"),
    )


def _note(
    df: DataFrame, kind: str, severity: str, description: Column | None, rank: int, *,
    fix: str | None = None, term: str | None = None, k1="idx", k2=None, k3=None,
) -> DataFrame:
    """A finding without the texts of its segment, which ``_told`` adds."""
    def key(c) -> Column:
        return (F.lit(0) if c is None else F.col(c)).cast("long")

    none = F.lit(None).cast("string")
    return df.select(
        "deck_id", "idx", F.lit(kind).alias("type"), F.lit(severity).alias("severity"), (none if description is None else description).alias("description"),
        (none if fix is None else F.col(fix)).alias("suggested_fix"), (none if term is None else F.col(term)).alias("term_source"),
        _no_location().alias("related_location"), F.lit(rank).alias("check_rank"), key(k1).alias("k1"), key(k2).alias("k2"), key(k3).alias("k3"),
    )


def _told(notes: DataFrame, bitext: DataFrame, others: DataFrame) -> DataFrame:
    """Findings of notes: each text moves once, however many findings it has. Findings that came with their texts keep them."""
    texts = bitext.select("deck_id", "idx", "slide_index", "shape_index", "paragraph_index", "original_text", "target")
    anchors = _anchored(others, bitext).select("deck_id", "idx", F.col("__anchor").alias("__at"), "__said")
    told = notes.join(texts, ["deck_id", "idx"], "left").join(anchors, ["deck_id", "idx"], "left").withColumn(
        "__anchor", F.when(F.col("check_rank") == _DIVERGENCE_RANK, F.col("__at"))
    )
    place, words = _location(), F.struct(F.col("original_text").alias("source"), F.col("target").alias("output"))
    described = F.coalesce("description", F.when(F.col("__anchor").isNotNull(), _divergence_message()))
    if "segment" in notes.columns:
        place, words = F.coalesce("location", place), F.coalesce("segment", words)
    return told.withColumns({
        "description": described, "location": place, "segment": words, "related_location": F.coalesce("__anchor", "related_location"),
    }).select(*FINDING_COLUMNS, "ordinal")
