"""Finding and substituting glossary terms with word boundaries, longest first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.operators import automaton as A
from segloom.operators import parcels as P
from segloom.plans.cut import cut

_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"


def _tokens(text) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def term_table(glossary: DataFrame) -> DataFrame:
    """One row per term: ``key`` (casefolded text), its ``tokens``, ``head`` (the first, casefolded), ``k`` of them, ``target`` of its last entry.

    Equal entries are brought together first, so only distinct ones are folded and cut into tokens.
    """
    entries = glossary.filter("source <> ''").groupBy("source", "target").agg(F.max("pos").alias("pos"))
    terms = entries.groupBy(P.fold_word(F.col("source")).alias("key")).agg(F.min("source").alias("source"), F.max_by("target", "pos").alias("target"))
    return terms.withColumn("tokens", _tokens(F.col("source"))).select(
        "key", T.fold(F.get("tokens", F.lit(0))).alias("head"), "tokens", F.size("tokens").alias("k"), "target"
    )


def _shared(terms: DataFrame) -> A.Shared | None:
    rows = A.carried(terms.select("key", "target", "tokens"))
    if rows is None:
        return None
    return A.share(terms.sparkSession, [(tuple(t.casefold() for t in r.tokens), r.key, r.target) for r in rows])


def _ngrams(segments: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """Every place of every term, overlaps included: ``deck_id, idx, start, stop, surface, key, target``.

    Tokens are words or single other characters, so equal token runs are exactly the matches that
    respect word boundaries. Narrow rows of single tokens meet the first tokens of terms; only at the places this leaves
    are runs cut out, for the lengths of the terms that begin so, and looked up by an equi-join. No row holds more
    than one text, and nothing but a term table is ever small enough to be broadcast.
    """
    heads = cut(terms.groupBy("head").agg(F.collect_set("k").alias("ks")))
    single = segments.select("deck_id", "idx", F.posexplode(_tokens(F.col(text))).alias("start", "__w"))
    near = single.withColumn("head", T.fold("__w")).join(heads, "head").groupBy("deck_id", "idx").agg(
        F.collect_list(F.struct("start", "ks")).alias("__s")
    )
    cut_up = segments.select("deck_id", "idx", F.col(text).alias("__x")).join(near.hint("merge"), ["deck_id", "idx"]).withColumn(
        "__t", _tokens(F.col("__x"))  # texts are exchanged, not their tokens
    )
    spans = F.flatten(F.transform("__s", lambda s: F.transform(s["ks"], lambda k: F.struct(
        s["start"].alias("start"), (s["start"] + k).alias("stop"), F.array_join(F.slice("__t", s["start"] + 1, k), "").alias("surface")
    ))))
    runs = cut_up.select("deck_id", "idx", F.size("__t").alias("__n"), F.inline(spans)).filter("stop <= __n").drop("__n")
    return runs.withColumn("key", T.fold("surface")).join(terms.select("key", "target"), "key")


def _settled(candidates: DataFrame) -> DataFrame:
    """Matches of each segment without overlaps, leftmost then longest: ``deck_id, idx, m`` (array in reading order)."""
    listed = candidates.groupBy("deck_id", "idx").agg(F.array_sort(F.collect_list(
        F.struct("start", (-F.col("stop")).alias("neg"), *_MATCH[1:])
    )).alias("c"))
    kept = F.aggregate(
        "c", F.struct(F.lit(0).alias("free"), F.slice("c", 1, F.lit(0)).alias("m")),
        lambda s, x: F.when(
            x["start"] >= s["free"], F.struct(x["stop"].alias("free"), F.concat(s["m"], F.array(x)).alias("m"))
        ).otherwise(s),
    )["m"]
    plain = F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in _MATCH]))
    return listed.select("deck_id", "idx", plain.alias("m"))


_MATCH = ("start", "stop", "surface", "key", "target")


def _folded(terms: DataFrame) -> DataFrame:
    """A written term table as ``parcels.in_parcels`` reads it."""
    return terms.select(F.transform("tokens", P.fold_word).alias("tokens"), "target")


def _in_parcels(segments: DataFrame, terms: DataFrame, text: str, said, more: str) -> DataFrame:
    """``said(stretch, settled places)`` gives the rows of each stretch, with the number of their segment before the columns ``more``."""
    def work(stretch: P.Stretch) -> pa.Table:
        row, columns = said(stretch, stretch.places(0).settled())
        return pa.table({**{c: stretch.rest[c].take(pa.array(row)) for c in ("deck_id", "idx")}, **columns})

    keys = ", ".join(f"{c} {segments.schema[c].dataType.simpleString()}" for c in ("deck_id", "idx"))
    return P.in_parcels(segments.select("deck_id", "idx", text), [text], _folded(terms), work, f"{keys}, {more}")


def _said_places(stretch: P.Stretch, p: A.Places) -> tuple:
    ids, surfaces = stretch.surfaces(p)
    at = np.arange(len(p.row)) - np.searchsorted(p.row, p.row)
    return p.row, {
        "mpos": pa.array(at, pa.int32()), "surface": surfaces.take(pa.array(ids)), "target": stretch.targets.take(pa.array(p.term)),
    }


def _said_counts(stretch: P.Stretch, p: A.Places) -> tuple:
    ids, surfaces = stretch.surfaces(p)
    size = max(len(surfaces), 1)
    # a surface has one term, so it stands for its target
    named, first, n = np.unique(p.row * size + ids, return_index=True, return_counts=True)
    return named // size, {
        "surface": surfaces.take(pa.array(named % size)), "target": stretch.targets.take(pa.array(p.term[first])), "n": pa.array(n, pa.int64()),
    }


def match_positions(segments: DataFrame, glossary: DataFrame, text: str = "original_text") -> DataFrame:
    """Every match in reading order: ``deck_id, idx, mpos, surface, target``.

    By automaton if the glossary can be carried, else parcel by parcel.
    """
    terms = cut(term_table(glossary))
    shared = _shared(terms)
    if shared is None:
        return _in_parcels(segments, terms, text, _said_places, "mpos int, surface string, target string")
    return _listed(segments.select("deck_id", "idx", A.token_places(shared, _tokens(F.col(text))).alias("m")))


def _listed(places: DataFrame) -> DataFrame:
    return places.select("deck_id", "idx", F.posexplode("m").alias("mpos", "x")).select(
        "deck_id", "idx", "mpos", "x.surface", "x.target"
    )


def _counted(positions: DataFrame) -> DataFrame:
    return positions.groupBy("deck_id", "idx", "surface", "target").agg(F.count(F.lit(1)).alias("n"))


def glossary_match(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """Terms per segment as written there: ``deck_id, idx, surface, target, n``."""
    terms = cut(term_table(glossary))
    shared = _shared(terms)
    if shared is None:
        return _in_parcels(segments, terms, "original_text", _said_counts, "surface string, target string, n long")
    return _counted(_listed(segments.select("deck_id", "idx", A.token_places(shared, _tokens(F.col("original_text"))).alias("m"))))


def glossary_match_ngram(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """As ``glossary_match``, by the n-gram join whatever the size of the glossary."""
    return _counted(_listed(_settled(_ngrams(segments, cut(term_table(glossary)), "original_text"))))


def _woven(text: str) -> Column:
    """``text`` with the places in ``__m`` replaced by their targets."""
    part = lambda t, first, stop: F.array_join(F.slice(t, first + 1, stop - first), "")
    woven = T.let(F.struct(_tokens(F.col(text)).alias("t"), F.col("__m").alias("m")), lambda v: F.aggregate(
        v["m"], F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            x["stop"].alias("at"),
            F.concat(s["out"], part(v["t"], s["at"], x["start"]), F.coalesce(x["target"], x["surface"])).alias("out"),
        ),
        lambda s: F.concat(s["out"], part(v["t"], s["at"], F.size(v["t"]))),
    ))
    return F.when(F.coalesce(F.size("__m"), F.lit(0)) <= 0, F.col(text)).otherwise(woven)


def _rewritten(rows: DataFrame, terms: DataFrame, texts: list[str], weave, new: str) -> DataFrame:
    """``rows`` with the column ``new``, woven stretch by stretch."""
    columns = list(dict.fromkeys([*rows.columns, new]))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {new: "string"}

    def work(stretch: P.Stretch) -> pa.Table:
        given = {t: stretch.woven(i) for i, t in enumerate(texts) if t != new} | {new: weave(stretch)}
        return pa.table({c: given[c] if c in given else stretch.rest[c] for c in columns})

    return P.in_parcels(rows, texts, _folded(terms), work, ", ".join(f"`{c}` {kinds[c]}" for c in columns))


def apply_glossary(segments: DataFrame, glossary: DataFrame, text: str = "original_text") -> DataFrame:
    """Replace every matched term by its target, literally and in one pass."""
    terms = cut(term_table(glossary))
    shared = _shared(terms)
    if shared is None:
        return _rewritten(segments, terms, [text], lambda s: s.woven(0, s.places(0).settled()), "prepared_text")
    found = segments.withColumn("__m", A.token_places(shared, _tokens(F.col(text))))
    return found.withColumn("prepared_text", _woven(text)).drop("__m")


def enforce_glossary(bitext: DataFrame, glossary: DataFrame) -> DataFrame:
    """Apply to each target only the terms its own source contains.

    Opposite-direction entries then cannot undo one another. Rows without a match keep their target.
    """
    terms = cut(term_table(glossary))
    shared = _shared(terms)
    if shared is None:
        both = ["original_text", "target"]
        return _rewritten(bitext, terms, both, lambda s: s.woven(1, s.places(1).settled(s.places(0).settled())), "target")
    sides = [_tokens(F.col(c)) for c in ("original_text", "target")]
    found = bitext.withColumn("__m", A.own_places(shared, *sides))
    return found.withColumn("target", _woven("target")).select(*bitext.columns)


def batch_glossary(batched: DataFrame, glossary: DataFrame) -> DataFrame:
    """Terms found in the original texts of each batch, as ``- s => t`` lines or ``None``."""
    positions = match_positions(batched, glossary)
    home = batched.select("deck_id", "idx", "batch_no")
    first = positions.join(home, ["deck_id", "idx"]).groupBy("deck_id", "batch_no", "surface", "target").agg(
        F.min(F.struct("idx", "mpos")).alias("at")
    )
    line = F.concat(F.lit("- "), "surface", F.lit(" => "), "target")
    listed = first.groupBy("deck_id", "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("l")
    )
    return home.select("deck_id", "batch_no").distinct().join(listed, ["deck_id", "batch_no"], "left").select(
        "deck_id", "batch_no", F.coalesce(F.array_join("l.line", "\n"), F.lit("None")).alias("terms")
    )


def term_usage(matches: DataFrame, *, approx: bool = False) -> DataFrame:
    """Occurrences of each term and over how many segments and decks they spread."""
    place = F.struct("deck_id", "idx")
    aggs = [
        F.sum("n").alias("occurrences"),
        F.count_distinct(place).alias("segments"),
        F.count_distinct("deck_id").alias("decks"),
    ]
    if approx:
        aggs.append(F.approx_count_distinct(F.xxhash64("deck_id", "idx")).alias("segments_approx"))
    return matches.groupBy(F.lower("surface").alias("term"), "target").agg(*aggs)


SKETCH_BITS = 14


def usage_sketches(matches: DataFrame) -> DataFrame:
    """Per term and deck (a run): occurrences, and a sketch of the segments they are in. Sketches are stored and merged, never recounted."""
    return matches.groupBy(F.lower("surface").alias("term"), "target", "deck_id").agg(
        F.sum("n").alias("occurrences"), F.hll_sketch_agg(F.xxhash64("deck_id", "idx"), SKETCH_BITS).alias("segments")
    )


def merged_usage(sketches: DataFrame) -> DataFrame:
    """Usage at every level: term and target, term, all (nulls mark totals), from stored sketches alone."""
    return sketches.rollup("term", "target").agg(
        F.sum("occurrences").alias("occurrences"), F.hll_union_agg("segments").alias("segments"), F.count_distinct("deck_id").alias("decks"),
        F.grouping_id().alias("level"),
    ).withColumn("segments", F.hll_sketch_estimate("segments"))
