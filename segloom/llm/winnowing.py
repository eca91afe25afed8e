"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines with a word, trimmed. Every ``window`` consecutive lines select their least
line hash (the last one on ties) as fingerprint, so two equal windows always share one at the same place. A line of ``long_line`` words or more, and
the only line of a text, is a fingerprint of its own, whatever its neighbours are. Fingerprints seen once in the corpus end there; around the others, positions are joined by fingerprint and window to the earliest
place of the same lines, and a match extends both ways over all neighbouring windows that match as well. Lines inside
later matches go.

All steps are aggregations and joins on hashes: the earliest place is a partial aggregate, so a run that a third
of the documents shares costs one row per place, never a pair per two places.

Earlier means a smaller doc_id (null last), then a smaller row key, then an earlier line. Defined results: null and blank
texts have no lines and stay as they are; lines without a word stay; equal rows get equal results and do not delete
each other; an empty table gives no rows; other columns pass through, but for an ``n_removed`` of the caller, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.llm.tables import cut, row_key

WINDOW = 2
LONG_LINE = 20
_BLANK = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
LAST = 2**63 - 1


def line_hashes(text: Column) -> Column:
    """``(i, h, n)`` of every line with a word: its index among all lines, the hash of its trimmed text, and its words."""
    numbered = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("i"), F.btrim(line, F.lit(_BLANK)).alias("t")))
    return F.transform(
        F.filter(numbered, lambda x: F.length(x["t"]) > 0), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["t"]).alias("h"), F.regexp_count(x["t"], F.lit(WORD)).alias("n"))
    )


def windows(lines: Column, window: int, long_line: int) -> Column:
    """``(s, size, fp, w)`` of every window and every line that stands for itself: first line, lines, fingerprint, and the hash of all its lines."""

    def one(s: Column) -> Column:
        part = F.transform(F.slice(lines, s + 1, window), lambda x: x["h"])
        return F.struct(
            s.alias("s"), F.lit(window).alias("size"), F.array_min(part).alias("fp"),
            F.aggregate(part, F.lit(window).cast("long"), lambda seed, h: F.xxhash64(seed, h)).alias("w"),
        )

    def alone(x: Column, s: Column) -> Column:
        return F.when((x["n"] >= long_line) | (F.size(lines) == 1), F.struct(
            s.alias("s"), F.lit(1).alias("size"), F.xxhash64(F.lit("line"), x["h"]).alias("fp"), x["h"].alias("w")
        ))

    many = F.when(
        F.size(lines) >= window, F.transform(F.sequence(F.lit(0), F.size(lines) - window), one)
    ).otherwise(F.array().cast("array<struct<s:int,size:int,fp:bigint,w:bigint>>"))
    return F.concat(many, F.filter(F.transform(lines, alone), lambda x: x.isNotNull()))


def later_runs(
    docs: DataFrame, *, window: int = WINDOW, long_line: int = LONG_LINE, text: str = "text", doc: str = "doc_id"
) -> DataFrame:
    """``doc_id, key, lines``: indexes of the lines of later repeated runs, for rows that have any."""
    lined = cut(docs.select(F.col(doc).cast("long").alias("doc_id"), row_key(docs).alias("key"), line_hashes(F.col(text)).alias("lines")))
    placed = cut(lined.select("doc_id", "key", F.explode(windows(F.col("lines"), window, long_line)).alias("x")).select(
        F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("key").alias("k"), F.col("x.s").alias("s")).alias("at"), "x.size", "x.fp", "x.w"
    ))
    often = placed.groupBy("fp").agg(F.min("at").alias("a"), F.max("at").alias("b")).filter("a < b").select("fp")
    first = placed.join(often, "fp", "left_semi").groupBy("fp", "w").agg(F.min("at").alias("a"), F.max("at").alias("b")).filter("a < b")
    hits = placed.join(first.select("fp", "w", "a"), ["fp", "w"]).filter("at > a")
    runs = cut(hits.groupBy(F.col("at.d").alias("d"), F.col("at.k").alias("k")).agg(F.collect_set(F.struct("at.s", "size")).alias("starts")))
    extended = F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x["s"], x["s"] + x["size"] - 1))))
    joined = lined.dropDuplicates(["doc_id", "key"]).join(
        runs, (F.col("key") == F.col("k")) & (F.coalesce("doc_id", F.lit(LAST)) == F.col("d"))
    )
    return joined.select("doc_id", "key", F.transform(extended, lambda j: F.get("lines", j)["i"]).alias("lines"))


def dedup_lines(
    docs: DataFrame, *, window: int = WINDOW, long_line: int = LONG_LINE, text: str = "text", doc: str = "doc_id"
) -> DataFrame:
    """``docs`` with later repeated runs of ``window`` or more lines, long lines and only lines taken out of the text, and ``n_removed``
    (which replaces a column of that name)."""
    gone = cut(later_runs(docs, window=window, long_line=long_line, text=text, doc=doc)).select(
        F.col("doc_id").alias("__d"), F.col("key").alias("__k"), F.col("lines").alias("__gone")
    )
    joined = docs.withColumn("__key", row_key(docs)).join(  # what goes grows with the corpus: never broadcast
        gone.hint("merge"), (F.col("__key") == F.col("__k")) & F.col(doc).eqNullSafe(F.col("__d")), "left"
    )
    kept = F.array_join(F.transform(
        F.filter(
            F.transform(F.split(text, "\n"), lambda line, i: F.struct(line.alias("t"), i.alias("i"))),
            lambda x: ~F.array_contains(F.col("__gone"), x["i"]),
        ), lambda x: x["t"],
    ), "\n")
    return joined.withColumns({
        text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept), "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
    }).drop("__key", "__d", "__k", "__gone")
