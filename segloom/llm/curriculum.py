"""Mixing sources to target weights along a time-varying curriculum.

Sources share a word budget by weight; none may take more than ``cap`` times its own words, and what it
cannot take is shared by the others (in one pass over the sources, ordered by how soon each fills up).
A source reads its documents in a fixed pseudo-random order, again from the start when it needs more,
until its target is reached. Its weight over training time is a polyline; the integral of the polyline is
the source's cumulative demand, and inverting it turns "words taken so far" into a training position.

Defined results: a null text has no words and takes none; null is a source of its own, last in order;
a null doc_id keeps its row (order: by text among such rows); rows equal in doc_id and text share a place in
the order, in either sequence; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm.tables import cut, row_key
from segloom.plans.ordering import running

WEIGHTS = (5, 2, 1)
#: Weight of a source at equal steps of training time, by the source's place in order.
SCHEDULES = ((1.0, 1.0), (0.5, 1.0, 2.0), (2.0, 1.0, 0.5))
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(place: Column, values: tuple) -> Column:
    chosen = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        chosen = F.when(place % len(values) == i, F.lit(v)).otherwise(chosen)
    return chosen


def targets(per_source: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, cap: int = 2) -> DataFrame:
    """``source, source_size`` with ``place``, ``weight`` and ``target``.

    A source fills up first when its cap per weight is smallest, so in that order each source is full
    exactly when an equal share of what is left would overfill it. There is one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = per_source.withColumn(
        "place", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
    ).withColumn("weight", _cycle(F.col("place"), weights).cast("long"))
    by_fill = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    shared = ranked.withColumns({
        "total": F.sum("source_size").over(everything),
        "held": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "open": F.sum("weight").over(after),
    })
    level = (F.lit(percent) * F.col("total") - F.lit(100 * cap) * F.col("held")).cast("double") / (F.lit(100) * F.col("open"))
    full = shared.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") > cap * F.col("source_size"))
    final = full.withColumn("level", F.min(F.when(~F.col("full"), F.struct("held", "level"))).over(everything)["level"])
    return final.select(
        "source", "source_size", "place", "weight",
        F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"),
    )


def position(share: Column, schedule: tuple[float, ...]) -> Column:
    """Training time (0 to 1) at which a source with this schedule has met ``share`` of its demand."""
    steps = len(schedule) - 1
    areas = [(schedule[i] + schedule[i + 1]) / 2 / steps for i in range(steps)]
    whole, done, found = sum(areas), 0.0, None
    pieces = []
    for i, area in enumerate(areas):
        a, slope = schedule[i], (schedule[i + 1] - schedule[i]) * steps
        need = share * F.lit(whole) - F.lit(done)
        if slope == 0:
            inside = need / F.lit(a)
        else:
            inside = (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * need, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
        done += area
        pieces.append((done / whole, F.lit(i / steps) + inside))
    for limit, value in reversed(pieces):
        found = value if found is None else F.when(share <= F.lit(limit), value).otherwise(found)
    return F.when(share.isNotNull(), found)


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, cap: int = 2,
    schedules: tuple = SCHEDULES, text: str = "text", doc: str = "doc_id", source: str = "source", seed: str = "mix",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, positions, key, source`` for every row.

    ``positions`` has the training time of the first word of each reading, null for a reading that takes nothing;
    ``key`` is the row's.
    """
    sized = cut(docs.select(
        F.col(doc).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
        row_key(docs).alias("key"),
        F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc).cast("string"), F.md5(text), F.lit("")))), 1, 15), 16, 10)
        .cast("long").alias("__order"),
    ))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    shares = cut(targets(per_source.drop("__rows"), weights=weights, percent=percent, cap=cap))
    with_target = sized.join(shares, sized["source"].eqNullSafe(shares["source"])).drop(shares["source"])
    bits = max(0, 60 - max(0, (sized.count() >> 11).bit_length()))  # about 2048 rows in a range of the order
    ordered = running(
        with_target, ["place"], "__order", {"__through": ("sum", F.col("size"))},
        tie=[F.col("doc_id"), F.col("size"), F.col("key")], bits=bits,
    )
    start = F.col("__through") - F.col("size")
    readings = []
    for again in range(cap):
        readings.append(F.greatest(F.lit(0).cast("long"), F.least(
            F.col("size"), F.floor("target") - again * F.col("source_size") - start
        )))
    asked = [
        F.when(readings[i] > 0, (start + i * F.col("source_size")).cast("double") / F.col("target")) for i in range(cap)
    ]

    def timed(share: Column) -> Column:
        out = position(share, schedules[-1])
        for i, s in reversed(list(enumerate(schedules[:-1]))):
            out = F.when(F.col("place") % len(schedules) == i, position(share, s)).otherwise(out)
        return out

    return ordered.select(
        "doc_id", "size", "source_size", "target", sum(readings[1:], readings[0]).cast("long").alias("taken"),
        F.array(*map(timed, asked)).alias("positions"), "key", "source",
    )


def training_order(docs: DataFrame, *, doc: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` as the mix reads them: once per reading of at least one word, range-sorted by position."""
    mixed = mix(docs, doc=doc, **options)
    readings = mixed.filter("taken > 0").select(
        F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), F.explode("positions").alias("__at"),
    ).filter("__at is not null").distinct()
    keyed = docs.withColumn("__own", row_key(docs))
    return keyed.join(
        readings, (F.col("__own") == F.col("__key")) & F.col(doc).eqNullSafe(F.col("__doc"))
    ).orderBy("__at", doc).select(*[F.col(f"`{c}`") for c in docs.columns])
