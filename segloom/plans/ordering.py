"""Running values over huge ordered groups without one task per group.

A deck may hold a third of all rows, so ``sum() over (partition by deck order by idx)``
would put it into one task. ``running`` cuts the order key into fixed ranges instead:

* each range of ``2**bits`` keys is scanned by a window of its own,
* the range totals, ``2**bits`` times fewer, are scanned per group (in as many such levels as
  asked for), and
* what precedes a range is joined back to its rows.

With the default of one level a group of 10**11 rows needs a top scan of six million small rows.
Nothing is sampled, so a retried or re-planned stage gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.plans.skew import attach

BITS = 14
_IDENTITY = {"sum": 0, "min": None, "max": None}
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(op: str, a: Column, b: Column) -> Column:
    if op == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return (F.least if op == "min" else F.greatest)(a, b)  # both skip nulls


def running(
    df: DataFrame,
    group: list[str],
    key: str,
    measures: dict[str, tuple[str, Column]],
    *,
    exclusive: bool = False,
    reverse: bool = False,
    tie: list[Column] | None = None,
    bits: int = BITS,
    levels: int = 1,
) -> DataFrame:
    """Add ``{out: op(column)}`` accumulated along ``key`` inside ``group``.

    ``key`` is an integer column. ``op`` is sum, min or max. Rows sharing a key are ordered
    by ``tie`` (which must then make the order total). ``exclusive`` leaves the row itself out,
    ``reverse`` accumulates from the largest key down.
    """
    chunk = f"__chunk{levels}"
    tie = tie or []
    ordering = [F.col(key).desc() if reverse else F.col(key).asc(), *tie]
    frame = Window.partitionBy(*group, chunk).orderBy(*ordering).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else Window.currentRow
    )
    cut = df.withColumn(chunk, F.shiftright(F.col(key).cast("long"), bits))
    local = cut.withColumns({f"__l_{out}": _AGG[op](col).over(frame) for out, (op, col) in measures.items()})
    totals = cut.groupBy(*group, chunk).agg(
        *[_AGG[op](col).alias(f"__t_{out}") for out, (op, col) in measures.items()]
    )
    upper = {f"__c_{out}": (op, F.col(f"__t_{out}")) for out, (op, _) in measures.items()}
    if levels > 1:
        carry = running(
            totals, group, chunk, upper, exclusive=True, reverse=reverse, bits=bits, levels=levels - 1
        )
    else:
        top = Window.partitionBy(*group).orderBy(
            F.col(chunk).desc() if reverse else F.col(chunk).asc()
        ).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.withColumns({out: _AGG[op](col).over(top) for out, (op, col) in upper.items()})
    carry = carry.select(*group, chunk, *upper)
    joined = local.join(carry, [*group, chunk])
    done = joined.withColumns({
        out: _combine(op, F.col(f"__c_{out}"), F.col(f"__l_{out}")) for out, (op, _) in measures.items()
    })
    return done.select(*df.columns, *measures)


def position(df: DataFrame, group: list[str], key: str, out: str, *, tie=None, start: int = 0) -> DataFrame:
    """Dense 0-based (or ``start``-based) position along ``key`` inside ``group``."""
    ranked = running(df, group, key, {out: ("sum", F.lit(1).cast("long"))}, tie=tie)
    return ranked.withColumn(out, (F.col(out) + (start - 1)).cast("long"))


def position2(
    df: DataFrame, group: list[str], major: str, minor: str, out: str, *, tie=None, start: int = 0
) -> DataFrame:
    """Dense position along ``(major, minor)``; neither level needs a whole group in one task."""
    per_major = df.groupBy(*group, major).agg(F.count(F.lit(1)).alias("__n"))
    before = running(per_major, group, major, {"__before": ("sum", F.col("__n"))}, exclusive=True)
    inner = running(df, [*group, major], minor, {"__inner": ("sum", F.lit(1).cast("long"))}, tie=tie)
    return (
        attach(
            inner, before.select(*group, major, "__before", "__n"), [*group, major], "__n", spread=[minor]
        )
        .withColumn(out, (F.col("__before") + F.col("__inner") + (start - 1)).cast("long"))
        .select(*df.columns, out)
    )


def neighbours(df: DataFrame, group: list[str], key: str, reach: int, bits: int = BITS) -> tuple[DataFrame, Window]:
    """Rows copied into the ranges within ``reach`` keys of them, plus the per-range window.

    Use it for frames such as "two rows before and after": compute over the returned window,
    then keep rows whose ``__home`` is true. ``key`` must be dense (0..n-1).
    """
    k = F.col(key).cast("long")
    home = F.shiftright(k, bits)
    ranges = F.array_distinct(F.array(
        home, F.shiftright(F.greatest(k - reach, F.lit(0)), bits), F.shiftright(k + reach, bits)
    ))
    out = df.withColumn("__range", F.explode(ranges)).withColumn("__home", F.col("__range") == home)
    return out, Window.partitionBy(*group, "__range").orderBy(key)
