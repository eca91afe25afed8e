"""Periodic runs of words: all maximal stretches that repeat a period three times or more.

All texts of a block form one array of word numbers, with a number of its own after each text, so that nothing repeats over
an end. A run of period q is a stretch in which words q apart are equal, and is found in one of two ways:

* periods up to ``DIRECT``: the array is compared with itself at each lag, and long stretches of equality are read off;
* longer periods, scale by scale: at the scale of periods in (2P/3, P], every stretch of P words gets its number (equal
  stretches, equal numbers, by doubling: no hash is involved), and windows over these numbers keep their smallest. In a run,
  windows one period apart hold equal content, so their minima lie exactly one period apart; and as P words are at least a period, equal
  stretches inside a run are whole periods apart, which makes the two minima neighbours among all places of that number. So
  pairs of neighbouring equal minima within P words of each other seed every run; each seed is extended word by word to both sides.

A stretch with period q at least 3q long that also has a smaller period has one that divides q, and then it is the same
stretch: of runs with the same bounds the smallest period stays.

Defined results: words are separated by white space (space, \\t \\n \\v \\f \\r); null and empty texts have no words and no run and
collapse to the empty text; rows are judged one by one, so that repeated rows and null doc_ids are nothing special;
other columns pass untouched unless they have the name of a result column (``n_words``, ``runs``, ``collapsed``), which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from segloom.functions import text as T
from segloom.llm import tokens

MIN_LENGTH = 24
MIN_PERIODS = 3
#: Periods up to this many words are scanned directly.
DIRECT = 24
BLOCK_BYTES = 2 << 20

_RESULTS = StructType([
    StructField("n_words", LongType()),
    StructField("runs", ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))),
    StructField("collapsed", StringType()),
])
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _stretch(q: int) -> int:
    """Least number of equal pairs at lag ``q`` in a run."""
    return max(MIN_LENGTH - q, (MIN_PERIODS - 1) * q)


def _direct(x: np.ndarray, q: int) -> list[tuple[int, int, int]]:
    """``start, end, q`` of all stretches with period ``q``, by comparison at that lag."""
    if len(x) <= q:
        return []
    need, held = _stretch(q), 1
    equal = run = x[:-q] == x[q:]
    while held < need and len(run):  # run[i]: ``held`` equal pairs from i on
        step = min(held, need - held)
        run = run[:-step] & run[step:] if len(run) > step else run[:0]
        held += step
    at = np.flatnonzero(run)
    if not len(at):
        return []
    gaps = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], gaps + 1])], at[np.concatenate([gaps, [len(at) - 1]])]
    return [(a, b + need + q, q) for a, b in zip(first.tolist(), last.tolist())]


def _ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of pairs: equal pairs, equal numbers."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)


def _minima(numbers: np.ndarray, width: int) -> np.ndarray:
    """Places of the leftmost smallest number of every window of ``width``."""
    n = len(numbers)
    low, held = numbers * n + np.arange(n), 1
    while held < width:
        step = min(held, width - held)
        low = np.minimum(low[:-step], low[step:])
        held += step
    at = low % n  # never falls from one window to the next
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def _equal_ahead(x: np.ndarray, i: int, j: int) -> int:
    """Words that agree from ``i`` and ``j`` on."""
    n, step = 0, 64
    while j + n < len(x):
        a, b = x[i + n : i + n + step], x[j + n : j + n + step]
        differ = np.flatnonzero(a[: len(b)] != b)
        if len(differ):
            return n + int(differ[0])
        n += len(b)
        step *= 2
    return n


def _equal_behind(x: np.ndarray, i: int, j: int) -> int:
    """Words that agree before ``i`` and ``j``."""
    n, step = 0, 64
    while i - n > 0:
        size = min(step, i - n)
        differ = np.flatnonzero(x[i - n - size : i - n] != x[j - n - size : j - n])
        if len(differ):
            return n + size - 1 - int(differ[-1])
        n += size
        step *= 2
    return n


def _scale(x: np.ndarray, numbers: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """``start, end, q`` of all stretches with a period in (low, high]; ``numbers`` of all stretches of ``high`` words."""
    width = 2 * (low + 1) - high + 1
    if len(numbers) < width + low + 1:
        return []
    at = _minima(numbers, width)
    order = np.lexsort((at, numbers[at]))
    at = at[order]
    near = (numbers[at[1:]] == numbers[at[:-1]]) & (np.diff(at) > low) & (np.diff(at) <= high)
    found, covered = [], {}
    for i, j in sorted(zip(at[:-1][near].tolist(), at[1:][near].tolist())):
        q = j - i
        if i < covered.get(q, -1):
            continue  # a word of the last stretch of this lag
        start, stop = i - _equal_behind(x, i, j), i + _equal_ahead(x, i, j)
        covered[q] = stop
        if stop - start >= _stretch(q):
            found.append((start, stop + q, q))
    return found


def find_runs(x: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, end, period`` of all runs. Texts lie one after another in ``x``, each of ``sizes`` words and an end of its own."""
    found = [r for q in range(1, DIRECT + 1) for r in _direct(x, q)]
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    # numbers of the stretches of ``held`` words; one that runs over the end of its text has a number of its own
    y, numbers, held, low = x, x, 1, DIRECT
    while True:
        long = sizes >= MIN_PERIODS * (low + 1)
        if not long.any():
            break
        if not long.all():  # only texts that can hold such a run, one after another again
            moved = np.cumsum(sizes[long] + 1) - (sizes[long] + 1)
            at = np.arange(moved[-1] + sizes[long][-1] + 1) + np.repeat((np.cumsum(sizes + 1) - (sizes + 1))[long] - moved, sizes[long] + 1)
            y, numbers, starts, sizes = y[at], numbers[at], starts[long], sizes[long]
        high = max(low + 1, low * 3 // 2)
        while held < high:
            step = min(held, high - held)
            beyond = numbers.max() + 1 + np.arange(step)
            numbers = _ranked(numbers, np.concatenate([numbers[step:], beyond])[: len(numbers)])
            held += step
        shift = starts - (np.cumsum(sizes + 1) - (sizes + 1))
        for a, b, q in _scale(y, numbers, low, high):
            move = int(shift[np.searchsorted(np.cumsum(sizes + 1), a, "right")])
            found.append((a + move, b + move, q))
        low = high
    least: dict[tuple[int, int], int] = {}
    for a, b, q in found:
        least[a, b] = min(q, least.get((a, b), q))
    return sorted((a, b, q) for (a, b), q in least.items())


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tokens.blocks(batches, text="__text", limit=BLOCK_BYTES):
        words = tokens.Words(*tokens.bytes_of(block.column("__text")), tokens.SPACED)
        sizes, n = words.counts(), block.num_rows
        codes, distinct = words.codes()
        x = np.empty(words.n + n, np.int64)
        ends = words.starts[1:] + np.arange(n)
        inside = np.ones(len(x), bool)
        inside[ends] = False
        x[inside] = codes
        x[ends] = len(distinct) + np.arange(n)  # an end of its own for each text
        runs = find_runs(x, sizes)
        row = np.searchsorted(ends, np.array([a for a, _, _ in runs], np.int64))
        begins = (words.starts[:-1] + np.arange(n))[row] if runs else []
        gone = np.zeros(len(x) + 1, np.int64)
        for a, b, q in runs:
            gone[a + q] += 1
            gone[b] -= 1
        kept = (np.cumsum(gone)[:-1] == 0)[inside]
        offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
        columns = [pa.array([a - b for (a, _, _), b in zip(runs, begins)], pa.int64()), pa.array([b - a for a, b, _ in runs], pa.int64()), pa.array([q for _, _, q in runs], pa.int64())]
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_RUN)))
        stays = np.concatenate([[0], np.cumsum(kept)])[words.starts].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(stays), words.array.filter(pa.array(kept)).cast(pa.string()))
        collapsed = pc.binary_join(lists, " ")
        yield pa.RecordBatch.from_arrays(
            [*(block.column(c) for c in block.schema.names if c != "__text"), pa.array(sizes.astype(np.int64)), listed, collapsed],
            [*(c for c in block.schema.names if c != "__text"), "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (structs of ``start, length, period`` in words, by start and period) and ``collapsed``: the words that no run
    holds after its first period, joined by one space."""
    rows = docs.drop("n_words", "runs", "collapsed")
    rows = rows.withColumn("__text", F.col(text) if isinstance(text, str) else text)
    kept = [f for f in rows.schema if f.name != "__text"]
    return rows.mapInArrow(_judged, StructType([*kept, *_RESULTS]))


def strongest(runs: Column | str) -> Column:
    """The run with the greatest exact length / period; of equal ones the first."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    return F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )


def looped(text: Column | str, doc_id: Column | str) -> Column:
    """``text`` with a planted run for one in ten documents, by the checksum of their number; nothing else changes.

    With ``h = crc32(doc_id)`` and ``g = h div 10``, where ``h mod 10`` is 0 and there are n > 0 words, each word i >= a becomes word
    a + (i-a) mod p, where a = g mod n and p = 1 + (n-a) div (3 + g mod 8). A null doc_id plants nothing.
    """
    text, doc_id = (F.col(c) if isinstance(c, str) else c for c in (text, doc_id))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def periodic(v: Column) -> Column:
        n = F.greatest(F.size(v["w"]), F.lit(1)).cast("long")
        a = v["g"] % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + v["g"] % 8))
        return T.let(F.struct(v["w"].alias("w"), a.alias("a"), p.cast("long").alias("p")), lambda u: F.array_join(F.transform(
            u["w"], lambda word, i: F.when(i >= u["a"], F.get(u["w"], (u["a"] + (i - u["a"]) % u["p"]).cast("int"))).otherwise(word)
        ), " "))

    planted = T.let(F.struct(words.alias("w"), F.floor(h / 10).cast("long").alias("g")), periodic)
    return F.when(h % 10 == 0, planted).otherwise(text)
