"""Sharding by histogram sort: exact byte counts below probe keys, refined until splitters fit.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours. For each border between
two shards the driver holds one interval of keys known to contain it. A round counts, for every
interval at once, the bytes in ``probes`` equal cells (one scan of a narrow table, one partial
aggregation, at most ``probes`` small rows per border for the driver) and keeps the cell that contains
the border. A border is settled as soon as some cell boundary is within ``tolerance`` of its target;
a text hash that is too heavy for that is cut by doc_id in the same way. Then rows are exchanged once.

Defined results: a null text has size 1 and the hash of no text; a null doc_id sorts last; rows equal in
doc_id and text cannot be told apart, so the nearest border before or after them is taken; an empty
table gives no rows; other columns pass through ``exchange`` untouched, but for a ``shard`` of the caller, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.llm.tables import cut
from segloom.plans.ordering import running

PROBES = 1024
TOLERANCE = 0.001
LAST = 2**63 - 1
KEYS = ("__k1", "__k2")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def keyed(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``docs`` with the two sort keys: 62 bits of the text's hash, and the document."""
    return docs.withColumns({
        KEYS[0]: F.shiftrightunsigned(F.xxhash64(text), 2),
        KEYS[1]: F.coalesce(F.col(doc).cast("long"), F.lit(LAST)),
    })


@dataclass
class _Border:
    """One border: bytes wanted before it, the keys fixed so far, and the interval that contains it."""

    target: float
    low: int
    high: int
    below: int = 0
    fixed: tuple[int, ...] = ()
    at: tuple[int, ...] | None = None
    seen: list[tuple[float, tuple[int, ...]]] = field(default_factory=list)

    @property
    def interval(self):
        return (self.fixed, self.low, self.high, self.below)


def _cells(rows: DataFrame, intervals: list, weight: str, probes: int) -> dict[int, list[tuple[int, int]]]:
    """Bytes in each non-empty cell of each interval, by cell."""
    which, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (fixed, low, high, _) in enumerate(intervals):
        key, width = F.col(KEYS[len(fixed)]), -(-(high - low) // probes)
        inside = (key >= low) & (key <= high - 1)
        for name, value in zip(KEYS, fixed):
            inside &= F.col(name) == value
        part = F.floor((key.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / width) if fixed else F.floor(
            F.expr(f"({KEYS[0]} - {low}L) div {width}L")
        )
        which, cell = F.when(inside, F.lit(i)).otherwise(which), F.when(inside, part.cast("long")).otherwise(cell)
    counted = (
        rows.select(which.alias("i"), cell.alias("c"), weight).filter("i is not null")
        .groupBy("i", "c").agg(F.sum(weight).alias("b"))
    )
    found: dict[int, list[tuple[int, int]]] = {i: [] for i in range(len(intervals))}
    for i, c, b in counted.collect():  # at most probes rows per border
        found[i].append((c, b))
    return {i: sorted(x) for i, x in found.items()}


def splitters(
    rows: DataFrame, shards: int, weight: str, *, probes: int = PROBES, tolerance: float = TOLERANCE
) -> list[tuple[int, ...]]:
    """First key of each shard but the first, from exact counts; ``rows`` has the keys and ``weight``."""
    total, low, high = rows.agg(F.sum(weight), F.min(KEYS[1]), F.max(KEYS[1])).first()
    if not total:
        return [(0,)] * (shards - 1)
    borders = [_Border(total * j / shards, 0, 2**62) for j in range(1, shards)]
    slack = tolerance * total / shards
    while opened := [b for b in borders if b.at is None]:
        intervals = list(dict.fromkeys(b.interval for b in opened))
        counts = _cells(rows, intervals, weight, probes)
        for b in opened:
            i, width = intervals.index(b.interval), -(-(b.high - b.low) // probes)
            sum_before, holder = b.below, None
            for c, n in counts[i]:
                if sum_before + n > b.target:
                    holder = (c, n)
                    break
                sum_before += n
            if holder is None:  # rounding put the target behind the last row
                b.at = (*b.fixed, b.high)
                continue
            c, n = holder
            begin, end = b.low + c * width, min(b.high, b.low + (c + 1) * width)
            b.seen += [(abs(sum_before - b.target), (*b.fixed, begin)), (abs(sum_before + n - b.target), (*b.fixed, end))]
            best = min(b.seen)
            if best[0] <= slack:
                b.at = best[1]
            elif end - begin > 1:
                b.low, b.high, b.below = begin, end, sum_before
            elif len(b.fixed) + 1 < len(KEYS):
                b.fixed, b.low, b.high, b.below = (*b.fixed, begin), low, high + 1, sum_before
            else:
                b.at = best[1]
    return [b.at for b in borders]


def _from(at: tuple[int, ...]) -> Column:
    """Rows at or behind a border. A border on the first key alone stands before all its documents."""
    first = F.col(KEYS[0])
    if len(at) == 1:
        return first >= at[0]
    second = F.col(KEYS[1]) >= at[1] if at[1] <= LAST else F.lit(False)
    return (first > at[0]) | ((first == at[0]) & second)


def histogram_sort(
    docs: DataFrame, shards: int = 8, *, text: str = "text", doc: str = "doc_id",
    probes: int = PROBES, tolerance: float = TOLERANCE,
) -> DataFrame:
    """``doc, size, text_crc32, shard, slot`` of all rows, as they stand in the exchanged table; see the module for the order.

    Borders come from a narrow table of sizes; then whole rows move once. Slots are gapless from 0 in each shard. They come
    from counts per range of the order, so no task holds a shard.
    """
    narrow = cut(keyed(docs.select(doc, text), text, doc).select(text_bytes(F.col(text)).alias("size"), *KEYS))
    borders = splitters(narrow, shards, "size", probes=probes, tolerance=tolerance)
    parts = max(1, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    moved = cut(exchange(docs.select(doc, text), borders, parts=parts, text=text, doc=doc))
    placed = keyed(moved, text, doc).select(
        F.col(doc), text_bytes(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), "shard", *KEYS,
    )
    bits = max(0, 62 - max(0, (narrow.count() >> 12).bit_length()))  # about 4096 hashes in a range
    texts = placed.groupBy("shard", KEYS[0]).agg(F.count(F.lit(1)).alias("__n"))
    before = running(texts, ["shard"], KEYS[0], {"__before": ("sum", F.col("__n"))}, exclusive=True, bits=bits)
    copies = texts.filter("__n > 1").select("shard", KEYS[0], F.lit(True).alias("__copied"))
    marked = placed.join(copies, ["shard", KEYS[0]], "left")
    inner = running(
        marked.filter("__copied"), ["shard", KEYS[0]], KEYS[1], {"__inner": ("sum", F.lit(1).cast("long"))}, bits=9
    ).unionByName(marked.filter("__copied is null").withColumn("__inner", F.lit(1).cast("long")))
    return inner.join(before.select("shard", KEYS[0], "__before"), ["shard", KEYS[0]]).select(
        doc, "size", "text_crc32", "shard",
        (F.coalesce("__before", F.lit(0)) + F.col("__inner") - 1).cast("long").alias("slot"),
    )


def exchange(docs: DataFrame, borders: list[tuple[int, ...]], *, parts: int, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """The one exchange of whole rows: each to its shard, cut into ``parts`` tasks by hash range, in order."""
    shard = sum((_from(at).cast("int") for at in borders), F.lit(0))
    piece = F.floor(F.col(KEYS[0]) / F.lit(-(-(2**62) // parts))).cast("int")
    return (
        keyed(docs, text, doc).withColumn("shard", shard)
        .repartition(parts * (len(borders) + 1), "shard", piece, F.pmod(F.xxhash64(doc), F.lit(parts)))
        .sortWithinPartitions("shard", *KEYS).drop(*KEYS)
    )
