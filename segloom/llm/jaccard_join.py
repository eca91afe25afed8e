"""N-gram Jaccard self-join by vertical partitioning.

Every text is the set of its word shingles, as 64-bit hashes. The global order of n-grams is cut into fragments;
a block of documents sends each fragment one row with its share of all their sets, so an n-gram's documents
meet in one place while no document travels whole. There, n-grams of a single document are dropped (they overlap
with nothing) and the others go back with their frequency. Back in its block a document stays only if
enough n-grams are left to reach the threshold with anyone; few do that have no partner.

The remaining sets, one per class of equal sets, are joined exactly. Rarest n-grams first, a set that reaches the
threshold with another shares one of its first ``n - ceil(t n) + 1`` n-grams with it. Candidates are then
verified fragment by fragment: overlaps are counted separately per fragment and summed per pair.

A group of thousands of near copies would make millions of pairs. So candidates come in two rounds: first each set
with the most central set of each of its n-grams (linear), then, between components of that round only, every
pair left: members of an n-gram outside its largest component against all of the n-gram. A link
between two components is never lost, since one of its ends is outside the largest.

Defined results: null, empty or blank texts have no n-grams and link with nothing; repeated rows and equal sets are
one class; null doc_ids take part and never name a component unless it has nothing else; an empty table gives
no rows; other columns are not read. Sets are compared as 64-bit hashes (a chance below 1e-9 per pair).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.llm import tokens
from segloom.llm.components import components
from segloom.llm.tables import cut, row_key

SHINGLE = 4
PERCENT = 85
#: Text bytes behind one fragment of the n-gram order.
FRAGMENT_BYTES = 16 << 20
#: Fragments in which a pair's overlap is counted separately.
COUNT_FRAGMENTS = 4
_PIECES = "frag int, block bigint, ords binary, runs binary, hashes binary, dfs binary, docs binary"
_PIECE_NAMES = ["frag", "block", "ords", "runs", "hashes", "dfs", "docs"]
_PIECE_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
_SETS = "doc_id bigint, key bigint, n int, node binary, shared int, central double, hashes array<bigint>"
_DOCS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("node", pa.binary())])


def shingles(words: tokens.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct shingle, sorted by both."""
    code, distinct = words.codes()
    each = tokens.mixed(tokens.hashed(distinct))[code]
    owner, counts = words.owner(), words.counts()
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        if words.n >= size:
            h = each[: words.n - size + 1].copy()
            for i in range(1, size):
                h = tokens.mixed(h * step + each[i : words.n - size + 1 + i])
            whole = owner[: words.n - size + 1] == owner[size - 1 :]
            h, o = h[whole], owner[: words.n - size + 1][whole]
        else:
            h, o = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < size))
        for d in short.tolist():  # the whole sequence is one shingle
            x = np.array([counts[d]], np.uint64)
            for w in each[words.starts[d] : words.starts[d + 1]]:
                x = tokens.mixed(x * step + w)
            h, o = np.append(h, x), np.append(o, d)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return o[new], h[new]


def _pieces(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _PIECE_TYPES)], _PIECE_NAMES)


def _split(owner: np.ndarray) -> tuple[bytes, bytes]:
    """Run starts and lengths of equal neighbours."""
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    first = np.flatnonzero(new)
    return owner[first].astype("<u4").tobytes(), np.diff(np.append(first, len(owner))).astype("<u4").tobytes()


def _owners(row: dict) -> np.ndarray:
    return np.repeat(np.frombuffer(row["ords"], "<u4"), np.frombuffer(row["runs"], "<u4"))


def _emit(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for number, block in enumerate(tokens.blocks(batches)):
        words = tokens.Words(*tokens.bytes_of(block.column("text")), tokens.SPACED_LOWER)
        owner, h = shingles(words, size)
        counts = np.bincount(owner, minlength=block.num_rows)
        ends = np.cumsum(counts)
        nodes = [xxhash.xxh3_128_digest(h[e - c : e].tobytes()) for c, e in zip(counts.tolist(), ends.tolist())]
        docs = pa.RecordBatch.from_arrays(
            [block.column("doc_id"), block.column("key"), pa.array(counts.astype(np.int32)), pa.array(nodes, pa.binary())], schema=_DOCS
        )
        key = task << 32 | number
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _DOCS) as out:
            out.write_batch(docs)
        rows = [[tokens.head_group(task, number), key, None, None, None, None, sink.getvalue().to_pybytes()]]
        frag = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        order = np.argsort(frag, kind="stable")
        cuts = np.searchsorted(frag[order], np.arange((1 << bits) + 1))
        for f in range(1 << bits):
            part = order[cuts[f] : cuts[f + 1]]
            if len(part):
                rows.append([f, key, *_split(owner[part]), h[part].astype("<u8").tobytes(), None, None])
        yield _pieces(rows)


def _frequencies(table: pa.Table) -> pa.Table:
    """One fragment: n-grams of two or more documents, with their document frequency."""
    rows = table.to_pylist()
    if not rows or rows[0]["docs"] is not None:
        return table
    parts = [np.frombuffer(r["hashes"], "<u8") for r in rows]
    h = np.concatenate(parts)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    group = np.cumsum(new) - 1
    df = np.empty(len(h), np.int64)
    df[order] = np.bincount(group)[group]
    out, at = [], 0
    for r, part in zip(rows, parts):
        mine = df[at : at + len(part)]
        at += len(part)
        keep = mine > 1
        if keep.any():
            capped = np.minimum(mine[keep], 65535).astype("<u2").tobytes()  # only orders n-grams
            out.append([r["frag"], r["block"], *_split(_owners(r)[keep]), part[keep].tobytes(), capped, None])
    return pa.Table.from_batches([_pieces(out)]) if out else table.slice(0, 0)


def _gather(table: pa.Table, percent: int) -> pa.Table:
    """One block: its documents, and the n-grams (rarest first) of those that can still reach the threshold."""
    docs, owners, hashes, dfs = None, [np.zeros(0, np.uint32)], [np.zeros(0, "<u8")], [np.zeros(0, "<u2")]
    for row in table.to_pylist():
        if row["docs"] is not None:
            docs = pa.ipc.open_stream(row["docs"]).read_all().combine_chunks()
        else:
            owners.append(_owners(row))
            hashes.append(np.frombuffer(row["hashes"], "<u8"))
            dfs.append(np.frombuffer(row["dfs"], "<u2"))
    owner, h, df = np.concatenate(owners), np.concatenate(hashes), np.concatenate(dfs)
    n = docs.column("n").to_numpy()
    shared = np.bincount(owner, minlength=len(n))
    alive = (n > 0) & (100 * shared >= percent * n)
    keep = alive[owner]
    owner, h, df = owner[keep], h[keep], df[keep]
    order = np.lexsort((h, df, owner))
    lengths = np.where(alive, shared, 0)
    central = np.bincount(owner, weights=df.astype(np.float64), minlength=len(n)) / np.maximum(n, 1)
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(h[order].view(np.int64))
    )
    return pa.table({
        "doc_id": docs.column("doc_id"), "key": docs.column("key"), "n": docs.column("n"), "node": docs.column("node"),
        "shared": pa.array(lengths.astype(np.int32)), "central": pa.array(central), "hashes": lists,
    })


def shared_sets(docs: DataFrame, *, shingle: int, percent: int, fragment_bytes: int = FRAGMENT_BYTES, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Every row with its set size and class; the n-grams only of those that may have a partner."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(0, int(total // fragment_bytes)).bit_length()
    rows = docs.select(F.col(text).alias("text"), F.col(doc).cast("long").alias("doc_id"), row_key(docs).alias("key"))
    sent = rows.mapInArrow(lambda it: _emit(it, shingle, bits), _PIECES)
    counted = sent.groupBy("frag").applyInArrow(_frequencies, _PIECES)
    return cut(counted.groupBy("block").applyInArrow(lambda t: _gather(t, percent), _SETS))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs at or above the threshold: overlaps per fragment of the n-gram order, summed per pair."""
    width = 2**64 // COUNT_FRAGMENTS
    whole = sets.select("node", "n", F.explode(F.array(*[
        F.struct(F.lit(v).alias("v"), F.filter("hashes", _within(-(2**63) + v * width, width)).alias("part")) for v in range(COUNT_FRAGMENTS)
    ])).alias("s")).select("node", "n", "s.v", "s.part")
    left = whole.select(F.col("node").alias("a"), F.col("n").alias("na"), "v", F.col("part").alias("pa"))
    right = whole.select(F.col("node").alias("b"), F.col("n").alias("nb"), "v", F.col("part").alias("pb"))
    partial = pairs.select("a", "b").join(left, "a").join(right, ["b", "v"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("c")
    )
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c")).filter(
        F.lit(100) * F.col("c") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("c"))
    ).select("a", "b")


def _within(low: int, width: int):
    return lambda h: (h >= F.lit(low)) & (h <= F.lit(low + width - 1))


def _similar_size(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def linked(sets: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of all classes that link; ``sets`` has one row per class: ``node, n, shared, central, hashes``."""
    need = F.ceil(F.lit(percent) * F.col("n") / 100).cast("int")
    prefix = cut(sets.select(
        "node", "n", "central", (F.col("n") - F.col("shared")).alias("unique"),
        F.posexplode(F.slice("hashes", 1, F.greatest(F.col("shared") - need + 1, F.lit(0)))).alias("i", "h"),
    ).select("node", "n", "central", "h", (F.col("unique") + F.col("i")).alias("at")))
    hubs = prefix.groupBy("h").agg(
        F.max(F.struct("central", "node")).alias("hub"), F.count(F.lit(1)).alias("size")
    ).filter("size > 1")
    shared = cut(prefix.join(hubs.select("h", F.col("hub.node").alias("hub")), "h"))
    first = shared.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = cut(_verified(first, sets, percent))
    found = components(links)
    placed = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = placed.groupBy("h", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = per.groupBy("h").agg(F.max(F.struct("m", "component")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    rest = cut(placed.drop("hub").join(mixed.select("h", F.col("top.component").alias("top")), "h"))
    x, y = rest.filter("component <> top").alias("x"), rest.alias("y")
    reach = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    second = x.join(y, F.col("x.h") == F.col("y.h")).filter(
        (F.col("x.component") != F.col("y.component"))
        & ((F.col("y.component") == F.col("y.top")) | (F.col("x.node") < F.col("y.node")))
        & _similar_size(F.col("x.n"), F.col("y.n"), percent)
        & (F.lit(100 + percent) * reach >= F.lit(percent) * (F.col("x.n") + F.col("y.n")))
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    more = _verified(cut(second), sets, percent)
    return components(cut(links.unionByName(more)))


def jaccard_components(
    docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, fragment_bytes: int = FRAGMENT_BYTES,
    text: str = "text", doc: str = "doc_id",
) -> DataFrame:
    """``doc_id, key, n_shingles, component_id, node`` of every row; ``node`` is the class of equal sets, ``key`` the row's."""
    everything = shared_sets(docs, shingle=shingle, percent=percent, fragment_bytes=fragment_bytes, text=text, doc=doc)
    sets = cut(everything.filter("shared > 0").select("node", "n", "shared", "central", "hashes").dropDuplicates(["node"]))
    found = linked(sets, percent)
    rows = everything.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), "node").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    named = rows.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    worded = rows.filter("n_shingles > 0").join(named, "component").select("doc_id", "key", "n_shingles", "component_id", "node")
    blank = rows.filter("n_shingles = 0").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"), "node")
    return worded.unionByName(blank)
