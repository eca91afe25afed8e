"""Benchmark decontamination over a positional inverted index.

``write_index`` stores the postings of every training token: documents are taken in blocks, and each
(block, term) gets a row with the gaps between its word positions in the block. A block's words are counted
through, so a phrase is a set of terms at fixed offsets. ``search`` cuts the test items into windows and
orders each window's terms by their frequency in the whole index. In a block that holds the rarest term, its
positions minus its offset are the candidates, and each further list keeps those that it continues; most windows
end at the first, missing list. With ``slop`` above 0 terms may stand up to so many words off
their place (proximity).

The index only grows with the corpus, reads of it are pruned to the terms asked for, and a block's lists meet in
one task of bounded size. Windows travel in packs of ``PACK_WINDOWS``, one pass over the pruned index each, so any
number of test items works.

Defined results: null or empty texts have no words and are clean; an item without words has no window; equal windows
of several items count for all of them; repeated rows are searched each; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.llm import tokens
from segloom.llm.tables import cut, row_key
from segloom.plans.cut import shared_dir

WINDOW = 10
PACK_WINDOWS = 100_000
#: ``term`` is null in the one row per block that lists its documents and their numbers of words.
INDEX_SCHEMA = "block bigint, term binary, n int, gaps array<int>, docs array<bigint>, keys array<bigint>"


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for number, block in enumerate(tokens.blocks(batches)):
        data, bounds = tokens.bytes_of(block.column("text"))
        words = tokens.Words(data, bounds, tokens.ALNUM_LOWER)
        code, terms = words.codes()
        order = np.argsort(code, kind="stable")
        counts = np.bincount(code, minlength=len(terms))
        ends = np.cumsum(counts)
        gaps = np.diff(order, prepend=0)
        first = (ends - counts)[counts > 0]
        gaps[first] = order[first]
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], ends, [words.n + block.num_rows]]).astype(np.int32)),
            pa.array(np.concatenate([gaps, words.counts()]).astype(np.int32)),
        )
        doc_offsets = np.zeros(len(terms) + 2, np.int32)
        doc_offsets[-1] = block.num_rows
        docs, keys = (pa.ListArray.from_arrays(pa.array(doc_offsets), block.column(c)) for c in ("doc_id", "key"))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(terms) + 1, task << 32 | number, np.int64)),
                pa.concat_arrays([terms.cast(pa.binary()), pa.nulls(1, pa.binary())]),
                pa.array(np.append(counts, words.n).astype(np.int32)), lists, docs, keys,
            ],
            ["block", "term", "n", "gaps", "docs", "keys"],
        )


def write_index(docs: DataFrame, path: str, *, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Store the postings of all words of ``docs`` below ``path`` and return the table."""
    rows = docs.select(F.col(text).alias("text"), F.col(doc).cast("long").alias("doc_id"), row_key(docs).alias("key"))
    rows.mapInArrow(_index_rows, INDEX_SCHEMA).write.parquet(path, compression="zstd")
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def documents_of(index: DataFrame) -> DataFrame:
    """Every indexed row: ``block, ord, doc_id, key, n_words``."""
    return index.filter("term is null").select("block", F.posexplode(F.arrays_zip("docs", "keys", "gaps")).alias("ord", "d")).select(
        "block", "ord", F.col("d.docs").alias("doc_id"), F.col("d.keys").alias("key"), F.col("d.gaps").cast("long").alias("n_words")
    )


def windows_of(items: DataFrame, size: int = WINDOW, *, text: str = "text", item: str = "item_id") -> DataFrame:
    """Distinct windows of the items' words: ``terms``, and ``items`` that hold them."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tokens.blocks(batches):
            words = tokens.Words(*tokens.bytes_of(block.column("text")), tokens.ALNUM_LOWER)
            flat, names, out, owners = words.array.to_pylist(), block.column("item_id").to_pylist(), [], []
            for i, (a, b) in enumerate(zip(words.starts[:-1], words.starts[1:])):
                for k in range(a, max(a + 1, b - size + 1) if b > a else a):
                    out.append(flat[k : min(k + size, b)])
                    owners.append(names[i])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary())), pa.array(owners, pa.string())], ["terms", "item"])

    rows = items.select(F.col(text).alias("text"), F.col(item).cast("string").alias("item_id"))
    return rows.mapInArrow(cut_up, "terms array<binary>, item string").groupBy("terms").agg(F.collect_set("item").alias("items"))


def _intersected(lists: dict[bytes, np.ndarray], asked: list[tuple[bytes, int]], slop: int):
    """First and last word of each match of one window in a block; ``asked`` is rarest first."""
    term, offset = asked[0]
    if term not in lists:
        return None
    low = high = lists[term]
    start = low - offset
    for term, offset in asked[1:]:
        held = lists.get(term)
        if held is None:
            return None
        want = start + offset
        at = np.searchsorted(held, want)
        after, before = held[np.minimum(at, len(held) - 1)], held[np.maximum(at - 1, 0)]
        near = np.where(np.abs(after - want) <= np.abs(before - want), after, before)
        keep = np.abs(near - want) <= slop
        if not keep.any():
            return None
        start, near = start[keep], near[keep]
        low, high = np.minimum(low[keep], near), np.maximum(high[keep], near)
    return low, high


def _search_block(table: pa.Table, pack: list, slop: int) -> pa.Table:
    terms = table.column("term").to_pylist()
    gaps = table.column("gaps").combine_chunks()
    docs, sizes, lists = [], np.zeros(0, np.int64), {}
    for i, term in enumerate(terms):
        values = gaps[i].values.to_numpy(zero_copy_only=False)
        if term is None:
            docs, sizes = table.column("docs")[i].as_py(), values.astype(np.int64)
        else:
            lists[term] = np.cumsum(values, dtype=np.int64)
    bases = np.cumsum(sizes) - sizes
    found: dict[int, tuple[list, set]] = {}
    for asked, items in pack:
        if (match := _intersected(lists, asked, slop)) is None:
            continue
        low, high = match
        owner = np.searchsorted(bases, low, "right") - 1
        same = high < (bases + sizes)[owner]
        for d, a, b in zip(owner[same].tolist(), low[same].tolist(), high[same].tolist()):
            spans, names = found.setdefault(d, ([], set()))
            spans.append((a - int(bases[d]), b + 1 - int(bases[d])))
            names.update(items)
    block = table.column("block")[0].as_py() if table.num_rows else 0
    rows = [
        {"block": block, "ord": d, "doc_id": docs[d], "spans": [{"begin": a, "end": b} for a, b in _merged(spans)], "items": sorted(names)}
        for d, (spans, names) in found.items()
    ]
    return pa.Table.from_pylist(rows, _HITS)


def _searcher(shared, slop: int):
    return lambda table: _search_block(table, shared.value, slop)


_HITS = pa.schema([
    ("block", pa.int64()), ("ord", pa.int32()), ("doc_id", pa.int64()),
    ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())),
])
HITS_SCHEMA = "block bigint, ord int, doc_id bigint, spans array<struct<begin:int,end:int>>, items array<string>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search(index: DataFrame, windows: DataFrame, *, slop: int = 0, pack_windows: int = PACK_WINDOWS) -> DataFrame:
    """Indexed rows with a match: ``block, ord, doc_id``, merged word ``spans`` and ``items``.

    A row has one line per pack that matched it; ``contamination`` puts them together.
    """
    spark = index.sparkSession
    windows = cut(windows)
    asked = cut(windows.select(F.explode("terms").alias("term")).distinct())
    frequency = cut(index.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")))
    packs = max(1, -(-windows.count() // pack_windows))
    numbered = windows.withColumn("pack", F.pmod(F.xxhash64("terms"), F.lit(packs)))
    out = None
    for k in range(packs):
        rows = numbered.filter(F.col("pack") == k).drop("pack")
        terms = rows.select(F.explode("terms").alias("term")).distinct()
        df = {bytes(r.term): r.df for r in frequency.join(terms, "term", "left_semi").collect()}
        pack = []
        for r in rows.collect():  # at most about pack_windows
            words = [bytes(t) for t in r.terms]
            if all(w in df for w in words):
                pack.append((sorted(((w, i) for i, w in enumerate(words)), key=lambda x: (df[x[0]], x)), list(r["items"])))
        shared = spark.sparkContext.broadcast(pack)
        wanted = cut(terms)
        lists = index.join(wanted, "term", "left_semi").unionByName(index.filter("term is null"))
        hits = lists.groupBy("block").applyInArrow(_searcher(shared, slop), HITS_SCHEMA)
        out = hits if out is None else out.unionByName(hits)
    return out


def contamination(
    docs: DataFrame, items: DataFrame, *, window: int = WINDOW, slop: int = 0, pack_windows: int = PACK_WINDOWS,
    text: str = "text", doc: str = "doc_id", item_text: str = "text", item: str = "item_id",
) -> DataFrame:
    """Every row of ``docs``: ``doc_id, key, n_words, n_hit, items`` (sorted), ``spans`` of words inside test windows."""
    path = f"{shared_dir(docs.sparkSession)}/segloom/postings-{uuid.uuid4().hex}"
    index = write_index(docs, path, text=text, doc=doc)
    hits = search(index, windows_of(items, window, text=item_text, item=item), slop=slop, pack_windows=pack_windows)
    per_row = hits.groupBy("block", "ord").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.flatten(F.collect_list("items")).alias("i")
    )
    span = "array<struct<begin:int,end:int>>"
    merged = F.aggregate(
        "s", F.array().cast(span),
        lambda out, x: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["begin"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(
                F.element_at(out, -1)["begin"].alias("begin"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(x))),
    )
    per_row = per_row.select("block", "ord", merged.alias("spans"), F.array_sort(F.array_distinct("i")).alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return documents_of(index).join(per_row, ["block", "ord"], "left").select(
        "doc_id", "key", "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast(span)).alias("spans"),
    )
