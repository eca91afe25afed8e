"""Exact repeats of at least ``length`` bytes by suffix arrays and their common-prefix intervals.

A suffix array of a whole corpus cannot be sorted in one place, so suffixes are dealt by anchors. The anchor of a
``length``-byte string is its least-hashed inner ``GRAM``-byte string: equal strings have equal anchors at equal places. Texts are
taken in blocks; neighbouring windows with one anchor form a run that is kept as one piece of text.

1. Each block sends its distinct anchor hashes to fragments; those that occur once in the corpus hold no repeat.
2. Blocks send the pieces around the others to fragments by anchor. A piece that the block has already sent is not sent
   again: all its windows are repeats of the first.
3. A fragment sorts the window starts of its pieces by their bytes (a suffix array), computes common prefixes of
   neighbours, and scans the intervals of at least ``length``: the groups of equal windows. Windows with an earlier
   occurrence go back to their block as spans.
4. Blocks cut the spans out of their texts.

``maximal_groups`` reports repeats themselves: a stack scan over the common prefixes yields the interval tree, and an
interval counts only if the bytes before its occurrences differ (else its left extension is the same group).

Earlier means a smaller doc_id, or an earlier start in the same row. Defined results: a null text is empty; null
doc_ids come after all others; rows that share a doc_id are not earlier than each other; texts shorter than ``length``
keep everything; an empty table gives no rows; other columns are not read. A fragment holds a piece at most once
per block, however many documents share it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm import tokens
from segloom.llm.tables import cut, row_key

LENGTH = 100
GRAM = 24
FRAGMENT_BYTES = 2 << 20
BLOCK_BYTES = 2 << 20
#: Windows sorted at a time; groups of equal hash are never split.
SLICE = 200_000
_ROWS = "frag int, block bigint, data binary, more binary, docs binary"
_NAMES = ["frag", "block", "data", "more", "docs"]
_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_DOCS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("size", pa.int64())])
LAST = 2**63 - 1


def _rows(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _TYPES)], _NAMES)


def _table(rows: list[list], like: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)]) if rows else like.slice(0, 0)


def _squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _doubled(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every ``length``-byte string, from hashes of half the length."""
    with np.errstate(over="ignore"):
        a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

        def joined(x, y):
            h = x * a + y
            h ^= h >> np.uint64(29)
            h *= b
            h ^= h >> np.uint64(32)
            return h

        size, power, done, out = 1, tokens.mixed(np.arange(1, 257, dtype=np.uint64))[data], 0, None
        while True:
            if length & size:
                n = len(data) - done - size + 1
                part = power[done : done + n]
                out = part.copy() if out is None else joined(out[:n], part)
                done += size
            if done == length:
                return out
            power = joined(power[:-size], power[size:]) if len(power) > size else power[:0]
            size *= 2


class Anchors:
    """Runs of windows with one anchor in a block: first and last window start, hash of the anchor."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
        n, width = len(data), length - gram + 1
        self.first = self.last = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if n < length:
            return
        h = _doubled(data, gram)
        bits = np.uint64(max(1, n).bit_length())
        least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if width > size:
            rest = width - size
            least = np.minimum(least[: len(least) - rest], least[rest:])
        at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        valid = np.zeros(n + 1, np.int32)
        inner = np.diff(bounds) >= length
        np.add.at(valid, bounds[:-1][inner], 1)
        np.add.at(valid, bounds[1:][inner] - length + 1, -1)
        window = np.flatnonzero(np.cumsum(valid)[: len(at)] > 0)
        if not len(window):
            return
        where = at[window]
        new = np.ones(len(window), bool)
        new[1:] = (where[1:] != where[:-1]) | (window[1:] != window[:-1] + 1)
        starts = np.flatnonzero(new)
        self.first = window[starts]
        self.last = window[np.append(starts[1:], len(window)) - 1]
        self.hash = tokens.mixed(h[where[starts]])  # the least hashes are small numbers: spread them


def _send_anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int, bits: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for number, block in enumerate(tokens.blocks(batches, limit=BLOCK_BYTES)):
        order = pa.array(np.argsort(block.column("doc_id").fill_null(LAST).to_numpy(), kind="stable"))
        block = block.take(order)
        data, bounds = tokens.bytes_of(block.column("text"))
        docs = pa.RecordBatch.from_arrays(
            [block.column("doc_id").fill_null(LAST), block.column("key"), pa.array(np.diff(bounds))], schema=_DOCS
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _DOCS) as out:
            out.write_batch(docs)
        key = task << 32 | number
        rows = [[tokens.head_group(task, number), key, _squeeze(data.tobytes()), None, sink.getvalue().to_pybytes()]]
        h, counts = np.unique(Anchors(data, bounds, length, gram).hash, return_counts=True)
        cuts = _cuts(h, bits)
        for f in range(1 << bits):
            a, b = cuts[f], cuts[f + 1]
            if b > a:
                rows.append([f, key, h[a:b].tobytes(), np.packbits(counts[a:b] > 1).tobytes(), None])
        yield _rows(rows)


def _cuts(h: np.ndarray, bits: int) -> np.ndarray:
    frag = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    return np.searchsorted(frag, np.arange((1 << bits) + 1))


def _repeated_anchors(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    if not rows or rows[0]["docs"] is not None:
        return table
    parts = [np.frombuffer(r["data"], "<u8") for r in rows]
    many = np.concatenate([np.unpackbits(np.frombuffer(r["more"], np.uint8), count=len(p)) for r, p in zip(rows, parts)])
    codes, distinct = pd.factorize(np.concatenate(parts))
    again = (np.bincount(codes, weights=1 + many, minlength=len(distinct)) > 1)[codes]
    out, at = [], 0
    for r, p in zip(rows, parts):
        out.append([r["frag"], r["block"], None, np.packbits(again[at : at + len(p)]).tobytes(), None])
        at += len(p)
    return _table(out, table)


def _send_pieces(table: pa.Table, length: int, gram: int, bits: int) -> pa.Table:
    """One block: its texts again (with the spans already known), and pieces around repeated anchors by fragment."""
    rows = sorted(table.to_pylist(), key=lambda r: r["frag"])
    head = rows[0]
    docs = pa.ipc.open_stream(head["docs"]).read_all().combine_chunks()
    sizes, ids = docs.column("size").to_numpy(), docs.column("doc_id").to_numpy()
    data = np.frombuffer(_expand(head["data"]), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    runs = Anchors(data, bounds, length, gram)
    h = np.unique(runs.hash)
    cuts, flags = _cuts(h, bits), {r["frag"]: r["more"] for r in rows[1:]}
    again = np.concatenate([np.zeros(0, bool), *(
        np.unpackbits(np.frombuffer(flags[f], np.uint8), count=int(cuts[f + 1] - cuts[f])).astype(bool)
        for f in range(1 << bits) if cuts[f + 1] > cuts[f]
    )])
    keep = again[np.searchsorted(h, runs.hash)] if len(h) else np.zeros(0, bool)
    first, last, anchor = runs.first[keep], runs.last[keep], runs.hash[keep]
    owner = np.searchsorted(bounds, first, "right") - 1
    ends = last + length
    text = data.tobytes()
    seen: dict[bytes, int] = {}
    sent, spans = [], []
    for i, (a, b) in enumerate(zip(first.tolist(), ends.tolist())):
        j = seen.setdefault(text[a:b], i)
        if j != i and (ids[owner[i]] > ids[owner[j]] or owner[i] == owner[j]):
            spans.append((a, b))
        else:
            sent.append(i)
    known = np.array(spans, "<i8").reshape(-1, 2)
    out = [[-1, head["block"], head["data"], known.tobytes(), head["docs"]]]
    pick = np.array(sent, np.int64)
    pick = pick[np.argsort(anchor[pick], kind="stable")]
    cuts = _cuts(anchor[pick], bits)
    for f in range(1 << bits):
        mine = pick[cuts[f] : cuts[f + 1]]
        if not len(mine):
            continue
        before = np.where(first[mine] > bounds[owner[mine]], data[np.maximum(first[mine] - 1, 0)].astype(np.int64), -1)
        meta = np.stack([ids[owner[mine]], owner[mine], first[mine], last[mine] - first[mine] + 1, before, bounds[owner[mine]]]).astype("<i8")
        body = b"".join(text[a:b] for a, b in zip(first[mine].tolist(), ends[mine].tolist()))
        out.append([f, head["block"], _squeeze(body), _squeeze(meta.tobytes()), None])
    return _table(out, table)


class Pieces:
    """Pieces of a fragment and every window in them."""

    def __init__(self, rows: list[dict], length: int):
        self.length, metas, bodies, blocks = length, [], [], []
        for r in rows:
            meta = np.frombuffer(_expand(r["more"]), "<i8").reshape(6, -1)
            metas.append(meta)
            blocks.append(np.full(meta.shape[1], r["block"], np.int64))
            bodies.append(np.frombuffer(_expand(r["data"]), np.uint8))
        self.doc, self.owner, self.first, windows, self.before, self.base = np.concatenate(metas, axis=1)
        self.block = np.concatenate(blocks)
        self.buffer = np.concatenate(bodies)
        sizes = windows + length - 1
        self.begin = np.cumsum(sizes) - sizes
        self.piece = np.repeat(np.arange(len(windows), dtype=np.int32), windows)
        ahead = np.repeat((self.begin - np.cumsum(windows) + windows).astype(np.int32), windows)
        self.at = np.arange(len(self.piece), dtype=np.int32) + ahead  # window start in the buffer

    def start(self, w: np.ndarray) -> np.ndarray:
        """Start of windows in their block."""
        return self.first[self.piece[w]] + self.at[w] - self.begin[self.piece[w]]

    def place(self, w: np.ndarray) -> np.ndarray:
        """Start of windows in their text."""
        return self.start(w) - self.base[self.piece[w]]

    def left(self, w: np.ndarray) -> np.ndarray:
        """Byte before each window, -1 at the start of a text."""
        inner = self.at[w] > self.begin[self.piece[w]]
        return np.where(inner, self.buffer[np.maximum(self.at[w] - 1, 0)].astype(np.int64), self.before[self.piece[w]])

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows that may repeat, in byte order, with the common prefix of each with its predecessor."""
        h = _doubled(self.buffer, self.length)[self.at]
        codes, distinct = pd.factorize(h)
        often = np.flatnonzero(np.bincount(codes, minlength=len(distinct))[codes] > 1)
        often = often[np.argsort(codes[often], kind="stable")]
        ends = np.flatnonzero(np.append(codes[often][1:] != codes[often][:-1], True)) + 1 if len(often) else []
        view, begin = np.lib.stride_tricks.sliding_window_view(self.buffer, self.length), 0
        for i, end in enumerate(ends):
            if end - begin < SLICE and i + 1 < len(ends):
                continue
            mine = often[begin:end]
            begin = end
            keys = np.ascontiguousarray(view[self.at[mine]])
            order = np.argsort(keys.view(f"V{self.length}").ravel().view(f"S{self.length}"), kind="stable")
            keys = keys[order]
            differ = keys[1:] != keys[:-1]
            prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), self.length)
            yield mine[order], np.concatenate([[0], prefix])


def intervals(prefix: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of a suffix array with prefix of at least ``least``, by a stack scan."""
    out, stack = [], []
    for i, p in enumerate([*prefix.tolist(), 0]):
        begin = i - 1
        while stack and stack[-1][0] > p:
            length, begin = stack.pop()
            out.append((length, begin, i - 1))
        if p >= least and i < len(prefix) and (not stack or stack[-1][0] < p):
            stack.append((p, begin))
    return out


def _mark(table: pa.Table, length: int) -> pa.Table:
    rows = table.to_pylist()
    if not rows or rows[0]["docs"] is not None:
        return table
    p, hits = Pieces(rows, length), []
    for order, prefix in p.suffixes():
        group = np.cumsum(prefix < length) - 1  # intervals of full length: equal windows
        if not (prefix >= length).any():
            continue
        piece = p.piece[order]
        doc, row = p.doc[piece], np.stack([p.block[piece], p.owner[piece]])
        least = np.full(group[-1] + 1, LAST)
        np.minimum.at(least, group, doc)
        inner = np.lexsort((p.start(order), row[1], row[0], group))
        same = np.zeros(len(order), bool)
        g, r = group[inner], row[:, inner]
        same[inner[1:]] = (g[1:] == g[:-1]) & (r[0, 1:] == r[0, :-1]) & (r[1, 1:] == r[1, :-1])
        hits.append(order[(doc > least[group]) | same])
    out = []
    if hits:
        hit = np.concatenate(hits)
        block, start = p.block[p.piece[hit]], p.start(hit)
        order = np.lexsort((start, block))
        block, start = block[order], start[order]
        edges = np.searchsorted(block, names := np.unique(block))
        for b, s in zip(names.tolist(), np.split(start, edges[1:])):
            new = np.append(True, s[1:] > s[:-1] + 1)
            first = np.flatnonzero(new)
            spans = np.stack([s[first], s[np.append(first[1:], len(s)) - 1] + length], axis=1)
            out.append([rows[0]["frag"], b, None, spans.astype("<i8").tobytes(), None])
    return _table(out, table)


def _cut_out(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["docs"] is None)
    head = rows[0]
    docs = pa.ipc.open_stream(head["docs"]).read_all().combine_chunks()
    sizes = docs.column("size").to_numpy()
    data = np.frombuffer(_expand(head["data"]), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    spans = np.concatenate([np.frombuffer(r["more"], "<i8").reshape(-1, 2) for r in rows])
    cover = np.zeros(len(data) + 1, np.int64)
    np.add.at(cover, spans[:, 0], 1)
    np.add.at(cover, spans[:, 1], -1)
    gone = np.cumsum(cover)[:-1] > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    begins[edges] = gone[edges]
    per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[bounds])
    kept = data[~gone].tobytes()
    left = np.concatenate([[0], np.cumsum(sizes - per(gone))]).tolist()
    texts = [kept[a:b] for a, b in zip(left[:-1], left[1:])]
    ids = docs.column("doc_id")
    return pa.table({
        "doc_id": pa.array([None if d == LAST else d for d in ids.to_pylist()], pa.int64()), "key": docs.column("key"),
        "n_bytes": pa.array(sizes), "n_removed": pa.array(per(gone)), "n_spans": pa.array(per(begins)),
        "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), "kept": pa.array(texts, pa.binary()),
    })


_RESULT = "doc_id bigint, key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _pieces_table(docs: DataFrame, length: int, gram: int, text: str, doc: str) -> DataFrame:
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(0, int(total // FRAGMENT_BYTES)).bit_length()
    rows = docs.select(F.col(text).alias("text"), F.col(doc).cast("long").alias("doc_id"), row_key(docs).alias("key"))
    sent = rows.mapInArrow(lambda it: _send_anchors(it, length, gram, bits), _ROWS)
    again = sent.groupBy("frag").applyInArrow(_repeated_anchors, _ROWS)
    return cut(again.groupBy("block").applyInArrow(lambda t: _send_pieces(t, length, gram, bits), _ROWS))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Every row with later repeats cut out: ``doc_id, key, n_bytes, n_removed, n_spans, kept_sha256, kept`` (bytes)."""
    table = _pieces_table(docs, length, min(gram, length), text, doc)
    marked = table.filter("frag >= 0").groupBy("frag").applyInArrow(lambda t: _mark(t, length), _ROWS)
    return table.filter("frag < 0").unionByName(marked).groupBy("block").applyInArrow(_cut_out, _RESULT)


def maximal_groups(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Left-maximal groups of equal strings of ``length`` bytes: ``group_id`` (its bytes' hash), ``doc_id, start``, one row per occurrence.

    A piece that its block sent once stands for its equals there, so occurrences are those in distinct surroundings.
    """

    def report(table: pa.Table) -> pa.Table:
        out = {"group_id": [], "doc_id": [], "start": []}
        p = Pieces(table.to_pylist(), length)
        for order, prefix in p.suffixes():
            for _, a, b in intervals(prefix, length):
                mine = order[a : b + 1]
                left = p.left(mine)
                if (left == -1).any() or (left != left[0]).any():
                    name = hashlib.sha256(p.buffer[p.at[mine[0]] : p.at[mine[0]] + length].tobytes()).hexdigest()
                    out["group_id"] += [name] * len(mine)
                    out["doc_id"] += [None if d == LAST else d for d in p.doc[p.piece[mine]].tolist()]
                    out["start"] += p.place(mine).tolist()
        return pa.table(out, schema=pa.schema([("group_id", pa.string()), ("doc_id", pa.int64()), ("start", pa.int64())]))

    table = _pieces_table(docs, length, min(gram, length), text, doc)
    return table.filter("frag >= 0").groupBy("frag").applyInArrow(report, "group_id string, doc_id bigint, start bigint")
