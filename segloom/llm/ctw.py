"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, walked down a binary tree (its node says which bits are known), in the context of
the up to ``depth`` bytes before it. Every (context, node) has a Krichevsky-Trofimov estimate from its counts; a context's
weighted probability is half its own estimate and half the product over the contexts one byte longer. That
weight, fixed after training, mixes the estimates of all depths along a path.

Training counts byte n-grams of all training texts in place, adds them up in one exchange, and builds the tree level
by level, deepest first, as aggregations; a walk back down turns it into one mixed probability per (context, node). Scoring
looks n-grams up in packs of at most ``PACK_ENTRIES`` entries (by context), one pass over the texts each.

The base score is a unigram model with add-one counts. A block of texts sends its distinct words to
fragments of the hash order, where their training counts meet, and gets the counts back.

Defined results: null or empty texts have only the end; null doc_id counts as the empty text in the fold; repeated
rows train and score each; an empty table gives no rows; other columns are not read. Texts are lower-cased (A-Z)
and preceded by zero bytes; their end is byte 255, which UTF-8 never has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.llm import tokens
from segloom.llm.tables import cut, drop, row_key

DEPTH = 5
END = 255
#: Model entries in one broadcast pack: 12 bytes each.
PACK_ENTRIES = 12_000_000
#: Entries that the driver fetches at a time.
SLICE_ENTRIES = 1_000_000
FOLDS, HELD_OUT = 7, 2
FRAGMENT_BYTES = 16 << 20
#: Text bytes whose n-grams are held at a time.
GRAM_BLOCK_BYTES = 2 << 20
#: Distinct n-grams that a counting task holds before it hands them on.
HELD_GRAMS = 2_000_000
_HALF = float(np.log(0.5))


def held_out(doc: Column) -> Column:
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def byte_grams(data: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram of every byte of every text and of its end (latest byte lowest), and the new bounds."""
    n = len(bounds) - 1
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    sizes = np.diff(bounds)
    starts = bounds[:-1] + (depth + 1) * np.arange(n)  # depth zeros, the text, the end
    padded = np.zeros(len(data) + (depth + 1) * n, np.uint8)
    place = np.ones(len(padded), bool)
    for k in range(depth):
        place[starts + k] = False
    place[starts + depth + sizes] = False
    padded[starts + depth + sizes] = END
    padded[place] = lower[data]
    code = padded.astype(np.uint64)
    gram = code.copy()
    for k in range(1, depth + 1):
        gram[k:] |= code[:-k] << np.uint64(8 * k)
    scored = np.ones(len(padded), bool)
    for k in range(depth):
        scored[starts + k] = False
    return gram[scored], bounds + np.arange(n + 1)


def _counted(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for block in tokens.blocks(batches, limit=GRAM_BLOCK_BYTES):
        gram, _ = byte_grams(*tokens.bytes_of(block.column("text")), depth)
        held.append(np.unique(gram, return_counts=True))
        if sum(len(g) for g, _ in held) > HELD_GRAMS:
            held = [_merged(held)]
            if len(held[0][0]) > HELD_GRAMS // 2:
                yield _gram_batch(*held.pop())
    if held:
        yield _gram_batch(*_merged(held))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    grams, counts = np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])[: len(grams)])
    return grams[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _gram_batch(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array((grams >> np.uint64(8)).view(np.int64)), pa.array((grams & np.uint64(255)).astype(np.int32)), pa.array(counts.astype(np.int64)),
    ], ["ctx", "byte", "n"])


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1/2: Stirling's series eight steps up."""
    x = x.cast("double")
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z)
    down = x
    for k in range(1, 8):
        down = down * (x + k)
    return series - F.log(down)


def _estimate(n0: Column, n1: Column) -> Column:
    """Log of the Krichevsky-Trofimov probability of all decisions at a node."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - F.lit(float(np.log(np.pi)))


def _stored(p: Column) -> Column:
    """A probability as a float below 1: after millions of equal bits it would round to 1, and the other bit score minus infinity."""
    return F.least(p, F.lit(1 - 2.0**-24)).cast("float")


def train(docs: DataFrame, *, depth: int = DEPTH, text: str = "text") -> DataFrame:
    """Model of all texts of ``docs``: ``level, ctx, node, p`` (probability of a 1), one row per seen context and node.

    Rows of a context meet before they fan out to nodes; estimates are worked out anew from the counts where they are
    needed, and a level's counts go as soon as its probabilities stand.
    """
    grams = docs.select(F.col(text).alias("text")).mapInArrow(
        lambda it: _counted(it, depth), "ctx bigint, byte int, n bigint"
    ).repartition("ctx")
    steps = F.explode(F.array(*[
        F.struct(
            F.shiftright("byte", 8 - k).bitwiseOR(F.lit(1 << k)).alias("node"),
            F.shiftright("byte", 7 - k).bitwiseAND(F.lit(1)).alias("bit"),
        ) for k in range(8)
    ]))
    deepest = grams.select("ctx", "n", steps.alias("s")).groupBy("ctx", F.col("s.node").alias("node")).agg(
        F.sum(F.when(F.col("s.bit") == 0, F.col("n")).otherwise(F.lit(0))).alias("n0"),
        F.sum(F.when(F.col("s.bit") == 1, F.col("n")).otherwise(F.lit(0))).alias("n1"),
    )
    own = _estimate(F.col("n0"), F.col("n1"))
    levels = {depth: cut(deepest)}  # nothing is longer there: ``all`` is its own estimate
    for d in range(depth - 1, -1, -1):
        shorter = F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1))
        longer = F.col("all") if d + 1 < depth else own
        up = levels[d + 1].groupBy(shorter.alias("ctx"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(longer).alias("longer")
        ).withColumn("own", own)
        high, low = F.greatest("own", "longer"), F.least("own", "longer")
        levels[d] = cut(up.select("ctx", "node", "n0", "n1", (F.lit(_HALF) + high + F.log1p(F.exp(low - high))).alias("all")))
    out, above = None, None
    for d in range(depth + 1):
        level = levels[d]
        if above is None:
            level = level.withColumns({"sum": F.lit(0.0), "left": F.lit(1.0)})
        else:
            shorter = F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))
            level = level.withColumn("up", shorter).join(above, ["up", "node"])
        kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
        if d < depth:
            stop = F.exp(F.lit(_HALF) + own - F.col("all"))
            level = cut(level.withColumn("stop", stop).select(
                "ctx", "node", _stored(F.col("sum") + F.col("left") * (F.col("stop") * kt + (1 - F.col("stop")) / 2)).alias("p"),
                (F.col("sum") + F.col("left") * F.col("stop") * kt).alias("sum"),
                (F.col("left") * (1 - F.col("stop"))).alias("left"),
            ))
            above = level.select(F.col("ctx").alias("up"), "node", "sum", "left")
        else:
            level = cut(level.select("ctx", "node", _stored(F.col("sum") + F.col("left") * kt).alias("p")))
        drop(levels.pop(d))
        part = level.select(F.lit(d).alias("level"), "ctx", "node", "p")
        out = part if out is None else out.unionByName(part)
    return out


def _ranges(sizes: list[tuple[int, int]], limit: int) -> list[tuple[int, int, int]]:
    """Neighbouring numbers joined to ranges ``(first, last, entries)`` of at most ``limit`` entries, or of one number."""
    out: list[tuple[int, int, int]] = []
    for number, n in sorted(sizes):
        if out and out[-1][2] + n <= limit:
            out[-1] = (out[-1][0], number, out[-1][2] + n)
        else:
            out.append((number, number, n))
    return out


class Pack:
    """Model entries by level, sorted by (context, node)."""

    def __init__(self, model: DataFrame, depth: int, slice_entries: int = SLICE_ENTRIES):
        """Levels come in ranges of contexts, so that the driver holds the sorted pack and one slice of it, and the JVM one slice."""
        self.depth, self.levels = depth, []
        key = F.shiftleft("ctx", 8).bitwiseOR(F.col("node").cast("long"))
        # the two earliest bytes of a context, at most 65,536 numbers a level
        top = F.expr("shiftrightunsigned(ctx, greatest(0, 8 * (level - 2)))")
        sizes: dict[int, list[tuple[int, int]]] = {d: [] for d in range(depth + 1)}
        for r in model.groupBy("level", top.alias("top")).agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist():
            sizes[r["level"]].append((r["top"], r["n"]))
        for d in range(depth + 1):
            n = sum(n for _, n in sizes[d])
            keys, values, at = np.empty(n, np.uint64), np.empty(n, np.float32), 0
            for first, last, entries in _ranges(sizes[d], slice_entries):
                table = model.filter((F.col("level") == d) & top.between(first, last)).select(key.alias("key"), "p").toArrow()
                own = table.column("key").to_numpy().view(np.uint64)
                order = np.argsort(own)
                keys[at : at + entries], values[at : at + entries] = own[order], table.column("p").to_numpy()[order]
                at += entries
            self.levels.append((keys, values))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """Log10 probability of each n-gram's last byte; the deepest seen context of each bit has the mixture."""
        ctx, byte = grams >> np.uint64(8), grams & np.uint64(255)
        out = np.zeros(len(grams))
        for k in range(8):
            node = (byte >> np.uint64(8 - k)) | np.uint64(1 << k)
            bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            p, todo = np.full(len(grams), 0.5), np.arange(len(grams))
            for d in range(self.depth, -1, -1):
                keys, values = self.levels[d]
                if not len(todo) or not len(keys):
                    continue
                want = ((ctx[todo] & np.uint64((1 << 8 * d) - 1)) << np.uint64(8)) | node[todo]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                seen = keys[at] == want
                p[todo[seen]] = values[at[seen]]
                todo = todo[~seen]
            out += np.log10(np.where(bit, p, 1 - p))
        return out


def _scored(batches: Iterator[pa.RecordBatch], pack: Pack, number: int, packs: int) -> Iterator[pa.RecordBatch]:
    for block in tokens.blocks(batches, limit=GRAM_BLOCK_BYTES):
        gram, bounds = byte_grams(*tokens.bytes_of(block.column("text")), pack.depth)
        codes, distinct = pd.factorize(gram)
        order = np.argsort(distinct)
        if packs > 1:
            order = order[_pack_of(distinct[order], packs) == number]
        values = np.zeros(len(distinct))
        values[order] = pack.log10(distinct[order])
        sums = np.concatenate([[0.0], np.cumsum(values[codes])])[bounds]
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), block.column("key"), pa.array(np.diff(sums)), pa.array(np.diff(bounds))],
            ["doc_id", "key", "score", "n_bytes"],
        )


def _pack_of(grams: np.ndarray, packs: int) -> np.ndarray:
    """Contexts are dealt by their two latest bytes, so that a path of depths from two on stays together."""
    return ((grams >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64) % packs


def score(docs: DataFrame, model: DataFrame, *, depth: int = DEPTH, pack_entries: int = PACK_ENTRIES, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``doc_id, key, score`` (log10 probability), ``n_bytes`` (with the end) of every text; equal rows once."""
    packs = max(1, -(-model.count() // pack_entries))
    rows = docs.select(F.col(text).alias("text"), F.col(doc).cast("long").alias("doc_id"), row_key(docs).alias("key"))
    out = None
    for k in range(packs):
        mine = (F.col("level") < 2) | (F.pmod(F.col("ctx").bitwiseAND(F.lit(0xFFFF)), F.lit(packs)) == k)
        pack = docs.sparkSession.sparkContext.broadcast(Pack(model.filter(mine), depth))
        part = cut(rows.mapInArrow(_scorer(pack, k, packs), "doc_id bigint, key bigint, score double, n_bytes bigint").dropDuplicates(["doc_id", "key"]))
        pack.destroy()
        out = part if out is None else out.unionByName(part)
    if packs == 1:
        return out
    return out.groupBy("doc_id", "key").agg(F.sum("score").alias("score"), F.first("n_bytes").alias("n_bytes"))


def _scorer(pack, number: int, packs: int):
    return lambda batches: _scored(batches, pack.value, number, packs)


_PIECES = "frag int, block bigint, hashes binary, counts binary, docs binary, ranks binary"
_PIECE_NAMES = ["frag", "block", "hashes", "counts", "docs", "ranks"]
_PIECE_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
_DOCS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64())])
#: The row of block -1 carries training tokens and distinct training tokens in ``n_tokens`` and ``n_known``.
_BASE = "doc_id bigint, key bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, total boolean"


def _pieces(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _PIECE_TYPES)], _PIECE_NAMES)


def _emit(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for number, block in enumerate(tokens.blocks(batches)):
        words = tokens.Words(*tokens.bytes_of(block.column("text")), tokens.SPACED_LOWER)
        code, distinct = words.codes()
        h = tokens.mixed(tokens.hashed(distinct))
        order = np.argsort(h)
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        trains = ~block.column("held_out").to_numpy(zero_copy_only=False)
        counts = np.bincount(code[trains[words.owner()]], minlength=len(h))[order]
        h = h[order]
        docs = pa.RecordBatch.from_arrays(
            [block.column("doc_id"), block.column("key"), block.column("held_out"), pa.array(words.counts())], schema=_DOCS
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _DOCS) as out:
            out.write_batch(docs)
        key = task << 32 | number
        packed = zstandard.ZstdCompressor(level=1).compress(rank[code].astype("<u4").tobytes())
        rows = [[tokens.head_group(task, number), key, None, None, sink.getvalue().to_pybytes(), packed]]
        frag = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        cuts = np.searchsorted(frag, np.arange((1 << bits) + 1))
        for f in range(1 << bits):
            a, b = cuts[f], cuts[f + 1]
            if b > a:
                rows.append([f, key, h[a:b].astype("<u8").tobytes(), counts[a:b].astype("<u4").tobytes(), None, None])
        yield _pieces(rows)


def _summed(table: pa.Table) -> pa.Table:
    """One fragment: training counts of its words over all blocks, back to each block in its order."""
    rows = table.to_pylist()
    if not rows or rows[0]["docs"] is not None:
        return table
    parts = [np.frombuffer(r["hashes"], "<u8") for r in rows]
    counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows])
    codes, distinct = pd.factorize(np.concatenate(parts))
    totals = np.bincount(codes, weights=counts, minlength=len(distinct)).astype(np.int64)
    back, at, out = totals[codes], 0, []
    for r, part in zip(rows, parts):
        out.append([r["frag"], r["block"], None, back[at : at + len(part)].astype("<i8").tobytes(), None, None])
        at += len(part)
    seen = np.array([totals.sum(), np.count_nonzero(totals)], "<i8")
    out.append([rows[0]["frag"], -1, None, seen.tobytes(), None, None])
    return pa.Table.from_batches([_pieces(out)])


def _looked_up(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["frag"])
    if rows[0]["block"] == -1:
        n, v = np.sum([np.frombuffer(r["counts"], "<i8") for r in rows], axis=0).tolist()
        return pa.table([[None], [None], [None], [n], [v], [0.0], [True]], schema=_BASE_SCHEMA)
    head = rows[0]  # the documents' row has a negative fragment
    docs = pa.ipc.open_stream(head["docs"]).read_all().combine_chunks()
    rank = np.frombuffer(zstandard.ZstdDecompressor().decompress(head["ranks"]), "<u4")
    counts = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(r["counts"], "<i8") for r in rows[1:])])
    sizes = docs.column("n").to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    known = np.concatenate([[0], np.cumsum((counts > 0)[rank], dtype=np.int64)])
    logs = np.concatenate([[0.0], np.cumsum(np.log10(counts + 1.0)[rank])])
    return pa.table([
        docs.column("doc_id"), docs.column("key"), docs.column("held_out"), pa.array(sizes),
        pa.array(np.diff(known[ends])), pa.array(np.diff(logs[ends])), pa.array(np.zeros(len(sizes), bool)),
    ], schema=_BASE_SCHEMA)


_BASE_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
    ("n_known", pa.int64()), ("logs", pa.float64()), ("total", pa.bool_()),
])


def base_scores(docs: DataFrame, *, fragment_bytes: int = FRAGMENT_BYTES, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``doc_id, key, held_out, n_tokens, n_known, train_tokens, base_score`` of every row."""
    bits = max(0, int((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // fragment_bytes)).bit_length()
    rows = docs.select(
        F.col(text).alias("text"), F.col(doc).cast("long").alias("doc_id"), row_key(docs).alias("key"),
        held_out(F.col(doc)).alias("held_out"),
    )
    sent = rows.mapInArrow(lambda it: _emit(it, bits), _PIECES)
    counted = sent.groupBy("frag").applyInArrow(_summed, _PIECES)
    found = cut(counted.groupBy("block").applyInArrow(_looked_up, _BASE))
    ends = docs.filter(~held_out(F.col(doc))).count()
    n, v = found.filter("total").agg(F.sum("n_tokens"), F.sum("n_known")).first()
    n, v = (n or 0) + ends, (v or 0) + (ends > 0)
    size = F.col("n_tokens") + 1
    return found.filter("not total").select(
        "doc_id", "key", "held_out", size.alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + float(np.log10(ends + 1)) - size * float(np.log10(n + v + 1))).alias("base_score"),
    )


def lm_scores(docs: DataFrame, *, depth: int = DEPTH, pack_entries: int = PACK_ENTRIES, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Base and context-tree scores of every row, both learnt from the rows outside the held-out fold."""
    model = train(docs.filter(~held_out(F.col(doc))), depth=depth, text=text)
    deep = score(docs, model, depth=depth, pack_entries=pack_entries, text=text, doc=doc)
    base = base_scores(docs, text=text, doc=doc)
    deep = deep.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), "score", "n_bytes")
    joined = base.join(deep, (F.col("key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d")))
    return joined.select(
        *base.columns, "score", (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte")
    )
