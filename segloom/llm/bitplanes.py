"""Token ids in files of bit planes.

Texts are encoded in place, ids travel once to range-ordered parts, and each part is written as chunks of
whole documents. In a chunk, blocks of ``BLOCK`` ids are transposed into bit (or byte) planes, each plane
is compressed with zstandard, and an index of plane lengths allows reading any block alone.

File format: a Parquet table, one row per chunk:
``part, chunk`` order of the chunk; ``start`` ids of the part before it; ``n_ids``; ``doc_ids``,
``n_tokens`` documents in it; ``bits`` planes per block; ``index`` compressed length of each
plane, block by block; ``payload`` the planes.

Distinct words of a block of texts are encoded once: a piece ends at white space, or between an ASCII letter or
digit and ASCII punctuation that cannot take part in a contraction or a special token. No tokenizer rule in
use reaches over such an end (tests compare with encoding whole texts).

Defined results: a null text is empty and yields the end id only; null doc_ids come last; rows with
the same doc_id are ordered by text hash, then length; an empty table gives no chunks; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.llm import tokens
from segloom.plans.cut import shared_dir

BLOCK = 8192
CHUNK_IDS = 1 << 20
END_ID = 2
#: Pieces whose ids a Python worker keeps in each of two generations, and that the tokenizer gets at a time.
CACHED_WORDS = 300_000
ENCODED_WORDS = 1_000
BLOCK_BYTES = 4 << 20
CHUNK_SCHEMA = (
    "part int, chunk int, start bigint, n_ids bigint, doc_ids array<bigint>, n_tokens array<int>, "
    "bits array<tinyint>, index array<int>, payload binary"
)


class _Encoder:
    """Ids of pieces of text, kept as bytes between batches of a Python worker."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.kind = np.uint16 if self.width == 2 else np.uint32
        self.end = end_id.to_bytes(self.width, "little")
        self.known, self.before = {}, {}

    def pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts in a row, and the number of the first piece of each text."""
        kind = _KIND[data]
        begins = kind > 0
        begins[1:] &= (kind[:-1] == 0) | ((kind[1:] == 2) & (kind[:-1] == 3)) | ((kind[1:] == 3) & (kind[:-1] == 2))
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        begins[edges] = kind[edges] > 0
        inside = kind > 0
        first = np.flatnonzero(begins)
        rank = np.cumsum(inside, dtype=np.int64) - inside
        offsets = np.append(rank[first], np.count_nonzero(inside)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        return words, np.searchsorted(first, bounds)

    def encoded(self, distinct: list[bytes]) -> list[bytes]:
        """Ids of pieces as bytes. Of the pieces kept, those not asked for since the last change of generations go."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.before = {}, self.known
        known, before, new = self.known, self.before, []
        out = list(map(known.get, distinct))
        for i, found in enumerate(out):
            if found is None:
                found = out[i] = before.get(distinct[i])
                if found is None:
                    new.append(i)
                else:
                    known[distinct[i]] = found
        for at in range(0, len(new), ENCODED_WORDS):
            part = new[at : at + ENCODED_WORDS]
            for i, ids in zip(part, self._together([distinct[i].decode() for i in part])):
                out[i] = known[distinct[i]] = ids
        return out

    def _together(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece from one call: pieces are joined by spaces, and an id belongs to the piece in which its text begins."""
        coded = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        begins = np.cumsum([0, *(len(p) + 1 for p in pieces)])
        at = np.array([start for start, _ in coded.offsets], np.int64)
        cuts = np.searchsorted(at, begins)
        if np.any(at[1:] < at[:-1]):  # a tokenizer whose offsets do not follow the text
            parts = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            return [p.tobytes() for p in parts]
        raw, width = np.array(coded.ids, self.kind).tobytes(), self.width
        edges = (cuts * width).tolist()
        return [raw[a:b] for a, b in zip(edges, edges[1:])]

    def ids(self, texts: pa.Array) -> pa.Array:
        """Ids of each text with the end id, as little-endian bytes."""
        data, bounds = tokens.bytes_of(texts)
        words, starts = self.pieces(data, bounds)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        table = pa.array([*self.encoded(distinct), self.end], pa.large_binary())
        ends = starts[1:] + np.arange(len(texts))  # the end id follows the last piece of each text
        order = np.full(len(words) + len(texts), len(distinct), np.int64)
        order[np.delete(np.arange(len(order)), ends)] = coded.indices.to_numpy(zero_copy_only=False)
        flat = table.take(pa.array(order))
        offsets = np.frombuffer(flat.buffers()[1], np.int64)[: len(order) + 1]
        cuts = offsets[np.concatenate([[0], ends + 1])]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(cuts.copy()), flat.buffers()[2]])


_encoders: dict[tuple[str, int], _Encoder] = {}


def _encoder(path: str, end_id: int) -> _Encoder:
    """One encoder, with its known words, for all tasks that a Python worker runs."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = _Encoder(path, end_id)
    return _encoders[path, end_id]


def _kinds() -> np.ndarray:
    kind = np.ones(256, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    for first, last in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
        kind[first : last + 1] = 3
    kind[[ord(c) for c in "'<|>"]] = 1
    for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
        kind[ord(first) : ord(last) + 1] = 2
    return kind


#: 0 white space, 2 ASCII letter or digit, 3 punctuation that ends a piece before and after such, 1 all else.
_KIND = _kinds()


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, bounds: list[int]) -> Iterator[pa.RecordBatch]:
    encoder, limits = _encoder(path, end_id), np.array(bounds, np.int64)
    for block in tokens.blocks(batches, limit=BLOCK_BYTES):
        ids = encoder.ids(block.column("text"))
        doc = block.column("doc_id").fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
        digest = block.column("digest").to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(limits, doc, "left"), np.searchsorted(limits, doc, "right")
        share = digest.astype(np.float64) / 2.0**64 + 0.5  # of a doc_id that fills several parts
        part = low + np.floor(share * (high - low + 1)).astype(np.int64).clip(0, high - low)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), block.column("doc_id"), block.column("digest"), ids.cast(pa.binary())],
            ["part", "doc_id", "digest", "ids"],
        )


def planes_of(ids: np.ndarray, plane: str) -> tuple[int, list[bytes]]:
    """Planes of one block and their number: only as many as its largest id needs."""
    wide = ids.astype("<u4")
    raw = wide.view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        used = (int(wide.max()).bit_length() + 7) // 8
        return used, [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(used)]
    used = int(wide.max()).bit_length()
    bits = np.unpackbits(raw[:, : (used + 7) // 8], axis=1, bitorder="little")
    packed = np.packbits(bits, axis=0, bitorder="little")
    return used, [np.ascontiguousarray(packed[:, i]).tobytes() for i in range(used)]


def ids_of(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    """Inverse of ``planes_of``."""
    if plane == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for i, p in enumerate(planes):
            raw[:, i] = np.frombuffer(p, np.uint8)
    else:
        width = (len(planes) + 7) // 8
        packed = np.zeros(((n + 7) // 8, 8 * width), np.uint8)
        for i, p in enumerate(planes):
            packed[:, i] = np.frombuffer(p, np.uint8)
        bits = np.unpackbits(packed, axis=0, count=n, bitorder="little")
        raw = np.zeros((n, 4), np.uint8)
        raw[:, :width] = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


def _chunk(part: int, number: int, start: int, docs: list, sizes: list[int], ids: np.ndarray, plane: str) -> pa.RecordBatch:
    squeeze, payload, index, bits = zstandard.ZstdCompressor(level=1), [], [], []
    for at in range(0, len(ids), BLOCK):
        used, planes = planes_of(ids[at : at + BLOCK], plane)
        bits.append(used)
        payload += [squeeze.compress(p) for p in planes]
    index = [len(p) for p in payload]
    values = [part, number, start, len(ids), docs, sizes, bits, index, b"".join(payload)]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.binary()]
    names = ["part", "chunk", "start", "n_ids", "doc_ids", "n_tokens", "bits", "index", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


def _pack(batches: Iterator[pa.RecordBatch], width: int, plane: str) -> Iterator[pa.RecordBatch]:
    part, number, start = TaskContext.get().partitionId(), 0, 0
    docs, sizes, held, n = [], [], [], 0
    kind = "<u2" if width == 2 else "<u4"
    for batch in batches:
        for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
            docs.append(doc)
            sizes.append(len(raw) // width)
            held.append(raw)
            n += sizes[-1]
            if n >= CHUNK_IDS:
                yield _chunk(part, number, start, docs, sizes, np.frombuffer(b"".join(held), kind), plane)
                number, start, docs, sizes, held, n = number + 1, start + n, [], [], [], 0
    if docs:
        yield _chunk(part, number, start, docs, sizes, np.frombuffer(b"".join(held), kind), plane)


def _unpack(batches: Iterator[pa.RecordBatch], plane: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _decoded(row, plane)


def _decoded(row: dict, plane: str) -> pa.RecordBatch:
    squeeze, out, at, k = zstandard.ZstdDecompressor(), [], 0, 0
    for b, used in enumerate(row["bits"]):
        n, planes = min(BLOCK, row["n_ids"] - b * BLOCK), []
        for length in row["index"][k : k + used]:
            planes.append(squeeze.decompress(row["payload"][at : at + length]))
            at += length
        k += used
        out.append(ids_of(planes, n, plane))
    ids = np.concatenate(out)
    sizes = np.array(row["n_tokens"], np.int64)
    ends = np.cumsum(sizes)
    raw = memoryview(np.ascontiguousarray(ids)).cast("B")
    crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(sizes), row["part"], np.int32)),
         pa.array(row["start"] + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
        ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
    )


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str, *, end_id: int = END_ID, plane: str = "bit", parts: int | None = None,
    text: str = "text", doc: str = "doc_id",
) -> DataFrame:
    """Write ``docs`` in ascending ``doc`` order below ``path`` and return the table of chunks.

    Range limits are quantiles of ``doc`` over all rows (a mergeable sketch; only balance depends on them). A
    ``doc`` that fills several ranges is dealt over them by text hash.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(doc).cast("long"), F.lit(2**63 - 1))
    bounds = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    bounds = sorted(bounds) if parts > 1 else []
    encoded = docs.select(
        F.col(text).alias("text"), F.col(doc).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest")
    ).mapInArrow(lambda it: _encode(it, tokenizer, end_id, bounds), "part int, doc_id bigint, digest bigint, ids binary")
    dealt = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_last(), "digest", F.length("ids")
    )
    chunks = dealt.select("doc_id", "ids").mapInArrow(lambda it: _pack(it, width, plane), CHUNK_SCHEMA)
    chunks.write.parquet(path, compression="none")
    return spark.read.schema(CHUNK_SCHEMA).parquet(path)


def read_token_files(spark: SparkSession, path: str, *, plane: str = "bit") -> DataFrame:
    """Per document from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts all ids before the document: those of earlier parts (one sum per part, from the
    index columns only) and of its own part.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    per_part = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = per_part.select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    found = chunks.mapInArrow(
        lambda it: _unpack(it, plane), "doc_id bigint, part int, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return found.join(before, "part").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_table(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID, plane: str = "bit") -> DataFrame:
    """Write ``docs`` to new files in the shared folder and read every document back from them."""
    path = f"{shared_dir(docs.sparkSession)}/segloom/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer, path, end_id=end_id, plane=plane)
    return read_token_files(docs.sparkSession, path, plane=plane)
