"""Words of whole Arrow batches as arrays, without one Python object per word.

The bytes of all texts of a batch lie in one buffer. A 256-entry table says which bytes belong to
words and what they become (lower case); words are then found by comparing neighbours, so that a
batch costs a few passes over its bytes. Every class used here keeps bytes above 0x7F in words,
which is why bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together.
BLOCK_BYTES = 4 << 20


def _table(separators: list[int], lower: bool) -> np.ndarray:
    """Byte to the byte kept in a word; 0 for separators."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[separators] = 0
    return table


_SPACE = [0x20, *range(0x09, 0x0E)]
#: Everything but space and \t \n \v \f \r; byte 0 is a word byte of this class and is kept apart below.
SPACED = _table(_SPACE, lower=False)
SPACED_LOWER = _table(_SPACE, lower=True)
#: 0-9, a-z and everything beyond ASCII.
ALNUM_LOWER = _table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)


class Words:
    """Words of a block of texts: ``array`` (binary, text order), ``starts`` (per text, and the end)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
        inside = table[data] != 0
        if table is not ALNUM_LOWER:
            inside |= data == 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        begins[edges] = inside[edges]  # a word never runs into the next text
        first = np.flatnonzero(begins)
        kept = table[data[inside]]
        rank = np.cumsum(inside, dtype=np.int64) - inside  # bytes of words before each byte
        offsets = np.append(rank[first], len(kept)).astype(np.int64)
        self.array = pa.Array.from_buffers(
            pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]
        )
        self.starts = np.searchsorted(first, bounds)
        self.at = first
        self.n = len(first)

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts())

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the distinct words by number."""
        coded = self.array.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts in a row and their bounds; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows regrouped so that a block holds about ``limit`` bytes of text; one longer text is a block of its own."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        begin = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > limit:
                held.append(batch.slice(begin, i - begin))
                yield _joined(held)
                held, size, begin = [], 0, i
            size += n
        if begin < len(sizes):
            held.append(batch.slice(begin))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches([b for b in held if b.num_rows] or held[:1]).combine_chunks().to_batches()[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), bijective."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def head_group(task: int, number: int) -> int:
    """Negative group of a block's head row: as many groups as blocks, spread over all tasks."""
    return -1 - int(mixed(np.array([task << 32 | number], np.uint64))[0] >> np.uint64(33))


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hash of each byte string of a (distinct) list."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
