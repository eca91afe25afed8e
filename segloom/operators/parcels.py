"""Texts in parcels that fetch the terms which can occur in them, for glossaries too large to be carried.

A parcel is a few MB of tokenised texts in one row: its distinct words, and the texts as numbers of these. Only the distinct
words of a parcel meet the terms, and each parcel gets back those terms alone whose rarest token it has. Nothing is
exchanged per occurrence, and the work on a parcel is local; everything grows in proportion to the texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from segloom.functions import text as T
from segloom.operators.automaton import Places, TokenAutomaton
from segloom.plans.cut import cut

#: About so many bytes of (each) text make a parcel, and so many tokens of it are worked on at once.
PARCEL_BYTES = 16_000_000
STRETCH_TOKENS = 500_000

_PACKED = "parcel long, own int, words array<string>, body binary"


def _ranges(weights: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches of rows that weigh about ``most`` together."""
    if not len(weights):
        return []
    cuts = np.flatnonzero(np.diff(np.cumsum(weights, dtype=np.int64) // most)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(weights)]))


def _numbered(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = tokens.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary


def _closed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(body: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(body.as_buffer()).read_all()


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parcels as they are exchanged: the words and their folded forms are one compressed value."""
    for batch in batches:
        for i in range(len(batch)):
            one = batch.slice(i, 1)
            said = pa.table({c: one[c].flatten() for c in ("words", "folded")})
            yield pa.RecordBatch.from_arrays([one["parcel"], pa.array([_closed(said)], pa.binary()), one["body"]], ["parcel", "said", "body"])


def _cut_up(texts: pa.Array, word: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All tokens (runs of characters that ``word`` marks, and single other ones) of some texts, and how many each text has."""
    texts = pa.concat_arrays([texts.fill_null("")])
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = data.to_pybytes()[edges[0] : edges[-1]] if data is not None else b""
    edges -= edges[0]
    signs = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    at = np.arange(len(signs) + 1, dtype=np.int64)
    if len(signs) < len(raw):
        wide = 1 + (signs >= 0x80).astype(np.int64) + (signs >= 0x800) + (signs >= 0x10000)
        at[1:] = np.cumsum(wide)
    inside = word[signs]
    begins = np.ones(len(signs), bool)
    begins[1:] = ~(inside[1:] & inside[:-1])
    begins[np.searchsorted(at, edges[:-1][np.diff(edges) > 0])] = True
    starts = at[:-1][begins]
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(raw))
    return tokens, np.diff(np.searchsorted(starts, edges))


def _parcel(number: int, held: list[pa.RecordBatch], texts: list[str], word: np.ndarray) -> pa.RecordBatch:
    """One row of a parcel; its words begin with the ``own`` ones, those of first texts."""
    cut_up = [[_cut_up(b[t], word) for b in held] for t in texts]
    lengths = [np.concatenate([n for _, n in x]) for x in cut_up]
    flats = [pa.concat_arrays([tokens for tokens, _ in x]) for x in cut_up]
    numbers, words = _numbered(pa.concat_arrays(flats))
    mine = np.zeros(len(words), bool)
    mine[numbers[: len(flats[0])]] = True
    order = np.argsort(~mine, kind="stable")
    place = np.empty(len(words), np.int32)
    place[order] = np.arange(len(words), dtype=np.int32)
    # the texts of a row stand side by side, where a repeated text packs well
    sizes, mixed, before = sum(lengths), np.empty(len(numbers), np.int32), np.zeros(len(lengths[0]), np.int64)
    rows, done = np.cumsum(sizes) - sizes, 0
    for n in lengths:
        to = np.repeat(rows + before - (np.cumsum(n) - n), n) + np.arange(n.sum())
        mixed[to] = place[numbers[done : done + n.sum()]]
        before, done = before + n, done + int(n.sum())
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    table = pa.Table.from_batches(held)
    body = table.drop_columns(texts)
    for i, (t, n) in enumerate(zip(texts, lengths)):
        null = table[t].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        body = body.append_column(f"__n{i}", pa.array(n, pa.int32(), mask=null))
    body = body.append_column("__t", pa.ListArray.from_arrays(pa.array(offsets), pa.array(mixed, pa.int32())))
    listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.take(pa.array(order)).cast(pa.string()))
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), pa.array([int(mine.sum())], pa.int32()), listed, pa.array([_closed(body.combine_chunks())], pa.binary()),
    ], ["parcel", "own", "words", "body"])


def _pack(texts: list[str], word: bytes, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, held, full = TaskContext.get().partitionId() << 32, [], 0
    table = np.unpackbits(np.frombuffer(word, np.uint8)).astype(bool)
    for batch in batches:
        sizes = sum(pc.binary_length(batch[t]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
        for begin, end in _ranges(sizes, most):
            held.append(batch.slice(begin, end - begin))
            full += int(sizes[begin:end].sum())
            if full >= most:
                yield _parcel(number, held, texts, table)
                number, held, full = number + 1, [], 0
    if held:
        yield _parcel(number, held, texts, table)


_words: dict[str, bytes] = {}


def word_signs(spark: SparkSession) -> bytes:
    """A bit for every code point: is it a letter, digit or ``_`` as Spark's patterns have it?"""
    app = spark.sparkContext.applicationId
    if app not in _words:
        every = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x110000))))
        kept = spark.createDataFrame([(every,)], "c string").select(F.regexp_replace("c", r"[^\p{L}\p{N}_]", "").alias("c")).first()["c"]
        table = np.zeros(0x110000, bool)
        table[np.frombuffer(kept.encode("utf-32-le"), np.uint32)] = True
        _words[app] = np.packbits(table).tobytes()
    return _words[app]


class Stretch(NamedTuple):
    """Some rows of a parcel: their other columns, each text as a list of token numbers, and the words and terms of the parcel."""

    rest: pa.Table
    texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # numbers, sizes, which are null
    words: pa.Array
    targets: pa.Array
    find: Callable[[np.ndarray, np.ndarray], Places]

    def places(self, text: int) -> Places:
        numbers, sizes, _ = self.texts[text]
        return self.find(numbers, sizes)

    def surfaces(self, p: Places) -> tuple[np.ndarray, pa.Array]:
        """Numbers of the places' surfaces, and the surfaces."""
        begin = p.starts[p.row] + p.start
        ids = p.numbers[begin].astype(np.int64)
        more: dict[str, int] = {}
        longer = np.flatnonzero(p.stop - p.start > 1)
        for i, b, n in zip(longer.tolist(), begin[longer].tolist(), (p.stop - p.start)[longer].tolist()):
            said = "".join(self.words.take(pa.array(p.numbers[b : b + n])).to_pylist())
            ids[i] = more.setdefault(said, len(self.words) + len(more))
        return ids, pa.concat_arrays([self.words, pa.array(list(more), pa.string())])

    def woven(self, text: int, p: Places | None = None) -> pa.Array:
        """The text with the places replaced by their targets; a term without one leaves its place as it is."""
        numbers, sizes, null = self.texts[text]
        pieces, n = numbers.astype(np.int64), len(self.words)
        if p is not None and len(p.row):
            said = self.targets.is_valid().to_numpy(zero_copy_only=False)[p.term]
            begin, length, term = (p.starts[p.row] + p.start)[said], (p.stop - p.start)[said], p.term[said]
            pieces[begin] = n + term
            inner = np.repeat(begin + 1, length - 1) + np.arange((length - 1).sum()) - np.repeat(np.cumsum(length - 1) - (length - 1), length - 1)
            pieces[inner] = n + len(self.targets)
        spoken = pa.concat_arrays([self.words, self.targets.fill_null(""), pa.array([""])]).take(pa.array(pieces))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, spoken), "")
        return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), joined)


def _finder(words: pa.Array, folded: pa.Array, answers: pa.Table) -> Callable[[np.ndarray, np.ndarray], Places]:
    """Every place of the answered terms in texts given as numbers of ``words``; ``folded`` has nulls for words that are their own folded form."""
    fold_of, folds = _numbered(pc.coalesce(folded, words))
    head, rest = answers["no"].to_numpy(), answers["tokens"].combine_chunks()

    def placed(row, start, stop, term, numbers, sizes) -> Places:
        return Places(len(sizes), row, start, stop, term, np.concatenate([[0], np.cumsum(sizes)]), [], numbers)

    if rest.null_count == len(rest):
        term_of = np.full(len(folds) + 1, -1, np.int64)
        term_of[head] = np.arange(len(head))
        term_of = term_of[fold_of]

        def single(numbers: np.ndarray, sizes: np.ndarray) -> Places:
            terms = term_of[numbers]
            at = np.flatnonzero(terms >= 0)
            starts = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(sizes)), sizes)[at]
            start = at - starts[row]
            return placed(row, start, start + 1, terms[at], numbers, sizes)

        return single

    number = {w: i for i, w in enumerate(folds.to_pylist())}
    lists = [[alone] if tokens is None else [number.get(t) for t in json.loads(tokens)] for alone, tokens in zip(head.tolist(), rest.to_pylist())]
    known = [(tuple(x), i, None) for i, x in enumerate(lists) if None not in x]
    machine = TokenAutomaton(known)
    node_of = np.array([machine.number(i) for i in range(len(folds))] or [0], np.int64)[fold_of]
    term_no = np.array(machine.keys, np.int64)

    def several(numbers: np.ndarray, sizes: np.ndarray) -> Places:
        row, start, stop, which = machine.located(node_of[numbers], sizes)
        return placed(row, start, stop, term_no[which], numbers, sizes)

    return several


def _stretches(most: int, body: pa.Table, texts: int, words: pa.Array, targets: pa.Array, find: Callable) -> Iterator[Stretch]:
    lists = body["__t"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    numbers, starts = lists.values.to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
    rest = body.drop_columns(["__t", *[f"__n{i}" for i in range(texts)]])
    lengths = [body[f"__n{i}"].combine_chunks() for i in range(texts)]
    for begin, end in _ranges(sizes, most):
        flat, parts, before = numbers[starts[begin] : starts[end]], [], np.zeros(end - begin, np.int64)
        inside = np.arange(len(flat)) - np.repeat(starts[begin:end] - starts[begin], sizes[begin:end])
        for length in lengths:
            own = length.slice(begin, end - begin)
            n = own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            within = (inside >= np.repeat(before, sizes[begin:end])) & (inside < np.repeat(before + n, sizes[begin:end]))
            parts.append((flat[within], n, own.is_null().to_numpy(zero_copy_only=False)))
            before = before + n
        yield Stretch(rest.slice(begin, end - begin), parts, words, targets, find)


def fold_word(word: Column) -> Column:
    """``T.fold``, which for a word in ASCII is its lower case."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(T.fold(word))


def in_parcels(rows: DataFrame, texts: list[str], terms: DataFrame, work: Callable[[Stretch], pa.Table], schema: str) -> DataFrame:
    """``work`` done on all ``rows``, with every term (written: ``tokens``, folded, and ``target``) that occurs in the first of ``texts``.

    A longer term goes to the parcels that have the token which the fewest terms have, so that a common first word sends nothing about.
    """
    pack = partial(_pack, texts, word_signs(rows.sparkSession), PARCEL_BYTES * len(texts))
    packed = cut(rows.mapInArrow(pack, _PACKED))
    asked = packed.select("parcel", F.posexplode(F.array_distinct(F.transform(F.slice("words", F.lit(1), F.col("own")), fold_word))).alias("no", "__token"))
    answers = asked.join(_by_rarest(terms), "__token").select(F.col("parcel").alias("to"), "no", F.to_json("tokens").alias("tokens"), "target")
    count, most = len(texts), STRETCH_TOKENS

    def run(parcels: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(parcels):
            return wanted.empty_table()
        words, forms = (c.combine_chunks() for c in _opened(parcels["said"][0]).columns)
        targets = pa.array(answers["target"].combine_chunks(), pa.string())
        find = _finder(words, forms, answers)
        body = _opened(parcels["body"][0]).combine_chunks()
        return pa.concat_tables([work(s) for s in _stretches(most, body, count, words, targets, find)])

    wanted = to_arrow_schema(StructType.fromDDL(schema))
    same = F.transform("words", lambda w: T.let(fold_word(w), lambda f: F.nullif(f, w)))
    whole = packed.select("parcel", "words", same.alias("folded"), "body").mapInArrow(_squeeze, "parcel long, said binary, body binary")
    return whole.groupBy("parcel").cogroup(answers.groupBy("to")).applyInArrow(run, schema)


def _by_rarest(terms: DataFrame) -> DataFrame:
    """Terms by the token that the fewest terms have: ``__token, tokens, target``; ``tokens`` is null for a term of one."""
    single = terms.filter(F.size("tokens") == 1).select(F.col("tokens")[0].alias("__token"), F.lit(None).cast("array<string>").alias("tokens"), "target")
    longer = terms.filter(F.size("tokens") > 1)
    if longer.isEmpty():
        return single
    by_token = longer.select(F.explode(F.array_distinct("tokens")).alias("__token"), "tokens", "target")
    heat = by_token.groupBy("__token").agg(F.count(F.lit(1)).alias("__n"))
    rarest = by_token.join(heat, "__token").groupBy("tokens").agg(F.min_by(F.struct("__token", "target"), F.struct("__n", "__token")).alias("b"))
    return single.unionByName(rarest.select("b.__token", "tokens", "b.target"))
