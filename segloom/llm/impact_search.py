"""Exact top-k search over integer impact vectors, in buckets of vectors ordered by length.

A document is a vector of impacts over the terms that the queries use; a query is a vector of term weights; the score
is their inner product. Vectors are sorted by length (Euclidean norm) over the whole table and cut into buckets. A query
skips a bucket as a whole when, by Cauchy-Schwarz, its own length times that of the bucket's longest vector stays below
its threshold (the k-th best score known so far, at least). Inside a bucket the threshold becomes an angle: on the
query's largest coordinates a vector can only qualify within bounds, and a coordinate whose lower bound is positive
sends the query to that term's entries alone. What survives is scored exactly, in 64-bit integers.

Scores: with N documents that hold a term, L terms in all, n terms and m = 100-90+((90*n*N) div L) of a document, df
documents with a term and tf its occurrences, the weight of a term is floor(1000*ln((2N+2)/(2df+1))) and its impact
(1000000000*tf) div (1000*tf+8*m).

Queries go in packs of bounded vocabulary (``PACK_TERMS``), which alone reach every task; each pack is one pass over the texts.

Defined results: null and empty texts, and texts without a term, are no vectors and count in no statistic; queries
without a term, or whose terms no document holds, have no rows; query rows that share an id (null is one id) are one query
with the terms of all; rows of the documents are ranked each for itself, also when they share doc_id or text; equal scores rank by
doc_id (null last), rows equal in both in any order (they cannot be
told apart); doc_ids are integers below 2**63-1; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm import tokens
from segloom.llm.tables import cut

#: Different terms of the queries that are answered together.
PACK_TERMS = 200_000
#: Vectors of a bucket, and the longest vectors that set the first thresholds.
BUCKET = 4096
SEEDS = 1024
#: Coordinates of a query that are tested against bounds.
FOCUS = 4
#: Relative slack of bounds in doubles, far above their rounding and below any integer step of a score.
SLACK = 1e-9
_LAST_DOC = 2**63 - 1

_VECTORS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
_HITS = pa.schema([("q", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def query_terms(queries: DataFrame, item: str = "item_id") -> DataFrame:
    """``item, term``: the different terms of each query."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return queries.select(F.col(item).alias("item"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def _vectors(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the numbered terms in each text that has a term at all."""
    for block in tokens.blocks(batches):
        words = tokens.Words(*tokens.bytes_of(block.column("text")), tokens.ALNUM_LOWER)
        codes, distinct = words.codes()
        known = np.array([numbers.get(w, -1) for w in distinct.to_pylist()], np.int64)
        term, owner = (known[codes], words.owner()) if words.n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        held = term >= 0
        pairs, tf = np.unique((owner[held].astype(np.int64) << 32) | term[held], return_counts=True)
        n = words.counts()
        offsets = np.searchsorted(pairs >> 32, np.arange(len(n) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (pairs & 0xFFFFFFFF, tf)]
        doc = block.column("doc_id").cast(pa.int64())
        yield pa.RecordBatch.from_arrays([doc, pa.array(n.astype(np.int64)), *lists], schema=_VECTORS).filter(pa.array(n > 0))


def _impacts(n: np.ndarray, tf: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Integer impacts; ``n`` is the document's length for each entry."""
    if documents and int(n.max(initial=0)) > (2**63 - 1) // (90 * documents):
        m = np.array([10 + 90 * x * documents // length for x in n.tolist()], np.int64)
    else:
        m = 10 + 90 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Query:
    """Weights of a query by term, largest first, and its length."""

    def __init__(self, terms: list[int], weights: list[int]):
        order = sorted(range(len(terms)), key=lambda i: (-weights[i], terms[i]))
        self.terms, self.weights = [terms[i] for i in order], [weights[i] for i in order]
        self.norm = math.sqrt(math.fsum(float(w) * w for w in self.weights))


class Bucket:
    """Vectors of similar length as entry lists by term."""

    def __init__(self, doc: np.ndarray, terms: np.ndarray, impact: np.ndarray, owner: np.ndarray):
        self.doc, self.n = doc, len(doc)
        order = np.argsort(terms, kind="stable")
        self.owner, self.impact = owner[order], impact[order]
        self.norm = np.sqrt(np.bincount(owner, impact.astype(np.float64) ** 2, self.n))
        self.longest = float(self.norm.max(initial=0.0))
        distinct, first = np.unique(terms[order], return_index=True)
        self.lists = {t: (a, b) for t, a, b in zip(distinct.tolist(), first.tolist(), [*first.tolist()[1:], len(order)])}

    def entries(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.lists.get(term, (0, 0))
        return self.owner[a:b], self.impact[a:b]

    def survivors(self, query: Query, floor: int) -> np.ndarray | None:
        """Vectors that may reach ``floor`` (None: all), by bounds on the query's largest coordinates."""
        if floor <= 0 or not query.norm or not self.longest:
            return None
        angle = floor / (query.norm * self.longest) * (1 - SLACK)
        rest = max(0.0, 1.0 - min(1.0, angle) ** 2)
        chosen = None
        for term, weight in zip(query.terms[:FOCUS], query.weights[:FOCUS]):
            q = weight / query.norm
            low = q * angle - math.sqrt(max(0.0, 1.0 - q * q) * rest) - SLACK
            if low <= 0:
                break  # vectors without this term qualify as well, and smaller coordinates bound even less
            high = 1.0 if angle <= q else min(1.0, q * angle + math.sqrt(max(0.0, 1.0 - q * q) * rest) + SLACK)
            owner, impact = self.entries(term)
            share = impact / self.norm[owner]
            inside = owner[(share >= low) & (share <= high + SLACK)]
            if chosen is None:
                chosen = np.zeros(self.n, bool)
                chosen[inside] = True
            else:
                both = np.zeros(self.n, bool)
                both[inside] = True
                chosen &= both
        return chosen

    def scores(self, query: Query, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows with a score above 0 and their exact scores."""
        total = np.zeros(self.n, np.int64)
        for term, weight in zip(query.terms, query.weights):
            owner, impact = self.entries(term)
            if among is not None:
                kept = among[owner]
                owner, impact = owner[kept], impact[kept]
            total[owner] += weight * impact
        rows = np.flatnonzero(total > 0)
        return rows, total[rows]


def search_bucket(bucket: Bucket, queries: list[Query], best: list[list[tuple[int, int]]], floors: list[int], k: int) -> None:
    """Keep in ``best`` (heaps of score and negated doc_id) the ``k`` best rows of each query seen so far."""
    for query, heap, floor in zip(queries, best, floors):
        bar = max(floor, heap[0][0] if len(heap) >= k else 0)
        if query.norm * bucket.longest * (1 + SLACK) < max(bar, 1):
            continue
        rows, scores = bucket.scores(query, bucket.survivors(query, bar))
        at = scores >= bar
        rows, scores = rows[at], scores[at]
        if len(rows) > k:
            order = np.lexsort((bucket.doc[rows], -scores))[:k]
            rows, scores = rows[order], scores[order]
        for doc, score in zip(bucket.doc[rows].tolist(), scores.tolist()):
            if len(heap) < k:
                heapq.heappush(heap, (score, -doc))
            elif (score, -doc) > heap[0]:
                heapq.heapreplace(heap, (score, -doc))


def _search(batches: Iterator[pa.RecordBatch], shared, k: int, size: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of a task for each query, from vectors that come longest first."""
    queries, floors = shared.value
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    for batch in batches:
        for at in range(0, batch.num_rows, BUCKET):
            part = batch.slice(at, BUCKET)
            lists = part.column("terms")
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            n = part.column("n").to_numpy(zero_copy_only=False)
            tf = part.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = part.column("doc_id").fill_null(_LAST_DOC).to_numpy(zero_copy_only=False)
            impact = _impacts(n[owner], tf, *size)
            search_bucket(Bucket(doc, lists.flatten().to_numpy(zero_copy_only=False), impact, owner), queries, best, floors, k)
    rows = [(q, None if doc == -_LAST_DOC else -doc, score) for q, heap in enumerate(best) for score, doc in heap]
    yield pa.RecordBatch.from_pydict(dict(zip(_HITS.names, zip(*rows) if rows else ((), (), ()))), schema=_HITS)


def _ranked(hits: DataFrame, by: Column | str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _nothing(terms: DataFrame) -> DataFrame:
    return terms.sparkSession.createDataFrame([], f"item {terms.schema['item'].dataType.simpleString()}, doc_id bigint, score bigint, rank int")


def _packs(terms: DataFrame) -> list[DataFrame]:
    """The queries in packs of bounded vocabulary, split by a hash of the item."""
    n = terms.count()
    packs = -(-n // PACK_TERMS)
    place = F.pmod(F.xxhash64("item"), F.lit(max(packs, 1)))
    return [terms.filter(place == i) for i in range(packs)]


def _top_pack(documents: DataFrame, pack: DataFrame, k: int) -> DataFrame:
    spark = documents.sparkSession
    listed = [(r.item, r.term) for r in pack.collect()]
    words = sorted({t for _, t in listed})
    numbers = {w.encode(): i for i, w in enumerate(words)}
    vectors = cut(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda batches: _vectors(batches, numbers), "doc_id bigint, n bigint, terms array<int>, tfs array<int>"
    ))
    size = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weight = {r.t: math.floor(1000 * math.log((2 * size[0] + 2) / (2 * r.df + 1))) for r in held.collect()}
    of_item: dict = {}
    for item, term in listed:
        number = numbers[term.encode()]
        if number in weight:
            of_item.setdefault(item, []).append(number)
    items = list(of_item)
    queries = [Query(of_item[i], [weight[t] for t in of_item[i]]) for i in items]
    if not items:
        return _nothing(pack)
    # buckets measure their vectors exactly; for the order doubles will do
    m = F.lit(10.0) + F.lit(90.0 * size[0] / size[1]) * F.col("n")
    length = F.sqrt(F.aggregate("tfs", F.lit(0.0), lambda s, tf: s + F.pow(F.lit(1e9) * tf / (F.lit(1000.0) * tf + F.lit(8.0) * m), F.lit(2))))
    long = vectors.filter(F.size("terms") > 0).withColumn("length", length)

    def found(rows: DataFrame, floors: list[int]) -> DataFrame:
        shared = spark.sparkContext.broadcast((queries, floors))
        return rows.mapInArrow(lambda batches: _search(batches, shared, k, tuple(size)), "q int, doc_id bigint, score bigint")

    seeds = found(long.orderBy(F.col("length").desc(), "doc_id").limit(SEEDS).drop("length"), [0] * len(items))
    floors = [0] * len(items)
    for r in seeds.groupBy("q").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("c")).filter(F.col("c") >= k).collect():
        floors[r.q] = r.s
    sorted_ = long.repartitionByRange(F.col("length").desc(), F.col("doc_id")).sortWithinPartitions(F.col("length").desc(), F.col("doc_id"))
    hits = _ranked(found(sorted_.drop("length"), floors), "q", k)
    names = spark.createDataFrame([(i, item) for i, item in enumerate(items)], f"q int, item {pack.schema['item'].dataType.simpleString()}")
    return hits.join(F.broadcast(names), "q").select("item", "doc_id", "score", "rank")


def top_documents(documents: DataFrame, queries: DataFrame, k: int = 10, item: str = "item_id") -> DataFrame:
    """The ``k`` best documents of each query: ``item, rank, doc_id, score``."""
    out, terms = None, cut(query_terms(queries, item))
    for pack in _packs(terms):
        found = _top_pack(documents, pack, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = _nothing(terms)
    return out.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
