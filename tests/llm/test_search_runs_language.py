"""Operators on searching, periodic runs and languages against plain Python."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from segloom.llm import impact_search, periodic_runs, rank_order

SPACED = re.compile("[^\x20\x09-\x0d]+")


# periodic runs ------------------------------------------------------------------------------------


def plain_runs(words):
    """All runs, lag by lag."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_row(words):
    runs = plain_runs(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(runs), *best, best[1] * 1000 // best[2] if runs else None,
        sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def planted(doc_id, text):
    words = SPACED.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def in_block(texts):
    """Runs of several texts as ``find_runs`` sees them."""
    numbers = {}
    sizes = np.array([len(t) for t in texts])
    x = []
    for i, t in enumerate(texts):
        x += [numbers.setdefault(w, len(numbers)) for w in t] + [10**6 + i]
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    out = [[] for _ in texts]
    for a, b, q in periodic_runs.find_runs(np.array(x, np.int64), sizes):
        at = int(np.searchsorted(starts, a, "right")) - 1
        out[at].append((a - int(starts[at]), b - a, q))
    return out


def test_runs_of_whole_table_equal_lag_scan(spark):
    got = {r.doc_id: tuple(r)[1:] for r in entry.queries()["op12_minimizer_runs"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    assert any(row[0] for row in got.values())
    for r in docs:
        assert got[r.doc_id] == plain_row(planted(r.doc_id, r.text)), r.doc_id


def test_long_periods_of_any_kind():
    rng = random.Random(5)
    texts = []
    for q in [1, 2, 7, 23, 24, 25, 26, 35, 36, 37, 53, 54, 55, 80, 81, 121, 122, 200, 301]:
        for alphabet in (2, 5, 1000):
            period = [rng.randrange(alphabet) for _ in range(q)]
            n = 3 * q + rng.choice([-1, 0, 1, q // 2])
            body = (period * 5)[:n]
            texts.append([rng.randrange(alphabet) for _ in range(rng.randrange(30))] + body + [rng.randrange(alphabet) for _ in range(rng.randrange(30))])
    texts += [[], [1], [1] * 500, ([1] * 40 + [2]) * 4, list(range(60)) * 3 + list(range(30)) * 6]
    # a period that itself repeats, and Fibonacci words
    a, b = [1], [1, 2]
    for _ in range(12):
        a, b = b, b + a
    texts.append(b)
    assert in_block(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.integers(1, 6), st.integers(0, 40)), max_size=4))
def test_runs_of_random_texts(parts):
    texts = [(p * k + [9] * 1 + p[:extra]) for p, k, extra in parts]
    joined = [w for t in texts for w in t]
    assert in_block([*texts, joined]) == [plain_runs(t) for t in [*texts, joined]]


def test_odd_rows_of_runs(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, " ".join(["la"] * 30), "y"), (None, " ".join(["la"] * 30), "y"), (3, "a\x00b \t c", "z"), (4, " \n ", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs string")
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    by = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=repr)
    assert by == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (None, 30, [(0, 30, 1)], "la"), (None, 30, [(0, 30, 1)], "la"), (3, 2, [], "a\x00b c"), (4, 0, [], ""),
    ], key=repr)
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


def test_very_long_text_of_runs(spark):
    words = [f"w{i}" for i in range(5000)] * 3 + ["end"] * 40
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    r = periodic_runs.periodic_runs(docs).first()
    assert [tuple(x) for x in r.runs] == [(0, 15000, 5000), (15000, 40, 1)]


# ranked search ------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_search(docs, items, k=10):
    words = [(d, WORD.findall(lowered(t))) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(WORD.findall(lowered(text)))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, w in words:
            m = 10 + 90 * len(w) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m))
                for t in terms if t in w
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d, score))
        out += [(item, i + 1, d, score) for i, (_, _, _, d, score) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def search(spark, docs, items, **kw):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    rows = impact_search.top_documents(frame, spark.createDataFrame(items, "item_id string, text string"), **kw).collect()
    return sorted((tuple(r) for r in rows), key=repr)


ODD = [
    (1, "Alpha beta beta, gamma"), (2, None), (3, ""), (4, "!!!"), (5, "alpha"), (6, "alpha"), (None, "alpha"), (None, "alpha"),
    (7, "delta " * 400 + "beta"), (8, "ÉTÉ été beta"), (9, "gamma delta epsilon"), (9, "gamma delta epsilon"),
]
ITEMS = [("a", "alpha BETA"), ("b", None), ("c", "nothing here"), ("d", "été"), (None, "delta"), (None, "gamma"), ("e", "gamma gamma epsilon"), ("e", "delta")]


def test_odd_rows_of_search(spark):
    assert search(spark, ODD, ITEMS) == plain_search(ODD, ITEMS)
    assert search(spark, ODD, ITEMS, k=2) == plain_search(ODD, ITEMS, 2)
    assert search(spark, [], ITEMS) == [] and search(spark, ODD, []) == [] and search(spark, [(2, None)], ITEMS) == []


def test_search_prunes_and_stays_exact(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(300)], k=rng.randrange(1, 120)))) for i in range(1500)]
    docs += [(2000 + i, docs[7][1]) for i in range(30)]  # copies: ties over many buckets
    items = [(f"q{i}", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))) for i in range(40)]
    monkeypatch.setattr(impact_search, "SEEDS", 64)
    assert search(spark, docs, items) == plain_search(docs, items)
    monkeypatch.setattr(impact_search, "PACK_TERMS", 25)
    assert search(spark, docs, items) == plain_search(docs, items)


def test_bounds_leave_out_but_lose_nothing():
    rng = np.random.default_rng(3)
    owner = np.repeat(np.arange(400), 6)
    terms = np.concatenate([rng.choice(40, 6, replace=False) for _ in range(400)])
    bucket = impact_search.Bucket(np.arange(400), terms, rng.integers(1, 900_000, len(terms)), owner)
    pruned = 0
    for _ in range(60):
        chosen = rng.choice(40, 5, replace=False).tolist()
        query = impact_search.Query(chosen, rng.integers(1, 9000, 5).tolist())
        rows, scores = bucket.scores(query, None)
        for floor in np.sort(scores)[[-1, -5, -20]].tolist():
            among = bucket.survivors(query, floor)
            if among is not None:
                pruned += int((~among).sum())
                assert among[rows[scores >= floor]].all()
    assert pruned > 0


# languages ----------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op13_rank_order"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.size(F.split("text", r"\s+")).alias("words"))
    judged = got.filter("held_out").join(truth, "doc_id").filter("lang is not null and words >= 20").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*"), F.min("score"), F.max("score")
    ).first()
    assert judged[0] >= 0.97 and judged[1] > 100 and judged[2] >= 0 and judged[3] <= 1


def test_odd_rows_of_languages(spark):
    training = spark.createDataFrame(
        [("en", "the cat and the dog and the house"), ("de", "der hund und die katze und das haus"), (None, "ni"), ("xx", None), ("yy", "123 !!")],
        "lang string, text string",
    )
    rows = [(1, "the house and the cat", "a"), (2, "das haus und der hund", "b"), (3, None, "c"), (4, "", "d"), (5, "42 -- !?", "e"), (None, "THE DOG", "f"), (None, "THE DOG", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    profiles = rank_order.language_profiles(training)
    assert {r.lang for r in profiles.select("lang").distinct().collect()} == {"en", "de"}
    got = rank_order.predict_languages(docs, profiles)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    found = sorted(((r.doc_id, r.lang_pred) for r in got.collect()), key=repr)
    assert found == sorted([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (None, "en")], key=repr)
    assert all(0 <= r.score <= 1 for r in got.collect())
    nothing = rank_order.predict_languages(docs, rank_order.language_profiles(training.limit(0)))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    assert rank_order.predict_languages(docs.limit(0), profiles).collect() == []


def test_languages_in_packs(spark, monkeypatch):
    training = spark.createDataFrame([(f"l{i}", f"{chr(97 + i)}{chr(98 + i)} " * 9) for i in range(12)], "lang string, text string")
    docs = spark.createDataFrame([(i, f"{chr(97 + i)}{chr(98 + i)} {chr(97 + i)}") for i in range(12)], "doc_id long, text string")
    profiles = rank_order.language_profiles(training)
    whole = sorted(map(tuple, rank_order.predict_languages(docs, profiles).collect()))
    monkeypatch.setattr(rank_order, "PACK_LANGUAGES", 2)
    assert sorted(map(tuple, rank_order.predict_languages(docs, profiles).collect())) == whole
    assert [r[2] for r in whole] == [f"l{i}" for i in range(12)]


@pytest.mark.parametrize("piece", [3, 5, 8])
def test_grams_of_long_texts_piece_by_piece(monkeypatch, piece):
    text = "Ein Haus, zwei Häuser; und (noch) ein Haus 12 am See."
    whole = {int(c): int(n) for c, n in zip(*rank_order.gram_counts(text))}
    monkeypatch.setattr(rank_order, "PIECE", piece)
    assert {int(c): int(n) for c, n in zip(*rank_order.gram_counts(text)) if n} == whole


def test_head_rows_spread_over_groups():
    from segloom.llm import tokens

    groups = {tokens.head_group(task, number) for task in range(200) for number in range(20)}
    assert len(groups) == 4000 and max(groups) < 0 and min(groups) >= -(1 << 31)
    assert len({g % 32 for g in groups if g}) == 32
