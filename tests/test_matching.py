"""Matchers of the two sizes of glossary against each other and plain Python; reading order at any depth."""

import random
import re

import pytest
from pyspark.sql import functions as F

from segloom.catalog import core
from segloom.catalog import fixtures as X
from segloom.operators import automaton as A
from segloom.operators import extract, glossary, language
from segloom.operators import matching as M
from segloom.operators import parcels as P
from segloom.operators import sweep as W
from segloom.sources import glossary_files

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[^\W]+|\W")


def plain_matches(text, terms):
    """Leftmost, longest, without overlaps; ``terms`` by their casefolded tokens."""
    tokens = TOKEN.findall(text)
    folded, at, out = [t.casefold() for t in tokens], 0, []
    longest = max(map(len, terms), default=0)
    while at < len(tokens):
        for k in range(min(longest, len(tokens) - at), 0, -1):
            if tuple(folded[at : at + k]) in terms:
                out.append(("".join(tokens[at : at + k]), terms[tuple(folded[at : at + k])]))
                at += k
                break
        else:
            at += 1
    return out


def a_glossary(spark, words, n):
    rng = random.Random(n)
    terms = {}
    while len(terms) < n:
        terms[" ".join(rng.choices(words, k=rng.choice([1, 1, 1, 2, 3])))] = f"T{len(terms)}"
    rows = [(i, s, t) for i, (s, t) in enumerate(terms.items())]
    return spark.createDataFrame(rows, "pos int, source string, target string"), {
        tuple(t.casefold() for t in TOKEN.findall(s)): t2 for s, t2 in terms.items()
    }


@pytest.fixture(scope="module")
def texts(spark):
    words = [r.w for r in spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.split("text", r"\s+")).alias("w")).distinct().orderBy("w").collect() if r.w]
    return X.segments(spark, SF), words


@pytest.mark.parametrize("n", [10, 5000])
def test_automaton_equals_ngram_join_and_plain_python(spark, texts, n):
    segments, words = texts
    terms, plain = a_glossary(spark, words, n)
    one = sorted(map(tuple, M.glossary_match(segments, terms).collect()), key=repr)
    two = sorted(map(tuple, M.glossary_match_ngram(segments, terms).collect()), key=repr)
    assert one == two and one
    counts = {}
    for r in segments.select("deck_id", "idx", "original_text").collect():
        for surface, target in plain_matches(r.original_text, plain):
            key = (r.deck_id, r.idx, surface, target)
            counts[key] = counts.get(key, 0) + 1
    assert sorted(((*k, v) for k, v in counts.items()), key=repr) == one


def test_both_ways_substitute_and_enforce_alike(spark, texts, monkeypatch):
    segments, words = texts
    terms, _ = a_glossary(spark, words, 400)
    bitext = X.bitext(spark, SF)

    def both():
        done = M.apply_glossary(segments, terms).select("deck_id", "idx", "prepared_text").collect()
        kept = M.enforce_glossary(bitext, terms).select("deck_id", "idx", "target").collect()
        return sorted(map(tuple, done), key=repr), sorted(map(tuple, kept), key=repr)

    carried = both()
    monkeypatch.setattr(A, "MAX_TERMS", 5)
    assert both() == carried


def test_parcels_give_the_same_matches(spark, texts, monkeypatch):
    segments, words = texts
    terms, plain = a_glossary(spark, words, 600)
    carried = sorted(map(tuple, M.glossary_match(segments, terms).collect()), key=repr)
    listed = sorted(map(tuple, M.match_positions(segments, terms).collect()), key=repr)
    monkeypatch.setattr(A, "MAX_TERMS", 5)
    monkeypatch.setattr(P, "PARCEL_BYTES", 9000)
    monkeypatch.setattr(P, "STRETCH_TOKENS", 700)
    found = M.glossary_match(segments, terms)
    assert sorted(map(tuple, found.collect()), key=repr) == carried
    assert sorted(map(tuple, M.match_positions(segments, terms).collect()), key=repr) == listed
    # tokens of texts are not exchanged one by one
    assert "explode(regexp_extract_all" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("longer", [False, True])
def test_parcels_rewrite_odd_texts(spark, monkeypatch, longer):
    """whole rows come back, null and empty texts, terms without a target and words in other cases included."""
    rows = [("d", 0, "a b c a b", "B a", 7), ("d", 1, "", "a", None), ("d", 2, None, "a b", 1), ("e", 0, "A-b\nStraße", None, 2), ("e", 1, "b " * 50, "x", 3)]
    bitext = spark.createDataFrame(rows, "deck_id string, idx int, original_text string, target string, more int").repartition(2)
    entries = [(0, "b", "B1"), (1, "A", "A1"), (2, "x", None), (3, "STRASSE", "rue"), (4, "zz", "z"), (5, "b", "B2")]
    entries += [(6, "b c", "BC"), (7, "a - b", "no"), (8, "A-b", None)] if longer else []
    terms = spark.createDataFrame(entries, "pos int, source string, target string")

    def both():
        done = M.apply_glossary(bitext, terms).select(*bitext.columns, "prepared_text").collect()
        return [sorted(map(tuple, x), key=repr) for x in (done, M.enforce_glossary(bitext, terms).collect())]

    carried = both()
    monkeypatch.setattr(A, "MAX_TERMS", 2)
    monkeypatch.setattr(P, "PARCEL_BYTES", 12)
    assert both() == carried
    assert "Join" not in str(M.apply_glossary(bitext, terms)._jdf.queryExecution().executedPlan().toString()).split("FlatMapCoGroupsInArrow")[0]
    assert any("B2" in (r[-1] or "") for r in carried[0])


def test_words_of_parcels_are_those_of_spark(spark):
    rows = ["", None, "ß,Ω_٣ x\n", "𝒜𝒷-𝟙 e\u0301", "½²Ⅷ\u0870\U00031350 漢字、가나", " ", "a", "-", "é\r\nb"]
    given = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").withColumn("w", M._tokens(F.col("t"))).orderBy("i").collect()
    signs = P.np.unpackbits(P.np.frombuffer(P.word_signs(spark), P.np.uint8)).astype(bool)
    for part in (slice(0, 9), slice(3, 5), slice(1, 2)):
        tokens, sizes = P._cut_up(P.pa.array(rows)[part], signs)
        want = [r.w or [] for r in given][part]
        assert sizes.tolist() == [len(w) for w in want] and tokens.to_pylist() == sum(want, [])


def test_no_segment_is_broadcast(spark, texts):
    segments, words = texts
    terms, _ = a_glossary(spark, words, 50)
    for df in (M.glossary_match_ngram(segments, terms), M.glossary_match(segments, terms)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            assert "BuildLeft" not in line


def test_overlaps_and_empty_tables(spark):
    rows = [("d", 0, "a b c a b"), ("d", 1, ""), ("d", 2, None), ("d", 3, "A-b B")]
    segments = spark.createDataFrame(rows, "deck_id string, idx int, original_text string")
    terms = spark.createDataFrame([(0, "b c", "BC"), (1, "a b", "AB"), (2, "b", "B1")], "pos int, source string, target string")
    got = {r.idx: r.prepared_text for r in M.apply_glossary(segments, terms).collect()}
    assert got == {0: "AB c AB", 1: "", 2: None, 3: "A-B1 B1"}
    assert M.glossary_match(segments, terms.limit(0)).collect() == []
    assert M.glossary_match(segments.limit(0), terms).collect() == []


def test_terms_as_substrings_both_ways(spark, monkeypatch):
    """All words of the documents as terms: no SQL can do this in time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12)
    terms = docs.select(F.explode(F.split("text", r"[^\p{L}]+")).alias("source")).filter("source <> ''").distinct().withColumn(
        "target", F.concat(F.lit("v"), "source")
    ).withColumn("pos", F.crc32("source"))
    rows = spark.createDataFrame(
        [(r.doc_id, r.text, f"{r.text} v{r.text[:40]}") for r in docs.collect()], "idx long, original_text string, target string"
    ).withColumns({"deck_id": F.lit("d"), "slide_index": F.lit(0), "shape_index": F.lit(0), "paragraph_index": F.lit(0)})
    norm = lambda s: re.sub(r"\s+", " ", s).strip().casefold()
    listed = [(r.source, r.target) for r in terms.collect()]
    want = sorted(
        (r.idx, s) for r in rows.collect() for s, t in listed
        if norm(s) in norm(r.original_text) and norm(t) not in norm(r.target)
    )
    found = lambda: sorted((r.idx, r.term_source) for r in W.term_violation_join(rows, terms).collect())
    assert found() == want and want
    monkeypatch.setattr(A, "MAX_TERMS", 5)
    assert found() == want


def test_large_queries_take_every_word(spark):
    from segloom.catalog import QUERIES

    words = {r.source for r in core._all_words(spark, SF).select("source").distinct().collect()}
    assert any(len(w) == 1 for w in words)
    assert QUERIES["term_violation_large"](spark, SF).limit(1).count() == 1
    assert QUERIES["locked_term_large"](spark, SF).limit(1).count() == 1


def test_hits_first_for_many_terms(spark, monkeypatch):
    segments = spark.createDataFrame([("d", 0, "Alpha beta"), ("d", 1, "none"), ("d", 2, None)], "deck_id string, idx int, original_text string")
    terms = spark.createDataFrame([(i, f"w{i}") for i in range(6000)] + [(9000, "BETA"), (9001, "alp")], "pos int, source string")
    got = {r.idx: (list(r.hits), len(r.others), len(r.terms)) for r in glossary.glossary_hits_first(segments, terms).collect()}
    assert got == {0: (["BETA", "alp"], 6000, 6002), 1: ([], 6002, 6002), 2: ([], 6002, 6002)}


def test_reading_order_forty_levels_deep(spark):
    rng = random.Random(1)
    shapes, parents = [], {}
    for i in range(200):
        parents[i] = (i - 1 if i else None) if i < 45 else (None if rng.random() < 0.05 else rng.randrange(i))
        shapes.append(("d", 0, i, rng.randrange(5) if rng.random() < 0.9 else None, rng.randrange(5), i, parents[i]))
    for i, p in ((900, 901), (901, 900), (902, 999)):  # a ring, and a parent that is not there
        parents[i] = p
        shapes.append(("d", 0, i, 1, 1, i, p))
    df = spark.createDataFrame(shapes, "deck_id string, slide_index int, shape_id int, top int, left int, z int, parent_id int")
    own = {s[2]: (s[3] is None, s[3] or 0, s[4] is None, s[4] or 0, s[5]) for s in shapes}

    def path(i, seen=()):
        p = parents[i]
        return [own[i]] if p is None or p not in own or p in (900, 901) else [*path(p), own[i]]

    leaves = [i for i in own if i not in {p for p in parents.values()}]
    want = sorted(leaves, key=path)
    got = [r.shape_id for r in extract.reading_order(df).orderBy("reading_pos").collect()]
    assert got == want
    assert max(len(path(i)) for i in leaves) >= 40


def test_large_glossary_is_written_in_order(spark, tmp_path):
    rows = [(i, f"term{i}", f"t{i}", None) for i in range(7000)]
    terms = spark.createDataFrame(rows, "pos long, source string, target string, notes string").repartition(7)
    glossary_files.write_glossary_csv(terms, str(tmp_path / "large"))
    lines = "".join(p.read_text(encoding="utf-8-sig") for p in sorted((tmp_path / "large").glob("part-*"))).splitlines()
    assert len(lines) == 7001 and [x.split('"')[1] for x in lines[1:]] == [f"term{i}" for i in range(7000)]


def test_language_of_a_deck_with_a_foreign_opening(spark):
    docs = spark.createDataFrame([("en", "the house and the dog of the man"), ("de", "das haus und der hund von dem mann")], "lang string, text string")
    rows = [("d", i, "das haus und der hund", False) for i in range(60)] + [("d", 60 + i, "the house and the dog of the man", False) for i in range(300)]
    segments = spark.createDataFrame(rows, "deck_id string, idx int, original_text string, is_note boolean")
    profile = language.language_profile(docs)
    whole = language.detect_language(segments, profile).first().language
    opening = language.detect_language(language.deck_samples(segments), profile, text="sample").first().language
    assert whole != opening


def test_glossary_files_as_rows_are_read_without_an_exchange(spark, tmp_path):
    bodies = ["source,target\r\na,b\r\n", "a;b;n\r\nsource;target\r\n", "\ufeff \r\nx\r\n,y\r\nterm\tt\r\n", "x\ty\nz\t1\t \n", "", "Source,Target", 'a,"b\nc"']
    files = spark.createDataFrame([(f"f{i}", b) for i, b in enumerate(bodies)], "path string, value string")
    rows = glossary_files.glossary_records(files)
    plain = [
        ("f0", 1, "a", "b", None), ("f1", 0, "a", "b", "n"), ("f1", 1, "source", "target", None), ("f3", 0, "x", "y", None),
        ("f3", 1, "z", "1", None), ("f6", 0, "a", "b\nc", None),
    ]
    assert sorted(map(tuple, rows.collect()), key=str) == plain
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    for i, b in enumerate(bodies):
        (tmp_path / f"f{i}").write_bytes(b.encode())
    read = glossary_files.read_glossary_csv(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert sorted(map(tuple, read.collect()), key=str) == plain


def test_signatures_without_the_contents(spark, tmp_path):
    zipped, ole2 = b"PK\x03\x04", bytes.fromhex("D0CF11E0A1B11AE1")
    heads = {
        "a.pptx": zipped + b"\n" * 5, "b.ppt": ole2 + b"x\r\n" * 9, "c.bin": ole2[:7], "d.bin": b"", "e.bin": b"\n" + zipped, "f.bin": b"\xef\xbb\xbf" + zipped + b"\n",
        "g.bin": b"\xef\xbb\xbf" + zipped, "h.gz": zipped + b"no gzip", "i.zst": b"neither", "j.bin": zipped, "k.bin": ole2 + b"\n",
        "l.bin": zipped + bytes(range(256)) * 2000, "m.bin": b"plain\n" * 90000 + zipped + b"\n" + ole2, "n.bin": b"\xff\xfe\n\n", "o.bin": b"\r" + zipped,
    }
    for name, body in heads.items():
        (tmp_path / name).write_bytes(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = glossary_files.file_signatures(spark, str(tmp_path))
        largest = spark.read.text(str(tmp_path / "m.bin"), lineSep="\n").rdd.getNumPartitions()
        rows = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = glossary_files.file_signature_filter(spark.read.format("binaryFile").load(str(tmp_path)))
    assert rows == sorted(map(tuple, whole.select("path", "length", "format", "valid").collect())) and largest > 1
    assert {r[0][-5:] for r in rows if r[3]} == {".pptx", "b.ppt", "/h.gz", "j.bin", "k.bin", "l.bin"}
