"""What a sweep writes and exchanges: positions and digests, not the texts of its findings."""

import random

from pyspark.sql import functions as F

from segloom.operators import automaton as A
from segloom.operators import language
from segloom.operators import sweep as W
from segloom.operators.blocks import merge_blocks

_ROWS = [
    (0, "the red house is here.", "la maison rouge"), (1, "the red house is here.", "das rote haus"), (2, "the red house is here.", "la  maison ROUGE"),
    (3, "we are in the house with it.", "we are in the house with it."), (4, "house", "HAUS Term"), (5, "", "leer"), (6, "the blue house stands there", "the blue one stands over there"),
]


def _bitext(spark):
    rows = [("d", i, i // 2, 0, i, a, b) for i, a, b in _ROWS]
    return spark.createDataFrame(rows, "deck_id string, idx long, slide_index long, shape_index int, paragraph_index int, original_text string, target string")


def _lists(spark):
    glossary = spark.createDataFrame([(0, "house", "haus"), (1, "red", "rouge"), (2, "The", "")], "pos long, source string, target string")
    locked = spark.createDataFrame([("r", "Haus", 0), ("r", "TERM", 1)], "rule_id string, term string, pos int")
    return glossary, locked, spark.createDataFrame([("d", 6, "en"), ("d", 0, "fr")], "deck_id string, idx long, code string")


def _plain(df):
    return sorted(map(str, df.select(*W.FINDING_COLUMNS).collect()))


def test_sweep_equals_its_checks_and_writes_no_texts(spark, monkeypatch):
    b, (glossary, locked, detected) = _bitext(spark), _lists(spark)
    fit = W.check_length_limit(b.withColumn("is_note", F.lit(False)), 60)
    want = W.findings_union(
        W.check_terminology(b, glossary, locked), W.check_divergence(b), W.check_untranslated(b, "영어", "한국어", detected), fit
    )
    written = []
    plain = W.cut
    monkeypatch.setattr(W, "cut", lambda df: written.append(df.columns) or plain(df))
    got = W.run_sweep(b, glossary, locked, source_lang="영어", target_lang="한국어", detected=detected, fit=fit)
    assert _plain(got) == _plain(want)
    assert {r.check_rank for r in got.collect()} == {1, 2, 3, 5}
    assert not any({"original_text", "src_n", "tgt_n"} & set(c) for c in written)
    assert sorted(r.ordinal for r in got.collect()) == list(range(1, got.count() + 1))


def test_sweep_with_a_glossary_too_large_to_carry(spark, monkeypatch):
    b, (glossary, locked, _) = _bitext(spark), _lists(spark)
    want = _plain(W.run_sweep(b, glossary, locked, source_lang="영어", target_lang="한국어"))
    monkeypatch.setattr(A, "carried", lambda terms: None)
    assert _plain(W.run_sweep(b, glossary, locked, source_lang="영어", target_lang="한국어")) == want


def test_terms_beyond_the_bound_go_to_the_texts_in_packs(spark, monkeypatch):
    b, (glossary, locked, _) = _bitext(spark), _lists(spark)
    want = _plain(W.check_terminology(b, glossary, locked))
    monkeypatch.setattr(A, "MAX_TERMS", 0)
    monkeypatch.setattr(A, "PACK_TERMS", 1)
    got = W.check_terminology(b, glossary, locked)
    assert _plain(got) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") > 2 and "Exchange" not in plan and "Join" not in plan
    assert W.check_terminology(b, glossary.limit(0)).collect() == []


def test_language_of_each_target_is_found_where_the_text_is(spark, monkeypatch):
    docs = spark.createDataFrame(
        [("the house with the blue door", "en"), ("la maison et la porte", "fr"), ("das rote haus", "de")], "text string, lang string"
    )
    b, profile = _bitext(spark), language.language_profile(docs)
    code = language.code_of(profile, F.col("target"))
    keys = ["deck_id", "idx"]
    near = sorted(map(tuple, b.select(*keys, code.alias("code")).filter("code is not null").collect()))
    joined = sorted(map(tuple, language.code_by_join(b, language.cut(profile), keys, "target").collect()))
    assert near == joined == sorted(map(tuple, language.detect_code(b, profile, keys, "target").collect())) and len({c for *_, c in near}) == 3
    decks = lambda: [tuple(r) for r in language.detect_code(b, profile, ["deck_id"], "target").collect()]
    one = decks()
    detected = language.detect_code(b, profile, keys, "target")
    with_column, with_rows = (W.check_untranslated(b, "영어", "한국어", x) for x in (code, detected))
    assert _plain(with_column) == _plain(with_rows) and {r.idx for r in with_rows.collect()} == {3, 6}
    assert "Exchange" not in with_column._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(language, "MAX_PROFILE", 0)
    assert language.code_of(profile, F.col("target")) is None and decks() == one


def test_notes_are_numbered_like_findings_and_move_no_texts(spark):
    b, (glossary, locked, detected) = _bitext(spark), _lists(spark)
    langs = dict(source_lang="영어", target_lang="한국어", detected=detected)
    said = ["deck_id", "idx", "type", "severity", "suggested_fix", "term_source", "check_rank", "ordinal"]
    numbered = W.assign_ordinals(W.sweep_notes(b, glossary, locked, **langs))
    want = W.run_sweep(b, glossary, locked, **langs)
    assert sorted(map(str, numbered.select(said).collect())) == sorted(map(str, want.select(said).collect()))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert not any(c in plan for c in ("original_text", "target", "src_n", "tgt_n"))


def test_findings_are_numbered_in_reporting_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice("de"), rng.randrange(9000), rng.choice("tu"), rank, rng.randrange(20000), 0, rng.randrange(3)) for rank in (1, 3, 5) for _ in range(150)]
    rows += [(d, i, "v", 2, g, i, 0) for d in "de" for g, i in [(5, x) for x in range(6, 60000, 700)] + [(9, 11), (7000, 7003)]]
    rows = sorted(set(rows))
    rng.shuffle(rows)
    got = W.assign_ordinals(spark.createDataFrame(rows, "deck_id string, idx long, type string, check_rank int, k1 long, k2 long, k3 long"))
    numbers = {tuple(r)[:7]: r.ordinal for r in got.collect()}
    for d in "de":
        mine = sorted((r for r in rows if r[0] == d), key=lambda r: (*r[3:], r[1], r[2]))
        assert [numbers[r] for r in mine] == list(range(1, len(mine) + 1))
    assert len(numbers) == len(rows)


def test_blocks_are_merged_without_moving_texts(spark):
    lines = [(0, "One line,"), (1, "goes on"), (2, "and ends."), (3, "New one"), (4, "again")]
    seg = spark.createDataFrame([("d", i, "s0", i, "textbox", t) for i, t in lines], "deck_id string, idx long, container_id string, paragraph_index int, container_kind string, original_text string")
    merged = merge_blocks(seg).select("deck_id", "idx", "block_id", "refusal")
    assert [(r.block_id, r.refusal) for r in merged.orderBy("idx").collect()] == [
        (0, "container"), (0, None), (0, None), (3, "not_continuation"), (3, None)
    ]
    above, _, below = merged._jdf.queryExecution().executedPlan().toString().partition("Exchange")
    assert below and "original_text" not in above
