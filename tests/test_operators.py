import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from segloom.catalog import fixtures, flows
from segloom.operators import batching as H
from segloom.operators import blocks as B
from segloom.operators import fit as J
from segloom.operators import glossary as G
from segloom.operators import jobs as K
from segloom.operators import ledger as L
from segloom.operators import matching as M
from segloom.operators import review as V
from segloom.operators import style as S
from segloom.operators import sweep as W
from segloom.operators.repetition import repetition_plan
from segloom.sources import glossary_files as Z

SEGMENT = (
    "deck_id string, idx int, slide_index long, shape_index int, paragraph_index int, original_text string, target string, "
    "is_note boolean, container_id string, container_kind string, slide_title string"
)


def bitext(spark, pairs):
    return spark.createDataFrame(
        [("d", i, i, 0, 0, s, t, False, f"s{i}", "textbox", None) for i, (s, t) in enumerate(pairs)], SEGMENT
    )


def terms(spark, pairs):
    return spark.createDataFrame(
        [("g", 1, i, s, t, None) for i, (s, t) in enumerate(pairs)],
        "glossary_id string, priority int, pos int, source string, target string, notes string",
    )


def test_matching_boundaries_and_substitution(spark):
    b = bitext(spark, [("게임팀 공지사항 gameplay", ""), ("게임 공지 Game smart director", "")])
    g = terms(spark, [("게임", "Game"), ("게임팀", "Game Team"), ("공지", r"\1 Notice"), ("game", "게임"), ("smart director", "SD")])
    got = {r["idx"]: r["prepared_text"] for r in M.apply_glossary(b, g).collect()}
    assert got == {0: "Game Team 공지사항 gameplay", 1: r"Game \1 Notice 게임 SD"}
    key = ["deck_id", "idx", "surface", "target", "n"]
    one = sorted(tuple(r[c] for c in key) for r in M.glossary_match(b, g).collect())
    other = sorted(tuple(r[c] for c in key) for r in M.glossary_match_ngram(b, g).collect())
    assert one == other and ("d", 1, "Game", "게임", 1) in one


def test_matching_folds_both_sides_at_any_length(spark):
    long = " ".join(f"w{i}" for i in range(300))
    b = bitext(spark, [("Der ſun und die STRASSE", ""), ("so: " + long.upper() + " end", "")])
    g = terms(spark, [("sun", "Sonne"), ("straße", "road"), (long, "LONG")] + [(f"other{i}", "x") for i in range(40)])
    got = {(r["idx"], r["target"]) for r in M.glossary_match(b, g).collect()}
    assert got == {(0, "Sonne"), (0, "road"), (1, "LONG")}
    texts = {r["idx"]: r["prepared_text"] for r in M.apply_glossary(b, g).collect()}
    assert texts == {0: "Der Sonne und die road", 1: "so: LONG end"}


def test_enforcement_uses_own_terms_only(spark):
    b = bitext(spark, [("공지", "Notice 공지"), ("Notice", "Notice 공지"), ("none", "Notice 공지")])
    g = terms(spark, [("공지", "Notice"), ("Notice", "공지")])
    got = {r["idx"]: r["target"] for r in M.enforce_glossary(b, g).collect()}
    assert got == {0: "Notice Notice", 1: "공지 공지", 2: "Notice 공지"}


def test_term_paths_agree(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["alpha", "beta", "alphabet", "ga", "gamma ray", "ray"]
    b = bitext(spark, [(" ".join(rnd.choices(words, k=4)), " ".join(rnd.choices(["A", "B", "C"], k=3))) for _ in range(80)])
    g = terms(spark, [(w, rnd.choice("ABC")) for w in words])

    def run(**kw):
        return sorted((r["idx"], r["term_source"]) for r in W.term_violation_join(b, g, **kw).collect())

    want = sorted(
        (r["idx"], t["source"]) for r, t in itertools.product(b.collect(), g.collect())
        if t["source"] in r["original_text"] and t["target"].lower() not in r["target"].lower()
    )
    assert run() == want


def test_sweep(spark):
    b = bitext(spark, [
        ("보급 상자 등장 주기 단축", "Shorten crate cycle"), ("보급 상자 등장 주기 단축", "Reduce crate spawn"), ("저지력 조정", "Stopping power"),
        ("3", "3"), ("R2", "R2"), ("한글 문장", "한글 문장"), ("PUBG", "PUBG"),
    ])
    got = W.run_sweep(b, terms(spark, [("저지력", "Aim Punch")]), source_lang="한국어", target_lang="영어").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["type"], r["idx"], r["severity"]) for r in got] == [
        (1, "terminology.violation", 2, "major"), (2, "consistency.phrase", 1, "major"), (3, "accuracy.omission", 5, "critical")]
    assert got[0]["suggested_fix"] == "Aim Punch" and got[1]["location"]["slide"] == 2 and got[1]["related_location"]["slide"] == 1


def test_batch_sizes(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 300, 1000)], "n int")
    sizes = {r["n"]: r["batch_size"] for r in H.batch_size(df).collect()}
    assert sizes[0] == 1 and sizes[1] == 1 and -(-300 // sizes[300]) >= 7
    fifty = H.batch_size(df.filter("n = 1000"), min_batch=10, concurrency=2, wave=1.0, target_batches=20)
    assert fifty.first()["batch_size"] == 50


def test_resolve_outputs(spark):
    rows = [("d", b, i, b * 3 + i - 1, f"s{b}{i}") for b in range(5) for i in (1, 2, 3)]
    batched = spark.createDataFrame(rows, "deck_id string, batch_no int, item int, idx int, original_text string")
    replies = [
        (0, 1, [(1, "T1"), (3, "T3")]), (0, 2, [(1, "U1"), (3, "U3")]),          # both with gaps: the first, padded
        (1, 1, [(1, "T1"), (3, "T3")]), (1, 2, [(3, "U3"), (1, "U1"), (2, "U2")]),  # complete retry
        (2, 1, [(1, "T1"), (1, "T2"), (9, "T9"), (9, "T10")]),                     # unusable: by position, trimmed
        (3, 1, [(2, "T2"), (1, "T1"), (3, "T3")]),                               # complete
        (4, 1, [(0, "T0")]),                                                     # unusable: padded
    ]
    out = spark.createDataFrame(
        [("d", b, a, i, n, t) for b, a, items in replies for n, (i, t) in enumerate(items)],
        "deck_id string, batch_no int, attempt int, item_index int, seq int, text string",
    )
    got = [r["target"] for r in H.resolve_outputs(batched, out).orderBy("idx").collect()]
    assert got == ["T1", "s02", "T3", "U1", "U2", "U3", "T1", "T2", "T9", "T1", "T2", "T3", "T0", "s42", "s43"]
    assert sorted(r["batch_no"] for r in H.retry_set(batched, out.filter("attempt = 1")).collect()) == [0, 1, 2, 4]


def test_progress(spark):
    done = spark.createDataFrame([("d", 2, 30), ("d", 1, 30), ("d", 3, 30)], "deck_id string, done_at int, size int")
    totals = spark.createDataFrame([("d", 3, 90)], "deck_id string, total_batches int, total_sentences int")
    got = H.progress_series(done, totals).orderBy("done_at").collect()
    assert [(r["percent"], r["current_sentence"]) for r in got] == [(33, 30), (56, 60), (80, 90)]


def test_localise_gives_every_segment_its_text(spark):
    b = bitext(spark, [("one", ""), ("two", ""), ("one", ""), (" ", ""), ("two ", "")])
    got = H.localise(b.drop("target"), lambda texts: [t.upper() for t in texts], size=1).orderBy("idx").collect()
    assert [r["target"] for r in got] == ["ONE", "TWO", "ONE", "", "TWO"]


def test_blocks_equal_the_sequential_rule(spark):
    rnd = random.Random(7)
    rows, idx = [], 0
    for c in range(60):
        par = 0
        for _ in range(rnd.randint(1, 9)):
            par += rnd.choice([1, 1, 1, 2])
            text = rnd.choice(["word", "Word", "word,", "Word.", "word:)"])
            rows.append(("d", idx, c, 0, par, text, "", False, f"s{c}", rnd.choice(["textbox", "textbox", "body"]), None))
            idx += 1
    want, reasons, block = {}, {}, []
    for i, r in enumerate(rows):
        why = "container"
        if block:
            p = rows[block[-1]]
            why = (
                "container" if p[8] != r[8] else "gap" if r[4] != p[4] + 1 else "kind" if r[9] == "body" else "cap" if len(block) >= 4
                else "not_continuation" if not r[5][0].islower() and not p[5].endswith(",")
                else "sentence_end" if p[5] in ("Word.", "word:)") else ""
            )
            if why:
                reasons[block[0]] = why
        block = block + [i] if block and not why else [i]
        want[i] = block[0]
    reasons[block[0]] = "end"
    df = spark.createDataFrame(rows, SEGMENT)
    assert {r["idx"]: r["block_id"] for r in B.merge_blocks(df).collect()} == want
    assert {r["block_id"]: r["reason"] for r in B.block_refusal_reason(df).collect()} == reasons


def test_suggest_fix(spark):
    rows = [
        ("d", 0, 1, "terminology.violation", "get the battle  pass now", "Battle Pass", "배틀패스"),
        ("d", 1, 2, "terminology.violation", "the 배틀패스 is", "Battle Pass", "배틀패스"),
        ("d", 2, 3, "terminology.violation", "Buy the Combat Pass today", "Battle Pass", "배틀패스"),
        ("d", 3, 4, "terminology.violation", "Battle Pass here", "Battle Pass", "배틀패스"),
        ("d", 4, 5, "fit.overflow", "the battle pass", "Battle Pass", None),
        ("d", 5, 6, "terminology.violation", "unrelated words", "Battle Pass", "배틀패스"),
    ]
    df = spark.createDataFrame(rows, "deck_id string, idx int, ordinal int, type string, target string, suggested_fix string, term_source string")
    got = {r["idx"]: (r["confidence"], r["new_target"]) for r in B.suggest_fix(df).collect()}
    assert got == {
        0: ("certain", "get the Battle Pass now"), 1: ("certain", "the Battle Pass is"), 2: ("estimated", "Buy the Battle Pass today")}


def test_partial_phrases(spark):
    targets = ["x", "활성화 모드", "비활성화 모드", "활성화A", "활성화 활성화", "concat CAT", "the catalog", "漢字語x漢", "CATS"]
    b = bitext(spark, [("s", t) for t in targets])
    edits = spark.createDataFrame(
        [("d", 1, 0, "활성화", "사용"), ("d", 2, 0, "CAT", ""), ("d", 3, 0, "漢字語", "새"), ("d", 4, 0, "12", "13")],
        "deck_id string, edit_id long, idx int, old_phrase string, new_phrase string",
    )
    got = {(r["edit_id"], r["idx"]): r["proposed_target"] for r in V.partial_phrase_candidates(edits, b).collect()}
    assert got == {(1, 1): "사용 모드", (1, 3): "사용A", (2, 5): "concat", (3, 7): "새x漢"}


def test_propagation(spark):
    b = bitext(spark, [("a", "1"), ("a", "2"), ("a", "new"), ("b", "3"), ("a", "4")])
    edits = spark.createDataFrame([("d", 9, 0, 0, "new"), ("d", 9, 1, 4, "other")], "deck_id string, op_id int, pos int, idx int, target string")
    got = {r["idx"]: r["target"] for r in V.propagate_edits(edits, repetition_plan(b), b).collect()}
    assert got == {0: "new", 1: "other", 2: "other", 4: "other"}


def test_preview_leaves_other_proposals_their_texts(spark):
    b = bitext(spark, [("a", "1"), ("a", "2"), ("a", "3"), ("b", "4")])
    proposed = spark.createDataFrame([("d", 0, 0, "x", True), ("d", 1, 1, "y", True)], "deck_id string, edit_id long, idx int, new_target string, propagate boolean")
    budgets = b.select("deck_id", "idx").withColumn("budget", F.lit(9))
    got = {r["edit_id"]: r["changed"] for r in V.edit_preview(proposed, b, repetition_plan(b), budgets)[0].collect()}
    assert got == {0: 2, 1: 2}  # its own segment and the third; not the segment of the other proposal


def test_batch_without_any_reply_is_sent_again(spark):
    seg = spark.createDataFrame([("d", i, f"line {i}") for i in range(3)], "deck_id string, idx long, original_text string")
    got = {r["idx"]: r["target"] for r in H.localise(
        seg, lambda t: t[:-1], size=2, retry_fn=lambda t: [f"<{x}>" for x in t]).collect()}
    assert got == {0: "<line 0>", 1: "<line 1>", 2: "<line 2>"}


def test_localise_writes_replies_only_and_lost_ones_keep_their_source(spark, monkeypatch):
    lines = ["a", "b ", "a", "c", "b", " ", "d", "b "]
    seg = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "deck_id string, idx long, original_text string")
    written, plain = [], H.cut
    monkeypatch.setattr(H, "cut", lambda df: written.append(df.columns) or plain(df))
    got = H.localise(seg, lambda t: [f"<{x}>" for x in t[:-1]], size=2).orderBy("idx").collect()
    assert [r["target"] for r in got] == ["<a>", "b ", "<a>", "<c>", "b ", "", "d", "b "]
    assert sum("text" in c for c in written) == 2 and not any({"original_text", "prepared_text"} & set(c) for c in written)
    written.clear()
    got = H.localise(seg, lambda t: [f"<{x}>" for x in t], size=2).orderBy("idx").collect()
    assert [r["target"] for r in got] == ["<a>", "<b>", "<a>", "<c>", "<b>", "", "<d>", "<b>"]
    assert sum("text" in c for c in written) == 1


def test_texts_do_not_move_for_readers_of_keys_alone(spark):
    """The plans of the repeat search and of numbered findings exchange digests and numbers, not texts."""
    b = bitext(spark, [("one two three", "x"), ("one two three", "y"), ("z", "z")])
    findings = W.run_sweep(b, terms(spark, [("one", "eins")]), source_lang="영어", target_lang="한국어")
    assert [(r["idx"], r["ordinal"]) for r in findings.orderBy("ordinal").collect()] == [(0, 1), (1, 2), (1, 3)]
    keys_only = findings.select("deck_id", "idx", "type", "ordinal")
    planned = keys_only._jdf.queryExecution().optimizedPlan().toString()
    assert "original_text" not in "".join(line for line in planned.splitlines() if "Join" in line or "Aggregate" in line)
    assert "format_string" not in planned
    plan = repetition_plan(b).select("idx", "canonical", "repeat_count")
    assert [tuple(r) for r in plan.orderBy("idx").collect()] == [(0, 0, 2), (1, 0, 2), (2, 2, 1)]


def test_propagation_query_edits_every_segment(spark):
    sf = "/root/testdata/sf0.001"
    edited = flows.group_edits(spark, sf).select("deck_id", "idx").distinct()
    assert edited.count() == fixtures.segments(spark, sf).count()


def test_phrase_search_does_not_copy_texts_per_word(spark):
    b = bitext(spark, [("a", "stone two"), ("b", "stone three")])
    edits = spark.createDataFrame([("d", 1, 0, "stone", "NEW")], "deck_id string, edit_id long, idx int, old_phrase string, new_phrase string")
    found = V.partial_phrase_candidates(edits, b)
    assert [(r["idx"], r["proposed_target"]) for r in found.collect()] == [(1, "NEW three")]
    planned = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in planned.splitlines() if "Project [" in line and "__key#" in line and "original_text#" in line]


def test_replay(spark):
    log = [
        (1, 1, "edit", 0, [(0, "x", "base")]), (1, 2, "edit", 0, [(0, "y", "base")]), (1, 3, "edit", 1, [(0, "x", "base")]),
        (1, 4, "edit", 1, [(0, "y", "base"), (1, "z", "b1")]), (1, 5, "commit", 2, []), (1, 6, "undo", 2, []), (1, 7, "undo", 3, []),
        (1, 8, "undo", 4, []), (2, 1, "undo", 0, []),
    ]
    ops = spark.createDataFrame(log, "session_id long, seq long, action string, expected_revision int, edits array<struct<idx:int,text:string,base:string>>")
    out = V.replay_edit_log(ops)
    got = [(r["accepted"], r["revision"], r["dirty"]) for r in out.filter("session_id = 1").orderBy("seq").collect()]
    assert got == [(True, 1, True), (False, 1, True), (True, 1, True), (True, 2, True), (True, 2, False), (True, 3, True), (True, 4, True), (True, 4, True)]
    assert {r["idx"]: r["target"] for r in V.drafts(out).collect()} == {0: "base", 1: "b1"}


def test_free_width_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [("d", s, i, rnd.randint(0, 9) * 10**6, rnd.randint(0, 40) * 10**5, rnd.randint(1, 3) * 10**6, rnd.randint(1, 30) * 10**5, rnd.random() < 0.8)
            for s in range(4) for i in range(12)]
    df = spark.createDataFrame(rows, "deck_id string, slide_index int, shape_id int, left_emu long, top_emu long, width_emu long, height_emu long, has_text boolean")
    want = {}
    for _, s, i, l, t, w, h, text in rows:
        left, right = l, 12192000 - (l + w)
        for _, s2, j, l2, t2, w2, h2, _ in rows:
            if s == s2 and i != j and t2 + h2 > t and t2 < t + h:
                left = min(left, l - l2 - w2) if l2 + w2 <= l else left
                right = min(right, l2 - l - w) if l2 >= l + w else right
        if text:
            want[(s, i)] = (max(0, left - 457200), max(0, right - 457200))
    got = {(r["slide_index"], r["shape_id"]): (r["free_left"], r["free_right"]) for r in J.free_width(df, 12192000).collect()}
    assert got == want


def test_overflow_ratio_counts_wrapped_lines(spark):
    frames = spark.createDataFrame([("d", 1, 1270000, 254000), ("d", 2, 0, 0)], "deck_id string, frame_id int, width_emu long, height_emu long")
    runs = spark.createDataFrame(
        [("d", 1, 0, 0, "가" * 15 + "\n" + "가", 10.0), ("d", 1, 1, 0, None, None), ("d", 2, 0, 0, "x", None)],
        "deck_id string, frame_id int, paragraph int, run_no int, text string, font_pt double",
    )
    got = {r["frame_id"]: r["ratio"] for r in J.frame_overflow_ratio(frames, runs).collect()}
    assert got[1] == pytest.approx(4 * 10 * 1.2 / 20) and got[2] is None


def test_runs_are_summed_per_line_and_size_and_breaks_carry_over(spark):
    texts = [("ab\ncd", 10.0), ("ef", 20.0), ("g\x0bh\ni", None), ("jk", 10.0), (None, None)]
    rows = [("d", f, p, i, t, pt) for f in (1, 2) for p in (0, 1) for i, (t, pt) in enumerate(texts)] + [("d", 3, 0, i, "word", 12.0) for i in range(50)]
    runs = spark.createDataFrame(rows, "deck_id string, frame_id int, paragraph int, run_no int, text string, font_pt double")
    parts = J.text_parts(runs)
    assert parts.filter("frame_id = 3").count() == 1
    first = {(r.line, r.font_pt): (r.n, r.head) for r in parts.filter("frame_id = 1 and paragraph = 0").collect()}
    assert first == {
        (0, 10.0): (1, True), (1, 10.0): (0, False), (1, 20.0): (1, True), (1, None): (1, True), (2, None): (0, False),
        (3, None): (1, False), (3, 10.0): (1, True),
    }
    frames = spark.createDataFrame([("d", f, 1270000, 254000) for f in (1, 2, 3)], "deck_id string, frame_id int, width_emu long, height_emu long")
    got = {r["frame_id"]: r["ratio"] for r in J.frame_overflow_ratio(frames, runs).collect()}
    base = 40 / 3
    assert got[1] == got[2] == pytest.approx(2 * (base + 20 + base + base) * 1.2 / 20)
    assert "text" not in parts.columns


def test_style_rules(spark):
    runs = spark.createDataFrame(
        [("d", 0, 0, "Sale ", "default"), ("d", 0, 1, "up ", "default"), ("d", 0, 2, "50%", "#FF0000")], "deck_id string, idx int, run_no int, text string, color string")
    groups = S.format_groups(runs)
    assert [(r["group_index"], r["text"], r["neutral"]) for r in groups.orderBy("group_index").collect()] == [(0, "Sale up ", True), (1, "50%", False)]
    b = bitext(spark, [("x", "할인 50%")])
    split = S.rule_based_style_split(groups, b).orderBy("seg_no").collect()
    assert [(r["text"], r["group_index"]) for r in split] == [("할인 ", 0), ("50%", 1)]
    assert S.style_status(groups, S.rule_based_style_split(groups, b)).first()["status"] == "preserved"
    styled = spark.createDataFrame([("d", 0, 0, " 할인 ", 0), ("d", 0, 1, "50%  ", 1)], "deck_id string, idx int, seg_no int, text string, group_index int")
    sizes = spark.createDataFrame([("d", 0, 2)], "deck_id string, idx int, n_groups int")
    assert S.validate_styled_segments(styled, b, sizes).first()["texts"] == ["할인 ", "50%"]


def test_job_rules(spark):
    rows = [(1, 1, "started"), (1, 2, "complete"), (1, 3, "error"), (1, 4, "progress"), (2, 1, "started"), (2, 2, "progress"),
            (3, 1, "complete"), (3, 2, "cancelled"), (4, 1, "progress")]
    ev = spark.createDataFrame([(j, e, k, 1.0 * e) for j, e, k in rows], "job_id long, event_id long, event_type string, value double").withColumn(
        "ts", F.timestamp_seconds("event_id"))
    assert {r["job_id"]: r["state"] for r in K.job_state(ev).collect()} == {1: "completed", 2: "running", 3: "cancelled", 4: "pending"}
    assert {r["job_id"]: r["event_id"] for r in K.latest_progress(ev).collect()} == {2: 2, 4: 1}


def test_upsert_counts(spark):
    old, new = terms(spark, [("A", "1")]), terms(spark, [("a", "2"), ("B", "3"), ("b", "4")])
    entries, counts = G.upsert_glossary(old, new)
    assert tuple(counts.first()) == (1, 2)
    assert sorted((r["source"], r["target"]) for r in entries.collect()) == [("a", "2"), ("b", "4")]


def test_glossary_files(spark, tmp_path):
    body = '﻿원문;번역\r\n"a;b";"multi\nline"\r\n;x\r\n=SUM;y;note\r\n'
    (tmp_path / "g.csv").write_bytes(body.encode())
    got = Z.read_glossary_csv(spark, str(tmp_path / "g.csv")).orderBy("pos").collect()
    assert [(r["source"], r["target"], r["notes"]) for r in got] == [("a;b", "multi\nline", None), ("=SUM", "y", "note")]
    Z.write_glossary_csv(terms(spark, [("=x", "1"), ('q"', "2")]), str(tmp_path / "out"))
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "out").glob("part-*"))
    assert text == '﻿원문,번역,메모\r\n"\t=x","1",""\r\n"q""","2",""\r\n'
    with pytest.raises(ValueError):
        Z.write_glossary_csv(terms(spark, [("A", "1"), ("a", "2")]), str(tmp_path / "dup"))


def test_glossary_files_go_in_lots(spark):
    """entries of many files are not held together, and those of one file meet without an exchange."""
    bodies = [f"a{i},b\r\n,x\r\n\r\nc,d{i},n\r\n" for i in range(7)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{i}" for i in range(9)]), pa.array(bodies, pa.string())], ["path", "value"])
    lots = list(Z._parsed(4, iter([batch])))
    assert len(lots) == 4 and [p for lot in lots for p in lot["path"].to_pylist()] == [f"p{i}" for i in range(9)]
    listed = [[tuple(e.values()) for e in entries] for lot in lots for entries in lot["entries"].to_pylist()]
    assert listed == [[(0, f"a{i}", "b", None), (2, "c", f"d{i}", "n")] for i in range(7)] + [[], []]
    plan = entry.queries()["read_glossary_csv"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_phrases_are_looked_for_once(spark):
    """the search in a target stands once in the plan, and words nobody asked for are dropped before the exchange."""
    rows = bitext(spark, [("s", f"alpha word{i % 3} gamma {'alpha' * (i == 4)}") for i in range(12)])
    edits = spark.createDataFrame([("d", 0, 0, "word0", "new"), ("d", 1, 1, "alpha", "")], "deck_id string, edit_id long, idx int, old_phrase string, new_phrase string")
    found = V.partial_phrase_candidates(edits, rows)
    assert sorted((r.edit_id, r.idx) for r in found.collect()) == sorted([(0, i) for i in (3, 6, 9)] + [(1, i) for i in range(12) if i not in (1, 4)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(target") == 1 and "regexp_extract_all" not in plan


def test_runs_are_packed_before_they_move(spark):
    """one row per paragraph and place is exchanged, also when runs come in no order, with gaps or with numbers twice."""
    rng = random.Random(5)
    rows = [("d", p, no, f"w{no}{'x' * rng.randrange(4)} ", rng.choice(["#FF0000", "default", None])) for p in range(9) for no in range(rng.randrange(1, 30)) if no % 7]
    rows += [("e", 1, 3, "bb", "#FF0000"), ("e", 1, 2, "a", None), ("e", 1, 3, "b", None), ("e", 1, 4, "c", None), ("e", 1, 5, "", None), ("e", None, 1, "z", None)]
    kinds = "deck_id string, idx int, run_no int, text string, color string"
    for order in (rows, rng.sample(rows, len(rows))):
        got = {(r.deck_id, r.idx): (r.text, r.length) for r in S._paragraph_texts(spark.createDataFrame(order, kinds).repartition(3)).collect()}
        want = {}
        for deck, idx, no, text, _ in sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2], r[3])):
            want[deck, idx] = want.get((deck, idx), "") + text
        assert got == {k: (t, len(t)) for k, t in want.items()}
    held = spark.createDataFrame(rows, kinds).repartition(1).sortWithinPartitions("deck_id", "idx", "run_no")
    lots = [b for b in S._pack_runs(iter(held.filter("text <> ''").select("deck_id", "idx", F.col("run_no").cast("long"), "text", F.lit(True).alias("strong")).toArrow().to_batches()))]
    assert sum(map(len, lots)) < len(rows) / 3


def test_ledger_files_are_packed(spark, tmp_path):
    """the ledger's lines lie on disk in gzip and read back as they were."""
    rows = spark.createDataFrame([(i, "same words " * 50) for i in range(200)], "id long, said string")
    L.append_json(rows, str(tmp_path / "l"))
    parts = list((tmp_path / "l").glob("part-*"))
    assert sum(p.stat().st_size for p in parts) < 20000 and spark.read.schema(rows.schema).json(str(tmp_path / "l")).exceptAll(rows).isEmpty()


def test_rules(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"en_target_rules": [{"id": "r1", "summary": "s1", "avoid": ["x"], "severity": "red", "locked_term": "Lock", "examples": [{"bad": "b", "good": "g"}]}],'
        ' "bidirectional": [{"id": "r2", "summary": "s2", "severity": "yellow", "locked_term": "No"}]}')
    rules = Z.read_rules(spark, str(tmp_path / "r.json"))
    assert Z.format_rules(rules, "영어").first()["text"] == (
        '- s1\n  avoid: x → use: —\n  [LOCKED TERM, use exactly: Lock]\n  e.g. "b" → "g"\n- s2\n  [LOCKED TERM, use exactly: No]')
    assert Z.format_rules(rules, "한국어").first()["text"].startswith("- s2")
    assert [(r["rule_id"], r["term"]) for r in Z.locked_terms(rules, "영어").collect()] == [("r1", "Lock")]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        Z.read_rules(spark, str(tmp_path / "bad.json"))


def test_paragraphs_pack_their_runs_before_the_exchange(spark):
    """Words of a paragraph move as one row: the partial aggregation stands below the exchange, and no window takes single runs."""
    from segloom.operators import style

    rows = [("d", 4, 1, "bc", "#FF0000"), ("d", 4, 0, "a", "default"), ("d", 4, 2, "defghij", "default"), ("d", 9, 0, "", "#FF0000"), ("d", 11, 0, "x", "#FF0000")]
    runs = spark.createDataFrame(rows, "deck_id string, idx long, run_no int, text string, color string")
    found = style.paragraphs_of(runs)
    got = {(r.idx, r.para_no, r.text, r.length, tuple(r.spots)) for r in found.collect()}
    assert got == {(4, 0, "abcdefghij", 10, ("front",)), (11, 1, "x", 1, ("middle",))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_list" in plan and "Window" not in plan
    # one deck has a paragraph more: its last texts are named
    other = spark.createDataFrame(rows[:3], runs.schema)
    mismatch = style.style_audit(runs, other).filter("kind = 'paragraph_count_mismatch'").collect()
    assert [(r["deck_id"], r["index"], r["source_text"], r["target_text"]) for r in mismatch] == [("d", 1, "x", "abcdefghij")]
