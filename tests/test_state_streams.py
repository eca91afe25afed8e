"""Stateful streams against their batch forms for any order of arrival, the ledger of replayed writes, and the plane sweep."""

import random
import time

import pytest
from pyspark.sql import functions as F

from segloom.operators import fit, jobs, matching, review
from segloom.operators import sweep as W
from segloom.sources.exactly_once import Ledger
from segloom.streaming import jobs as Z
from segloom.streaming import state as Y


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream of the given batches, one micro-batch each."""

    def stream(batches, schema):
        folder = str(tmp_path / f"in{time.time_ns()}")
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        Z.use_rocksdb(spark)
        return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return stream


def test_divergence_is_withdrawn_and_made_again(spark, arriving):
    rng = random.Random(2)
    rows = [("d", i, 0, 0, i % 4, f"text {rng.randrange(6)}", rng.choice(["", "One", "two ", " TWO", "three", "four"])) for i in range(120)]
    schema = "deck_id string, idx long, slide_index long, shape_index int, paragraph_index int, original_text string, target string"
    late_first = [rows[90:], rows[40:90], rows[:3], rows[3:40]]
    changes = Z.run_available(Y.divergence_stream(arriving(late_first, schema)))
    want = W.check_divergence(spark.createDataFrame(rows, schema)).select("idx", "description").collect()
    assert sorted(map(tuple, Y.net(changes).select("idx", "description").collect())) == sorted(map(tuple, want)) and want
    assert changes.filter("change < 0").count() > 0


@pytest.mark.parametrize("states", [1, 7])
def test_texts_of_several_decks_share_states(spark, arriving, states):
    rng = random.Random(5)
    rows = [(rng.choice("de"), i, i, 0, 0, f"text {rng.randrange(9)}", rng.choice(["One", " ONE", "two", "three"])) for i in range(150)]
    schema = "deck_id string, idx long, slide_index long, shape_index int, paragraph_index int, original_text string, target string"
    want = W.check_divergence(spark.createDataFrame(rows, schema)).select("deck_id", "idx", "description").collect()
    rng.shuffle(rows)
    changes = Z.run_available(Y.divergence_stream(arriving([rows[:50], rows[50:70], rows[70:]], schema), states=states))
    assert sorted(map(tuple, Y.net(changes).select("deck_id", "idx", "description").collect())) == sorted(map(tuple, want)) and want
    assert changes.groupBy(*[c for c in changes.columns if c != "change"]).agg(F.sum("change").alias("n")).filter("n not in (0, 1)").isEmpty()


def test_dismissals_in_any_order(spark, arriving):
    rng = random.Random(4)
    log = [(rng.randrange(3), s, rng.choice(["dismiss", "restore", "edit"]), rng.randrange(-1, 5)) for s in range(90)]
    schema = "session_id long, seq long, action string, idx int"
    want = sorted(map(tuple, review.dismissal_state(spark.createDataFrame(log, schema))[0].collect()))
    rng.shuffle(log)
    changes = Z.run_available(Y.dismissal_stream(arriving([log[:20], log[20:50], log[50:]], schema)), "update")
    newest = changes.groupBy("session_id", "idx").agg(F.max_by("action", "batch_id").alias("a")).filter("a = 'dismiss'")
    assert sorted((r.session_id, r.idx) for r in newest.collect()) == want
    # only real changes: states of a key alternate
    for key in {(r.session_id, r.idx) for r in changes.collect()}:
        states = [r.action for r in changes.filter(f"session_id = {key[0]} and idx = {key[1]}").orderBy("batch_id").collect()]
        assert states[0] == "dismiss" and all(a != b for a, b in zip(states, states[1:]))


def a_log(rng, n):
    kinds = ["started", "progress", "progress", "progress", "complete", "cancelled"]
    return [(rng.randrange(6), i, i * 60.0, rng.choice(kinds), float(i)) for i in range(n)]


EVENTS = "job_id long, event_id long, at double, event_type string, value double"


def timed(df):
    return df.withColumn("ts", F.timestamp_seconds("at")).drop("at")


def test_progress_for_any_order_within_the_watermark(spark, arriving):
    rng = random.Random(9)
    log = a_log(rng, 60)
    want = sorted(map(tuple, jobs.latest_progress(timed(spark.createDataFrame(log, EVENTS))).collect()))
    shuffled = sorted(log, key=lambda r: r[2] + rng.random() * 600)
    batches = [shuffled[:15], shuffled[15:30], shuffled[30:45], shuffled[45:]]
    changes = Z.run_available(Y.progress_stream(timed(arriving(batches, EVENTS)), late="30 minutes"), "update")
    newest = changes.groupBy("job_id").agg(F.max_by(F.struct("event_id", "value"), "batch_id").alias("s")).select("job_id", "s.*")
    assert sorted(map(tuple, newest.filter("event_id is not null").collect())) == want and want


def test_timers_reap_what_the_batch_form_expires(spark, arriving):
    rng = random.Random(3)
    log = [(rng.randrange(12), i, (i * 7 + rng.randrange(5)) * 60.0, rng.choice(["started", "progress", "complete"]), 0.0) for i in range(70)]
    log = sorted(log, key=lambda r: r[2]) + [(99, 999, 9_000_000.0, "started", 0.0)]
    early, later = log[:60], log[60:]
    want = jobs.expire_idle(timed(spark.createDataFrame(log, EVENTS)))
    got = Z.run_available(Y.expire_idle_stream(timed(arriving([early, later], EVENTS))))
    newest = got.groupBy("job_id").agg(F.max("last_activity").alias("last_activity"))
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, want.collect())) and newest.count() > 3


def test_replay_answers_operations_that_share_a_predecessor(spark, arriving):
    schema = "session_id long, seq long, action string, expected_revision long, edits array<struct<idx:long,text:string,base:string>>, prior long"
    op = lambda seq, prior, text, rev: (1, seq, "edit", rev, [(0, text, "")], prior)
    batches = [[op(5, 0, "late rival", 1), op(3, 0, "b", 1)], [op(0, None, "a", 0)], [op(4, 0, "rival", 1), op(3, 0, "b", 1)]]
    got = Z.run_available(Z.replay_stream(arriving(batches, schema))).select("seq", "accepted", "revision").collect()
    assert sorted(map(tuple, got)) == [(0, True, 1), (3, True, 2), (4, False, 2), (5, False, 2)]


def test_glossary_changes_touch_only_what_changed(spark):
    schema = "pos int, source string, target string"
    one = spark.createDataFrame([(0, "a", "x"), (1, "b", "y"), (2, "c", "z")], schema)
    two = spark.createDataFrame([(0, "a", "x"), (1, "b", "other"), (3, "d", "w")], schema)
    assert sorted(r.source for r in Y.glossary_changes(one, two).collect()) == ["b", "c", "d"]
    assert Y.glossary_changes(one, one).collect() == []


def test_ledger_counts_a_repeated_write_once(spark, tmp_path):
    ledger, schema = Ledger(spark, str(tmp_path / "ledger")), "id string, n int"
    assert ledger.read(schema).collect() == []
    rows = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    assert ledger.append(rows, "run-1") and not ledger.append(rows, "run-1")
    # a writer that died before its manifest, and two that raced for one name
    rows.write.json(f"{ledger.path}/data/run-2-dead")
    for folder in ("run-3-x", "run-3-y"):
        rows.withColumn("id", F.concat("id", F.lit("3"))).write.json(f"{ledger.path}/data/{folder}")
        spark.createDataFrame([(folder, "run-3")], "folder string, write string").write.mode("append").json(f"{ledger.path}/manifest")
    assert sorted(r.id for r in ledger.read(schema).collect()) == ["a", "a3", "b", "b3"]


def plain_free(shapes, width):
    out = {}
    for i, (l, t, w, h) in enumerate(shapes):
        r, b = l + w, t + h
        near = [(l - (ol + ow), ol - r) for j, (ol, ot, ow, oh) in enumerate(shapes) if j != i and ot + oh > t and ot < b]
        left = min([l, *(a for a, _ in near if a >= 0)])
        right = min([width - r, *(a for _, a in near if a >= 0)])
        out[i] = max(0, left - 457200), max(0, right - 457200)
    return out


def test_plane_sweep_equals_strips_and_plain_python(spark, monkeypatch):
    rng = random.Random(8)
    unit = 100_000
    shapes = [tuple(rng.randrange(k) * unit for k in (120, 60, 9, 12)) for _ in range(300)] + [(unit, unit, unit, unit)] * 3
    df = spark.createDataFrame(
        [("d", 0, i, True, *s, "") for i, s in enumerate(shapes)],
        "deck_id string, slide_index int, shape_id int, has_text boolean, left_emu long, top_emu long, width_emu long, height_emu long, x string",
    )
    free = lambda: {r.shape_id: (r.free_left, r.free_right) for r in fit.free_width(df, 12192000).collect()}
    want = plain_free(shapes, 12192000)
    monkeypatch.setattr(fit, "SWEPT_SHAPES", 10)
    assert free() == want
    # strips see only shapes of some height
    tall = df.filter("height_emu > 0")
    swept_ = sorted(map(tuple, fit.free_width(tall, 12192000).collect()))
    monkeypatch.setattr(fit, "SWEPT_SHAPES", 10_000)
    assert sorted(map(tuple, fit.free_width(tall, 12192000).collect())) == swept_


def test_one_strip_of_many_shapes_is_swept():
    import numpy as np

    rng = np.random.default_rng(1)
    n = 20_000
    left = rng.integers(0, 10**7, n)
    top = rng.integers(0, 900_000, n)
    began = time.process_time()
    out = fit.swept(left, left + rng.integers(1, 1000, n), top, top + rng.integers(1, 1000, n))
    assert len(out) == n and time.process_time() - began < 20


def test_merged_sketches_stay_near_exact_counts(spark):
    matches = spark.range(200_000).select(
        F.concat(F.lit("deck"), F.col("id") % 7).alias("deck_id"), (F.col("id") % 60_000).alias("idx"),
        F.when(F.col("id") % 3 == 0, "Term").otherwise("term").alias("surface"), F.lit("t").alias("target"), F.lit(1).cast("long").alias("n"),
    )
    exact = matches.select("deck_id", "idx").distinct().count()
    for r in matching.merged_usage(matching.usage_sketches(matches)).collect():
        assert abs(r.segments - exact) <= 0.03 * exact and r.occurrences == 200_000 and r.decks == 7


def test_places_of_a_session_share_a_state(spark, arriving):
    log = [(s, i, "dismiss" if i % 3 else "restore", i % 600) for s in range(2) for i in range(1800)]
    schema = "session_id long, seq long, action string, idx int"
    stream = Y.dismissal_stream(arriving([log[900:], log[:900]], schema))
    grouped = next(line for line in str(stream._jdf.queryExecution().analyzed()).splitlines() if "TransformWithState" in line)
    assert "__range" in grouped
    changes = Z.run_available(stream, "update")
    newest = changes.groupBy("session_id", "idx").agg(F.max_by("action", "batch_id").alias("a")).filter("a = 'dismiss'")
    want = sorted(map(tuple, review.dismissal_state(spark.createDataFrame(log, schema))[0].collect()))
    assert sorted((r.session_id, r.idx) for r in newest.collect()) == want and want
