"""Queries over batching and reassembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from segloom.catalog import fixtures as X
from segloom.catalog.core import _PLAN, SWEEP_CTE, sweep_notes
from segloom.catalog.registry import query
from segloom.catalog.terms import _DICT, _merged, tokens_sql
from segloom.operators import batching as H
from segloom.operators import repetition as R
from segloom.plans.cut import cut

_CLEAN = "trim(replace(replace(original_text, chr(13), ' '), chr(10), ' '))"
_UNIQ = f"""{_PLAN},
u AS (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY idx) - 1 AS r FROM plan WHERE canonical = idx),
ub AS (SELECT *, CAST(r // 25 AS BIGINT) AS batch_no, CAST(r % 25 AS INT) AS item FROM u)"""


def unique_batches(spark, d):
    return H.assign_batches(R.repetition_plan(X.segments(spark, d)).filter("is_unique"), 25)


@query("assign_batches", f"WITH {_UNIQ} SELECT deck_id, idx, batch_no, item FROM ub", "segments")
def _assign(spark, d):
    return unique_batches(spark, d).select("deck_id", "idx", "batch_no", "item")


_CL = "greatest(40, least(100, CAST(ceil({x}) AS BIGINT)))"


@query("batch_size", f"""
WITH a AS (SELECT doc_id AS deck_id, n_chars AS n, {_CL.format(x='n_chars / 20.0')} AS s0 FROM documents),
b AS (SELECT *, CASE WHEN s0 < 80 THEN greatest(s0, least(80, greatest(1, CAST(ceil(n / 8.0) AS BIGINT)))) ELSE s0 END AS s1 FROM a),
c AS (SELECT *, greatest(1, CAST(ceil(n / CAST(s1 AS DOUBLE)) AS BIGINT)) AS k FROM b),
e AS (SELECT *, n - (k - 1) * s1 AS rest FROM c)
SELECT deck_id, n, CAST(CASE WHEN n <= 0 THEN 1 ELSE greatest(1, least(n, CASE WHEN k > 1 AND rest > 0 AND rest < 20
  THEN {_CL.format(x='n / CAST(k - 1 AS DOUBLE)')} ELSE s1 END)) END AS INT) AS batch_size FROM e""")
def _size(spark, d):
    return H.batch_size(X.table(spark, d, "documents").select(F.col("doc_id").alias("deck_id"), F.col("n_chars").alias("n")))


_PAYLOAD = f"""
pay AS (SELECT deck_id, batch_no, string_agg((item + 1) || '. ' || CASE WHEN {_CLEAN} = '' THEN '[EMPTY]' ELSE {_CLEAN} END, chr(10) ORDER BY item) AS texts,
  string_agg(CASE WHEN is_note THEN (item + 1) || '. no length limit (speaker note)'
    ELSE (item + 1) || '. maximum ' || greatest(1, length({_CLEAN}) * 120 // 100) || ' target characters' END, chr(10) ORDER BY item) AS item_length_limits,
  CAST(count(*) AS INT) AS expected_count, CAST(min(r) + 1 AS INT) AS start_idx, CAST(max(r) + 1 AS INT) AS end_idx FROM ub GROUP BY deck_id, batch_no)"""


@query("batch_payload", f"WITH {_UNIQ}, {_PAYLOAD} SELECT * FROM pay", "segments")
def _payload(spark, d):
    return H.batch_ranges(H.batch_payload(unique_batches(spark, d), 120))


@query("safe_concurrency", f"""
WITH {_UNIQ}, {_PAYLOAD}, f AS (SELECT deck_id, greatest(1, length(texts) // 4) * 20 + 200 AS t FROM pay WHERE batch_no = 0)
SELECT deck_id, CAST(greatest(1, least(8, greatest(1, 30000 // t))) AS INT) AS concurrency FROM f""", "segments")
def _concurrency(spark, d):
    from segloom.functions import text as T

    pay = H.batch_payload(unique_batches(spark, d))
    return H.safe_concurrency(pay.withColumn("tokens", T.approx_tokens("texts") * 20 + 200))


_STATS = """
st AS (SELECT o.deck_id, o.batch_no, o.attempt, any_value(e.n) AS n, count(*) AS c, count(DISTINCT item_index) AS dc, min(item_index) AS lo, max(item_index) AS hi
  FROM model_outputs o JOIN (SELECT deck_id, batch_no, count(*) AS n FROM batched GROUP BY ALL) e USING (deck_id, batch_no) GROUP BY ALL),
att AS (SELECT deck_id, batch_no, attempt, c = dc AND lo >= 1 AND hi <= n AS usable, c = dc AND lo >= 1 AND hi <= n AND c = n AS "full" FROM st)"""


@query("align_outputs", f"""
WITH {_STATS} SELECT b.deck_id, b.batch_no, a.attempt, b.item, b.idx, o.text FROM batched b JOIN att a ON a.deck_id = b.deck_id AND a.batch_no = b.batch_no AND a.usable
LEFT JOIN model_outputs o ON o.deck_id = b.deck_id AND o.batch_no = b.batch_no AND o.attempt = a.attempt AND o.item_index = b.item""", "batched model_outputs")
def _align(spark, d):
    return H.align_outputs(X.batches_of_40(spark, d), X.model_outputs(spark, d))[0]


@query("attempt_status", f'WITH {_STATS} SELECT deck_id, batch_no, attempt, usable, "full" FROM att', "batched model_outputs")
def _attempts(spark, d):
    return H.align_outputs(X.batches_of_40(spark, d), X.model_outputs(spark, d))[1]


@query("resolve_outputs", f"""
WITH {_STATS},
md AS (SELECT deck_id, batch_no, CASE WHEN bool_or(attempt = 1 AND "full") THEN 'a' WHEN bool_or(attempt = 2 AND "full") THEN 'b'
  WHEN bool_or(attempt = 1 AND NOT usable) THEN 'p' ELSE 'a' END AS mode FROM att GROUP BY ALL),
rn AS (SELECT *, row_number() OVER (PARTITION BY deck_id, batch_no, attempt ORDER BY item_index, seq) AS nth FROM model_outputs),
ch AS (SELECT rn.deck_id, rn.batch_no, CASE WHEN mode = 'p' THEN nth ELSE item_index END AS item, text FROM rn JOIN md USING (deck_id, batch_no)
  WHERE attempt = CASE WHEN mode = 'b' THEN 2 ELSE 1 END)
SELECT b.deck_id, b.idx, coalesce(ch.text, b.original_text) AS target FROM batched b LEFT JOIN ch USING (deck_id, batch_no, item)""", "batched model_outputs")
def _resolve(spark, d):
    return H.resolve_outputs(X.batches_of_40(spark, d), X.model_outputs(spark, d))


@query("retry_set", f"""
WITH {_STATS} SELECT deck_id, batch_no, count(*) AS expected_count FROM batched
WHERE (deck_id, batch_no) NOT IN (SELECT (deck_id, batch_no) FROM att WHERE "full" AND attempt = 1) GROUP BY ALL""", "batched model_outputs")
def _retry(spark, d):
    return H.retry_set(X.batches_of_40(spark, d), X.model_outputs(spark, d).filter("attempt = 1"))


_STYLE = """
sb AS (SELECT deck_id, idx, CAST(idx // 8 AS BIGINT) AS batch_no, CAST(idx % 8 AS INT) AS item FROM segments),
so AS (SELECT deck_id, batch_no, CASE WHEN idx % 29 = 3 THEN 0 ELSE item END AS item_id, concat('c', idx) AS dist FROM sb WHERE idx % 31 <> 5)"""


@query("align_styled_outputs", f"""
WITH {_STYLE},
ok AS (SELECT deck_id, batch_no FROM so JOIN (SELECT deck_id, batch_no, count(*) AS n FROM sb GROUP BY ALL) USING (deck_id, batch_no)
  GROUP BY deck_id, batch_no, n HAVING count(*) = n AND count(DISTINCT item_id) = n)
SELECT sb.deck_id, sb.batch_no, sb.idx, so.dist FROM sb JOIN ok USING (deck_id, batch_no)
JOIN so ON so.deck_id = sb.deck_id AND so.batch_no = sb.batch_no AND so.item_id = sb.item""", "segments")
def _styled(spark, d):
    seg = X.segments(spark, d).select("deck_id", "idx")
    i = F.col("idx")
    out = seg.filter("idx % 31 <> 5").select(
        "deck_id", F.floor(i / 8).cast("long").alias("batch_no"),
        F.when(i % 29 == 3, F.lit(0)).otherwise((i % 8).cast("int")).alias("item_id"),
        F.concat(F.lit("c"), i.cast("string")).alias("dist"),
    )
    return H.align_styled_outputs(seg, out)


def _angle(texts: list[str]) -> list[str]:
    return [f"<{t}>" for t in texts]


@query("translate_batches", f"""
SELECT deck_id, batch_no, CAST(1 AS INT) AS attempt, item AS item_index, item AS seq,
  '<' || CASE WHEN {_CLEAN} = '' THEN '[EMPTY]' ELSE {_CLEAN} END || '>' AS text FROM batched""", "batched")
def _translate(spark, d):
    return H.translate_batches(X.batches_of_40(spark, d), _angle)


_LOCALISE_SQL = f"""
WITH {tokens_sql('segments', 'original_text', 'tk')},
prep AS (SELECT deck_id, idx, string_agg(CASE WHEN opens THEN 'du' WHEN closes OR bridges THEN '' ELSE coalesce({_DICT}, tok) END, '' ORDER BY i) AS p FROM tk GROUP BY ALL),
mt AS (SELECT DISTINCT deck_id, idx, CASE WHEN opens THEN 'of the' ELSE lower(tok) END AS k FROM tk WHERE NOT closes AND NOT bridges AND (opens OR {_DICT} IS NOT NULL)),
own AS (SELECT deck_id, idx, list(k) AS known FROM mt GROUP BY ALL), {_PLAN},
pairs AS (SELECT plan.deck_id, plan.idx, '<' || trim(p) || '>' AS target, coalesce(known, []) AS known FROM plan
  JOIN prep ON prep.deck_id = plan.deck_id AND prep.idx = plan.canonical LEFT JOIN own ON own.deck_id = plan.deck_id AND own.idx = plan.idx),
{tokens_sql('pairs', 'target', 'tt')},
tj AS (SELECT tt.*, known, list_contains(known, 'of the') AS c FROM tt JOIN pairs USING (deck_id, idx))
SELECT deck_id, idx, string_agg(CASE WHEN opens AND c THEN 'du' WHEN (closes OR bridges) AND c THEN ''
    WHEN list_contains(known, lower(tok)) THEN coalesce({_DICT}, tok) ELSE tok END, '' ORDER BY i) AS target FROM tj GROUP BY ALL"""


@query("localise", _LOCALISE_SQL, "segments")
def _localise(spark, d):
    return H.localise(X.segments(spark, d), _angle, _merged(spark)).select("deck_id", "idx", "target")


def _forgetful(texts):
    """A first attempt that loses the last text of every other batch and repeats one of the others."""
    replies = _angle(texts)
    return replies[:-1] if len(texts) % 2 else [*replies, replies[0]]


@query("localise_retry", _LOCALISE_SQL, "segments")
def _localise_retry(spark, d):
    """Broken first attempts leave no trace: every batch is repaired by its retry."""
    return H.localise(X.segments(spark, d), _forgetful, _merged(spark), retry_fn=_angle).select("deck_id", "idx", "target")


_DONE = "(batch_no * 7919 % 10007) * 100000 + batch_no"


@query("progress_series", f"""
WITH c AS (SELECT deck_id, batch_no, CAST({_DONE} AS BIGINT) AS done_at, count(*) AS size FROM batched GROUP BY ALL),
t AS (SELECT deck_id, count(*) AS total_batches, CAST(sum(size) - 3 AS BIGINT) AS total_sentences FROM c GROUP BY ALL),
r AS (SELECT c.*, count(*) OVER w AS current_batch, CAST(sum(size) OVER w AS BIGINT) AS s FROM c WINDOW w AS (PARTITION BY deck_id ORDER BY done_at))
SELECT deck_id, batch_no, done_at, size, current_batch, least(s, total_sentences) AS current_sentence,
  CAST(10 + floor(current_batch / CAST(total_batches AS DOUBLE) * 70) AS INT) AS percent FROM r JOIN t USING (deck_id)""", "batched")
def _progress(spark, d):
    sizes = X.batches_of_40(spark, d).groupBy("deck_id", "batch_no").agg(F.count(F.lit(1)).alias("size"))
    done = sizes.withColumn("done_at", F.expr(f"cast({_DONE} as bigint)"))
    totals = sizes.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("total_batches"), (F.sum("size") - 3).alias("total_sentences")
    )
    return H.progress_series(done, totals)


@query("run_summary", f"""
WITH {_UNIQ}, {SWEEP_CTE}
SELECT deck_id, count(*) AS total_segments, count(*) FILTER (canonical = idx) AS unique_segments,
  (SELECT count(DISTINCT batch_no) FROM ub WHERE ub.deck_id = plan.deck_id) AS batch_count,
  (SELECT count(*) FROM numbered n WHERE n.deck_id = plan.deck_id) AS finding_count FROM plan GROUP BY deck_id""", "segments normed glossary")
def _run(spark, d):
    plan = cut(R.repetition_plan(X.segments(spark, d).select("deck_id", "idx", "original_text")).select("deck_id", "idx", "is_unique"))
    return H.run_summary(plan, H.assign_batches(plan.filter("is_unique"), 25), sweep_notes(spark, d))
