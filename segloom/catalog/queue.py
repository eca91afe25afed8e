"""Queries over review blocks and the queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from segloom.catalog import fixtures as X
from segloom.catalog.core import SWEEP_CTE, sweep_notes
from segloom.catalog.registry import query
from segloom.operators import blocks as B
from segloom.operators import sweep as W
from segloom.plans.cut import cut

_END = "[.!?。！？…:;][''\"”’)\\]]*$"


def blocks_cte(view: str) -> str:
    """Sequential merge rule in SQL: pairwise flag, island, cut every four."""
    return f"""
b1 AS (SELECT *, lag(container_id) OVER w AS pc, lag(paragraph_index) OVER w AS pp, trim(lag(original_text) OVER w) AS pt FROM {view}
       WINDOW w AS (PARTITION BY deck_id ORDER BY idx)),
b2 AS (SELECT *, CASE WHEN pc IS NULL OR pc <> container_id THEN 'container' WHEN paragraph_index <> pp + 1 THEN 'gap'
   WHEN container_kind IN ('body', 'notes') THEN 'kind'
   WHEN NOT regexp_matches(ltrim(original_text), '^\\p{{Ll}}') AND NOT regexp_matches(pt, '[,،、]$') THEN 'not_continuation'
   WHEN regexp_matches(pt, '{_END}') THEN 'sentence_end' END AS reason FROM b1),
b3 AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY deck_id ORDER BY idx) AS island FROM b2),
b4 AS (SELECT *, row_number() OVER (PARTITION BY deck_id, island ORDER BY idx) - 1 AS place FROM b3),
b5 AS (SELECT *, CAST(idx - place % 4 AS BIGINT) AS block_id, CAST(place % 4 AS INT) AS block_pos FROM b4),
blk AS (SELECT deck_id, block_id, min(slide_index) AS slide_index, min(container_id) AS container_id,
        min(container_kind) AS container_kind, min(slide_title) AS slide_title, count(*) AS size FROM b5 GROUP BY ALL),
nx AS (SELECT *, lead(reason) OVER w AS nreason, lead(block_id) OVER w AS nblock FROM b5 WINDOW w AS (PARTITION BY deck_id ORDER BY idx)),
ref AS (SELECT deck_id, block_id, block_pos + 1 AS size, CASE WHEN nblock IS NULL THEN 'end'
   WHEN nreason IN ('container', 'gap', 'kind') THEN nreason WHEN block_pos = 3 THEN 'cap' ELSE nreason END AS reason
   FROM nx WHERE nblock IS NULL OR nblock <> block_id)"""


@query("merge_blocks", f"WITH {blocks_cte('fragments')} SELECT deck_id, idx, block_id, block_pos FROM b5", "fragments")
def _merge(spark, d):
    return B.merge_blocks(X.fragments(spark, d)).select("deck_id", "idx", "block_id", "block_pos")


@query("block_refusal_reason", f"WITH {blocks_cte('fragments')} SELECT deck_id, block_id, size, reason FROM ref", "fragments")
def _refusal(spark, d):
    return B.block_refusal_reason(X.fragments(spark, d))


_BUCKETS = [("1-5", 0, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21-40", 21, 40), ("41-80", 41, 80), ("81-160", 81, 160), ("161+", 161, 10**9)]
_KINDS = ("title", "body", "textbox", "placeholder", "table_cell", "notes")
_REASONS = ("container", "gap", "kind", "cap", "not_continuation", "sentence_end", "end")


@query("fragment_summary", f"""
WITH {blocks_cte('fragments')},
base AS (SELECT deck_id, count(*) AS paragraphs, count(*) FILTER (n < 10) AS under_10_chars, count(*) FILTER (n < 20) AS under_20_chars,
  {", ".join(f'count(*) FILTER (n BETWEEN {lo} AND {hi}) AS "len_{label}"' for label, lo, hi in _BUCKETS)},
  {", ".join(f"count(*) FILTER (container_kind = '{k}') AS kind_{k}" for k in _KINDS)}
  FROM (SELECT *, length(trim(original_text)) AS n FROM fragments) GROUP BY deck_id),
fr AS (SELECT deck_id, count(*) AS containers, count(*) FILTER (n > 1) AS split_containers
  FROM (SELECT deck_id, container_id, count(*) AS n FROM fragments GROUP BY ALL) GROUP BY deck_id),
sh AS (SELECT deck_id, count(*) AS review_items, count(*) FILTER (size > 1) AS merged_blocks,
  CAST(sum(size - 1) AS BIGINT) AS paragraphs_absorbed, CAST(max(size) AS INT) AS max_paragraphs,
  {", ".join(f"count(*) FILTER (size = {k}) AS blocks_of_{k}" for k in range(1, 5))},
  {", ".join(f"count(*) FILTER (reason = '{r}') AS blocked_by_{r}" for r in _REASONS)} FROM ref GROUP BY deck_id)
SELECT *, round((1 - review_items / CAST(paragraphs AS DOUBLE)) * 100, 1) AS reduction_pct,
  round(under_20_chars / CAST(paragraphs AS DOUBLE) * 100, 1) AS pct_under_20,
  round(split_containers / CAST(containers AS DOUBLE) * 100, 1) AS pct_of_containers
FROM base JOIN fr USING (deck_id) JOIN sh USING (deck_id)""", "fragments")
def _summary(spark, d):
    return B.fragment_summary(X.fragments(spark, d))


def merged_and_notes(spark, d):
    """Blocks and numbered findings; no text moves for either."""
    return B.merge_blocks(X.segments(spark, d)), W.assign_ordinals(sweep_notes(spark, d)).select(
        "deck_id", "idx", "ordinal", "type", "severity", "suggested_fix", "term_source"
    )


def merged_and_findings(spark, d):
    merged, notes = merged_and_notes(spark, d)
    return merged, notes.join(X.bitext(spark, d).select("deck_id", "idx", "target"), ["deck_id", "idx"], "left")


_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END"
_BF = f"{SWEEP_CTE}, {blocks_cte('segments')}, bf AS (SELECT n.*, b5.block_id, {_RANK} AS rank FROM numbered n JOIN b5 USING (deck_id, idx))"


@query("primary_finding", f"""
WITH {_BF} SELECT deck_id, block_id, idx, ordinal, type, severity, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY deck_id, block_id ORDER BY rank, idx, ordinal) AS rn FROM bf) WHERE rn = 1""", "normed glossary")
def _primary(spark, d):
    return B.primary_finding(*merged_and_notes(spark, d))


_QUEUE = f"""{_BF},
fl AS (SELECT deck_id, block_id, min(rank) AS rank, count(*) AS findings FROM bf GROUP BY ALL),
queue AS (SELECT blk.*, coalesce(CAST(rank AS INT), 3) AS rank, coalesce(findings, 0) AS findings
  FROM blk LEFT JOIN fl USING (deck_id, block_id) WHERE findings IS NOT NULL OR block_id % 13 = 0)"""


def queue_of(spark, d):
    merged, findings = merged_and_notes(spark, d)
    pinned = B.block_summary(merged).filter("block_id % 13 = 0")
    return B.review_queue(merged, findings, pinned=pinned)


@query("review_queue", f"WITH {_QUEUE} SELECT * FROM queue", "normed glossary")
def _queue(spark, d):
    return queue_of(spark, d)


@query("slide_progress", f"""
WITH {_QUEUE} SELECT deck_id, slide_index, count(*) AS remaining, arg_min(slide_title, rank * 100000000 + block_id) AS title
FROM queue WHERE block_id % 3 <> 0 GROUP BY ALL""", "normed glossary")
def _progress(spark, d):
    q = cut(queue_of(spark, d))
    return B.slide_progress(q, q.filter("block_id % 3 = 0"))[0]


@query("finished_slides", f"""
WITH {_QUEUE} SELECT deck_id, count(*) FILTER (n = 0) AS done_slides FROM
  (SELECT deck_id, slide_index, count(*) FILTER (block_id % 3 <> 0) AS n FROM queue GROUP BY ALL) GROUP BY deck_id""", "normed glossary")
def _finished(spark, d):
    q = cut(queue_of(spark, d))
    return B.slide_progress(q, q.filter("block_id % 3 = 0"))[1]


@query("top_merged_blocks", f"""
WITH {blocks_cte('fragments')} SELECT * FROM blk WHERE size > 1 ORDER BY size DESC, deck_id, block_id LIMIT 40""", "fragments")
def _top(spark, d):
    return B.top_merged_blocks(B.merge_blocks(X.fragments(spark, d)))


def _outcomes(spark, d):
    merged = B.merge_blocks(X.segments(spark, d))
    return B.block_summary(merged).withColumn(
        "outcome", F.when(F.col("block_id") % 2 == 0, "applied").otherwise("skipped")
    )


@query("still_flagged", f"""
WITH {_BF} SELECT DISTINCT deck_id, block_id FROM bf WHERE block_id % 2 = 0""", "normed glossary")
def _reopened(spark, d):
    merged, findings = merged_and_notes(spark, d)
    return B.still_flagged(_outcomes(spark, d), B.block_findings(merged, findings))[0]


@query("settled_blocks", f"""
WITH {_BF} SELECT deck_id, block_id FROM blk WHERE block_id % 2 = 0 AND (deck_id, block_id) NOT IN (SELECT (deck_id, block_id) FROM bf)""", "normed glossary")
def _settled(spark, d):
    merged, findings = merged_and_notes(spark, d)
    return B.still_flagged(_outcomes(spark, d), B.block_findings(merged, findings))[1]


@query("suggest_fix_certain", f"""
WITH {SWEEP_CTE},
f AS (SELECT deck_id, idx, ordinal, output AS target, suggested_fix AS fix, coalesce(term_source, '') AS src FROM numbered
      WHERE type LIKE 'terminology.%' AND NOT contains(output, suggested_fix)),
g AS (SELECT *, CASE WHEN src <> '' THEN strpos(lower(target), lower(src)) ELSE 0 END AS at1, strpos(lower(target), lower(fix)) AS at2 FROM f),
h AS (SELECT *, CAST(CASE WHEN at1 > 0 THEN at1 ELSE at2 END - 1 AS INT) AS start FROM g WHERE at1 > 0 OR at2 > 0)
SELECT deck_id, idx, ordinal, start, CAST(start + CASE WHEN at1 > 0 THEN length(src) ELSE length(fix) END AS INT) AS stop,
  substr(target, 1, start) || fix || substr(target, start + CASE WHEN at1 > 0 THEN length(src) ELSE length(fix) END + 1) AS new_target
FROM h""", "normed glossary")
def _certain(spark, d):
    _, findings = merged_and_findings(spark, d)
    return B.suggest_fix(findings).filter("confidence = 'certain'").select(
        "deck_id", "idx", "ordinal", "start", "stop", "new_target"
    )


@query("suggest_fix")
def _suggest(spark, d):
    _, findings = merged_and_findings(spark, d)
    return B.suggest_fix(findings)
