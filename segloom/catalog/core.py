"""Queries over segments, repeats and the sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from segloom.catalog import fixtures as X
from segloom.catalog.registry import query
from segloom.operators import repetition as R
from segloom.operators import segments as S
from segloom.operators import sweep as W


@query("segments_from_documents", "SELECT * FROM segments", "segments")
def _segments(spark, d):
    return X.new_segments(spark, d)


@query("container_id", """
SELECT deck_id, idx, concat('s', slide_index, '/sh', idx % 4, '/g', idx % 3, '/g', idx % 2, '/r', idx % 5, 'c', idx % 6) AS cell_path,
  concat('s', slide_index, '/sh', idx % 4, CASE WHEN idx % 2 = 0 THEN concat('/g', idx % 3) ELSE '' END) AS group_path
FROM segments""", "segments")
def _container(spark, d):
    i = F.col("idx")
    return X.segments(spark, d).select(
        "deck_id", "idx",
        S.container_id("slide_index", i % 4, groups=F.array(i % 3, i % 2), row=i % 5, col=i % 6).alias("cell_path"),
        S.container_id("slide_index", i % 4, groups=F.when(i % 2 == 0, F.array(i % 3)).otherwise(F.array().cast("array<int>"))).alias("group_path"),
    )


@query("align_bitext", """
SELECT s.deck_id, s.idx, s.original_text, coalesce(CASE WHEN s.idx % 5 = 0 THEN NULL ELSE b.target END, '') AS target
FROM segments s JOIN bitext b USING (deck_id, idx)""", "bitext")
def _align(spark, d):
    return S.align_bitext(X.segments(spark, d), X.bitext(spark, d).filter("idx % 5 <> 0")).select(
        "deck_id", "idx", "original_text", "target"
    )


@query("global_context", """
SELECT deck_id, substr(coalesce(string_agg('Slide ' || (slide_index + 1) || ' - ' ||
    CASE WHEN coalesce(slide_title, '') = '' THEN 'Untitled' ELSE slide_title END || ': ' ||
    replace(trim(original_text), chr(10), ' '), chr(10) ORDER BY idx) FILTER (NOT is_note), ''), 1, 2000) AS context
FROM segments WHERE idx < 80 GROUP BY deck_id""", "segments")
def _global_context(spark, d):
    return S.global_context(X.segments(spark, d))


@query("context_window", """
SELECT deck_id, idx, string_agg('[' || (idx2 + 1) || '] ' || trim(t2), chr(10) ORDER BY idx2) AS window_text
FROM (SELECT a.deck_id, a.idx, b.idx AS idx2, b.original_text AS t2 FROM segments a
      JOIN segments b ON a.deck_id = b.deck_id AND b.idx BETWEEN a.idx - 2 AND a.idx + 2)
GROUP BY deck_id, idx""", "segments")
def _context_window(spark, d):
    return S.context_window(X.segments(spark, d)).select("deck_id", "idx", "window_text")


_CLEAN = "trim(replace(replace(original_text, chr(13), ' '), chr(10), ' '))"
_PLAN = f"""
plan AS (SELECT *, min(idx) OVER (PARTITION BY deck_id, {_CLEAN}) AS canonical,
         count(*) OVER (PARTITION BY deck_id, {_CLEAN}) AS repeat_count FROM segments)"""


@query("repeat_counts", f"""
SELECT deck_id, {_CLEAN} AS text, count(*) AS n FROM segments GROUP BY ALL HAVING count(*) > 1""", "segments")
def _repeat_counts(spark, d):
    return R.repeat_counts(X.segments(spark, d))


@query("repetition_plan", f"""
WITH {_PLAN} SELECT deck_id, idx, canonical, canonical = idx AS is_unique, repeat_count FROM plan""", "segments")
def _plan(spark, d):
    return R.repetition_plan(X.segments(spark, d)).select("deck_id", "idx", "canonical", "is_unique", "repeat_count")


@query("expand_repeats", f"""
WITH {_PLAN}
SELECT p.deck_id, p.idx, CASE WHEN p.canonical % 9 = 4 THEN '' ELSE 'T:' || u.original_text END AS target
FROM plan p JOIN segments u ON p.deck_id = u.deck_id AND p.canonical = u.idx""", "segments")
def _expand(spark, d):
    plan = R.repetition_plan(X.segments(spark, d))
    results = plan.filter("is_unique and idx % 9 <> 4").select(
        "deck_id", "idx", F.concat(F.lit("T:"), "original_text").alias("target")
    )
    return R.expand_repeats(plan, results)


@query("identical_segments", f"""
WITH {_PLAN}
SELECT p.deck_id, p.canonical, p.idx FROM plan p
WHERE (deck_id, canonical) IN (SELECT (deck_id, canonical) FROM plan)""", "segments")
def _identical(spark, d):
    plan = R.repetition_plan(X.segments(spark, d))
    return R.identical_segments(plan, plan)


# sweep ------------------------------------------------------------------------------------------

FLAT = [
    "deck_id", "idx", "type", "severity", "description", "slide", "shape", "paragraph",
    "source", "output", "suggested_fix", "term_source", "related_slide", "related_paragraph",
]


def flat(df, *more):
    """Findings with their structs spread into columns."""
    return df.select(
        "deck_id", "idx", "type", "severity", "description",
        F.col("location.slide").alias("slide"), F.col("location.shape").alias("shape"),
        F.col("location.paragraph").alias("paragraph"), F.col("segment.source").alias("source"),
        F.col("segment.output").alias("output"), "suggested_fix", "term_source",
        F.col("related_location.slide").alias("related_slide"),
        F.col("related_location.paragraph").alias("related_paragraph"), *more,
    )


def finding_sql(kind, severity, description, frm, *, fix="NULL", term="NULL", rslide="NULL", rpara="NULL", keys=("idx", "0", "0"), rank=0):
    return f"""SELECT deck_id, idx, '{kind}' AS type, '{severity}' AS severity, {description} AS description,
  slide_index + 1 AS slide, shape_index AS shape, paragraph_index AS paragraph, original_text AS source, target AS output,
  CAST({fix} AS VARCHAR) AS suggested_fix, CAST({term} AS VARCHAR) AS term_source,
  CAST({rslide} AS BIGINT) AS related_slide, CAST({rpara} AS INT) AS related_paragraph,
  {rank} AS check_rank, CAST({keys[0]} AS BIGINT) AS k1, CAST({keys[1]} AS BIGINT) AS k2, CAST({keys[2]} AS BIGINT) AS k3 {frm}"""


TERM_SQL = finding_sql(
    "terminology.violation", "major",
    """concat('용어집: "', g_source, '" → "', g_target, '" 인데 번역에 "', g_target, '"가 없습니다.')""",
    f"""FROM normed JOIN (SELECT pos, source AS g_source, target AS g_target, {X.norm_sql('source')} AS g_n, {X.norm_sql('target')} AS g_tn FROM glossary) g
  ON contains(src_n, g_n) AND NOT contains(tgt_n, g_tn) WHERE src_n <> '' AND tgt_n <> ''""",
    fix="g_target", term="g_source", keys=("idx", "0", "pos"), rank=1,
)
LOCKED = [("r1", "LE", 0), ("r2", "Und", 1), ("r3", "QUE", 2)]
LOCKED_SQL = finding_sql(
    "terminology.violation", "major",
    """concat('확정 용어 규칙(', rule_id, '): "', term, '" 표기를 정확히 지켜야 합니다.')""",
    f"""FROM normed JOIN (SELECT * FROM (VALUES {X._values(LOCKED)}) AS t(rule_id, term, lpos)) l
  ON contains(tgt_n, lower(term)) AND NOT contains(target, term) WHERE src_n <> '' AND tgt_n <> ''""",
    fix="term", keys=("idx", "0", "lpos + 1000000"), rank=1,
)
DIVERGENCE_CTE = """
variants AS (SELECT deck_id, src_n, tgt_n, min(idx) AS vidx FROM normed WHERE length(src_n) >= 4 GROUP BY ALL),
grp AS (SELECT deck_id, src_n, min(vidx) AS gidx, min(vidx) FILTER (tgt_n <> '') AS aidx,
        count(*) FILTER (tgt_n <> '') AS nv FROM variants GROUP BY ALL HAVING count(*) FILTER (tgt_n <> '') >= 2),
div AS (SELECT b.*, grp.gidx, a.slide_index + 1 AS aslide, a.paragraph_index AS apara, a.target AS atarget
        FROM variants v JOIN grp USING (deck_id, src_n)
        JOIN bitext b ON b.deck_id = v.deck_id AND b.idx = v.vidx
        JOIN bitext a ON a.deck_id = v.deck_id AND a.idx = grp.aidx
        WHERE v.tgt_n <> '' AND v.vidx <> grp.aidx)"""
DIVERGENCE_SQL = finding_sql(
    "consistency.phrase", "major",
    """concat('같은 원문 "', original_text, '"가 슬라이드 ', aslide, '에서는 "', atarget, '", 슬라이드 ', slide_index + 1, '에서는 "', target, '"로 다르게 번역됐습니다. 하나로 통일하세요.')""",
    "FROM div", rslide="aslide", rpara="apara", keys=("gidx", "idx", "0"), rank=2,
)
_WORDS = "regexp_extract_all(original_text, '\\S*\\p{L}\\S*')"
_FUNCTION = "|".join(__import__("segloom.functions.values", fromlist=["x"]).FUNCTION_WORDS)
_PROSE = f"""(len(list_filter({_WORDS}, lambda w: regexp_full_match(lower(trim(w, '.,;:!?()[]''"')), '{_FUNCTION}'))) > 0
  OR (len({_WORDS}) >= 4 AND regexp_matches(original_text, '[.!?]\\s*$')))"""
UNTRANSLATED_SQL = finding_sql(
    "accuracy.omission", "critical", "'번역되지 않고 원문이 그대로 남아 있습니다.'",
    f"""FROM normed WHERE src_n <> '' AND tgt_n <> '' AND regexp_matches(original_text, '\\p{{L}}') AND src_n = tgt_n
  AND len({_WORDS}) >= 3 AND {_PROSE}""", rank=3,
)
_FLAT_SQL = ", ".join(FLAT)


def _locked(spark):
    return spark.createDataFrame(LOCKED, "rule_id string, term string, pos int")


@query("term_violation_join", f"SELECT {_FLAT_SQL} FROM ({TERM_SQL})", "normed glossary")
def _terms(spark, d):
    return flat(W.term_violation_join(X.bitext(spark, d), X.glossary(spark)))


@query("locked_term_join", f"SELECT {_FLAT_SQL} FROM ({LOCKED_SQL})", "normed")
def _locked_terms(spark, d):
    return flat(W.locked_term_join(X.bitext(spark, d), _locked(spark)))


# every word of the documents as a term: too many pairs for SQL, tests compare with plain Python
def _all_words(spark, d):
    return X.lexicon(spark, d).filter(F.col("source").rlike(r"^\p{L}+$"))


@query("term_violation_large")
def _terms_large(spark, d):
    return W.term_violation_join(X.bitext(spark, d), _all_words(spark, d)).select("deck_id", "idx", "term_source", "suggested_fix")


@query("locked_term_large")
def _locked_large(spark, d):
    words = _all_words(spark, d).groupBy(F.col("source").alias("term")).agg(F.min("pos").alias("pos"))
    locked = words.select(F.lit("r").alias("rule_id"), "term", "pos")
    return W.locked_term_join(X.bitext(spark, d), locked).select("deck_id", "idx", "suggested_fix")


@query("check_terminology", f"SELECT {_FLAT_SQL} FROM ({TERM_SQL} UNION ALL {LOCKED_SQL})", "normed glossary")
def _terminology(spark, d):
    return flat(W.check_terminology(X.bitext(spark, d), X.glossary(spark), _locked(spark)))


@query("check_divergence", f"WITH {DIVERGENCE_CTE} SELECT {_FLAT_SQL} FROM ({DIVERGENCE_SQL})", "normed")
def _divergence(spark, d):
    return flat(W.check_divergence(X.bitext(spark, d)))


@query("check_untranslated", f"SELECT {_FLAT_SQL} FROM ({UNTRANSLATED_SQL})", "normed")
def _untranslated(spark, d):
    return flat(W.check_untranslated(X.bitext(spark, d), "영어", "한국어"))


SWEEP_CTE = f"""{DIVERGENCE_CTE},
sweep AS ({TERM_SQL} UNION ALL {LOCKED_SQL} UNION ALL {DIVERGENCE_SQL} UNION ALL {UNTRANSLATED_SQL}),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY check_rank, k1, k2, k3) AS BIGINT) AS ordinal FROM sweep)"""


def sweep(spark, d):
    return W.run_sweep(
        X.bitext(spark, d), X.glossary(spark), _locked(spark), source_lang="영어", target_lang="한국어"
    )


def sweep_notes(spark, d):
    """The same findings without texts and numbers."""
    return W.sweep_notes(
        X.bitext(spark, d), X.glossary(spark), _locked(spark), source_lang="영어", target_lang="한국어"
    )


@query("run_sweep", f"WITH {SWEEP_CTE} SELECT {_FLAT_SQL}, ordinal FROM numbered", "normed glossary")
def _sweep(spark, d):
    return flat(sweep(spark, d), "ordinal")


@query("assign_ordinals", f"""
WITH {SWEEP_CTE} SELECT deck_id, idx, type, check_rank, ordinal FROM numbered""", "normed glossary")
def _ordinals(spark, d):
    return W.assign_ordinals(sweep_notes(spark, d)).select("deck_id", "idx", "type", "check_rank", "ordinal")


@query("findings_union", f"SELECT {_FLAT_SQL} FROM ({TERM_SQL} UNION ALL {UNTRANSLATED_SQL})", "normed glossary")
def _union(spark, d):
    b = X.bitext(spark, d)
    return flat(W.findings_union(
        W.term_violation_join(b, X.glossary(spark)), W.check_untranslated(b, "영어", "한국어")
    ))


@query("check_length_limit", f"SELECT {_FLAT_SQL} FROM (" + finding_sql(
    "fit.length_limit", "major",
    "concat('번역 ', length(target), '자가 설정한 최대 ', lim, '자(120%)를 초과합니다.')",
    f"FROM (SELECT *, greatest(1, length({_CLEAN}) * 120 // 100) AS lim FROM bitext) WHERE NOT is_note AND length(target) > lim",
) + ")", "bitext")
def _length_limit(spark, d):
    return flat(W.check_length_limit(X.bitext(spark, d), 120))
