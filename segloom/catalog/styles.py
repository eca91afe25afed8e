"""Queries over style runs and text fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from segloom.catalog import fixtures as X
from segloom.catalog.core import _FLAT_SQL, finding_sql, flat
from segloom.catalog.registry import query
from segloom.catalog.scalars import width_sql
from segloom.operators import fit as J
from segloom.operators import style as S
from segloom.operators import sweep as W
from segloom.plans.cut import cut

GROUPS_CTE = """
g1 AS (SELECT *, CASE WHEN lag(color) OVER w <> color THEN 1 ELSE 0 END AS nw FROM runs WINDOW w AS (PARTITION BY deck_id, idx ORDER BY run_no)),
g2 AS (SELECT *, sum(nw) OVER (PARTITION BY deck_id, idx ORDER BY run_no) AS gi FROM g1),
groups AS (SELECT deck_id, idx, CAST(gi AS INT) AS group_index, min(color) AS fmt, string_agg(text, '' ORDER BY run_no) AS text,
  CAST(sum(length(text)) AS BIGINT) AS length, min(color) <> '#FF0000' AS neutral FROM g2 GROUP BY ALL)"""


@query("format_groups", f"WITH {GROUPS_CTE} SELECT * FROM groups", "runs")
def _groups(spark, d):
    return S.format_groups(X.runs(spark, d))


_STYLED = "styled AS (SELECT DISTINCT deck_id, idx, CAST(run_no % 4 AS INT) AS group_index FROM runs WHERE idx % 3 <> 0)"
_STATUS = f"""{GROUPS_CTE}, {_STYLED},
need AS (SELECT deck_id, idx, count(*) AS n, list(group_index) FILTER (trim(text) <> '') AS shown FROM groups GROUP BY ALL),
us AS (SELECT deck_id, idx, list(group_index) AS used FROM styled GROUP BY ALL),
stat AS (SELECT deck_id, idx, CASE WHEN n <= 1 THEN 'single_style' WHEN used IS NULL THEN 'dropped'
  WHEN list_has_all(used, shown) THEN 'preserved' ELSE 'partial' END AS status FROM need LEFT JOIN us USING (deck_id, idx))"""


def _status(spark, d):
    styled = X.runs(spark, d).filter("idx % 3 <> 0").select("deck_id", "idx", (F.col("run_no") % 4).cast("int").alias("group_index"))
    return S.style_status(S.format_groups(X.runs(spark, d)), styled)


@query("style_status", f"WITH {_STATUS} SELECT * FROM stat", "runs")
def _style_status(spark, d):
    return _status(spark, d)


@query("check_style_mapping", f"WITH {_STATUS} SELECT {_FLAT_SQL} FROM (" + finding_sql(
    "style.mapping_dropped", "minor", "'원문의 부분 강조를 모두 확실하게 매핑하지 못했습니다. 색상 미리보기를 확인하세요.'",
    "FROM bitext JOIN stat USING (deck_id, idx) WHERE status IN ('dropped', 'partial') AND idx % 11 <> 0",
) + ")", "runs bitext")
def _mapping(spark, d):
    muted = X.segments(spark, d).filter("idx % 11 = 0").select("deck_id", "idx", F.lit("style.mapping_dropped").alias("type"))
    return flat(W.check_style_mapping(X.bitext(spark, d), _status(spark, d), muted))


@query("fallback_group", f"""
WITH {GROUPS_CTE} SELECT deck_id, idx, group_index FROM (SELECT *, row_number() OVER (PARTITION BY deck_id, idx
  ORDER BY neutral DESC, length DESC, group_index) AS rn FROM groups) WHERE rn = 1""", "runs")
def _fallback(spark, d):
    return S.fallback_group(S.format_groups(X.runs(spark, d)))


_PAIRS = """
pr AS (SELECT deck_id, idx, concat(idx, '% ') AS g0, CASE WHEN idx % 5 = 0 THEN concat('#', idx) ELSE original_text END AS g1,
  CASE idx % 4 WHEN 0 THEN concat(original_text, ' ', idx, '%') WHEN 1 THEN concat(idx, '% ', original_text) WHEN 2 THEN original_text
    ELSE concat('#', idx, ' ', original_text) END AS target FROM segments),
an AS (SELECT *, trim(g0) AS a0, trim(g1) AS a1 FROM pr),
fx AS (SELECT *, length(a0) >= 2 AND regexp_matches(a0, '[\\p{Nd}$%€£¥#@&+]') AS f0, length(a1) >= 2 AND regexp_matches(a1, '[\\p{Nd}$%€£¥#@&+]') AS f1 FROM an),
cs AS (SELECT *, CASE WHEN f0 AND ends_with(target, a0) THEN 1 WHEN f0 AND starts_with(target, a0) THEN 2
  WHEN f1 AND ends_with(target, a1) THEN 3 WHEN f1 AND starts_with(target, a1) THEN 4 END AS c FROM fx)"""


@query("rule_based_style_split", f"""
WITH {_PAIRS}
SELECT deck_id, idx, CAST(0 AS INT) AS seg_no, CASE c WHEN 1 THEN substr(target, 1, length(target) - length(a0)) WHEN 2 THEN a0
  WHEN 3 THEN substr(target, 1, length(target) - length(a1)) ELSE a1 END AS text, CAST(CASE c WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 1 END AS INT) AS group_index FROM cs WHERE c IS NOT NULL
UNION ALL
SELECT deck_id, idx, CAST(1 AS INT), CASE c WHEN 1 THEN a0 WHEN 2 THEN substr(target, length(a0) + 1) WHEN 3 THEN a1 ELSE substr(target, length(a1) + 1) END,
  CAST(CASE c WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS INT) FROM cs WHERE c IS NOT NULL""", "segments")
def _split(spark, d):
    i = F.col("idx").cast("string")
    t = F.col("original_text")
    m = F.col("idx") % 4
    base = X.segments(spark, d).select(
        "deck_id", "idx",
        F.when(m == 0, F.concat(t, F.lit(" "), i, F.lit("%"))).when(m == 1, F.concat(i, F.lit("% "), t))
        .when(m == 2, t).otherwise(F.concat(F.lit("#"), i, F.lit(" "), t)).alias("target"),
        F.array(F.concat(i, F.lit("% ")), F.when(F.col("idx") % 5 == 0, F.concat(F.lit("#"), i)).otherwise(t)).alias("g"),
    )
    groups = base.select("deck_id", "idx", F.posexplode("g").alias("group_index", "text"))
    return S.rule_based_style_split(groups, base.select("deck_id", "idx", "target"))


@query("run_offsets", """
SELECT deck_id, idx, run_no, CAST(e - length(text) AS BIGINT) AS start, CAST(e AS BIGINT) AS stop, text_length
FROM (SELECT *, sum(length(text)) OVER (PARTITION BY deck_id, idx ORDER BY run_no) AS e, CAST(sum(length(text)) OVER (PARTITION BY deck_id, idx) AS BIGINT) AS text_length FROM runs)""", "runs")
def _offsets(spark, d):
    return S.run_offsets(X.runs(spark, d)).select("deck_id", "idx", "run_no", "start", F.col("end").alias("stop"), "text_length")


def _par_cte(view, name):
    return f"""
{name}0 AS (SELECT *, (2 * sum(length(text)) OVER w - length(text)) / 2.0 / sum(length(text)) OVER (PARTITION BY deck_id, idx) AS m
  FROM {view} WINDOW w AS (PARTITION BY deck_id, idx ORDER BY run_no)),
{name} AS (SELECT deck_id, idx, row_number() OVER (PARTITION BY deck_id ORDER BY idx) - 1 AS pno, string_agg(text, '' ORDER BY run_no) AS text,
  sum(length(text)) AS len, coalesce(list(DISTINCT CASE WHEN m < 0.33 THEN 'front' WHEN m > 0.67 THEN 'back' ELSE 'middle' END) FILTER (color = '#FF0000'), []) AS spots
  FROM {name}0 GROUP BY deck_id, idx)"""


_AUDIT = _par_cte("runs", "sp") + "," + _par_cte("target_runs", "tp")


@query("style_audit_join", f"""
WITH {_AUDIT} SELECT s.deck_id, CAST(s.pno AS BIGINT) AS para_no, s.idx AS src_idx, t.idx AS tgt_idx, s.text AS src_text, t.text AS tgt_text
FROM sp s JOIN tp t USING (deck_id, pno)""", "runs target_runs")
def _audit_join(spark, d):
    tgt = X.styled_words(X.bitext(spark, d), "target")
    return S.style_audit_join(cut(S.paragraphs_of(X.runs(spark, d))), cut(S.paragraphs_of(tgt))).select(
        "deck_id", "para_no", "src_idx", "tgt_idx", "src_text", "tgt_text"
    )


@query("style_audit", f"""
WITH {_AUDIT},
j AS (SELECT s.deck_id, s.pno, s.text AS st, t.text AS tt, s.len AS sl, t.len AS tl, s.spots AS ss, t.spots AS ts FROM sp s JOIN tp t USING (deck_id, pno)),
k AS (SELECT *, CASE WHEN len(ss) = 0 AND len(ts) > 0 THEN 'target_added_highlight' WHEN len(ss) > 0 AND len(ts) = 0 THEN 'dropped_highlight'
  WHEN list_has_any(ss, ts) THEN 'position_like_highlight' END AS kind FROM j),
c AS (SELECT coalesce(a.deck_id, b.deck_id) AS deck_id, coalesce(an, 0) AS an, coalesce(bn, 0) AS bn, coalesce(at1, '') AS at1, coalesce(bt, '') AS bt FROM
  (SELECT deck_id, count(*) AS an, arg_max(text, pno) AS at1 FROM sp GROUP BY 1) a FULL JOIN (SELECT deck_id, count(*) AS bn, arg_max(text, pno) AS bt FROM tp GROUP BY 1) b USING (deck_id))
SELECT deck_id, CAST(pno AS BIGINT) AS index, kind, CASE kind WHEN 'target_added_highlight' THEN 'medium' WHEN 'dropped_highlight' THEN 'low'
  ELSE CASE WHEN sl <> tl THEN 'high' ELSE 'medium' END END AS severity, st AS source_text, tt AS target_text FROM k WHERE kind IS NOT NULL
UNION ALL SELECT deck_id, CAST(least(an, bn) AS BIGINT), 'paragraph_count_mismatch', 'high', at1, bt FROM c WHERE an <> bn""", "runs target_runs")
def _audit(spark, d):
    return S.style_audit(X.runs(spark, d), X.styled_words(X.bitext(spark, d), "target"))


@query("findings_by_type", f"""
WITH {_AUDIT},
k AS (SELECT CASE WHEN len(s.spots) = 0 AND len(t.spots) > 0 THEN 'target_added_highlight' WHEN len(s.spots) > 0 AND len(t.spots) = 0 THEN 'dropped_highlight'
  WHEN list_has_any(s.spots, t.spots) THEN 'position_like_highlight' END AS type FROM sp s JOIN tp t USING (deck_id, pno)
  UNION ALL SELECT 'paragraph_count_mismatch' FROM (SELECT deck_id, count(*) AS n FROM sp GROUP BY 1) a JOIN (SELECT deck_id, count(*) AS m FROM tp GROUP BY 1) b USING (deck_id) WHERE n <> m)
SELECT type, count(*) AS n FROM k WHERE type IS NOT NULL GROUP BY ALL""", "runs target_runs")
def _by_type(spark, d):
    from segloom.operators.ledger import findings_by_type

    audit = S.style_audit(X.runs(spark, d), X.styled_words(X.bitext(spark, d), "target"))
    return findings_by_type(audit.withColumnRenamed("kind", "type"))


@query("validate_styled_segments", """
SELECT deck_id, idx, trim(target) <> '' AND idx % 4 <> 3 AND NOT (idx % 5 = 0 AND len(regexp_extract_all(target, '\\S+\\s*')) >= 3) AS valid,
  CASE WHEN trim(target) <> '' AND idx % 4 <> 3 AND NOT (idx % 5 = 0 AND len(regexp_extract_all(target, '\\S+\\s*')) >= 3) THEN target END AS joined
FROM bitext""", "bitext")
def _validate(spark, d):
    b = X.bitext(spark, d)
    m = F.col("idx") % 4
    pieces = F.regexp_extract_all("target", F.lit(r"\S+\s*"), F.lit(0))
    tail = F.element_at("p", -1)
    b2 = b.select("deck_id", "idx", pieces.alias("p")).filter(F.size("p") > 0)
    tailed = F.concat(F.slice("p", F.lit(1), F.size("p") - 1), F.array(
        F.concat(tail, F.when(m == 2, F.lit("  ")).when(m == 3, F.lit("x")).otherwise(F.lit("")))
    ))
    b2 = b2.withColumn("p", tailed)
    first = F.concat(F.when(m == 1, F.lit("   ")).otherwise(F.lit("")), F.get("p", F.lit(0)))
    bent = F.concat(F.array(first), F.slice("p", F.lit(2), F.size("p") - 1))
    styled = b2.select("deck_id", "idx", F.posexplode(bent).alias("seg_no", "text")).withColumn("group_index", F.col("seg_no") % 3)
    sizes = b.select("deck_id", "idx", F.when(F.col("idx") % 5 == 0, 2).otherwise(3).alias("n_groups"))
    return S.validate_styled_segments(styled, b, sizes).select("deck_id", "idx", "valid", F.array_join("texts", "").alias("joined"))


@query("resolve_theme_color", """
WITH th AS (SELECT DISTINCT deck_id, n AS name, '#' || upper(substr(md5(deck_id || n), 1, 6)) AS value
  FROM segments, (SELECT unnest(['dk1', 'lt2', 'accent1', 'tx1']) AS n) WHERE n <> 'tx1' OR right(deck_id, 1) IN ('0', '2', '4', '6', '8')),
r AS (SELECT deck_id, idx, run_no, CASE length(text) % 4 WHEN 0 THEN 'ff0000' END AS rgb,
  CASE length(text) % 4 WHEN 1 THEN 'tx1' WHEN 2 THEN 'accent1' WHEN 3 THEN 'bg2' END AS scheme FROM runs)
SELECT r.*, CASE WHEN rgb IS NOT NULL THEN '#' || upper(rgb) ELSE coalesce(a.value, b.value) END AS color FROM r
LEFT JOIN th a ON a.deck_id = r.deck_id AND a.name = r.scheme
LEFT JOIN th b ON b.deck_id = r.deck_id AND b.name = CASE r.scheme WHEN 'tx1' THEN 'dk1' WHEN 'tx2' THEN 'dk2' WHEN 'bg1' THEN 'lt1' WHEN 'bg2' THEN 'lt2' END""", "runs")
def _theme(spark, d):
    names = F.when(F.right("deck_id", F.lit(1)).isin(*"02468"), F.lit(["dk1", "lt2", "accent1", "tx1"])).otherwise(F.lit(["dk1", "lt2", "accent1"]))
    theme = X.segments(spark, d).select("deck_id").distinct().select("deck_id", F.explode(names).alias("name")).withColumn(
        "value", F.concat(F.lit("#"), F.upper(F.substring(F.md5(F.concat("deck_id", "name")), 1, 6)))
    )
    m = F.length("text") % 4
    runs = X.runs(spark, d).select(
        "deck_id", "idx", "run_no", F.when(m == 0, "ff0000").alias("rgb"),
        F.when(m == 1, "tx1").when(m == 2, "accent1").when(m == 3, "bg2").alias("scheme"),
    )
    return S.resolve_theme_color(runs, theme)


# fit --------------------------------------------------------------------------------------------

SLIDE_WIDTH = 12192000


@query("free_width_right", """
WITH s AS (SELECT *, left_emu AS l, top_emu AS t, left_emu + width_emu AS r, top_emu + height_emu AS b FROM shapes)
SELECT a.deck_id, a.slide_index, a.shape_id,
  greatest(0, least(any_value(a.l), coalesce(min(a.l - o.r) FILTER (o.r <= a.l), any_value(a.l))) - 457200) AS free_left,
  greatest(0, least(12192000 - any_value(a.r), coalesce(min(o.l - a.r) FILTER (o.l >= a.r), 12192000 - any_value(a.r))) - 457200) AS free_right
FROM s a LEFT JOIN s o ON a.deck_id = o.deck_id AND a.slide_index = o.slide_index AND a.shape_id <> o.shape_id AND o.b > a.t AND o.t < a.b
WHERE a.has_text GROUP BY a.deck_id, a.slide_index, a.shape_id""", "shapes")
def _free(spark, d):
    return J.free_width(X.shapes(spark, d), SLIDE_WIDTH)


def fit_inputs(spark, d):
    frames = X.frames(spark, d).withColumn("frame_id", F.col("idx"))
    m = F.length("text") % 3
    words = F.filter(F.split("target", " "), lambda w: w != "")
    runs = X.bitext(spark, d).select("deck_id", F.col("idx").alias("frame_id"), F.posexplode_outer(words).alias("run_no", "text")).select(
        "deck_id", "frame_id", F.lit(0).alias("paragraph"), F.coalesce("run_no", F.lit(0)).alias("run_no"), "text",
        F.when(m == 0, 12.0).when(m == 1, 20.0).alias("font_pt"),
    )
    return frames, runs


_RATIO = f"""
w AS (SELECT *, CASE length(text) % 3 WHEN 0 THEN 12e0 WHEN 1 THEN 20e0 END AS pt FROM target_runs),
bs AS (SELECT f.deck_id, f.idx, coalesce(avg(pt), 18e0) AS base FROM frames f LEFT JOIN w USING (deck_id, idx) GROUP BY ALL),
ln AS (SELECT f.deck_id, f.idx, any_value(base) AS base, coalesce(sum({width_sql('text')} * coalesce(pt, base)), 0) / 100 AS width,
  greatest(any_value(base), coalesce(max(CASE WHEN text IS NOT NULL THEN coalesce(pt, base) END), 0)) AS tall,
  greatest(1e0, any_value(width_emu) / 12700e0) AS uw, greatest(1e0, any_value(height_emu) / 12700e0) AS uh
  FROM frames f JOIN bs USING (deck_id, idx) LEFT JOIN w USING (deck_id, idx) GROUP BY f.deck_id, f.idx),
rt AS (SELECT deck_id, idx, greatest(1, ceil(width / uw)) * tall * 1.2e0 / uh AS ratio FROM ln)"""


@query("frame_overflow_ratio", f"WITH {_RATIO} SELECT deck_id, idx AS frame_id, round(ratio, 6) AS ratio FROM rt", "frames target_runs")
def _ratio(spark, d):
    return J.frame_overflow_ratio(*fit_inputs(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query("frame_length_totals", """
SELECT deck_id, container_id AS frame_id, CAST(sum(length(original_text)) AS BIGINT) AS src_len, CAST(sum(length(target)) AS BIGINT) AS tgt_len,
  round(CASE WHEN sum(length(original_text)) > 0 AND sum(length(target)) > sum(length(original_text)) THEN sum(length(target)) / CAST(sum(length(original_text)) AS DOUBLE) ELSE 1 END, 6) AS ratio
FROM bitext WHERE NOT is_note GROUP BY ALL""", "bitext")
def _totals(spark, d):
    return J.frame_length_totals(X.bitext(spark, d)).withColumn("ratio", F.round("ratio", 6))


# a ratio that needs no font metrics, shared by the arithmetic queries
_R = "round((length(target) + 1) / CAST(length(original_text) + 1 AS DOUBLE), 6)"


def _rated(spark, d):
    r = F.round((F.length("target") + 1) / (F.length("original_text") + 1).cast("double"), 6)
    return X.frames(spark, d).withColumn("ratio", r)


@query("shrink_factor", f"""
SELECT deck_id, idx, round(CASE WHEN ratio > 1.05 THEN greatest(1 / ratio, 0.8e0) END, 6) AS factor, CASE WHEN ratio > 1.05 THEN 1 / ratio < 0.8e0 END AS hit_floor,
  CASE WHEN ratio > 1.05 AND font_pt IS NOT NULL THEN greatest(1, CAST(round_even(font_pt * 12700 * greatest(1 / ratio, 0.8e0) / 12700, 0) AS INT)) END AS new_pt
FROM (SELECT *, {_R} AS ratio FROM frames)""", "frames")
def _shrink(spark, d):
    return J.shrink_factor(_rated(spark, d)).select("deck_id", "idx", F.round("factor", 6).alias("factor"), "hit_floor", "new_pt")


@query("expand_width", f"""
SELECT deck_id, idx, CASE WHEN ratio > 1.05 AND rotation < 0.01 AND least(floor(width_emu * (ratio - 1)), floor(width_emu * 0.3e0), idx % 9 * 60000) > 0
  THEN width_emu + CAST(least(floor(width_emu * (ratio - 1)), floor(width_emu * 0.3e0), idx % 9 * 60000) AS BIGINT) END AS new_width
FROM (SELECT *, {_R} AS ratio FROM frames)""", "frames")
def _expand(spark, d):
    rated = _rated(spark, d).withColumn("free_right", (F.col("idx") % 9 * 60000).cast("long"))
    return J.expand_width(rated).select("deck_id", "idx", "new_width")


_PLANNED = """SELECT r.deck_id, r.idx AS frame_id, round(ratio, 6) AS ratio, CASE WHEN ratio > 1.05 THEN '{mode}' ELSE 'none' END AS action, {pt} AS new_pt, {width} AS new_width
FROM rt r JOIN frames f USING (deck_id, idx) WHERE NOT is_note"""


def _planned(spark, d, mode):
    frames, runs = fit_inputs(spark, d)
    frames = frames.withColumns({
        "src_len": F.length("original_text"), "tgt_len": F.length("target"),
        "free_right": (F.col("idx") % 9 * 60000).cast("long"),
    })
    return J.fit_plan(frames, runs, mode).withColumn("ratio", F.round("ratio", 6))


@query("fit_plan_auto_shrink", f"WITH {_RATIO} " + _PLANNED.format(
    mode="auto_shrink", width="CAST(NULL AS BIGINT)",
    pt="CASE WHEN ratio > 1.05 AND font_pt IS NOT NULL THEN greatest(1, CAST(round_even(font_pt * 12700 * greatest(1 / ratio, 0.8e0) / 12700, 0) AS INT)) END",
), "frames target_runs")
def _plan_shrink(spark, d):
    return _planned(spark, d, "auto_shrink")


@query("fit_plan_expand_box", f"WITH {_RATIO} " + _PLANNED.format(
    mode="expand_box", pt="CAST(NULL AS INT)",
    width="CASE WHEN ratio > 1.05 AND rotation < 0.01 AND least(floor(width_emu * (ratio - 1)), floor(width_emu * 0.3e0), idx % 9 * 60000) > 0 THEN width_emu + CAST(least(floor(width_emu * (ratio - 1)), floor(width_emu * 0.3e0), idx % 9 * 60000) AS BIGINT) END",
), "frames target_runs")
def _plan_expand(spark, d):
    return _planned(spark, d, "expand_box")


@query("fit_plan_shrink_then_expand")
def _plan_both(spark, d):
    return _planned(spark, d, "shrink_then_expand")


BUDGET_SQL = """CASE WHEN is_note THEN NULL ELSE CAST(greatest(8, floor(
  greatest(1, floor(greatest(1e0, width_emu / 12700e0) / greatest(coalesce(font_pt, 18e0) * {glyph}, 1e0))) *
  greatest(1, floor(greatest(1e0, height_emu / 12700e0) / greatest(coalesce(font_pt, 18e0) * 1.2e0, 1e0))) * {grow})) AS INT) END"""


@query("length_budget", f"SELECT deck_id, idx, {BUDGET_SQL.format(glyph='1e0', grow='1.3e0')} AS budget FROM frames", "frames")
def _budget(spark, d):
    return J.length_budget(X.frames(spark, d), "한국어", "expand_box").select("deck_id", "idx", "budget")


@query("check_overflow", f"SELECT {_FLAT_SQL} FROM (" + finding_sql(
    "fit.overflow", "major", "concat('번역 ', length(target), '자가 예상 박스 용량 ', budget, '자를 초과합니다.')",
    f"FROM bitext JOIN (SELECT deck_id, idx, {BUDGET_SQL.format(glyph='0.55e0', grow='1e0')} AS budget FROM frames) q USING (deck_id, idx) WHERE length(target) > budget",
) + ")", "bitext frames")
def _overflow(spark, d):
    return flat(W.check_overflow(X.bitext(spark, d), J.length_budget(X.frames(spark, d), "영어")))
