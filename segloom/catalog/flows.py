"""Queries over extraction, review, jobs, ledger, language and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from segloom.catalog import fixtures as X
from segloom.catalog.core import _PLAN, DIVERGENCE_CTE, DIVERGENCE_SQL, SWEEP_CTE, TERM_SQL, UNTRANSLATED_SQL, sweep
from segloom.catalog.registry import query
from segloom.catalog.styles import BUDGET_SQL, _STATUS, _status
from segloom.catalog.terms import _merged
from segloom.operators import blocks as B
from segloom.operators import extract as E
from segloom.operators import fit as J
from segloom.operators import jobs as K
from segloom.operators import language as G
from segloom.operators import ledger as L
from segloom.operators import repetition as R
from segloom.operators import review as V
from segloom.plans.cut import cut
from segloom.plans.ordering import running
from segloom.sources.exactly_once import Ledger
from segloom.streaming import jobs as Z
from segloom.streaming import state as Y

# extraction -------------------------------------------------------------------------------------

_HTML = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, "
    "'(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), "
    "'(?i)<(?:ul|ol)(?:\\s[^>]*)?>', chr(1) || '+' || chr(2), 'g'), "
    "'(?i)</(?:ul|ol)>', chr(1) || '-' || chr(2), 'g'), "
    "'(?i)<(title|h[1-6]|p|li)(?:\\s[^>]*)?>', chr(1) || '\\1' || chr(2), 'g'), "
    f"'(?i)</?(?:title|h[1-6]|p|li|{E._OTHER_BLOCKS})(?:\\s[^>]*)?/?>', chr(1) || chr(2), 'g')"
)
_UNESCAPED = "regexp_replace(substr(piece, strpos(piece, chr(2)) + 1), '<[^>]*>', '', 'g')"
for _entity, _char in E._ENTITIES:
    _UNESCAPED = "replace({}, '{}', '{}')".format(_UNESCAPED, _entity, _char.replace("'", "''"))
PAGE_BLOCKS = f"""
pc AS (SELECT page_id, i, string_split(m, chr(1))[i] AS piece FROM (SELECT page_id, m, unnest(range(1, len(string_split(m, chr(1))) + 1)) AS i
  FROM (SELECT page_id, {_HTML} AS m FROM pages))),
pt AS (SELECT page_id, i, lower(substr(piece, 1, strpos(piece, chr(2)) - 1)) AS tag, trim(regexp_replace({_UNESCAPED}, '\\s+', ' ', 'g')) AS text
  FROM pc WHERE contains(piece, chr(2))),
pd AS (SELECT *, sum(CASE tag WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM pt),
pb AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS pos,
  CASE WHEN tag = 'title' THEN 'title' WHEN tag = 'p' THEN 'paragraph' WHEN tag = 'li' THEN 'list_item' ELSE 'heading' END AS kind,
  CAST(CASE WHEN tag = 'li' THEN greatest(0, depth - 1) WHEN tag LIKE 'h_' THEN CAST(substr(tag, 2, 1) AS INT) ELSE 0 END AS INT) AS level, text
  FROM pd WHERE text <> '' AND regexp_full_match(tag, 'title|h[1-6]|p|li'))"""


@query("blocks_from_pages", f"WITH {PAGE_BLOCKS} SELECT * FROM pb")
def _page_blocks(spark, d):
    return E.blocks_from_pages(X.table(spark, d, "pages"))


def slide_shapes(spark, d):
    """Four lines of a document make a shape; positions are arithmetic, some missing, some grouped."""
    s = X.segments(spark, d)
    shape = F.floor(F.col("paragraph_index") / 4).cast("int")
    lines = s.select(
        "deck_id", "slide_index", shape.alias("shape_id"), F.col("paragraph_index").alias("line_no"), F.col("original_text").alias("text")
    )
    i = F.col("shape_id")
    shapes = lines.select("deck_id", "slide_index", "shape_id").distinct().withColumns({
        "top": F.when(i % 7 != 3, (i * 37 % 11 * 1000).cast("long")), "left": F.when(i % 5 != 2, (i * 53 % 13 * 500).cast("long")),
        "z": i, "parent_id": F.when(i % 6 == 5, i - 1),
        "kind": F.when((i % 4 == 2) & (F.col("slide_index") % 3 == 0), "title").when(i % 4 == 1, "table").otherwise("textbox"),
    })
    return shapes, lines


_SHAPES = """
ll AS (SELECT deck_id, slide_index, CAST(paragraph_index // 4 AS INT) AS shape_id, paragraph_index AS line_no, original_text AS text FROM segments),
ss AS (SELECT DISTINCT deck_id, slide_index, shape_id, CASE WHEN shape_id % 7 <> 3 THEN shape_id * 37 % 11 * 1000 END AS top,
  CASE WHEN shape_id % 5 <> 2 THEN shape_id * 53 % 13 * 500 END AS lft, CASE WHEN shape_id % 6 = 5 THEN shape_id - 1 END AS parent_id,
  CASE WHEN shape_id % 4 = 2 AND slide_index % 3 = 0 THEN 'title' WHEN shape_id % 4 = 1 THEN 'table' ELSE 'textbox' END AS kind FROM ll),
so AS (SELECT s.*, CAST(row_number() OVER (PARTITION BY s.deck_id, s.slide_index ORDER BY coalesce(g.top, s.top) IS NULL AND (g.shape_id IS NULL OR g.top IS NULL),
    CASE WHEN g.shape_id IS NULL THEN coalesce(s.top, 0) ELSE coalesce(g.top, 0) END,
    CASE WHEN g.shape_id IS NULL THEN s.lft IS NULL ELSE g.lft IS NULL END, CASE WHEN g.shape_id IS NULL THEN coalesce(s.lft, 0) ELSE coalesce(g.lft, 0) END,
    coalesce(g.shape_id, s.shape_id)) - 1 AS INT) AS reading_pos
  FROM ss s LEFT JOIN ss g ON g.deck_id = s.deck_id AND g.slide_index = s.slide_index AND g.shape_id = s.parent_id
  WHERE (s.deck_id, s.slide_index, s.shape_id) NOT IN (SELECT (deck_id, slide_index, parent_id) FROM ss WHERE parent_id IS NOT NULL))"""
# a member's place depends on its group only, so top-null must be read from the group
_SHAPES = _SHAPES.replace(
    "coalesce(g.top, s.top) IS NULL AND (g.shape_id IS NULL OR g.top IS NULL)",
    "CASE WHEN g.shape_id IS NULL THEN s.top IS NULL ELSE g.top IS NULL END",
)


@query("reading_order", f"WITH {_SHAPES} SELECT deck_id, slide_index, shape_id, reading_pos FROM so", "segments")
def _order(spark, d):
    return E.reading_order(slide_shapes(spark, d)[0]).select("deck_id", "slide_index", "shape_id", "reading_pos")


_TITLES = f"""{_SHAPES},
fl AS (SELECT ll.*, kind, reading_pos FROM ll JOIN so USING (deck_id, slide_index, shape_id)),
tt AS (SELECT deck_id, slide_index, arg_min(shape_id, reading_pos) AS sh, arg_min(title, reading_pos) AS title FROM
  (SELECT deck_id, slide_index, shape_id, reading_pos, trim(string_agg(text, chr(10) ORDER BY line_no)) AS title FROM fl WHERE kind = 'title' GROUP BY ALL) WHERE title <> '' GROUP BY ALL),
bx AS (SELECT deck_id, slide_index, shape_id AS sh, line_no AS ln, trim(text) AS title FROM (SELECT *, row_number() OVER (PARTITION BY deck_id, slide_index ORDER BY reading_pos, line_no) AS rn
  FROM fl WHERE kind = 'textbox' AND trim(text) <> '') WHERE rn = 1),
titles AS (SELECT s.deck_id, s.slide_index, coalesce(tt.title, bx.title, concat('Slide ', s.slide_index + 1)) AS title, coalesce(tt.sh, bx.sh) AS title_shape,
  CASE WHEN tt.sh IS NULL THEN bx.ln END AS title_line FROM (SELECT DISTINCT deck_id, slide_index FROM so) s LEFT JOIN tt USING (deck_id, slide_index) LEFT JOIN bx USING (deck_id, slide_index)),
rest AS (SELECT fl.* FROM fl JOIN titles USING (deck_id, slide_index) WHERE title_shape IS NULL OR shape_id <> title_shape OR line_no > title_line)"""


def _titles(spark, d):
    shapes, lines = slide_shapes(spark, d)
    return E.slide_title(E.reading_order(shapes), lines)


@query("slide_title", f"WITH {_TITLES} SELECT * FROM titles", "segments")
def _slide_title(spark, d):
    return _titles(spark, d)[0]


@query("slide_body_lines", f"WITH {_TITLES} SELECT deck_id, slide_index, shape_id, line_no, text FROM rest", "segments")
def _body(spark, d):
    return _titles(spark, d)[1]


@query("slides_subset", f"WITH {_TITLES} SELECT deck_id, slide_index, title FROM titles WHERE slide_index + 1 IN (2, 3, 5, 8, 13, 21, 34, 55, 89, 144)", "segments")
def _subset(spark, d):
    return E.slides_subset(_titles(spark, d)[0], [2, 3, 5, 8, 13, 21, 34, 55, 89, 144]).select("deck_id", "slide_index", "title")


def document_blocks(spark, d):
    """Every block kind from each document: its plain lines, its table lines, a chart, a figure, a note."""
    docs = X.table(spark, d, "documents")
    lines = F.split("text", "\n")
    is_row = lambda t: F.contains(t, F.lit(" | "))
    plain, rows = F.filter(lines, lambda t: ~is_row(t)), F.filter(lines, is_row)
    none, n = F.lit(None), F.col("n_chars").cast("double")

    def block(pos, kind, lines=none, levels=none, rows=none, title=none, cats=none, series=none, figure=none):
        return F.struct(
            F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), lines.cast("array<string>").alias("lines"), levels.cast("array<int>").alias("indent_levels"),
            rows.cast("array<array<string>>").alias("rows"), title.cast("string").alias("title"), cats.cast("array<string>").alias("categories"),
            series.cast("array<struct<name:string,values:array<double>>>").alias("series"), figure.cast("string").alias("figure_type"),
        )

    return docs.select(F.col("doc_id").cast("string").alias("deck_id"), F.lit(0).cast("long").alias("slide_index"), F.explode(F.array(
        block(0, "text", lines=plain, levels=F.transform(plain, lambda t, i: i % 3)),
        block(1, "table", rows=F.transform(rows, lambda r: F.split(r, " \\| "))),
        block(2, "chart", title=F.col("lang"), cats=F.array(F.lit("a"), F.lit("b|c"), F.lit("d")),
              series=F.array(F.struct(F.lit("s").alias("name"), F.array(n, n / 2 + 0.5).alias("values")))),
        block(3, "figure", figure=F.lit("image"), title=F.col("source")),
        block(4, "note", lines=F.array("text")),
    )).alias("b")).select("deck_id", "slide_index", "b.*")


_MD = """
dl AS (SELECT doc_id, lang, source, n_chars, text, list_filter(string_split(text, chr(10)), lambda t: NOT contains(t, ' | ')) AS pl,
  list_transform(list_filter(string_split(text, chr(10)), lambda t: contains(t, ' | ')), lambda t: list_transform(string_split(t, ' | '), lambda c: replace(c, '|', '\\|'))) AS rw FROM documents),
md AS (SELECT CAST(doc_id AS VARCHAR) AS deck_id, 0 AS pos,
    array_to_string(list_append(list_filter(list_transform(range(1, len(pl) + 1), lambda i: CASE WHEN pl[i] <> '' THEN repeat('  ', (i - 1) % 3) || '- ' || pl[i] END), lambda x: x IS NOT NULL), ''), chr(10)) AS markdown FROM dl
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, CASE WHEN len(rw) > 0 THEN
    '| ' || array_to_string(rw[1], ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(rw[1], lambda x: '---'), ' | ') || ' |' || chr(10) ||
    array_to_string(list_append(list_transform(rw[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |'), ''), chr(10)) END FROM dl
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, '[Chart: ' || lang || ']' || chr(10) || '| 구분 | a | b\\|c | d |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
    '| s | ' || n_chars || ' | ' || CASE WHEN n_chars % 2 = 1 THEN CAST((n_chars + 1) // 2 AS VARCHAR) ELSE CAST(n_chars // 2 AS VARCHAR) || '.5' END || ' |  |' || chr(10) FROM dl
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 3, '[Figure: ' || source || ']' || chr(10) FROM dl
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 4, '> NOTE: ' || trim(replace(text, chr(10), ' ')) || chr(10) FROM dl)"""


@query("block_to_markdown", f"WITH {_MD} SELECT deck_id, CAST(pos AS INT) AS pos, markdown FROM md")
def _markdown(spark, d):
    return E.block_to_markdown(document_blocks(spark, d)).select("deck_id", "pos", "markdown")


@query("slides_to_markdown", f"""
WITH {_MD}, bd AS (SELECT deck_id, string_agg(markdown, chr(10) ORDER BY pos) AS body FROM md GROUP BY ALL)
SELECT deck_id, '## Slide 1 - ' || source || chr(10) || chr(10) || trim(body, ' ' || chr(10)) || chr(10) AS markdown
FROM bd JOIN documents ON CAST(doc_id AS VARCHAR) = deck_id""")
def _slides_md(spark, d):
    slides = X.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("deck_id"), F.lit(0).cast("long").alias("slide_index"), F.col("source").alias("title")
    )
    return E.slides_to_markdown(slides, E.block_to_markdown(document_blocks(spark, d)))


# review -----------------------------------------------------------------------------------------

_DISMISSED = "(idx % 4 = 1 AND type = 'terminology.violation') OR (idx % 6 = 0 AND type = 'accuracy.omission')"


def _dismissals(spark, d):
    s = X.segments(spark, d).select("deck_id", "idx")
    return s.filter("idx % 4 = 1").withColumn("type", F.lit("terminology.violation")).unionByName(
        s.filter("idx % 6 = 0").withColumn("type", F.lit("accuracy.omission"))
    ).unionByName(s.filter("idx % 11 = 0").withColumn("type", F.lit("style.mapping_dropped")))


@query("dismissal_anti_join", f"""
WITH {SWEEP_CTE} SELECT deck_id, idx, type, ordinal FROM numbered WHERE NOT ({_DISMISSED})""", "normed glossary")
def _anti(spark, d):
    return V.dismissal_anti_join(sweep(spark, d), _dismissals(spark, d)).select("deck_id", "idx", "type", "ordinal")


def phrase_edits(spark, d):
    """An edit of the longest word of every segment whose number 20 divides."""
    words = F.regexp_extract_all("target", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return X.bitext(spark, d).filter("idx % 20 = 0").select(
        "deck_id", F.col("idx").cast("long").alias("edit_id"), "idx", longest.alias("old_phrase"),
        F.when(F.col("idx") % 2 == 0, "").otherwise("NEW").alias("new_phrase"),
    ).filter("old_phrase is not null")


_EDITS = """
ew AS (SELECT deck_id, idx, unnest(regexp_extract_all(target, '[\\p{L}\\p{N}_]+')) AS w FROM bitext WHERE idx % 20 = 0),
ed AS (SELECT deck_id, idx AS eidx, max(struct_pack(n := length(w), w := w)).w AS old FROM ew GROUP BY ALL),
good AS (SELECT * FROM ed WHERE NOT regexp_full_match(old, '[_\\p{Nd}]*') AND (length(regexp_replace(old, '_', '', 'g')) >= 4 OR
  (length(regexp_replace(old, '_', '', 'g')) >= 2 AND regexp_matches(old, '\\p{Lu}') AND NOT regexp_matches(old, '\\p{Ll}')))),
tk AS (SELECT deck_id, idx, w, count(*) AS n FROM (SELECT deck_id, idx, unnest(regexp_extract_all(target, '[\\p{L}\\p{N}_]+')) AS w FROM bitext) GROUP BY ALL),
pp AS (SELECT good.deck_id, eidx, tk.idx, old FROM good JOIN tk ON tk.deck_id = good.deck_id AND tk.w = old AND n = 1 AND tk.idx <> eidx)"""


@query("partial_phrase_candidates", f"WITH {_EDITS} SELECT pp.deck_id, CAST(eidx AS BIGINT) AS edit_id, pp.idx, old AS old_phrase, target FROM pp JOIN bitext USING (deck_id, idx)", "bitext")
def _partial(spark, d):
    return V.partial_phrase_candidates(phrase_edits(spark, d), X.bitext(spark, d)).select(
        "deck_id", "edit_id", "idx", "old_phrase", "target"
    )


_BOUND = "(?:^|[^\\p{L}\\p{N}_])"


@query("replace_phrase_once", f"""
WITH {_EDITS}, q AS (SELECT pp.deck_id, eidx, pp.idx, old, target, regexp_extract(concat(' ', target, ' '), '[^\\p{{L}}\\p{{N}}_](' || old || ')[^\\p{{L}}\\p{{N}}_]') AS hit FROM pp JOIN bitext USING (deck_id, idx)),
r AS (SELECT *, strpos(concat(' ', target, ' '), hit) AS p FROM q)
SELECT deck_id, CAST(eidx AS BIGINT) AS edit_id, idx, CASE WHEN eidx % 2 = 1 THEN substr(target, 1, p - 1) || 'NEW' || substr(target, p + length(old))
  WHEN substr(target, p + length(old), 1) = ' ' THEN substr(target, 1, p - 1) || substr(target, p + length(old) + 1)
  WHEN p > 1 AND substr(target, p - 1, 1) = ' ' THEN substr(target, 1, p - 2) || substr(target, p + length(old))
  ELSE substr(target, 1, p - 1) || substr(target, p + length(old)) END AS proposed_target FROM r""", "bitext")
def _replace(spark, d):
    return V.partial_phrase_candidates(phrase_edits(spark, d), X.bitext(spark, d)).select("deck_id", "edit_id", "idx", "proposed_target")


def group_edits(spark, d):
    """Nine operations per deck that between them edit every segment, each every ninth, sometimes with the same text."""
    return X.bitext(spark, d).select(
        "deck_id", (F.col("idx") % 9).cast("int").alias("op_id"), F.col("idx").alias("pos"), "idx",
        F.when(F.col("idx") % 2 == 0, F.concat(F.lit("E"), (F.col("idx") % 4).cast("string"))).otherwise(F.col("original_text")).alias("target"),
    )


_GE = "ge AS (SELECT deck_id, idx AS eidx, CAST(idx % 9 AS INT) AS op_id, CASE WHEN idx % 2 = 0 THEN concat('E', idx % 4) ELSE original_text END AS t FROM bitext)"
_PROP = f"""{_PLAN}, {_GE},
cand AS (SELECT p.deck_id, p.idx, ge.op_id, ge.eidx, ge.t, b.target AS cur FROM ge JOIN plan o ON o.deck_id = ge.deck_id AND o.idx = ge.eidx
  JOIN plan p ON p.deck_id = o.deck_id AND p.canonical = o.canonical JOIN bitext b ON b.deck_id = p.deck_id AND b.idx = p.idx
  WHERE p.idx = ge.eidx OR p.idx % 9 <> ge.op_id)"""


@query("propagate_edits", f"""
WITH {_PROP} SELECT deck_id, op_id, idx, arg_max(t, eidx) AS target FROM cand WHERE t <> cur GROUP BY deck_id, op_id, idx""", "segments bitext")
def _propagate(spark, d):
    plan = cut(R.repetition_plan(X.segments(spark, d)).select("deck_id", "idx", "canonical", "repeat_count"))
    return V.propagate_edits(group_edits(spark, d), plan, X.bitext(spark, d))


@query("effective_edits", """
WITH s AS (SELECT *, sum(CASE action WHEN 'edit' THEN 1 ELSE -1 END) OVER (PARTITION BY session_id ORDER BY seq) AS sm FROM review_log WHERE action IN ('edit', 'undo')),
l AS (SELECT *, sm - least(0, min(sm) OVER (PARTITION BY session_id ORDER BY seq)) AS lv FROM s),
a AS (SELECT *, min(lv) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS af FROM l)
SELECT session_id, idx, arg_max(new_target, seq) AS target FROM a WHERE action = 'edit' AND af >= lv GROUP BY ALL""", "review_log")
def _effective(spark, d):
    return V.effective_edits(X.review_log(spark, d))


_ACTS = "a AS (SELECT *, lag(action) OVER (PARTITION BY session_id, idx ORDER BY seq) AS pa FROM review_log WHERE action IN ('dismiss', 'restore'))"


@query("dismissal_state", f"WITH {_ACTS} SELECT session_id, idx FROM a GROUP BY ALL HAVING arg_max(action, seq) = 'dismiss'", "review_log")
def _dstate(spark, d):
    return V.dismissal_state(X.review_log(spark, d))[0]


@query("dismissal_changes", f"WITH {_ACTS} SELECT session_id, idx, seq, action FROM a WHERE action <> coalesce(pa, 'restore')", "review_log")
def _dchanges(spark, d):
    return V.dismissal_state(X.review_log(spark, d))[1]


def operations(spark, d):
    """Edit operations of the log. Every 40th names a stale revision, the others the one that is current then.

    Each accepted edit brings a new text, so it raises the revision; an undo does while there is something to take
    back. With S the edits minus undos so far, undos that met an empty stack number as many as S has been below 0.
    """
    log = X.review_log(spark, d).filter("action in ('edit', 'undo', 'commit')")
    good = F.col("seq") % 40 != 0
    steps = log.withColumns({
        "e": (good & (F.col("action") == "edit")).cast("long"), "u": (good & (F.col("action") == "undo")).cast("long"),
    })
    key = ["session_id"]
    sums = running(steps, key, "seq", {"es": ("sum", F.col("e")), "us": ("sum", F.col("u"))})
    low = running(sums, key, "seq", {"low": ("min", F.col("es") - F.col("us"))}, exclusive=True)
    prior = running(low, key, "seq", {"prior": ("max", F.col("seq"))}, exclusive=True)
    current = F.col("es") - F.col("e") + F.col("us") - F.col("u") - F.greatest(F.lit(0), -F.coalesce("low", F.lit(0)))
    return prior.select(
        "session_id", "seq", "action", F.when(good, current).otherwise(F.lit(-1)).cast("long").alias("expected_revision"),
        F.array(F.struct("idx", F.col("new_target").alias("text"), F.lit("").alias("base"))).alias("edits"),
        F.col("prior").cast("long").alias("prior"),
    )


_REPLAY_SQL = """
WITH o AS (
  SELECT session_id, seq, action, seq % 40 <> 0 AS accepted,
    CASE WHEN seq % 40 <> 0 AND action = 'edit' THEN 1 ELSE 0 END AS e, CASE WHEN seq % 40 <> 0 AND action = 'undo' THEN 1 ELSE 0 END AS u
  FROM review_log WHERE action IN ('edit', 'undo', 'commit')),
s AS (SELECT *, sum(e) OVER w AS es, sum(u) OVER w AS us FROM o WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
r AS (SELECT *, CAST(es + us - greatest(0, -min(es - us) OVER (PARTITION BY session_id ORDER BY seq)) AS INT) AS revision FROM s),
c AS (SELECT *, last_value(CASE WHEN accepted AND action = 'commit' THEN revision END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq) AS committed FROM r)
SELECT session_id, seq, action, accepted, revision, revision <> coalesce(committed, 0) AS dirty FROM c"""


@query("replay_edit_log", _REPLAY_SQL, "review_log")
def _replay(spark, d):
    return V.replay_edit_log(operations(spark, d)).select("session_id", "seq", "action", "accepted", "revision", "dirty")


@query("edit_preview", f"""
WITH {_PLAN},
e AS (SELECT b.deck_id, b.idx, b.target AS old, replace(b.target, ' the ', ' a ') AS nw, o.canonical, budget
  FROM (SELECT deck_id, idx, target, {BUDGET_SQL.format(glyph='1e0', grow='1e0')} AS budget FROM frames) b JOIN plan o USING (deck_id, idx) WHERE b.idx % 20 = 0),
ch AS (SELECT e.deck_id, e.idx, count(*) AS n FROM e JOIN plan p ON p.deck_id = e.deck_id AND p.canonical = e.canonical
  JOIN bitext b ON b.deck_id = p.deck_id AND b.idx = p.idx WHERE b.target <> e.nw AND (p.idx = e.idx OR NOT (p.idx % 20 = 0)) GROUP BY ALL)
SELECT e.deck_id, CAST(e.idx AS BIGINT) AS edit_id, e.idx, old AS old_target, nw AS new_target, coalesce(ch.n, 0) AS changed, coalesce(length(nw) > budget, false) AS over_budget
FROM e LEFT JOIN ch USING (deck_id, idx)""", "segments bitext frames")
def _preview(spark, d):
    b = X.bitext(spark, d)
    plan = cut(R.repetition_plan(X.segments(spark, d)).select("deck_id", "idx", "canonical", "repeat_count"))
    proposed = b.filter("idx % 20 = 0").select(
        "deck_id", F.col("idx").cast("long").alias("edit_id"), "idx", F.replace("target", F.lit(" the "), F.lit(" a ")).alias("new_target"), F.lit(True).alias("propagate")
    )
    previews, _ = V.edit_preview(proposed, b, plan, J.length_budget(X.frames(spark, d), "한국어"))
    return previews.select("deck_id", "edit_id", "idx", "old_target", "new_target", "changed", "over_budget")


@query("review_table", f"""
WITH {SWEEP_CTE}, {_PLAN}, {_STATUS},
f AS (SELECT deck_id, idx, string_agg(type, ',' ORDER BY ordinal) AS types FROM numbered WHERE NOT ({_DISMISSED}) GROUP BY ALL),
bg AS (SELECT deck_id, idx, {BUDGET_SQL.format(glyph='1e0', grow='1e0')} AS budget FROM frames)
SELECT b.deck_id, b.idx, b.slide_index + 1 AS slide, b.original_text AS source, b.target, repeat_count, budget AS length_budget,
  concat_ws(',', types, CASE WHEN status IN ('dropped', 'partial') AND b.idx % 11 <> 0 THEN 'style.mapping_dropped' END) AS finding_types,
  b.idx % 7 = 1 AS edited, coalesce(status, 'single_style') AS style_status, b.container_kind
FROM bitext b JOIN plan USING (deck_id, idx) LEFT JOIN f USING (deck_id, idx) LEFT JOIN bg USING (deck_id, idx) LEFT JOIN stat USING (deck_id, idx)""", "normed glossary runs frames")
def _table(spark, d):
    b = X.bitext(spark, d)
    out = V.review_table(
        b, R.repetition_plan(X.segments(spark, d)), sweep(spark, d), _dismissals(spark, d), b.filter("idx % 7 = 1"),
        J.length_budget(X.frames(spark, d), "한국어"), _status(spark, d),
    )
    return out.select(
        "deck_id", "idx", "slide", "source", "target", "repeat_count", "length_budget",
        F.array_join("findings.type", ",").alias("finding_types"), "edited", "style_status", "container_kind",
    )


def _shout(texts: list[str], strict: bool) -> list[str]:
    return [t[: max(1, len(t) * 2 // 3)] if strict else f"{t} {t}" for t in texts]


@query("relocalise_blocks")
def _relocalise(spark, d):
    blocks = cut(B.merge_blocks(X.fragments(spark, d)))
    budgets = blocks.groupBy("deck_id", "block_id").agg(F.lit(200).alias("budget"))
    return V.relocalise_blocks(blocks, _shout, budgets)


# jobs -------------------------------------------------------------------------------------------

_JS = """
je AS (SELECT *, CASE WHEN event_type = 'progress' AND event_id % 211 = 0 THEN 'cancelled' ELSE event_type END AS kind FROM job_events),
js AS (SELECT job_id, count(*) AS events, max(event_id) FILTER (kind = 'cancelled') AS cid, arg_min(kind, event_id) FILTER (kind IN ('complete', 'error')) AS fk,
  min(event_id) FILTER (kind IN ('complete', 'error')) AS fid, coalesce(bool_or(kind = 'started'), false) AS st, min(event_id) FILTER (kind IN ('complete', 'error', 'cancelled')) AS endid FROM je GROUP BY ALL),
state AS (SELECT job_id, CASE WHEN cid IS NOT NULL THEN 'cancelled' WHEN fk = 'complete' THEN 'completed' WHEN fk = 'error' THEN 'failed' WHEN st THEN 'running' ELSE 'pending' END AS state,
  coalesce(cid, fid) AS ended_by, events FROM js)"""


def events(spark, d):
    """Job events; now and then a progress event is a cancellation. Ids follow time."""
    e = X.job_events(spark, d)
    odd = (F.col("event_type") == "progress") & (F.col("event_id") % 211 == 0)
    return e.withColumn("event_type", F.when(odd, "cancelled").otherwise(F.col("event_type")))


@query("job_state", f"WITH {_JS} SELECT * FROM state", "job_events")
def _job_state(spark, d):
    return K.job_state(events(spark, d))


@query("latest_progress", f"""
WITH {_JS} SELECT job_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM je JOIN js USING (job_id)
WHERE kind = 'progress' AND (endid IS NULL OR event_id < endid) GROUP BY ALL""", "job_events")
def _latest(spark, d):
    return K.latest_progress(events(spark, d))


@query("expire_idle", f"""
WITH {_JS} SELECT job_id, max(ts) AS last_activity FROM je GROUP BY ALL
HAVING bool_or(kind IN ('complete', 'error', 'cancelled')) AND max(ts) + INTERVAL 1 HOUR < (SELECT max(ts) FROM je)""", "job_events")
def _expire(spark, d):
    return K.expire_idle(events(spark, d))


@query("activity_sessions", f"""
WITH {_JS}, g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY job_id ORDER BY ts) + INTERVAL 1 HOUR > ts THEN 0 ELSE 1 END AS nw FROM je),
h AS (SELECT *, sum(nw) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS sn FROM g)
SELECT job_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS stop, count(*) AS events, bool_or(kind IN ('complete', 'error', 'cancelled')) AS ended FROM h GROUP BY job_id, sn""", "job_events")
def _sessions(spark, d):
    return K.activity_sessions(events(spark, d))


@query("event_counts_tumbling", f"WITH {_JS} SELECT date_trunc('hour', ts) AS start, kind AS event_type, count(*) AS n FROM je GROUP BY ALL", "job_events")
def _tumbling(spark, d):
    return K.event_counts(events(spark, d), "1 hour")


@query("event_counts_sliding", f"""
WITH {_JS} SELECT time_bucket(INTERVAL 15 MINUTE, ts) - CAST(k AS INT) * INTERVAL 15 MINUTE AS start, kind AS event_type, count(*) AS n
FROM je, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL""", "job_events")
def _sliding(spark, d):
    return K.event_counts(events(spark, d), "1 hour", "15 minutes")


@query("last_n_events", """
SELECT job_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM job_events) WHERE rn <= 50""", "job_events")
def _last(spark, d):
    return K.last_n_events(X.job_events(spark, d), 50).select("job_id", "event_id")


@query("active_counts", f"""
WITH {_JS} SELECT count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state IN ('running', 'pending')) AS active FROM state""", "job_events")
def _active(spark, d):
    return K.active_counts(K.job_state(events(spark, d)))


# ledger -----------------------------------------------------------------------------------------

_SEV = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "major", "minor"))


@query("findings_by_severity", f"WITH {SWEEP_CTE} SELECT deck_id, {_SEV} FROM numbered GROUP BY ALL", "normed glossary")
def _by_severity(spark, d):
    return L.findings_by_severity(sweep(spark, d))


def _run_meta(spark, d):
    return X.segments(spark, d).groupBy("deck_id").agg(F.count(F.lit(1)).alias("doc_words")).withColumn(
        "started_at", F.lit(1700000000000).cast("long")
    )


@query("quality_runs", f"""
WITH {SWEEP_CTE}, w AS (SELECT deck_id, count(*) AS doc_words FROM segments GROUP BY ALL), c AS (SELECT deck_id, {_SEV} FROM numbered GROUP BY ALL)
SELECT 'run_' || substr(sha256(w.deck_id || '|1700000000000'), 1, 16) AS id, w.deck_id AS project_id, CAST(1700000000000 AS BIGINT) AS started_at, 's1_translate' AS stage,
  'en_to_ko' AS direction, doc_words, coalesce(critical, 0) AS critical, coalesce(major, 0) AS major, coalesce(minor, 0) AS minor FROM w LEFT JOIN c USING (deck_id)""", "segments normed glossary")
def _runs(spark, d):
    runs = L.quality_runs(sweep(spark, d), _run_meta(spark, d), source_lang="영어", target_lang="한국어")
    return runs.select("id", "project_id", "started_at", "stage", "direction", "doc_words", "findings_count.*")


_RECORD_SQL = """'qr_' || substr(sha256(deck_id || '|' || ordinal || '|' || type), 1, 16) AS id, deck_id AS project_id, 'en_to_ko' AS direction, slide, paragraph,
  source, output, type, severity, suggested_fix, 'proposed' AS disposition, 'candidate' AS status"""


@query("quality_records", f"WITH {SWEEP_CTE} SELECT {_RECORD_SQL} FROM numbered", "normed glossary")
def _records(spark, d):
    """Written to the ledger as JSON lines and read back."""
    from segloom.plans.cut import shared_dir
    import uuid

    rows = L.quality_records(sweep(spark, d), F.lit(1700000000000), source_lang="영어", target_lang="한국어")
    path = f"{shared_dir(spark)}/segloom/{uuid.uuid4().hex}/{L.RECORDS_TABLE}"
    L.append_json(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    return back.select(
        "id", "project_id", "direction", "location.slide", "location.paragraph", "segment.source", "segment.output",
        "finding.type", "finding.severity", "finding.suggested_fix", "disposition", "promotion.status",
    )


@query("review_records", """
SELECT 'qr_' || substr(sha256(session_id || '|' || seq), 1, 16) AS id, session_id AS project_id, seq, idx, CASE WHEN action = 'edit' THEN new_target END AS corrected,
  'manual.edit' AS type, CASE WHEN action = 'edit' THEN 'accepted' ELSE 'rejected' END AS disposition, CASE WHEN action = 'edit' THEN 'candidate' ELSE 'rejected' END AS promotion_status
FROM review_log WHERE action IN ('edit', 'dismiss')""", "review_log")
def _review_records(spark, d):
    return L.review_records(X.review_log(spark, d)).drop("severity", "description", "stage")


@query("corpus_rollup", f"""
WITH {SWEEP_CTE} SELECT deck_id, severity, type, count(*) AS findings, count(DISTINCT place) AS segments, CAST(grouping_id(deck_id, severity, type) AS BIGINT) AS level
FROM (SELECT *, (deck_id, idx) AS place FROM numbered) GROUP BY ROLLUP (deck_id, severity, type)""", "normed glossary")
def _rollup(spark, d):
    return L.corpus_rollup(sweep(spark, d))


@query("corpus_cube", f"""
WITH {SWEEP_CTE} SELECT severity, type, count(*) AS findings, CAST(grouping_id(severity, type) AS BIGINT) AS level FROM numbered GROUP BY CUBE (severity, type)""", "normed glossary")
def _cube(spark, d):
    return L.corpus_cube(sweep(spark, d))


# language ---------------------------------------------------------------------------------------

def _grams_sql(keys: str, text: str, frm: str) -> str:
    """Trigram rows of padded words."""
    words = f"SELECT {keys}, ' ' || unnest(string_split_regex(lower({text}), '[^\\p{{L}}]+')) || ' ' AS w FROM {frm}"
    return f"SELECT {keys}, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) AS gram FROM ({words}) WHERE w <> '  '"


_PROFILE = f"prof AS (SELECT lang, gram, count(*) AS n FROM ({_grams_sql('lang', 'text', 'documents')}) GROUP BY ALL)"


@query("language_profile", f"WITH {_PROFILE} SELECT * FROM prof")
def _profile(spark, d):
    return G.language_profile(X.table(spark, d, "documents"))


@query("deck_samples", """
SELECT deck_id, substr(trim(coalesce(string_agg(original_text, chr(10) ORDER BY idx) FILTER (NOT is_note), '')), 1, 500) AS sample FROM segments WHERE idx < 50 GROUP BY deck_id""", "segments")
def _samples(spark, d):
    return G.deck_samples(X.segments(spark, d))


def _detect_sql(sm: str, text: str) -> str:
    return f"""
WITH {_PROFILE},
sm AS ({sm}),
ct AS (SELECT deck_id, gram, count(*) AS c FROM ({_grams_sql('deck_id', text, 'sm')}) GROUP BY ALL),
den AS (SELECT lang, sum(n) + (SELECT count(DISTINCT gram) FROM prof) AS den FROM prof GROUP BY ALL),
sc AS (SELECT deck_id, lang, sum(c * ln(coalesce(n, 0) + 1)) - sum(c) * ln(any_value(den)) AS s FROM ct CROSS JOIN den LEFT JOIN prof USING (lang, gram) GROUP BY ALL)
SELECT deck_id, coalesce(CASE arg_max(lang, s) WHEN 'en' THEN '영어' WHEN 'fr' THEN '프랑스어' WHEN 'de' THEN '독일어' WHEN 'es' THEN '스페인어' END, '영어') AS language
FROM (SELECT DISTINCT deck_id FROM segments) LEFT JOIN sc USING (deck_id) GROUP BY deck_id"""


@query("detect_language_sample", _detect_sql(
    "SELECT deck_id, substr(trim(coalesce(string_agg(original_text, chr(10) ORDER BY idx) FILTER (NOT is_note), '')), 1, 500) AS sample FROM segments WHERE idx < 50 GROUP BY deck_id",
    "sample"), "segments")
def _detect_sample(spark, d):
    return G.detect_language(G.deck_samples(X.segments(spark, d)), G.language_profile(X.table(spark, d, "documents")), text="sample")


@query("detect_language", _detect_sql("SELECT deck_id, idx, original_text FROM segments WHERE NOT is_note", "original_text"), "segments")
def _detect(spark, d):
    """By all texts of each deck."""
    return G.detect_language(X.segments(spark, d).filter("not is_note"), G.language_profile(X.table(spark, d, "documents")), decks=X.segments(spark, d))


@query("check_untranslated_detected")
def _untranslated(spark, d):
    """Both tests of the untranslated check; the detector reads every target."""
    from segloom.catalog.core import flat
    from segloom.operators import sweep as W

    b = X.bitext(spark, d)
    profile = cut(G.language_profile(X.table(spark, d, "documents")))
    detected = G.code_of(profile, F.col("target"))
    if detected is None:  # a profile too large to go to every task
        b = cut(W.with_norms(b))
        detected = G.detect_code(b.filter("length(tgt_n) >= 12"), profile, ["deck_id", "idx"], "target")
    return flat(W.check_untranslated(b, "영어", "한국어", detected))


# streams ----------------------------------------------------------------------------------------

def _event_stream(spark, d):
    Z.use_rocksdb(spark)
    raw = spark.readStream.schema(X.table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    e = F.col("event_type")
    kind = F.when(e == "signup", "started").when(e.isin("view", "click"), "progress").when(e == "purchase", "complete").otherwise("error")
    odd = (kind == "progress") & (F.col("event_id") % 211 == 0)
    return raw.select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(odd, "cancelled").otherwise(kind).alias("event_type"), "value",
    )


@query("job_state_stream", f"WITH {_JS} SELECT job_id, state, ended_by FROM state", "job_events")
def _state_stream(spark, d):
    changes = Z.run_available(Z.job_state_stream(_event_stream(spark, d)), "update")
    return changes.groupBy("job_id").agg(F.max_by(F.struct("state", "ended_by"), "batch_id").alias("s")).select("job_id", "s.*")


@query("event_counts_stream", f"""
WITH {_JS} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, kind AS event_type, count(*) AS n FROM je
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM je) - INTERVAL 10 MINUTE GROUP BY ALL""", "job_events")
def _counts_stream(spark, d):
    """Windows the watermark has closed."""
    out = Z.run_available(Z.event_counts_stream(_event_stream(spark, d), "1 hour"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("idle_sessions_stream")
def _idle_stream(spark, d):
    out = Z.run_available(Z.idle_sessions_stream(_event_stream(spark, d)))
    return out.select("job_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "ended")


@query("expire_idle_stream", f"""
WITH {_JS} SELECT job_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_activity FROM je GROUP BY ALL
HAVING bool_or(kind IN ('complete', 'error', 'cancelled')) AND max(ts) + INTERVAL 1 HOUR < (SELECT max(ts) FROM je)""", "job_events")
def _expire_stream(spark, d):
    """Timers reap ended jobs when event time has passed their idle gap."""
    out = Z.run_available(Y.expire_idle_stream(_event_stream(spark, d)))
    return out.select("job_id", F.date_format("last_activity", "yyyy-MM-dd HH:mm:ss").alias("last_activity"))


@query("latest_progress_stream", f"""
WITH {_JS} SELECT job_id, max(event_id) AS event_id, CAST(arg_max(value, event_id) AS DOUBLE) AS value FROM je JOIN js USING (job_id)
WHERE kind = 'progress' AND (endid IS NULL OR event_id < endid) GROUP BY ALL""", "job_events")
def _latest_stream(spark, d):
    changes = Z.run_available(Y.progress_stream(_event_stream(spark, d)), "update")
    newest = changes.groupBy("job_id").agg(F.max_by(F.struct("event_id", "value"), "batch_id").alias("s"))
    return newest.select("job_id", "s.*").filter("event_id is not null")


#: Files of a micro-batch: many, so that it is written and read by many tasks.
_ARRIVING = 16


def _in_files(spark, df, n, *by):
    """``df`` arriving in ``n`` micro-batches, in no order."""
    written = cut(df.repartition(n * _ARRIVING, F.xxhash64(*by)))
    Z.use_rocksdb(spark)
    per_batch = -(-len(written.inputFiles()) // n)
    return spark.readStream.schema(written.schema).option("maxFilesPerTrigger", per_batch).parquet(written.inputFiles()[0].rsplit("/", 1)[0])


@query("dismissal_stream", f"WITH {_ACTS} SELECT session_id, idx FROM a GROUP BY ALL HAVING arg_max(action, seq) = 'dismiss'", "review_log")
def _dismissal_stream(spark, d):
    """Dismissals and restores that arrive out of order."""
    changes = Z.run_available(Y.dismissal_stream(_in_files(spark, X.review_log(spark, d), 3, "session_id", "seq")), "update")
    newest = changes.groupBy("session_id", "idx").agg(F.max_by("action", "batch_id").alias("action"))
    return newest.filter("action = 'dismiss'").select("session_id", "idx")


@query("divergence_stream", f"""
WITH {DIVERGENCE_CTE} SELECT deck_id, idx, description FROM ({DIVERGENCE_SQL})""", "normed")
def _divergence_stream(spark, d):
    """Segments arrive out of order; findings are made and withdrawn, and what stands is the sweep's."""
    b = X.bitext(spark, d).select("deck_id", "idx", "slide_index", "paragraph_index", "original_text", "target")
    changes = Z.run_available(Y.divergence_stream(_in_files(spark, b, 3, "deck_id", "idx")))
    return Y.net(changes).select("deck_id", "idx", "description")


@query("sweep_after_glossary_change", f"SELECT deck_id, idx, suggested_fix, term_source FROM ({TERM_SQL})", "normed glossary")
def _after_change(spark, d):
    """The glossary is built up in three upserts while segments arrive; stored findings follow without a full sweep."""
    from segloom.operators import sweep as W

    b, terms = cut(X.bitext(spark, d)), cut(X.glossary(spark))
    states = [
        (b.filter("idx % 3 = 0"), terms.filter("pos < 5").withColumn("target", F.concat("target", F.lit("?")))),
        (b.filter("idx % 3 = 1"), terms.filter("pos < 8").withColumn("target", F.when(F.col("pos") == 2, "x").otherwise(F.col("target")))),
        (b.filter("idx % 3 = 2"), terms),
    ]
    there, now = states[0]
    found = cut(W.term_violation_join(there, now))
    for arrived, after in states[1:]:
        found = cut(Y.refresh_terminology(found, there, arrived, now, after))
        there, now = there.unionByName(arrived), after
    return found.select("deck_id", "idx", "suggested_fix", "term_source")


@query("ledger_exactly_once", """
SELECT 'qr_' || substr(sha256(session_id || '|' || seq), 1, 16) AS id, seq, CASE WHEN action = 'edit' THEN 'accepted' ELSE 'rejected' END AS disposition
FROM review_log WHERE action IN ('edit', 'dismiss')""", "review_log")
def _exactly_once(spark, d):
    """Every micro-batch is written, and written again as after a failure; the ledger has one row per id."""
    import uuid

    from segloom.plans.cut import shared_dir

    base = f"{shared_dir(spark)}/segloom/{uuid.uuid4().hex}"
    ledger = Ledger(spark, f"{base}/ledger")
    records = Z.quality_stream(_in_files(spark, X.review_log(spark, d), 3, "session_id", "seq"), late="3650 days")

    def twice(batch, number):
        ledger.append(batch, f"review-{number}")
        ledger.append(batch, f"review-{number}")

    writer = records.writeStream.option("checkpointLocation", f"{base}/log").trigger(availableNow=True)
    writer.foreachBatch(twice).start().awaitTermination()
    return ledger.read(records.schema).select("id", "seq", "disposition")


@query("incremental_sweep", f"""
SELECT deck_id, idx, type, suggested_fix, term_source FROM ({TERM_SQL} UNION ALL {UNTRANSLATED_SQL})""", "normed glossary")
def _incremental(spark, d):
    """New segments arrive as files and are checked as they come."""
    b = cut(X.bitext(spark, d))
    arriving = spark.readStream.schema(b.schema).parquet(b.inputFiles()[0].rsplit("/", 1)[0])
    found = Z.sweep_available(arriving, X.glossary(spark), source_lang="영어", target_lang="한국어")
    return found.select("deck_id", "idx", "type", "suggested_fix", "term_source")


@query("quality_stream", """
SELECT 'qr_' || substr(sha256(session_id || '|' || seq), 1, 16) AS id, seq, CASE WHEN action = 'edit' THEN 'accepted' ELSE 'rejected' END AS disposition
FROM review_log WHERE action IN ('edit', 'dismiss')""", "review_log")
def _quality_stream(spark, d):
    log = cut(X.review_log(spark, d))
    arriving = spark.readStream.schema(log.schema).parquet(log.inputFiles()[0].rsplit("/", 1)[0])
    return Z.run_available(Z.quality_stream(arriving)).select("id", "seq", "disposition")


@query("replay_stream", _REPLAY_SQL, "review_log")
def _replay_stream(spark, d):
    """The same log arriving out of order, a file at a time."""
    ops = cut(operations(spark, d).repartition(3, F.xxhash64("session_id", "seq")).sortWithinPartitions(F.xxhash64("seq")))
    Z.use_rocksdb(spark)
    arriving = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(ops.inputFiles()[0].rsplit("/", 1)[0])
    return Z.run_available(Z.replay_stream(arriving)).select("session_id", "seq", "action", "accepted", "revision", "dirty")
