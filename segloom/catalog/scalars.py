"""Queries for the column functions, each run over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from segloom.catalog import fixtures as X
from segloom.catalog.registry import query
from segloom.functions import text as T
from segloom.functions import values as V

_CJK = V.CJK_CLASS
_LANG_SQL = "CASE lang WHEN 'en' THEN '영어' WHEN 'fr' THEN '프랑스어' WHEN 'de' THEN '독일어' WHEN 'es' THEN '스페인어' ELSE '영어' END"


@query("clean_text", "SELECT doc_id, trim(replace(replace(text, chr(13), ' '), chr(10), ' ')) AS clean FROM documents")
def _clean(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.clean_text("text").alias("clean"))


@query("norm_text", f"SELECT doc_id, {X.norm_sql('text')} AS norm FROM documents")
def _norm(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.norm_text("text").alias("norm"))


@query("term_key", "SELECT source, count(*) AS n, replace(lower(trim(source)), 'ß', 'ss') AS term_key FROM lexicon GROUP BY source", "lexicon")
def _term_key(spark, d):
    return X.lexicon(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("term_key", T.term_key("source"))


@query("has_letters_cjk", f"""
SELECT deck_id, idx, regexp_matches(original_text, '\\p{{L}}') AS letters, regexp_matches(original_text, '[{_CJK}]') AS cjk
FROM segments""", "segments")
def _letters(spark, d):
    return X.segments(spark, d).select(
        "deck_id", "idx", T.has_letters("original_text").alias("letters"), T.has_cjk("original_text").alias("cjk")
    )


_WORDS = "regexp_extract_all(original_text, '\\S*\\p{L}\\S*')"


@query("looks_like_prose", f"""
SELECT deck_id, idx, CAST(len({_WORDS}) AS INT) AS words,
  len(list_filter({_WORDS}, lambda w: regexp_full_match(lower(trim(w, '.,;:!?()[]''"')), '{"|".join(V.FUNCTION_WORDS)}'))) > 0
  OR (len({_WORDS}) >= 4 AND regexp_matches(original_text, '[.!?]\\s*$')) AS prose
FROM segments""", "segments")
def _prose(spark, d):
    return X.segments(spark, d).select(
        "deck_id", "idx", T.letter_words("original_text").alias("words"), T.looks_like_prose("original_text").alias("prose")
    )


@query("char_limit", """
SELECT deck_id, idx, CAST(greatest(1, length(trim(original_text)) * 80 // 100) AS INT) AS at80,
  CAST(greatest(1, length(trim(original_text)) * 135 // 100) AS INT) AS at135 FROM segments""", "segments")
def _limit(spark, d):
    return X.segments(spark, d).select(
        "deck_id", "idx", T.char_limit("original_text", 80).alias("at80"), T.char_limit("original_text", 135).alias("at135")
    )


_TOK = "CASE WHEN length({c}) = 0 THEN 0 ELSE greatest(1, length({c}) // 4) END"


@query("approx_tokens", f"""
SELECT deck_id, idx, CAST({_TOK.format(c='target')} AS INT) AS tokens,
  CAST({_TOK.format(c='original_text')} + {_TOK.format(c='slide_title')} + {_TOK.format(c='target')} + 200 AS INT) AS batch
FROM bitext""", "bitext")
def _tokens(spark, d):
    return X.bitext(spark, d).select(
        "deck_id", "idx", T.approx_tokens("target").alias("tokens"),
        T.batch_tokens("original_text", "slide_title", "target").alias("batch"),
    )


@query("output_token_budget", "SELECT doc_id, CAST(least(8192, greatest(1024, (n_chars // 50) * 120 + 256)) AS INT) AS budget FROM documents")
def _budget(spark, d):
    return X.table(spark, d, "documents").select(
        "doc_id", T.output_token_budget(F.floor(F.col("n_chars") / 50)).alias("budget")
    )


@query("length_bucket", """
SELECT deck_id, CASE WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 40 THEN '21-40'
  WHEN n <= 80 THEN '41-80' WHEN n <= 160 THEN '81-160' ELSE '161+' END AS bucket, count(*) AS segments
FROM (SELECT deck_id, length(trim(original_text)) AS n FROM fragments) GROUP BY ALL""", "fragments")
def _bucket(spark, d):
    return X.fragments(spark, d).groupBy(
        "deck_id", T.length_bucket(F.length(T.strip("original_text"))).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("segments"))


@query("sanitize_html", """
SELECT page_id, replace(replace(replace(replace(replace(CASE WHEN length(html) > 2000 THEN substr(html, 1, 2000) || '...' ELSE html END,
  '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe FROM pages""")
def _html(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.sanitize_html("html", 2000).alias("safe"))


_NAME = "trim(regexp_replace(regexp_replace(url, '[^\\p{L}\\p{N}\\-_. ]', '', 'g'), ' +', ' ', 'g'))"


@query("sanitize_name", f"""
SELECT page_id, CASE WHEN length(n) <= 30 THEN n
  WHEN contains(n, '.') AND 30 - length(e) - 1 > 0 THEN substr(n, 1, least(30 - length(e) - 1, length(n) - length(e) - 1)) || '.' || e
  ELSE substr(n, 1, 30) END AS name
FROM (SELECT page_id, n, string_split(n, '.')[-1] AS e FROM (SELECT page_id, {_NAME} AS n FROM pages))""")
def _name(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.sanitize_name("url", 30).alias("name"))


@query("normalize_ws", """
SELECT doc_id, replace(replace(replace(t, chr(160), ' '), chr(8195), ' '), chr(12288), ' ') AS plain
FROM (SELECT doc_id, replace(replace(replace(text, ' the ', chr(160) || 'the' || chr(8195)), ' de ', chr(12288) || 'de '), ' der ', chr(8195) || 'der ') AS t FROM documents)""")
def _ws(spark, d):
    t = F.col("text")
    for a, b in ((" the ", " the "), (" de ", "　de "), (" der ", " der ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return X.table(spark, d, "documents").select("doc_id", T.normalize_ws(t).alias("plain"))


@query("md_escape", "SELECT doc_id, replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '|', '\\|'), chr(10), '<br>') AS cell FROM documents")
def _md(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.md_escape("text").alias("cell"))


def width_sql(c: str) -> str:
    """Glyph width units of a column in DuckDB."""
    def gone(chars):
        return f"(length({c}) - length(translate({c}, {chars}, '')))"

    return (
        f"(length({c}) * 55 + (length({c}) - length(regexp_replace({c}, '[{_CJK}]', '', 'g'))) * 45 "
        f"- (length({c}) - length(regexp_replace({c}, '\\s', '', 'g'))) * 22 "
        f"- {gone(chr(39) + V.NARROW_GLYPHS.replace(chr(39), chr(39) * 2) + chr(39))} * 25 + {gone(chr(39) + V.WIDE_GLYPHS + chr(39))} * 30)"
    )


@query("text_width", f"SELECT deck_id, idx, {width_sql('original_text')} * CAST(18 AS DOUBLE) / CAST(100 AS DOUBLE) AS width FROM segments", "segments")
def _width(spark, d):
    return X.segments(spark, d).select("deck_id", "idx", T.text_width("original_text", F.lit(18.0)).alias("width"))


@query("char_width", f"""
SELECT ch, count(*) AS n, {width_sql('ch')} / CAST(100 AS DOUBLE) AS factor
FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch""")
def _char(spark, d):
    chars = X.table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''")
    return chars.groupBy("ch").agg(F.count(F.lit(1)).alias("n")).withColumn("factor", T.char_width("ch"))


_EDIT = "replace(replace(original_text, ' the ', ' a '), 'tion', 'sion')"


@query("changed_phrase", f"""
WITH p AS (SELECT deck_id, idx, original_text AS a, {_EDIT} AS b FROM segments),
q AS (SELECT *, coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i]), true) - 1,
   least(length(a), length(b))) AS pre FROM p),
r AS (SELECT *, reverse(substr(a, CAST(pre + 1 AS BIGINT))) AS ra, reverse(substr(b, CAST(pre + 1 AS BIGINT))) AS rb FROM q),
s AS (SELECT *, coalesce(list_position(list_transform(range(1, least(length(ra), length(rb)) + 1), lambda i: ra[i] <> rb[i]), true) - 1,
   least(length(ra), length(rb))) AS suf FROM r)
SELECT deck_id, idx, trim(reverse(substr(ra, CAST(suf + 1 AS BIGINT)))) AS old_phrase, trim(reverse(substr(rb, CAST(suf + 1 AS BIGINT)))) AS new_phrase FROM s""", "segments")
def _changed(spark, d):
    edited = F.replace(F.replace(F.col("original_text"), F.lit(" the "), F.lit(" a ")), F.lit("tion"), F.lit("sion"))
    return X.segments(spark, d).select(
        "deck_id", "idx", T.changed_phrase("original_text", edited).alias("p")
    ).select("deck_id", "idx", "p.old_phrase", "p.new_phrase")


_AN = "regexp_replace(source, '[^\\p{L}\\p{N}]', '', 'g')"


@query("is_meaningful_phrase", f"""
SELECT source, CASE WHEN length(a) = 0 OR regexp_full_match(a, '\\p{{Nd}}+') THEN false
  WHEN regexp_matches(source, '[{V.PHRASE_CJK_CLASS}]') THEN length(a) >= 3
  ELSE length(a) >= 4 OR (length(a) >= 2 AND regexp_matches(source, '\\p{{Lu}}') AND NOT regexp_matches(source, '[\\p{{Ll}}\\p{{Lt}}]')) END AS meaningful
FROM (SELECT DISTINCT source, {_AN} AS a FROM lexicon)""", "lexicon")
def _meaningful(spark, d):
    return X.lexicon(spark, d).select("source").distinct().withColumn("meaningful", T.is_meaningful_phrase("source"))


@query("bigram_dice", """
WITH p AS (SELECT source AS a, lower(target) AS b FROM lexicon GROUP BY ALL),
g AS (SELECT a, b, list_transform(range(1, length(a)), lambda i: substr(a, i, 2)) AS ga,
             list_transform(range(1, length(b)), lambda i: substr(b, i, 2)) AS gb FROM p)
SELECT a, b, CASE WHEN length(a) < 2 OR length(b) < 2 THEN CASE WHEN a = b THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  ELSE CAST(2 * coalesce(list_sum(list_transform(list_distinct(ga), lambda x: least(len(list_filter(ga, lambda y: y = x)), len(list_filter(gb, lambda z: z = x))))), 0) AS DOUBLE)
    / (len(ga) + len(gb)) END AS score FROM g""", "lexicon")
def _dice(spark, d):
    pairs = X.lexicon(spark, d).select(F.col("source").alias("a"), F.lower("target").alias("b")).distinct()
    return pairs.withColumn("score", T.bigram_dice("a", "b"))


@query("relative_position", """
SELECT deck_id, idx, run_no, CASE WHEN m < 0.33 THEN 'front' WHEN m > 0.67 THEN 'back' ELSE 'middle' END AS place
FROM (SELECT deck_id, idx, run_no, CAST(2 * sum(length(text)) OVER w - length(text) AS DOUBLE) / 2 / sum(length(text)) OVER (PARTITION BY deck_id, idx) AS m
      FROM runs WINDOW w AS (PARTITION BY deck_id, idx ORDER BY run_no))""", "runs")
def _place(spark, d):
    from segloom.operators.style import run_offsets

    return run_offsets(X.runs(spark, d)).select(
        "deck_id", "idx", "run_no", T.relative_position("start", "end", "text_length").alias("place")
    )


def _hex(p):
    return f"CAST('0x' || substr(color, {p}, 2) AS INT)"


@query("is_neutral_color", f"""
SELECT source, color, CASE WHEN color LIKE 'scheme:%' THEN color IN ('scheme:tx1', 'scheme:bg2')
  WHEN color LIKE '#%' THEN length(color) = 7 AND greatest({_hex(2)}, {_hex(4)}, {_hex(6)}) - least({_hex(2)}, {_hex(4)}, {_hex(6)}) <= 12 ELSE true END AS neutral
FROM (SELECT DISTINCT source, CASE length(source) % 5 WHEN 0 THEN 'default' WHEN 1 THEN 'scheme:tx1' WHEN 2 THEN 'scheme:accent1'
  WHEN 3 THEN '#' || upper(substr(md5(source), 1, 6)) ELSE '#' || repeat(substr(md5(source), 1, 2), 2) || substr(md5(source), 1, 1) || '0' END AS color FROM lexicon)""", "lexicon")
def _neutral(spark, d):
    m, h = F.length("source") % 5, F.md5("source")
    color = (
        F.when(m == 0, "default").when(m == 1, "scheme:tx1").when(m == 2, "scheme:accent1")
        .when(m == 3, F.concat(F.lit("#"), F.upper(F.substring(h, 1, 6))))
        .otherwise(F.concat(F.lit("#"), F.repeat(F.substring(h, 1, 2), 2), F.substring(h, 1, 1), F.lit("0")))
    )
    words = X.lexicon(spark, d).select("source").distinct().withColumn("color", color)
    return words.withColumn("neutral", T.is_neutral_color("color"))


@query("language_mapping", f"""
SELECT doc_id, {_LANG_SQL} AS language, '한국어' AS suggested,
  CASE lang WHEN 'en' THEN 'en_to_ko' ELSE CASE WHEN lang IN ('fr', 'de', 'es') THEN 'xx_to_ko' ELSE 'en_to_ko' END END AS direction
FROM documents""")
def _language(spark, d):
    language = T.map_lang_code("lang")
    return X.table(spark, d, "documents").select(
        "doc_id", language.alias("language"), T.infer_target(language).alias("suggested"),
        T.direction_code(language, T.infer_target(language)).alias("direction"),
    )


@query("wrap_to_weights")
def _wrap(spark, d):
    weights = F.transform(F.split("text", "\n"), lambda line: F.greatest(F.lit(1), F.length(line)))
    return X.table(spark, d, "documents").select(
        "doc_id", F.posexplode(T.wrap_to_weights(F.translate("text", "\n", " "), weights)).alias("line_no", "line")
    )
