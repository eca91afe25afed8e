"""Working tables derived from the driver tables: once with Spark operators, once as DuckDB SQL.

A deck is a document source, a slide a document, a segment a non-blank line of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.operators.segments import segments_from_documents
from segloom.plans.cut import cut

_KINDS = {0: "textbox", 1: "body", 2: "table_cell", 3: "title"}

GLOSSARY_ROWS = [
    ("g1", 1, 0, "the", "le"), ("g1", 1, 1, "and", "et"), ("g1", 1, 2, "of the", "du"),
    ("g1", 1, 3, "und", "and"), ("g1", 1, 4, "para", "for"),
    ("g2", 2, 5, "The", "LE"), ("g2", 2, 6, "der", "the"), ("g2", 2, 7, "les", "the"),
    ("g2", 2, 8, "of", "de"), ("g2", 2, 9, "that", "que"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind() -> Column:
    m = F.col("doc_id") % 5
    expr = F.when(m == 0, "textbox")
    for value, name in list(_KINDS.items())[1:]:
        expr = expr.when(m == value, name)
    return expr.otherwise("notes")


_written: dict[tuple, DataFrame] = {}


def forget() -> None:
    """Drop the tables written so far, so that the next query builds its own."""
    _written.clear()


def _once(name: str, spark: SparkSession, d: str, build) -> DataFrame:
    """The segment table is written once per session, as a deployment would keep it."""
    key = (name, spark.sparkContext.applicationId, d)
    if key not in _written:
        _written[key] = cut(build())
    return _written[key]


def segments(spark: SparkSession, d: str) -> DataFrame:
    return _once("segments", spark, d, lambda: new_segments(spark, d))


def new_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments_from_documents(table(spark, d, "documents"), is_note=F.col("doc_id") % 5 == 4, kind=_kind())


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """As segments, but lines also break after a comma so that continuations exist."""
    return _once("fragments", spark, d, lambda: segments_from_documents(
        table(spark, d, "documents"),
        text=F.replace(F.col("text"), F.lit(", "), F.lit(",\n")),
        is_note=F.col("doc_id") % 5 == 4, kind=_kind(),
    ))


def target_of(idx: str = "idx", text: str = "original_text") -> Column:
    """A made translation: unchanged, padded, empty, doubled or one of two variants."""
    i, t = F.col(idx), F.col(text)
    return (
        F.when(i % 7 == 0, t)
        .when(i % 7 == 1, F.concat(F.lit("  "), t, F.lit(" ")))
        .when(i % 7 == 2, F.lit(""))
        .when(i % 7 == 3, F.concat(t, F.lit(" "), t))
        .otherwise(F.concat(F.lit("v"), (i % 2).cast("string"), F.lit(" "), t))
    )


def bitext(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).withColumn("target", target_of())


def glossary(spark: SparkSession, d: str | None = None) -> DataFrame:
    return spark.createDataFrame(
        GLOSSARY_ROWS, "glossary_id string, priority int, pos int, source string, target string"
    )


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Raw glossary entries taken from the words of all documents (many repeats and case variants)."""
    words = table(spark, d, "documents").select(
        "doc_id", "lang", F.posexplode(F.split(F.translate("text", "\n", " "), " ")).alias("p", "source")
    ).filter("source <> ''")
    return words.select(
        F.concat(F.lit("g"), (F.col("doc_id") % 7).cast("string")).alias("glossary_id"),
        (F.col("doc_id") % 7).cast("int").alias("priority"),
        (F.col("doc_id") * 100000 + F.col("p")).alias("pos"),
        "source",
        F.concat("source", F.lit("/"), "lang").alias("target"),
        F.when(F.col("p") % 3 == 0, F.concat(F.lit("n"), F.col("p").cast("string"))).alias("notes"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Words of a segment as styled runs."""
    return styled_words(segments(spark, d), "original_text")


def styled_words(df: DataFrame, text: str) -> DataFrame:
    m = F.length("text") % 4
    return df.select("deck_id", "idx", F.posexplode(F.split(F.col(text), " ")).alias("run_no", "text")).filter(
        "text <> ''"
    ).withColumn(
        "color", F.when(m == 0, "#FF0000").when(m == 3, "scheme:tx1").otherwise("default")
    )


def shapes(spark: SparkSession, d: str) -> DataFrame:
    p, s, i = F.col("paragraph_index"), F.col("slide_index"), F.col("idx")
    return segments(spark, d).select(
        "deck_id", "slide_index", p.alias("shape_id"), "idx",
        ((p % 3) * 3000000 + (s % 4) * 100000).cast("long").alias("left_emu"),
        (F.floor(p / 3) * 900000).cast("long").alias("top_emu"),
        (1500000 + (i % 5) * 250000).cast("long").alias("width_emu"),
        (600000 + (i % 3) * 200000).cast("long").alias("height_emu"),
        F.when(i % 11 == 0, 90.0).otherwise(0.0).alias("rotation"),
        (p % 6 != 5).alias("has_text"),
    )


def frames(spark: SparkSession, d: str) -> DataFrame:
    """One text frame per segment with geometry, target text and sometimes a font size."""
    i = F.col("idx")
    return bitext(spark, d).select(
        "deck_id", "idx", "slide_index", "container_id", "original_text", "target", "is_note",
        (1500000 + (i % 5) * 250000).cast("long").alias("width_emu"),
        (600000 + (i % 3) * 200000).cast("long").alias("height_emu"),
        F.when(i % 4 != 0, (12 + i % 3 * 4).cast("double")).alias("font_pt"),
        F.when(i % 11 == 0, 90.0).otherwise(0.0).alias("rotation"),
    )


def job_events(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").alias("job_id"), "event_id", "ts",
        F.when(e == "signup", "started").when(e.isin("view", "click"), "progress")
        .when(e == "purchase", "complete").otherwise("error").alias("event_type"),
        "value",
    )


def review_log(spark: SparkSession, d: str) -> DataFrame:
    """Reviewer actions per session (user), numbered in time order."""
    e = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(e == "click", "edit").when(e == "view", "dismiss").when(e == "signup", "restore")
        .when(e == "error", "undo").otherwise("commit").alias("action"),
        F.get_json_object("props", "$.k").cast("long").alias("idx"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("new_target"),
    )


def batches_of_40(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select(
        "deck_id", F.floor(F.col("idx") / 40).cast("long").alias("batch_no"),
        (F.col("idx") % 40 + 1).cast("int").alias("item"), "idx", "original_text",
    )


def model_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Two attempts at every batch: gaps and duplicated indices in the first, gaps in odd retries."""
    b = batches_of_40(spark, d)
    clash = (F.col("batch_no") % 5 == 3) & (F.col("item") == 2)
    first = b.filter("idx % 17 <> 5").select(
        "deck_id", "batch_no", F.lit(1).alias("attempt"),
        F.when(clash, F.lit(1)).otherwise(F.col("item")).alias("item_index"), F.col("item").alias("seq"),
        F.concat(F.lit("A"), "original_text").alias("text"),
    )
    second = b.filter("batch_no % 2 = 0 or idx % 3 <> 0").select(
        "deck_id", "batch_no", F.lit(2).alias("attempt"), F.col("item").alias("item_index"), F.col("item").alias("seq"),
        F.concat(F.lit("B"), "original_text").alias("text"),
    )
    return first.unionByName(second)


# DuckDB twins ---------------------------------------------------------------------------------

_LINES = """
SELECT doc_id, source, lang, i - 1 AS pos, string_split({text}, chr(10))[i] AS line
FROM (SELECT *, unnest(range(1, len(string_split({text}, chr(10))) + 1)) AS i FROM documents)
"""

_SEGMENTS = """
SELECT source AS deck_id,
  CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS BIGINT) AS idx,
  doc_id AS slide_index,
  CAST(CASE WHEN doc_id % 5 = 4 THEN -1 ELSE 0 END AS INT) AS shape_index,
  CAST(pos AS INT) AS paragraph_index,
  line AS original_text,
  first_value(line) OVER (PARTITION BY source, doc_id ORDER BY pos) AS slide_title,
  doc_id % 5 = 4 AS is_note,
  concat('s', CAST(doc_id AS STRING), CASE WHEN doc_id % 5 = 4 THEN '/notes' ELSE '/sh0' END) AS container_id,
  CASE doc_id % 5 WHEN 0 THEN 'textbox' WHEN 1 THEN 'body' WHEN 2 THEN 'table_cell' WHEN 3 THEN 'title' ELSE 'notes' END AS container_kind,
  lang
FROM ({lines}) WHERE length(trim(line)) > 0
"""

_NORM = "replace(translate(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), 'ςſ', 'σs'), 'ß', 'ss')"


def norm_sql(c: str) -> str:
    return _NORM.format(c=c)


def _values(rows: list[tuple]) -> str:
    return ",".join("(" + ",".join(repr(v) for v in row) + ")" for row in rows)


VIEWS: dict[str, tuple[list[str], str]] = {
    "segments": ([], _SEGMENTS.format(lines=_LINES.format(text="text"))),
    "fragments": ([], _SEGMENTS.format(lines=_LINES.format(text="replace(text, ', ', ',' || chr(10))"))),
    "bitext": (["segments"], """
SELECT s.*, CASE WHEN idx % 7 = 0 THEN original_text
  WHEN idx % 7 = 1 THEN concat('  ', original_text, ' ')
  WHEN idx % 7 = 2 THEN ''
  WHEN idx % 7 = 3 THEN concat(original_text, ' ', original_text)
  ELSE concat('v', CAST(idx % 2 AS STRING), ' ', original_text) END AS target
FROM segments s"""),
    "normed": (["bitext"], f"SELECT *, {norm_sql('original_text')} AS src_n, {norm_sql('target')} AS tgt_n FROM bitext"),
    "glossary": ([], f"SELECT * FROM (VALUES {_values(GLOSSARY_ROWS)}) AS t(glossary_id, priority, pos, source, target)"),
    "lexicon": ([], """
SELECT concat('g', doc_id % 7) AS glossary_id, CAST(doc_id % 7 AS INT) AS priority,
  doc_id * 100000 + p AS pos, source, concat(source, '/', lang) AS target,
  CASE WHEN p % 3 = 0 THEN concat('n', p) END AS notes
FROM (SELECT doc_id, lang, i - 1 AS p, w[i] AS source
      FROM (SELECT doc_id, lang, w, unnest(range(1, len(w) + 1)) AS i
            FROM (SELECT doc_id, lang, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents)))
WHERE source <> ''"""),
    "runs": (["segments"], """
SELECT deck_id, idx, CAST(i - 1 AS INT) AS run_no, w[i] AS text,
  CASE length(w[i]) % 4 WHEN 0 THEN '#FF0000' WHEN 3 THEN 'scheme:tx1' ELSE 'default' END AS color
FROM (SELECT deck_id, idx, w, unnest(range(1, len(w) + 1)) AS i
      FROM (SELECT deck_id, idx, string_split(original_text, ' ') AS w FROM segments))
WHERE w[i] <> ''"""),
    "target_runs": (["bitext"], """
SELECT deck_id, idx, CAST(i - 1 AS INT) AS run_no, w[i] AS text,
  CASE length(w[i]) % 4 WHEN 0 THEN '#FF0000' WHEN 3 THEN 'scheme:tx1' ELSE 'default' END AS color
FROM (SELECT deck_id, idx, w, unnest(range(1, len(w) + 1)) AS i
      FROM (SELECT deck_id, idx, string_split(target, ' ') AS w FROM bitext))
WHERE w[i] <> ''"""),
    "shapes": (["segments"], """
SELECT deck_id, slide_index, paragraph_index AS shape_id, idx,
  CAST((paragraph_index % 3) * 3000000 + (slide_index % 4) * 100000 AS BIGINT) AS left_emu,
  CAST((paragraph_index // 3) * 900000 AS BIGINT) AS top_emu,
  CAST(1500000 + (idx % 5) * 250000 AS BIGINT) AS width_emu,
  CAST(600000 + (idx % 3) * 200000 AS BIGINT) AS height_emu,
  CAST(CASE WHEN idx % 11 = 0 THEN 90 ELSE 0 END AS DOUBLE) AS rotation,
  paragraph_index % 6 <> 5 AS has_text
FROM segments"""),
    "frames": (["bitext"], """
SELECT deck_id, idx, slide_index, container_id, original_text, target, is_note,
  CAST(1500000 + (idx % 5) * 250000 AS BIGINT) AS width_emu,
  CAST(600000 + (idx % 3) * 200000 AS BIGINT) AS height_emu,
  CASE WHEN idx % 4 <> 0 THEN CAST(12 + idx % 3 * 4 AS DOUBLE) END AS font_pt,
  CAST(CASE WHEN idx % 11 = 0 THEN 90 ELSE 0 END AS DOUBLE) AS rotation
FROM bitext"""),
    "job_events": ([], """
SELECT user_id AS job_id, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'progress'
    WHEN 'purchase' THEN 'complete' ELSE 'error' END AS event_type, value
FROM events"""),
    "review_log": ([], """
SELECT user_id AS session_id, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'dismiss' WHEN 'signup' THEN 'restore'
    WHEN 'error' THEN 'undo' ELSE 'commit' END AS action,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS idx, concat('t', event_id) AS new_target
FROM events"""),
    "batched": (["segments"], """
SELECT deck_id, CAST(idx // 40 AS BIGINT) AS batch_no, CAST(idx % 40 + 1 AS INT) AS item, idx, original_text
FROM segments"""),
    "model_outputs": (["batched"], """
SELECT deck_id, batch_no, CAST(1 AS INT) AS attempt,
  CASE WHEN batch_no % 5 = 3 AND item = 2 THEN 1 ELSE item END AS item_index, item AS seq, concat('A', original_text) AS text
FROM batched WHERE idx % 17 <> 5
UNION ALL
SELECT deck_id, batch_no, CAST(2 AS INT) AS attempt, item AS item_index, item AS seq, concat('B', original_text) AS text
FROM batched WHERE batch_no % 2 = 0 OR idx % 3 <> 0"""),
}


def with_views(names: list[str], body: str) -> str:
    """``body`` preceded by the named views and everything they read, as WITH clauses."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in VIEWS[name][0]:
                visit(dep)
            order.append(name)

    for name in names:
        visit(name)
    body = body.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
