"""The queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.llm import (
    bitplanes, ctw, curriculum, decontaminate, histogram_sort, impact_search, jaccard_join, periodic_runs, quality, rank_order, repeats,
    surrogates, winnowing,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a key from a secret store.
SURROGATE_KEY = "check-key"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@_query("op1_mcd_outliers")
def op1_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2"
    )


DECONTAMINATE_SQL = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'b', item_id::VARCHAR, text FROM benchmark),
w AS (
  SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM t),
bw AS (
  SELECT id, least(10, len(words)) AS k, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i
  FROM w WHERE side = 'b' AND len(words) > 0),
win AS (SELECT DISTINCT id, k, array_to_string(words[i:i + k - 1], ' ') AS win FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT id, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE side = 'd'),
dwin AS (
  SELECT dw.id, i, ks.k, array_to_string(words[i:i + ks.k - 1], ' ') AS win FROM dw, ks WHERE i + ks.k - 1 <= len(words)),
hit AS (SELECT dwin.id, dwin.i, dwin.k, win.id AS item FROM dwin JOIN win ON dwin.k = win.k AND dwin.win = win.win),
pos AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY id),
its AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id)
SELECT d.doc_id, coalesce(len(w.words), 0)::BIGINT AS n_words, coalesce(pos.n_hit, 0)::BIGINT AS n_hit,
       coalesce(its.n_items, 0)::BIGINT AS n_items, sha256(coalesce(its.names, '')) AS items_sha256,
       coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM documents d JOIN w ON w.side = 'd' AND w.id = d.doc_id::VARCHAR
LEFT JOIN pos ON pos.id = w.id LEFT JOIN its ON its.id = w.id"""


@_query("op2_positional_index", DECONTAMINATE_SQL)
def op2_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query("op3_histogram_sort")
def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.histogram_sort(_table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 3) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS to_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(to_id) AS c FROM r GROUP BY doc_id) m USING (doc_id)"""


@_query("op4_ngram_jaccard", JACCARD_SQL)
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@_query("op5_keyed_surrogates")
def op5_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         substr(md5('mix' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
f AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w),
l AS (SELECT *, (150 * total - 200 * held)::DOUBLE / (100 * open)::DOUBLE AS own FROM f),
m AS (SELECT *, own * weight > 2 * source_size AS is_full FROM l),
n AS (SELECT *, arg_min(own, held) FILTER (NOT is_full) OVER () AS level FROM m),
t AS (SELECT source, source_size, place, CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE level * weight END AS target FROM n),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (
  SELECT *, greatest(0, least(size, floor(target) - start))::BIGINT AS one,
         greatest(0, least(size, floor(target) - source_size - start))::BIGINT AS two FROM c),
v AS (
  SELECT *, CASE WHEN one > 0 THEN start::DOUBLE / target WHEN two > 0 THEN (start + source_size)::DOUBLE / target END AS share FROM u),
z AS (
  SELECT *, CASE place % 3
    WHEN 0 THEN share
    WHEN 1 THEN CASE WHEN 3 * share <= 1 THEN sqrt(0.25::DOUBLE + 2 * 1.125::DOUBLE * share) - 0.5::DOUBLE
      ELSE 0.5::DOUBLE + (sqrt(1 + 4 * (1.125::DOUBLE * share - 0.375::DOUBLE)) - 1) / 2 END
    ELSE CASE WHEN 3 * share <= 2 THEN (2 - sqrt(greatest(0, 4 - 4 * 1.125::DOUBLE * share))) / 2
      ELSE 1.5::DOUBLE - sqrt(greatest(0, 1 - 2 * (1.125::DOUBLE * share - 0.75::DOUBLE))) END END AS moment FROM v)
SELECT doc_id, size::BIGINT AS size, source_size, target, one + two AS taken, CASE WHEN share IS NOT NULL THEN floor(moment * 1000000)::BIGINT END AS first_micro FROM z"""


@_query("op6_curriculum_mix", MIX_SQL)
def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(_table(spark, sf_dir, "documents"))
    first = F.coalesce(*[F.get("positions", F.lit(i)) for i in range(2)])
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken", F.floor(first * 1_000_000).alias("first_micro")
    ).orderBy("first_micro", "doc_id")


@_query("op7_bitplane_files")
def op7_bitplane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.token_table(_table(spark, sf_dir, "documents"), tokenizer_path())


WINNOW_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
t AS (
  SELECT doc_id, i, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM t WHERE t <> ''),
w AS (SELECT doc_id, k, t AS a, lead(t) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM n),
f AS (SELECT a, b, min((doc_id, k)) AS at FROM w WHERE b IS NOT NULL GROUP BY a, b),
h AS (SELECT w.doc_id, w.k FROM w JOIN f USING (a, b) WHERE (w.doc_id, w.k) > f.at),
o AS (SELECT * FROM n QUALIFY len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) >= 20 OR count(*) OVER (PARTITION BY doc_id) = 1),
e AS (SELECT t, min((doc_id, k)) AS at FROM o GROUP BY t),
g AS (
  SELECT n.doc_id, n.i FROM n JOIN h ON n.doc_id = h.doc_id AND n.k IN (h.k, h.k + 1) UNION
  SELECT o.doc_id, o.i FROM o JOIN e USING (t) WHERE (o.doc_id, o.k) > e.at),
c AS (
  SELECT l.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(c.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id)"""


@_query("op8_line_winnowing", WINNOW_SQL)
def op8_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


@_query("op9_context_tree")
def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.lm_scores(_table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


@_query("op10_repeat_intervals")
def op10_repeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS words FROM documents),
l AS (SELECT row, doc_id, words, len(words)::BIGINT AS n FROM d WHERE len(words) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM l),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (
  SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(words) AS term FROM l)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
s AS (
  SELECT q.item_id, p.row, p.doc_id, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
         * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""


@_query("op11_norm_buckets", SEARCH_SQL)
def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op12_minimizer_runs")
def op12_minimizer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", periodic_runs.looped("text", "doc_id").alias("text"))
    found = periodic_runs.periodic_runs(docs).withColumn("best", periodic_runs.strongest("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    sha256 = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        sha256(F.array_join(lines, "")).alias("runs_sha256"), sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, e: CASE WHEN e < 0 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, e) END)"""
LANGUAGE_SQL = f"""
WITH h AS (SELECT row_number() OVER () AS row, doc_id, text, lang, (4294967295 - {_CRC}) % 3 = 1 AS held_out FROM documents),
t AS (
  SELECT row, lang, held_out, list_transform(
    string_split(' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g')) || ' ', ''), lambda x: ord(x)::BIGINT) AS c
  FROM h WHERE regexp_matches(text, '\\p{{L}}')),
g AS (
  SELECT row, lang, held_out, unnest(list_filter(c, lambda x: x <> 32) || list_transform(range(1, len(c)), lambda i: c[i] * 2097152 + c[i + 1])
    || list_transform(range(1, len(c) - 1), lambda i: (c[i] * 2097152 + c[i + 1]) * 2097152 + c[i + 2])) AS gram FROM t),
n AS (SELECT row, lang, held_out, gram, count(*) AS n FROM g GROUP BY ALL),
p AS (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS rank
  FROM n WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram QUALIFY rank < {rank_order.PROFILE}),
d AS (SELECT row, gram, row_number() OVER (PARTITION BY row ORDER BY n DESC, gram) - 1 AS rank FROM n QUALIFY rank < {rank_order.DOCUMENT}),
m AS (SELECT row, count(*) AS m FROM d GROUP BY row),
o AS (
  SELECT d.row, p.lang, sum(least(abs(d.rank - p.rank), {rank_order.PROFILE}) - {rank_order.PROFILE}) AS near FROM d JOIN p USING (gram) GROUP BY ALL),
a AS (
  SELECT m.row, l.lang, ({rank_order.PROFILE} * m + coalesce(near, 0))::BIGINT AS apart, {rank_order.PROFILE} * m AS most
  FROM m, (SELECT DISTINCT lang FROM p) l LEFT JOIN o ON o.row = m.row AND o.lang = l.lang),
b AS (SELECT row, arg_min(lang, (apart, lang)) AS lang, 1.0::DOUBLE - min(apart)::DOUBLE / any_value(most)::DOUBLE AS score FROM a GROUP BY row)
SELECT doc_id, held_out, coalesce(b.lang, '{rank_order.UNKNOWN}') AS lang_pred, coalesce(score, 0.0::DOUBLE) AS score FROM h LEFT JOIN b USING (row)"""


@_query("op13_rank_order", LANGUAGE_SQL)
def op13_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", rank_order.held_out("doc_id").alias("held_out"))
    profiles = rank_order.language_profiles(docs.filter("not held_out"))
    return rank_order.predict_languages(docs.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")
