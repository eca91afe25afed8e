"""Quality rules: robust multivariate outliers by minimum covariance determinants.

One pass over the texts gives each document a few counts (``text_stats``). Documents that fail the plain
limits go. The others become vectors of transformed rates, and in each (language, source) group the
half-sample with the smallest covariance determinant is sought: from a robust start (medians and quartile
spreads) concentration steps keep the ``share`` of rows nearest to the present centre and estimate
again, until no group's determinant falls. Each step is one aggregation over the narrow table of vectors:
distances go into fine bins, bins into a cut-off per group, and rows below it into moments. Groups too
small for an estimate of their own use their language's rows, then all rows.

Rejected are documents whose squared Mahalanobis distance exceeds the chi-square quantile and who are worse
than the centre in at least one rate that counts against a text: a long or a tidy text is unusual, not bad.

Defined results: null or empty text has zero counts and fails the base rule; null language or source is a
group of its own; repeated rows count as often as they occur; rates without spread get a floor, so a group
of equal rows rejects none of them; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.llm import tokens
from segloom.llm.tables import cut, row_key

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of rows in the half-sample; up to a quarter of a group may be junk.
SHARE = 0.75
#: Rows that a group needs for an estimate of its own.
MIN_ROWS = 200
MAX_STEPS = 12
#: Squared distances are binned as floor(BINS_PER_E * ln(d + 1)).
BINS_PER_E = 200
#: Chi-square quantile at 0.999 for four rates.
CUTOFF = 18.47
#: Least spread of each rate, and whether a high (1) or any deviation (0) speaks against a text. Most texts repeat
#: neither lines nor words, so half-samples have no spread there: at 0.1, shares above 18 % (of both together) go.
RATES = {"length_rate": (0.08, 0), "symbol_rate": (0.04, 1), "line_rate": (0.1, 1), "repeat_rate": (0.1, 1)}
STATS_SCHEMA = (
    "doc_id bigint, key bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, "
    "n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"
)
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def _lines(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those among them equal to an earlier one."""
    n = len(bounds) - 1
    ends = np.flatnonzero(data == 10)
    owner = np.concatenate([np.arange(n), np.searchsorted(bounds, ends, "right") - 1])
    start = np.concatenate([bounds[:-1], ends + 1])
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    kept = data != 10
    before = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
    offsets = np.append(before[start], before[-1]).astype(np.int64)
    lines = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])
    worded = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    has = worded[np.append(start[1:], len(data))] > worded[start]
    code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.unique(owner[has] * (len(start) + 1) + code[has])
    counts = np.bincount(owner[has], minlength=n)
    return counts, counts - np.bincount(keys // (len(start) + 1), minlength=n)


def _repeated(words: tokens.Words) -> np.ndarray:
    """Per text: words in windows of three that occur twice or more in the text."""
    n = len(words.starts) - 1
    if words.n < 3:
        return np.zeros(n, np.int64)
    code, distinct = words.codes()
    code, owner = code.astype(np.int64), words.owner()
    pair = np.unique(code[:-1] * len(distinct) + code[1:], return_inverse=True)[1]
    same = owner[:-2] == owner[2:]
    triple = np.unique(pair[:-1][same] * len(distinct) + code[2:][same], return_inverse=True)[1]
    key = owner[:-2][same] * (words.n + 1) + triple
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    start = np.flatnonzero(same)[count[inverse] > 1]
    hit = np.zeros(words.n, bool)
    for shift in range(3):
        hit[start + shift] = True
    return np.bincount(owner[hit], minlength=n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tokens.blocks(batches):
        data, bounds = tokens.bytes_of(block.column("text"))
        words = tokens.Words(data, bounds, tokens.SPACED)
        inside = (tokens.SPACED[data] != 0) | (data == 0)
        lines, dup = _lines(data, bounds, inside)
        found = [
            words.counts(), _per_text(inside & ((data & 0xC0) != 0x80), bounds), _per_text(_SYMBOL[data], bounds),
            lines, dup, _repeated(words),
        ]
        yield pa.RecordBatch.from_arrays(
            [block.column(c) for c in ("doc_id", "key", "lang", "source")] + [pa.array(x.astype(np.int64)) for x in found],
            ["doc_id", "key", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"],
        )


def text_stats(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts of every whole text; the texts stay in their tasks."""
    return docs.select(
        F.col(doc).cast("long").alias("doc_id"), row_key(docs).alias("key"), F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"), F.col(text).alias("text"),
    ).mapInArrow(_count, STATS_SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_rates(stats: DataFrame) -> DataFrame:
    """Counts become rates with about even spread: logarithm of a length, square roots of shares."""
    words = F.greatest("n_words", F.lit(1))
    return stats.withColumns({
        "length_rate": F.log(F.greatest("word_chars", F.lit(1)) / words),
        "symbol_rate": F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "line_rate": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "repeat_rate": F.sqrt(F.col("n_repeat_words") / words),
    })


_NAMES = list(RATES)
_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[: i + 1]]


def _distance(values: dict[str, Column], centre: dict[str, Column], root: dict[tuple[str, str], Column]) -> Column:
    """Squared Mahalanobis distance: the inverse Cholesky factor applied to the difference."""
    total = F.lit(0.0)
    for i, a in enumerate(_NAMES):
        z = reduce(lambda s, b: s + root[a, b] * (values[b] - centre[b]), _NAMES[: i + 1], F.lit(0.0))
        total = total + z * z
    return total


def _factors(moments: DataFrame) -> DataFrame:
    """Centre, inverse Cholesky factor and log determinant of each group, from its moments (one small row each)."""
    names = ["group", "n", *_NAMES, *(f"{a}__{b}" for a, b in _PAIRS)]
    floor = np.diag([RATES[a][0] ** 2 for a in _NAMES])

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf[names].to_dict("records"):
                mean = np.array([r[a] for a in _NAMES]) / r["n"]
                cov = np.zeros((len(_NAMES),) * 2)
                for a, b in _PAIRS:
                    i, j = _NAMES.index(a), _NAMES.index(b)
                    cov[i, j] = cov[j, i] = r[f"{a}__{b}"] / r["n"] - mean[i] * mean[j]
                low = np.linalg.inv(np.linalg.cholesky(CONSISTENCY * cov + floor))
                logdet = -2 * float(np.log(np.diag(low)).sum())
                rows.append([r["group"], *mean, *(low[_NAMES.index(a), _NAMES.index(b)] for a, b in _PAIRS), logdet])
            yield type(pdf)(rows, columns=["group", *(f"c_{a}" for a in _NAMES), *(f"r_{a}__{b}" for a, b in _PAIRS), "logdet"])

    schema = ", ".join(["group string", *(f"c_{a} double" for a in _NAMES), *(f"r_{a}__{b} double" for a, b in _PAIRS), "logdet double"])
    return moments.mapInPandas(solve, schema)


#: Widens the covariance of the nearest three quarters to that of all rows (normal model, four rates).
CONSISTENCY = 1.6


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(a).alias(a) for a in _NAMES),
        *(F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in _PAIRS),
    )


def _measured(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` with ``d2`` under their group's model; the model has one row per group."""
    joined = rows.join(model, "group")
    d2 = _distance(
        {a: F.col(a) for a in _NAMES}, {a: F.col(f"c_{a}") for a in _NAMES},
        {(a, b): F.col(f"r_{a}__{b}") for a, b in _PAIRS},
    )
    return joined.withColumn("d2", d2)


def grouped(rates: DataFrame, *, min_rows: int = MIN_ROWS) -> DataFrame:
    """``rates`` with ``group``: language and source where they have enough rows, else the language, else all."""
    own = F.concat_ws("\u001f", F.lit("s"), F.coalesce("lang", F.lit("\u001e")), F.coalesce("source", F.lit("\u001e")))
    tongue = F.concat_ws("\u001f", F.lit("l"), F.coalesce("lang", F.lit("\u001e")))
    sizes = rates.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("__n"))
    of_lang = sizes.groupBy(F.col("lang").alias("__l")).agg(F.sum("__n").alias("__m"))
    sizes = sizes.join(of_lang, F.col("lang").eqNullSafe(F.col("__l"))).select(
        F.col("lang").alias("__lang"), F.col("source").alias("__source"),
        F.when(F.col("__n") >= min_rows, own).when(F.col("__m") >= min_rows, tongue).otherwise(F.lit("a")).alias("group"),
    )
    sizes = cut(sizes)
    return rates.join(
        sizes, rates["lang"].eqNullSafe(sizes["__lang"]) & rates["source"].eqNullSafe(sizes["__source"])
    ).drop("__lang", "__source")


def robust_model(rows: DataFrame, *, share: float = SHARE, max_steps: int = MAX_STEPS) -> DataFrame:
    """Centre and factor of each group after concentration; ``rows`` has ``group`` and the rates."""
    starts = rows.groupBy("group").agg(*(F.percentile_approx(a, [0.25, 0.5, 0.75], 1000).alias(a) for a in _NAMES))
    first = [F.col("group")]
    for a in _NAMES:
        first.append(F.col(a)[1].alias(f"c_{a}"))
    for a, b in _PAIRS:
        spread = F.greatest((F.col(a)[2] - F.col(a)[0]) / 1.349, F.lit(RATES[a][0]))
        first.append((1 / spread if a == b else F.lit(0.0)).alias(f"r_{a}__{b}"))
    model = cut(starts.select(*first, F.lit(None).cast("double").alias("logdet")))
    for _ in range(max_steps):
        binned = _measured(rows, model).withColumn("bin", F.floor(BINS_PER_E * F.log1p("d2")).cast("int"))
        near = binned.groupBy("group", "bin").agg(
            F.count(F.lit(1)).alias("n"), *(F.sum(a).alias(a) for a in _NAMES),
            *(F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in _PAIRS),
        )
        per_bin = cut(near)  # at most a few thousand bins per group, with the moments of their rows
        wanted = per_bin.groupBy("group").agg(F.sum("n").alias("all"), F.collect_list(F.struct("bin", "n")).alias("bins"))
        limit = wanted.select("group", F.aggregate(
            F.array_sort("bins"), F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("bin")),
            lambda s, x: F.when(s["seen"] >= F.ceil(share * F.col("all")), s).otherwise(
                F.struct((s["seen"] + x["n"]).alias("seen"), x["bin"].alias("bin"))),
        )["bin"].alias("limit"))
        inner = per_bin.join(limit, "group").filter("bin <= limit").groupBy("group").agg(
            F.sum("n").alias("n"), *(F.sum(a).alias(a) for a in _NAMES),
            *(F.sum(f"{a}__{b}").alias(f"{a}__{b}") for a, b in _PAIRS),
        )
        new = cut(_factors(inner))
        moved = new.alias("n").join(model.alias("o"), "group").filter(
            F.col("o.logdet").isNull() | (F.col("n.logdet") < F.col("o.logdet") - 1e-3)
        )
        done = moved.isEmpty()
        model = new
        if done:
            break
    return model


def quality(
    docs: DataFrame, *, cutoff: float = CUTOFF, share: float = SHARE, min_rows: int = MIN_ROWS,
    text: str = "text", doc: str = "doc_id", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """Counts, ``base_failed``, squared distance ``d2`` (null where the base rule failed) and ``kept`` per row."""
    stats = cut(with_rates(text_stats(docs, text=text, doc=doc, lang=lang, source=source)).withColumn("base_failed", base_failed()))
    rows = cut(grouped(stats.filter(~F.col("base_failed")), min_rows=min_rows))
    measured = _measured(rows, robust_model(rows, share=share))
    against = reduce(lambda x, y: x | y, (
        F.col(a) > F.col(f"c_{a}") if side > 0 else F.col(a) != F.col(f"c_{a}") for a, (_, side) in RATES.items()
    ))
    judged = measured.withColumn("kept", ~((F.col("d2") > cutoff) & against))
    columns = [*stats.columns]
    failed = stats.filter("base_failed").withColumns({"d2": F.lit(None).cast("double"), "kept": F.lit(False)})
    return judged.select(*columns, "d2", "kept").unionByName(failed.select(*columns, "d2", "kept"))
