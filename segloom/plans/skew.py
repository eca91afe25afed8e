"""Joins that survive one key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAT_BUCKETS = 4096
HOT_ROWS = 1_000_000


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    weight: str,
    *,
    how: str = "inner",
    spread: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` to ``per_key`` (one row per key) with hot keys spread over many tasks.

    ``weight`` is the number of ``rows`` of that key, known from the aggregation that built
    ``per_key``. Keys are hashed into a fixed number of buckets; the bucket heat table therefore
    has at most ``HEAT_BUCKETS`` rows, which is what makes broadcasting it safe at any scale. Rows
    of a hot bucket get a salt from the ``spread`` columns and the few aggregate rows of that
    bucket are repeated once per salt. Cold keys take an ordinary shuffle join.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(HEAT_BUCKETS)).cast("int")
    heat = (
        per_key.groupBy(bucket.alias("__bucket"))
        .agg(F.sum(weight).alias("__heat"))
        .filter(F.col("__heat") > hot_rows)
        .select("__bucket", F.ceil(F.col("__heat") / F.lit(hot_rows)).cast("int").alias("__fan"))
    )
    heat = F.broadcast(heat)
    left = (
        rows.withColumn("__bucket", bucket)
        .join(heat, "__bucket", "left")
        .withColumn("__salt", F.pmod(F.xxhash64(*spread), F.coalesce("__fan", F.lit(1))).cast("int"))
        .drop("__bucket", "__fan")
    )
    right = (
        per_key.drop(weight)
        .withColumn("__bucket", bucket)
        .join(heat, "__bucket", "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__fan", F.lit(1)) - 1)))
        .drop("__bucket", "__fan")
    )
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def attach_weighted(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    weight: str,
    *,
    how: str = "inner",
    spread: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """As ``attach`` for rows that already carry the size of their own key group.

    ``weight`` is a column of both sides; no heat table is needed because each side derives the
    same number of salts from it.
    """
    fan = F.greatest(F.lit(1), F.ceil(F.col(weight) / F.lit(hot_rows)).cast("int"))
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), fan).cast("int"))
    right = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), fan - 1))).drop(weight)
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
