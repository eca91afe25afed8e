"""From documents to token files: quality, near duplicates, contamination, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; ``run`` writes each
result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.llm import bitplanes, curriculum, decontaminate, jaccard_join, quality
from segloom.llm.catalog import tokenizer_path
from segloom.llm.tables import cut, row_key, within, without
from segloom.plans.ship import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    judged = quality.quality(docs)
    return without(docs, judged.filter("not kept").select("doc_id", "key"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: its smallest (null last); of equal rows, one."""
    found = cut(jaccard_join.jaccard_components(docs, shingle=5, percent=80).filter("n_shingles > 0"))
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")
    stays = cut(found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("node")).alias("node")).agg(
        F.min(place).alias("best")
    ).select("best.doc_id", "best.key"))
    best = stays.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"))
    goes = found.join(best, (F.col("key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left_anti")
    twice = cut(found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "key"))
    kept = without(docs, goes.select("doc_id", "key"))
    if twice.isEmpty():
        return kept
    copies = within(kept, twice)
    single = copies.withColumn("__key", row_key(copies)).dropDuplicates(["doc_id", "__key"]).drop("__key")
    return without(kept, twice).unionByName(single)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.filter("n_hit > 0").select("doc_id", "key"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in training order."""
    return curriculum.training_order(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all readings, and what they hold per reading."""
    return bitplanes.token_table(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("token output", token_output),
]

#: Robust estimates, similarity components and a tokenizer are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
