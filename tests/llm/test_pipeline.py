"""Every stage of the pipeline against plain Python on its own input."""

import collections

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from segloom.llm import quality
from segloom.llm.tables import cut
from test_llm_operators import SCHEMA, near_copies, plain_contamination, plain_ids, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = cut(stage(spark, docs, SF))
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_columns(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])


def test_quality_keeps_the_kept(stages):
    before, after = stages[0]
    assert ids(after) == ids(quality.quality(before).filter("kept"))


def groups(texts, size, percent):
    from test_llm_operators import plain_components

    return {c for _, _, c in plain_components(texts, size, percent)}


def test_near_duplicates_leave_one(stages):
    before, after = stages[1]
    assert set(ids(after)) == groups([(r.doc_id, r.text) for r in before.collect()], 5, 80)


def test_contaminated_go(spark, stages):
    before, after = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [d for d, _, hit, _ in plain_contamination([(r.doc_id, r.text) for r in before.collect()], items, 10) if not hit]
    assert ids(after) == sorted(clean)


def test_tokens_of_all_readings(stages):
    before, after = stages[4]
    texts = before.collect()
    wanted = collections.Counter((r.doc_id, len(i)) for r, i in zip(texts, plain_ids([r.text for r in texts])))
    assert collections.Counter((r.doc_id, r.n_tokens) for r in after.collect()) == wanted


def test_odd_rows_pass_all_stages(spark):
    made = near_copies(groups=2, copies=4)
    texts = [(d if i % 4 else None, t) for i, (d, t) in enumerate(made)] + [(None, None), (1, ""), (900, made[0][1]), (900, made[0][1])]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    for _, stage in P.STAGES:
        docs = cut(stage(spark, docs, SF))
    assert docs.count() > 0


def test_repeated_rows_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame(rows([(5, text), (5, text), (None, text), (3, "other words only in here")])[1:] + rows([(5, text), (5, text)])[1:], SCHEMA)
    kept = P.near_duplicates(spark, docs, SF)
    assert kept.filter(F.col("text") == text).count() == 1 and kept.count() == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = cut(stage(spark, docs, SF))
    assert docs.count() == 0
