"""Scale helpers against the plain one-task forms, with ranges and thresholds made tiny."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from segloom.plans.bounded import bounded_rows
from segloom.plans.ordering import neighbours, position, position2, running
from segloom.plans.skew import attach, attach_weighted


def rows_of(spark, n=400):
    rnd = random.Random(1)
    return spark.createDataFrame(
        [("ab"[i % 3 == 0], k, rnd.randint(-5, 5)) for i, k in enumerate(rnd.sample(range(5000), n))], "g string, k long, v int"
    ).cache()


def test_running_equals_a_window(spark):
    df = rows_of(spark)
    for reverse in (False, True):
        for exclusive in (False, True):
            order = F.col("k").desc() if reverse else F.col("k")
            w = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
            for levels in (1, 2):
                got = running(
                    df, ["g"], "k", {"s": ("sum", F.col("v")), "m": ("min", F.col("v"))},
                    reverse=reverse, exclusive=exclusive, bits=3, levels=levels,
                )
                want = df.withColumns({"s": F.coalesce(F.sum("v").over(w), F.lit(0)), "m": F.min("v").over(w)})
                assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_positions(spark):
    df = rows_of(spark).withColumn("minor", F.col("k") % 7).withColumn("major", F.floor(F.col("k") / 700))
    got = position(df, ["g"], "k", "p").select("g", "k", "p")
    want = df.select("g", "k", (F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).alias("p"))
    assert sorted(got.collect()) == sorted(want.collect())
    two = position2(df, ["g"], "major", "minor", "p", tie=[F.col("k")], start=1).select("g", "k", "p")
    order = Window.partitionBy("g").orderBy("major", "minor", "k")
    assert sorted(two.collect()) == sorted(df.select("g", "k", F.row_number().over(order).alias("p")).collect())


def test_neighbours_keep_frames_whole(spark):
    df = spark.range(50).select(F.lit("g").alias("g"), F.col("id").alias("k"))
    spread, w = neighbours(df, ["g"], "k", 2, bits=2)
    got = spread.withColumn("n", F.collect_list("k").over(w.rowsBetween(-2, 2))).filter("__home").orderBy("k").collect()
    assert [r["n"] for r in got] == [[j for j in range(i - 2, i + 3) if 0 <= j < 50] for i in range(50)]


def test_salted_joins_equal_plain_joins(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("key"), "id")
    per = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    want = sorted(df.join(per.drop("n"), "key").select("id", "top").collect())
    assert sorted(attach(df, per, ["key"], "n", spread=["id"], hot_rows=20).select("id", "top").collect()) == want
    sized = df.join(per.select("key", F.col("n").alias("w")), "key")
    salted = attach_weighted(sized, per.withColumnRenamed("n", "w"), ["key"], "w", spread=["id"], hot_rows=20)
    assert sorted(salted.select("id", "top").collect()) == want
    left = attach(df, per.filter("key <> 0"), ["key"], "n", how="left", spread=["id"], hot_rows=20)
    assert left.count() == 1000 and left.filter("top is null").count() == df.filter("key = 0").count()


def test_bounded_rows(spark):
    assert len(bounded_rows(spark.range(5), 5)) == 5
    assert bounded_rows(spark.range(6), 5) is None


def test_positions_are_long(spark):
    df = spark.createDataFrame([("d", (1 << 40) + 5 * i) for i in range(100)], "deck_id string, k long")
    out = position(df, ["deck_id"], "k", "p", start=(1 << 33))
    assert dict(out.dtypes)["p"] == "bigint"
    assert sorted(r.p for r in out.collect()) == [(1 << 33) + i for i in range(100)]
