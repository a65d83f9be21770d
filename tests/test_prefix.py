"""Running sums: the bucket expression does not grow with the cluster, and buckets keep the order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.functions import prefix
from calibra.operators import metrics as M


def _scores(spark, n=4000):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(int(i % 3), int(rng.random() < 0.3), float(np.round(rng.lognormal(0, 3), 2)))
                                  for i in range(n)], "g int, y int, score double").repartition(4)


@pytest.mark.parametrize("buckets", [1, 2, 5, 64, 300, 5000])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_cumulative_counts_for_every_number_of_buckets(spark, buckets, groups):
    df = _scores(spark, 900)
    got = prefix.cumulative_counts(df, groups, "score", {"n": F.count(F.lit(1))}, buckets=buckets).collect()
    rows = [(r.g, r.score) for r in df.collect()]
    for r in got:
        own = [s for g, s in rows if not groups or g == r.g]
        assert (r.cum_n, r.tot_n) == (sum(s <= r.score for s in own), len(own))


def test_infinite_values_and_non_numeric_keys(spark):
    df = spark.createDataFrame([(float(x),) for x in ["-inf", "inf", "inf", 0, 1, 2, 3, -5]], "v double")
    got = prefix.cumulative_counts(df, [], "v", {"n": F.count(F.lit(1))}, buckets=200).orderBy("v").collect()
    assert [r.cum_n for r in got] == [1, 2, 3, 4, 5, 6, 8]
    many = spark.createDataFrame([(i, 1) for i in range(500)], "k long, one int")
    assert prefix.running_sums(many, [], "k", ["one"], buckets=3000).where("cum_one <> k + 1").count() == 0


def test_plan_does_not_grow_with_the_cluster(spark):
    df = _scores(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def plan(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            return len(M.roc_auc(df, "y", "score", by=["g"])._jdf.queryExecution().optimizedPlan().toString())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    small, large = plan(64), plan(400_000)
    assert large < 1.3 * small


def test_running_sums_without_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = _scores(spark, 600)
        got = prefix.cumulative_counts(df, ["g"], "score", {"n": F.count(F.lit(1))}).collect()
        rows = [(r.g, r.score) for r in df.collect()]
        assert all(r.cum_n == sum(s <= r.score for g, s in rows if g == r.g) for r in got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
