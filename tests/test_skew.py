"""A key with half of all rows must not stay in one task."""

import re

import pytest
from pyspark.sql import functions as F

from newsmill.operators.articles import article_join
from newsmill.operators.lifecycle import type_rollup
from newsmill.operators.perf import latency_percentiles

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark.range(0, 120000, 1, 8).withColumn("hot", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 50))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def split_joins(df):
    df.count()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("skew=true")


def test_hot_link_target(spark, skewed):
    url = F.concat(F.lit("https://x.org/"), "hot")
    links = skewed.select(url.alias("url"), F.col("id").alias("pos"))
    pages = skewed.where("id < 200").select(url.alias("url"), F.lit("t").alias("title"), F.lit("c").alias("content"), F.col("id").alias("fetched_at"))
    out = article_join(links, pages)
    assert split_joins(out) > 0
    assert out.where("matched").count() == 120000


def test_hot_type(skewed):
    out = type_rollup(skewed, "hot", ("id",))
    assert split_joins(out) > 0
    assert {r.n_in_type for r in out.where("hot = -1").limit(5).collect()} == {60000}


def test_hot_group_of_percentiles(skewed):
    out = latency_percentiles(skewed, ["hot"], F.col("id").cast("double"))
    assert split_joins(out) > 0
    assert out.where("hot = -1").first().p50 == 59999.0
