"""Narrow tables and pages are dealt to all cores before anything wide is made of them."""

from pyspark.sql import functions as F

from factsieve.functions.urls import site_root, url_parts
from factsieve.sources.nodes import explode_nodes
from factsieve.workloads import queries as Q
from factsieve.workloads import rendered as R


def tasks_of(frame):
    return frame.select(F.spark_partition_id().alias("p")).distinct().count()


def test_pages_of_one_row_group_are_made_by_many_tasks(spark, tmp_path):
    rows = spark.range(400).select(
        F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit("m").alias("c_mktsegment"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert tasks_of(R.table(spark, str(tmp_path), "customer")) == 1
    for made in (R.customer_sites, R.customer_pages, R.snapshot_pages, R.segment_pages, R.access_pages):
        assert tasks_of(made(spark, str(tmp_path))) >= spark.sparkContext.defaultParallelism, made.__name__


def test_element_rows_are_made_where_their_bucket_is(spark):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("<p>a</p><p>b</p>").alias("html")).coalesce(1)
    nodes = explode_nodes(pages, 7)
    strayed = nodes.where(F.spark_partition_id() != F.expr("pmod(hash(page_id), 7)"))
    assert nodes.count() == 200 and strayed.count() == 0


def test_site_of_addresses_that_are_none(spark):
    given = ["http://User:pw@WWW.a.Example.com:80/x", "http:///x", "mailto:x@y.z", "http://ho st/p", "http://[::1]:8080/p", None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "i int, u string")
    got = rows.select("i", site_root(F.col("u")).alias("s"), url_parts(F.col("u"))["host"].alias("h")).orderBy("i").collect()
    assert [r.s for r in got] == ["example.com", None, None, None, "[::1]", None]
    assert [r.h for r in got] == ["www.a.example.com", None, None, None, "[::1]", None]


def test_social_profiles_are_judged_by_many_tasks(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert tasks_of(Q.social_profiles(spark, str(tmp_path))) >= spark.sparkContext.defaultParallelism
