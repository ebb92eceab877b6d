"""Composed environments."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakeseed.operators.vectors import Collection
from lakeseed.plans.catalog import Catalogs
from lakeseed.plans.stacks import AnalyticsStack, LakeStack, RetrievalStack
from lakeseed.sources.collections import create_collection, open_collection, read_collection, upsert_points
from lakeseed.sources.lake import LakeEnvironment
from lakeseed.sources.objects import stat_objects
from lakeseed.workspace import new_path


def test_analytics_stack(spark, tmp_path):
    path = new_path(spark, "events")
    script = tmp_path / "more.sql"
    script.write_text("INSERT INTO stack_events VALUES (2, 'login')")
    stack = AnalyticsStack(
        "analytics",
        sql=[
            "DROP TABLE IF EXISTS stack_events",
            f"CREATE TABLE stack_events (id DECIMAL(20,0), name STRING) USING parquet LOCATION '{path}'",
            "INSERT INTO stack_events VALUES (1, 'signup')",
        ],
        files=[str(script)],
        catalogs=Catalogs().with_memory("side"),
    ).create(spark)
    stack.execute(spark, "INSERT INTO stack_events VALUES (18446744073709551615, 'last')")
    names = stack.query(spark, "SELECT name FROM stack_events WHERE id > :low ORDER BY id", low=1)
    assert [row["name"] for row in names.collect()] == ["login", "last"]


def test_lake_stack(spark):
    stack = LakeStack("lake", LakeEnvironment("warehouse", "stack_lake")).create(spark)
    assert stack.query(spark, "SELECT 1 AS one").head()["one"] == 1
    assert "stack_lake" in [row["namespace"] for row in stack.query(spark, "SHOW DATABASES").collect()]


def test_collection_is_created_updated_and_upserted(spark):
    Catalogs().register(spark)
    name = "c" + new_path(spark, "id").rsplit("-", 1)[-1]
    create_collection(spark, "memory", Collection(name, 4, "dot"))
    create_collection(spark, "memory", Collection(name, 3))
    assert open_collection(spark, "memory", name) == Collection(name, 3, "cosine")
    schema = "id long, vector array<double>, n int, payload string"
    rows = spark.createDataFrame(
        [(1, [0.1, 0.2, 0.3], 1, '{"a":1}'), (2, [0.4, 0.5, 0.6], 1, "{}"), (1, [0.7, 0.8, 0.9], 2, '{"a":2}')], schema
    ).withColumn("payload", F.parse_json("payload"))
    for _ in range(2):
        upsert_points(rows, "memory", name, ["n"])
    stored = read_collection(spark, "memory", name).select("id", "vector", F.try_variant_get("payload", "$.a", "int"))
    assert sorted(map(tuple, stored.collect())) == [("1", [0.7, 0.8, 0.9], 2), ("2", [0.4, 0.5, 0.6], None)]
    with pytest.raises(Exception, match="size 3"):
        upsert_points(rows.withColumn("vector", F.array(F.lit(1.0))), "memory", name, ["n"])
    assert read_collection(spark, "memory", name).count() == 2
    for bad, message in ((rows.where("n = 1").union(rows.where("n = 2")), "occurs twice"), (rows.withColumn("id", F.lit(None)), "null")):
        with pytest.raises(Exception, match=message):
            upsert_points(bad, "memory", name)
    assert read_collection(spark, "memory", name).count() == 2


def test_a_load_touches_only_its_buckets(spark):
    Catalogs().register(spark)
    name = "c" + new_path(spark, "id").rsplit("-", 1)[-1]
    create_collection(spark, "memory", Collection(name, 1), buckets=16)
    points = spark.range(400).select("id", F.array(F.col("id").cast("double")).alias("vector"), F.lit(None).cast("variant").alias("payload"))
    upsert_points(points, "memory", name)
    files = lambda: {row["f"] for row in spark.table(f"memory.{name}").select(F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    upsert_points(points.where("id = 7").withColumn("vector", F.array(F.lit(0.5))), "memory", name)
    after = files()
    assert len(before) == len(after) == 16 and len(before & after) == 15
    found = {int(row["id"]): row["vector"][0] for row in read_collection(spark, "memory", name).collect()}
    assert found == {i: 0.5 if i == 7 else float(i) for i in range(400)}


def test_retrieval_stack(spark):
    path = new_path(spark, "docs")
    stack = RetrievalStack(
        "rag_test", Collection("docs" + path.rsplit("-", 1)[-1], 2),
        sql=[
            "DROP TABLE IF EXISTS rag_documents",
            f"CREATE TABLE rag_documents (doc_id INT, lang STRING, body STRING) USING parquet LOCATION '{path}'",
            "INSERT INTO rag_documents VALUES (1, 'en', 'one'), (2, 'fr', 'two'), (3, 'en', 'three')",
        ],
    ).create(spark)
    documents = spark.table("rag_documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    documents = documents.withColumns({"bucket": F.col("lang"), "key": F.concat("doc_id", F.lit(".txt"))})
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id int, vector array<double>")
    stack.load_points(vectors.withColumn("payload", F.parse_json(F.lit("{}"))))
    stack.load_objects(documents.select(F.col("lang").alias("bucket"), F.concat("doc_id", F.lit(".txt")).alias("key"), F.col("body").alias("content")))
    labels = documents.where("doc_id = '2'").select("doc_id", F.lit(1).alias("quality"))
    queries = spark.createDataFrame([("q", [1.0, 0.05])], "query_id string, vector array<double>")
    found = stack.search(queries, documents, labels, 2).orderBy("rank").collect()
    assert [(row["doc_id"], row["body"], row["quality"]) for row in found] == [("1", "one", None), ("2", "two", 1)]
    stored = {(row["bucket"], row["key"], row["length"]) for row in stat_objects(spark, stack.objects).collect()}
    assert {(row["object_bucket"], row["object_key"], row["object_length"]) for row in found} <= stored
