"""Vector collections against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeseed.operators.retrieve import retrieve
from lakeseed.operators.vectors import Collection, nearest
from lakeseed.sources.points import point_json, read_points, write_points
from lakeseed.workspace import new_path

SIZE = 4
draw = np.random.default_rng(5)
POINTS = draw.integers(-2, 3, (700, SIZE)).astype(float)
QUERIES = draw.integers(-2, 3, (9, SIZE)).astype(float)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, vector.tolist()) for i, vector in enumerate(POINTS)]
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(5).cache()


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(f"q{i}", vector.tolist()) for i, vector in enumerate(QUERIES)]
    return spark.createDataFrame(rows, "query_id string, vector array<double>")


def brute(metric, k):
    out = {}
    for q, query in enumerate(QUERIES):
        scored = []
        for i, point in enumerate(POINTS):
            if metric == "euclidean":
                scored.append((round(float(np.linalg.norm(query - point)), 9), i))
            else:
                score = float(query @ point)
                if metric == "cosine":
                    length = np.linalg.norm(query) * np.linalg.norm(point)
                    score = score / length if length else 0.0
                scored.append((-round(score, 9), i))
        out[f"q{q}"] = [value for value, _ in sorted(scored)[:k]]
    return out


def scores(frame, metric):
    out = {}
    for row in frame.orderBy("query_id", "rank").collect():
        sign = 1 if metric == "euclidean" else -1
        out.setdefault(row["query_id"], []).append(sign * round(row["score"], 9) + 0.0)
    return out


@pytest.mark.parametrize("metric", ["", "dot", "Euclidean"])
@pytest.mark.parametrize("query_bytes", [10**9, 2 * 8 * SIZE])
def test_nearest_equals_brute_force(points, queries, metric, query_bytes):
    collection = Collection("t", SIZE, metric)
    got = scores(nearest(points, queries, collection, 6, query_bytes), collection.metric)
    assert got == brute(collection.metric, 6)


def test_ties_go_to_the_smaller_id(spark, queries):
    points = spark.range(100).select("id", F.array(*[F.lit(1.0)] * SIZE).alias("vector")).repartition(7)
    found = nearest(points, queries.where("query_id = 'q1'"), Collection("t", SIZE, "dot"), 3)
    assert [row["id"] for row in found.orderBy("rank").collect()] == [0, 1, 2]


def test_text_ids_fewer_points_than_k_and_no_queries(spark, queries):
    points = spark.createDataFrame([("b", [1.0] * SIZE), ("a", [1.0] * SIZE)], "id string, vector array<float>")
    found = nearest(points, queries.where("query_id = 'q0'"), Collection("t", SIZE), 5)
    assert [row["id"] for row in found.orderBy("rank").collect()] == ["a", "b"]
    none = nearest(points, queries.where("false"), Collection("t", SIZE), 5)
    assert none.count() == 0 and none.columns == found.columns


def test_numbers_must_be_finite(spark, queries):
    points = spark.createDataFrame([(1, [float("nan")] * SIZE), (2, [-1.0] * SIZE)], "id int, vector array<double>")
    with pytest.raises(Exception, match="finite"):
        nearest(points, queries.where("query_id = 'q0'"), Collection("t", SIZE), 2).collect()


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_copies_tie_exactly_wherever_they_are_stored(spark, metric):
    vectors = draw.standard_normal((40, 64))
    rows = [(i, vectors[0 if i % 3 == 0 else i % 40].tolist()) for i in range(5000)]
    points = spark.createDataFrame(rows, "id int, vector array<double>").repartition(7)
    query = spark.createDataFrame([("q", vectors[0].tolist())], "query_id string, vector array<double>")
    found = nearest(points, query, Collection("t", 64, metric), 20).orderBy("rank").collect()
    copies = sorted(i for i in range(5000) if i % 3 == 0 or i % 40 == 0)
    if metric != "dot":
        assert [row["id"] for row in found] == copies[:20]
    ordered = [(-row["score"] if metric != "euclidean" else row["score"], row["id"]) for row in found]
    assert ordered == sorted(ordered)


def test_size_is_checked(spark, queries):
    collection = Collection("docs", 3, "Cosine")
    points = spark.createDataFrame([("1", [0.1, 0.2, 0.3]), ("2", [0.4, 0.5, 0.6])], "id string, vector array<double>")
    assert collection.checked(points).count() == 2
    wrong = points.union(spark.createDataFrame([("3", [0.1])], "id string, vector array<double>"))
    assert {row["fits"]: row["points"] for row in collection.size_report(wrong).collect()} == {True: 2, False: 1}
    with pytest.raises(Exception, match="size 3"):
        collection.checked(wrong).collect()
    with pytest.raises(Exception, match="size 3"):
        query = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, vector array<double>")
        nearest(wrong, query, collection, 1).collect()


@pytest.mark.parametrize("query_bytes", [10**9, 8 * SIZE])
def test_bad_queries_are_refused(spark, points, queries, query_bytes):
    with pytest.raises(ValueError, match="must differ"):
        nearest(points, queries.union(queries), Collection("t", SIZE), 1, query_bytes)
    with pytest.raises(ValueError, match="4 finite numbers"):
        short = spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>")
        nearest(points, short, Collection("t", SIZE), 1, query_bytes)


def test_metric_names():
    assert Collection("a", 3).metric == "cosine"
    with pytest.raises(ValueError):
        Collection("a", 3, "manhattan")
    with pytest.raises(ValueError):
        Collection("", 3)


def test_points_from_json_files(spark):
    path = new_path(spark, "points")
    rows = spark.range(25).select("id", F.array(F.col("id") * 0.5).alias("vector"), F.lit("x").alias("tag"))
    payload = F.when(F.col("id") > 5, F.create_map(F.lit("tag"), F.col("tag"))).otherwise(F.create_map().cast("map<string,string>"))
    write_points(rows, path, point_json(F.col("id"), F.col("vector"), payload))
    loaded = read_points(spark, path, lines=True)
    assert loaded.count() == 25
    assert loaded.where("payload is null").count() == 6
    assert loaded.where("id = '9'").head()["vector"] == [4.5]


def test_points_keep_large_ids_and_fail_on_bad_json(spark):
    path = new_path(spark, "points")
    text = '[{"id": 9007199254740993, "vector": [1]},\n {"id": "a-b", "vector": [2.5], "payload": {"n": 1}}]'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    assert sorted(row["id"] for row in read_points(spark, path).collect()) == ["9007199254740993", "a-b"]
    bad = new_path(spark, "points")
    spark.createDataFrame([('[{"id": 1, "vector": [1]}, {"id"',)], "value string").coalesce(1).write.text(bad)
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_points(spark, bad).collect()


def test_retrieve_joins_documents_labels_and_objects(spark, points, queries):
    documents = points.where("id <> 5").select(
        F.col("id").alias("doc_id"), F.lit("en").alias("bucket"), F.concat("id", F.lit(".txt")).alias("key")
    )
    labels = points.where("id % 2 = 0").select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    objects = documents.where("doc_id % 3 = 0").select("bucket", "key", F.lit("text/plain").alias("content_type"), F.col("doc_id").alias("length"))
    found = retrieve(points, queries, documents, labels, objects, Collection("t", SIZE), 40)
    hits = nearest(points, queries, Collection("t", SIZE), 40).where("id <> 5")
    want = {
        (r["query_id"], r["rank"], r["id"], 1 if r["id"] % 2 == 0 else None, f"{r['id']}.txt" if r["id"] % 3 == 0 else None)
        for r in hits.collect()
    }
    got = {(r["query_id"], r["rank"], r["doc_id"], r["quality"], r["object_key"]) for r in found.collect()}
    assert got == want


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_very_large_and_small_vectors(spark, metric):
    vectors = [[1e200, 0.0], [1e200, 1e200], [1e-200, 0.0], [1e-200, 3e-200], [0.5, 0.5], [0.0, 0.0]]
    points = spark.createDataFrame(list(enumerate(vectors)), "id int, vector array<double>")
    queries = spark.createDataFrame([("one", [1.0, 0.0]), ("tiny", [2e-200, 0.0])], "query_id string, vector array<double>")
    found = nearest(points, queries, Collection("t", 2, metric), 3).orderBy("query_id", "rank").collect()
    got = {}
    for row in found:
        got.setdefault(row["query_id"], []).append(row["id"])
    want = {"cosine": {"one": [0, 2, 1], "tiny": [0, 2, 1]}, "euclidean": {"one": [4, 2, 3], "tiny": [2, 5, 3]}}[metric]
    assert got == want
