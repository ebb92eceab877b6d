"""Vector collections and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.operators.retrieve import retrieve
from lakeseed.operators.vectors import Collection, nearest
from lakeseed.operators.write import last_wins, upsert
from lakeseed.plans.catalog import Catalogs
from lakeseed.sources.collections import create_collection, read_collection, upsert_points
from lakeseed.plans.queries.inputs import document_objects
from lakeseed.sources.objects import put_objects
from lakeseed.sources.points import point_json, read_points, write_points
from lakeseed.sources.tables import read_table
from lakeseed.workspace import new_path

DOCS = Collection("docs", 64)
NEIGHBOURS = 5


def points(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def label_means(embeddings: DataFrame) -> DataFrame:
    """One query vector per label: the mean of all its vectors.

    There are as many queries as labels however many vectors there are.
    """
    parts = embeddings.select("label", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "mean"))).alias("all"))
    return vectors.select(F.col("label").alias("query_id"), F.col("all.mean").alias("vector"))


def retrieve_documents(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = read_table(spark, folder, "embeddings")
    documents = read_table(spark, folder, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        F.col("lang").alias("bucket"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("key"),
    )
    labels = read_table(spark, folder, "labels").select("doc_id", "quality")
    objects = put_objects(document_objects(spark, folder), new_path(spark, "objects"))
    found = retrieve(points(embeddings), label_means(embeddings), documents, labels, objects, DOCS, NEIGHBOURS)
    return found.select(
        "query_id", "rank", "doc_id", F.round("score", 6).alias("score"),
        "lang", "source", "n_chars", "quality", "object_bucket", "object_key", "object_length", "content_type",
    )


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = read_table(spark, folder, "embeddings")
    found = nearest(points(embeddings), label_means(embeddings), DOCS, NEIGHBOURS)
    return found.withColumn("score", F.round("score", 6))


def vector_topk_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = read_table(spark, folder, "embeddings")
    flat = Collection("docs", 64, "euclidean")
    found = nearest(points(embeddings), label_means(embeddings), flat, NEIGHBOURS)
    return found.withColumn("score", F.round("score", 6))


def vector_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = read_table(spark, folder, "embeddings")
    documents = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    """Vectors are stored with a payload, and one language of them is searched."""
    payload = F.to_variant_object(F.struct("lang", "source"))
    path = new_path(spark, "points")
    points(embeddings).join(documents, "id").select("id", "vector", payload.alias("payload")).write.parquet(path)
    english = spark.read.parquet(path).where(F.variant_get("payload", "$.lang", "string") == "en")
    found = nearest(english, label_means(embeddings), DOCS, NEIGHBOURS)
    return found.withColumn("score", F.round("score", 6))


def vector_dim_check(spark: SparkSession, folder: str) -> DataFrame:
    return DOCS.size_report(points(read_table(spark, folder, "embeddings")))


def vector_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings are the collection; documents, then labels, arrive as one batch."""
    base = points(read_table(spark, folder, "embeddings")).select(
        "id", F.col("vector").cast("array<double>").alias("vector"), F.lit("embeddings").alias("origin")
    )
    documents = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.array(F.col("n_chars").cast("double")).alias("vector"),
        F.lit("documents").alias("origin"),
        F.lit(1).alias("seq"),
    )
    labels = read_table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"),
        F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("vector"),
        F.lit("labels").alias("origin"),
        F.lit(2).alias("seq"),
    )
    merged = upsert(base, documents.unionByName(labels), ["id"], ["seq"])
    return merged.select(
        "id", "origin", F.size("vector").alias("dims"), F.round(F.element_at("vector", 1), 6).alias("first")
    )


def points_from_json(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = read_table(spark, folder, "embeddings")
    path = new_path(spark, "points")
    payload = F.create_map(F.lit("label"), F.col("label").cast("string"))
    point = point_json(F.col("vec_id"), F.col("embedding").cast("array<double>"), payload)
    write_points(embeddings, path, point)
    loaded = DOCS.checked(read_points(spark, path, lines=True)).withColumn("seq", F.lit(0))
    return last_wins(loaded, ["id"], ["seq"]).select(
        "id",
        F.variant_get("payload", "$.label", "string").alias("label"),
        F.size("vector").alias("dims"),
        F.round(F.element_at("vector", 1), 6).alias("first"),
        F.round(F.element_at("vector", -1), 6).alias("last"),
    )


def vector_collection(spark: SparkSession, folder: str) -> DataFrame:
    """A stored collection: embeddings are loaded, then their documents' languages, twice."""
    name = "c" + new_path(spark, "id").rsplit("-", 1)[-1]
    Catalogs().register(spark)
    create_collection(spark, "memory", Collection(name, 64))
    embeddings = read_table(spark, folder, "embeddings")
    labelled = embeddings.select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"),
        F.to_variant_object(F.struct("label")).alias("payload"),
    )
    upsert_points(labelled, "memory", name)
    documents = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang")
    told = points(embeddings).join(documents, "id").select(
        "id", "vector", F.to_variant_object(F.struct("lang")).alias("payload")
    )
    for _ in range(2):
        upsert_points(told, "memory", name)
    return read_collection(spark, "memory", name).select(
        "id",
        F.try_variant_get("payload", "$.label", "int").alias("label"),
        F.try_variant_get("payload", "$.lang", "string").alias("lang"),
        F.round(F.element_at("vector", 1), 6).alias("first"),
    )


QUERIES = {
    "retrieve_documents": retrieve_documents,
    "vector_collection": vector_collection,
    "vector_topk": vector_topk,
    "vector_topk_euclidean": vector_topk_euclidean,
    "vector_topk_filtered": vector_topk_filtered,
    "vector_dim_check": vector_dim_check,
    "vector_upsert": vector_upsert,
    "points_from_json": points_from_json,
}

MEANS = """
  parts AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
  means AS (SELECT label, pos, avg(x) AS mean FROM parts GROUP BY label, pos),
  queries AS (SELECT label::BIGINT AS query_id, list(mean ORDER BY pos) AS q FROM means GROUP BY label)
"""
COSINE = """
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
             FROM (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score
                   FROM embeddings CROSS JOIN queries))
"""

CHECKS = {
    "vector_collection": """
SELECT vec_id::VARCHAR AS id, CASE WHEN doc_id IS NULL THEN label END AS label, lang,
       round(embedding[1]::DOUBLE, 6) AS first
FROM embeddings LEFT JOIN documents ON doc_id = vec_id""",
    "retrieve_documents": f"""
WITH {MEANS}, {COSINE}
SELECT query_id, rank, d.doc_id, round(score, 6) AS score, d.lang, d.source, d.n_chars, l.quality,
       d.lang AS object_bucket, d.source || '/' || d.doc_id || '.txt' AS object_key,
       strlen(d.text) AS object_length, 'text/plain' AS content_type
FROM ranked JOIN documents d ON d.doc_id = ranked.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE rank <= 5""",
    "vector_topk": f"""
WITH {MEANS}, {COSINE}
SELECT query_id, rank, vec_id AS id, round(score, 6) AS score FROM ranked WHERE rank <= 5""",
    "vector_topk_euclidean": f"""
WITH {MEANS},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank
             FROM (SELECT query_id, vec_id, list_distance(embedding::DOUBLE[], q) AS score
                   FROM embeddings CROSS JOIN queries))
SELECT query_id, rank, vec_id AS id, round(score, 6) AS score FROM ranked WHERE rank <= 5""",
    "vector_topk_filtered": f"""
WITH {MEANS},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
             FROM (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score
                   FROM embeddings JOIN documents ON doc_id = vec_id AND lang = 'en' CROSS JOIN queries))
SELECT query_id, rank, vec_id AS id, round(score, 6) AS score FROM ranked WHERE rank <= 5""",
    "vector_dim_check": "SELECT len(embedding) = 64 AS fits, count(*) AS points FROM embeddings GROUP BY 1",
    "vector_upsert": """
WITH versions AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS vector, 'embeddings' AS origin, 0 AS seq FROM embeddings
  UNION ALL SELECT doc_id, [n_chars::DOUBLE], 'documents', 1 FROM documents
  UNION ALL SELECT doc_id, [quality::DOUBLE, toxic::DOUBLE], 'labels', 2 FROM labels)
SELECT id, origin, len(vector)::INT AS dims, round(vector[1], 6) AS first
FROM versions QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""",
    "points_from_json": """
SELECT vec_id::VARCHAR AS id, label::VARCHAR AS label, len(embedding)::INT AS dims,
       round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last
FROM embeddings""",
}
