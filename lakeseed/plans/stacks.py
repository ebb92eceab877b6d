"""Environments that users compose: analytics, lake and retrieval."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lakeseed.operators.retrieve import retrieve
from lakeseed.operators.vectors import Collection
from lakeseed.plans import catalog, seed
from lakeseed.session import configure
from lakeseed.sources.collections import (
    create_collection,
    open_collection,
    read_collection,
    upsert_points,
)
from lakeseed.sources.lake import LakeEnvironment
from lakeseed.sources.objects import put_objects, stat_objects
from lakeseed.workspace import new_path


@dataclass
class AnalyticsStack:
    """An analytic store seeded by SQL, and catalogs to query beside it."""

    name: str
    sql: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    catalogs: catalog.Catalogs = field(default_factory=catalog.Catalogs)

    def create(self, spark: SparkSession) -> AnalyticsStack:
        """Register the catalogs, then run all SQL strings and all files in order."""
        self.catalogs.register(configure(spark))
        seed.SeedSpec(self.name, self.sql, self.files).plan().run(spark)
        return self

    def execute(self, spark: SparkSession, sql: str) -> None:
        seed.execute(spark, sql)

    def query(self, spark: SparkSession, sql: str, **parameters: object) -> DataFrame:
        return catalog.query(spark, sql, **parameters)


@dataclass
class LakeStack:
    """A warehouse bucket with a catalog and SQL over it."""

    name: str
    environment: LakeEnvironment = field(default_factory=LakeEnvironment)

    def create(self, spark: SparkSession) -> LakeStack:
        self.environment.create(configure(spark))
        return self

    def query(self, spark: SparkSession, sql: str, **parameters: object) -> DataFrame:
        return catalog.query(spark, sql, **parameters)


@dataclass
class RetrievalStack:
    """Relational documents, a vector collection and stored objects."""

    name: str
    collection: Collection
    sql: list[str] = field(default_factory=list)
    objects: str = ""

    def create(self, spark: SparkSession) -> RetrievalStack:
        """Register the stack's catalog, seed the documents, create the collection."""
        catalog.Catalogs().with_memory(self.name).register(configure(spark))
        seed.SeedSpec(self.name, self.sql).plan().run(spark)
        create_collection(spark, self.name, self.collection)
        self.objects = self.objects or new_path(spark, f"{self.name}-objects")
        return self

    def load_points(self, points: DataFrame, seq: list[str] | None = None) -> None:
        upsert_points(points, self.name, self.collection.name, seq)

    def load_objects(self, objects: DataFrame, seq: list[str] | None = None) -> DataFrame:
        return put_objects(objects, self.objects, seq)

    def search(self, queries: DataFrame, documents: DataFrame, labels: DataFrame, k: int) -> DataFrame:
        """Nearest documents of each query with their labels and stored objects.

        ``documents`` and ``labels`` are keyed by ``doc_id``; documents name their object by
        ``bucket`` and ``key``.
        """
        spark = queries.sparkSession
        stored = open_collection(spark, self.name, self.collection.name)
        points = read_collection(spark, self.name, self.collection.name)
        objects = stat_objects(spark, self.objects)
        return retrieve(points, queries, documents, labels, objects, stored, k)
