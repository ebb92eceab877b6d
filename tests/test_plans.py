"""Seed plans and catalogs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakeseed.plans.catalog import Catalogs, catalog_settings, mount, query
from lakeseed.plans.queries.surface import over_files
from lakeseed.plans.seed import SeedError, SeedPlan, SeedSpec, execute
from lakeseed.workspace import new_path


def test_seed_steps_run_in_order(spark, tmp_path):
    path = new_path(spark, "seed_check")
    script = tmp_path / "seed.sql"
    plan = SeedPlan("analytics")
    plan.with_sql("DROP TABLE IF EXISTS seed_check")
    plan.with_sql(f"CREATE TABLE seed_check (id DECIMAL(20,0), name STRING) USING parquet LOCATION '{path}'")
    plan.with_sql_file(str(script))
    plan.with_step(lambda s: s.table("seed_check").withColumn("n", F.length("name")).createOrReplaceTempView("seeded"))
    # The file is written only after it was added to the plan.
    script.write_text("INSERT INTO seed_check VALUES (1, 'signup');\nINSERT INTO seed_check VALUES (2, 'x;y'); -- done;")
    plan.run(spark)
    assert sorted((int(r["id"]), r["name"], r["n"]) for r in spark.table("seeded").collect()) == [(1, "signup", 6), (2, "x;y", 3)]


def test_first_failure_stops_the_run(spark):
    ran = []
    plan = SeedPlan("store").with_step(lambda s: ran.append(1)).with_sql("SELECT nothing FROM nowhere")
    plan.with_step(lambda s: ran.append(3))
    with pytest.raises(SeedError, match=r"failed to seed store at step 2 \(sql\)"):
        plan.run(spark)
    assert ran == [1]


def test_failed_list_is_run_again_as_a_whole(spark):
    ran = []

    def second(_):
        ran.append("b")
        if ran.count("b") < 3:
            raise RuntimeError("not yet")

    plan = SeedPlan("objects").with_step(lambda s: ran.append("a")).with_step(second)
    plan.run(spark, retry_for=5, interval=0.01)
    assert ran == ["a", "b"] * 3
    with pytest.raises(SeedError):
        SeedPlan("x").with_sql("bad sql").run(spark, retry_for=0.05, interval=0.01)


def test_strings_run_before_files():
    plan = SeedSpec("s", sql=["one", "two"], files=["/a.sql"]).plan()
    assert [label for label, _ in plan.steps] == ["sql", "sql", "/a.sql"]


def test_execute_runs_a_query_to_its_end(spark):
    execute(spark, "SELECT 1")
    execute(spark, "CREATE OR REPLACE TEMP VIEW ex AS SELECT 1 AS one")
    with pytest.raises(Exception, match="boom"):
        execute(spark, "SELECT raise_error('boom') AS x")


def test_catalogs(spark):
    properties = {"connector.name": "memory"}
    catalogs = Catalogs().with_catalog("a", {"connector": "memory"}).with_catalog("a", properties)
    properties["y"] = "2"
    assert catalogs.resolved() == {"a": {"connector.name": "memory"}}
    assert list(Catalogs().resolved()) == ["memory"]
    assert catalogs.register(spark) == ["a"]
    assert "a" in [row["namespace"] for row in spark.sql("SHOW DATABASES").collect()]
    assert {"spark_catalog", "a"} <= {row["catalog"] for row in catalogs.show(spark).collect()}
    with pytest.raises(ValueError):
        Catalogs().with_catalog("", {})


def test_catalog_class_becomes_a_spark_catalog(spark):
    Catalogs().with_catalog("lakecat", {"connector": "org.example.Missing", "uri": "u"}).register(spark)
    assert spark.conf.get("spark.sql.catalog.lakecat") == "org.example.Missing"
    assert spark.conf.get("spark.sql.catalog.lakecat.uri") == "u"
    spark.conf.unset("spark.sql.catalog.lakecat")
    spark.conf.unset("spark.sql.catalog.lakecat.uri")


def test_lake_properties_are_translated_and_unknown_ones_refused():
    given = {
        "connector.name": "iceberg", "iceberg.catalog.type": "rest", "iceberg.rest-catalog.uri": "http://c:8181",
        "iceberg.rest-catalog.warehouse": "s3://w/", "fs.native-s3.enabled": "true", "s3.endpoint": "http://m:9000",
        "s3.aws-access-key": "a", "s3.aws-secret-key": "b", "s3.path-style-access": "true",
    }
    prefix = "spark.sql.catalog.lake"
    assert catalog_settings("lake", given) == {
        prefix: "org.apache.iceberg.spark.SparkCatalog", f"{prefix}.type": "rest", f"{prefix}.uri": "http://c:8181",
        f"{prefix}.warehouse": "s3://w/", f"{prefix}.io-impl": "org.apache.iceberg.aws.s3.S3FileIO",
        f"{prefix}.s3.endpoint": "http://m:9000", f"{prefix}.s3.access-key-id": "a",
        f"{prefix}.s3.secret-access-key": "b", f"{prefix}.s3.path-style-access": "true",
    }
    for bad in ({**given, "more": "1"}, {"connector.name": "memory", "x": "1"}, {"connector.name": "oracle"}):
        with pytest.raises(ValueError):
            Catalogs().with_catalog("lake", bad)


def test_folder_of_scripts_runs_whole_and_in_order(spark, tmp_path):
    path = new_path(spark, "folder_check")
    (tmp_path / "2.sql").write_text("INSERT INTO folder_check VALUES (2);\nINSERT INTO folder_check VALUES (3)")
    (tmp_path / "1.sql").write_text(f"DROP TABLE IF EXISTS folder_check; CREATE TABLE folder_check (id INT) USING parquet LOCATION '{path}';")
    (tmp_path / "3.sql").write_text("\n")
    SeedPlan("folder").with_sql_file(str(tmp_path)).run(spark)
    assert sorted(row["id"] for row in spark.table("folder_check").collect()) == [2, 3]


def test_mount_replaces(spark):
    Catalogs().register(spark)
    for n in (1, 2):
        path = new_path(spark, "mount")
        spark.range(n).write.parquet(path)
        mount(spark, "memory", "numbers", path)
    assert query(spark, "SELECT count(*) AS n FROM memory.numbers WHERE id >= :low", low=0).head()["n"] == 2
    assert query(spark, "select 1").head()[0] == 1


def test_table_names_are_pointed_at_files():
    sql = over_files("SELECT a FROM orders JOIN nation ON x", "/d")
    assert sql == "SELECT a FROM parquet.`/d/orders.parquet` AS orders JOIN parquet.`/d/nation.parquet` AS nation ON x"
