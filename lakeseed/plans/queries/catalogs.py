"""Seed scripts, catalogs, SQL and joins between stores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.plans.catalog import Catalogs, mount, query
from lakeseed.plans.seed import SeedPlan, SeedSpec, execute
from lakeseed.sources.documents import as_documents, collection_path, insert_documents, read_documents
from lakeseed.sources.tables import read_table, table_path
from lakeseed.workspace import new_path

OPEN_ORDERS = """CREATE OR REPLACE TEMP VIEW seed_open_orders AS
SELECT o_orderkey, o_custkey FROM parquet.`{orders}` WHERE o_orderstatus = 'O'"""
ORDER_LINES = """CREATE OR REPLACE TEMP VIEW seed_order_lines AS
SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM parquet.`{lineitem}` GROUP BY l_orderkey"""
OPEN_LINES = """CREATE OR REPLACE TEMP VIEW seed_open_lines AS
SELECT o_custkey, sum(lines) AS lines, round(sum(quantity), 2) AS quantity
FROM seed_open_orders JOIN seed_order_lines ON l_orderkey = o_orderkey GROUP BY o_custkey"""


def _filled(sql: str, folder: str) -> str:
    return sql.format(orders=table_path(folder, "orders"), lineitem=table_path(folder, "lineitem"))


def seed_script(spark: SparkSession, folder: str) -> DataFrame:
    """A statement, then a script of two; each statement uses what the earlier ones made."""
    script = f"{ORDER_LINES};\n{OPEN_LINES}; -- a ';' ends nothing here"
    SeedSpec("orders", sql=[_filled(OPEN_ORDERS, folder), _filled(script, folder)]).plan().run(spark)
    return spark.table("seed_open_lines")


def seed_script_file(spark: SparkSession, folder: str) -> DataFrame:
    """A statement, then a folder of two script files, then a custom step."""
    path = new_path(spark, "script")
    scripts = [_filled(ORDER_LINES, folder) + ";", "SELECT ';';\n" + OPEN_LINES]
    for number, script in enumerate(scripts):
        spark.createDataFrame([(script,)], "value string").coalesce(1).write.text(f"{path}/step={number}")

    def rename(session: SparkSession) -> DataFrame:
        result = session.table("seed_open_lines").withColumnRenamed("o_custkey", "customer")
        result.createOrReplaceTempView("seed_customer_lines")
        return result

    plan = SeedPlan("orders").with_sql(_filled(OPEN_ORDERS, folder)).with_sql_file(path).with_step(rename)
    plan.run(spark)
    return spark.table("seed_customer_lines")


def catalog_query(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of two catalogs by qualified name."""
    Catalogs().with_memory().with_catalog("crm", {"connector.name": "memory"}).register(spark)
    mount(spark, "memory", "nation", table_path(folder, "nation"))
    mount(spark, "crm", "customer", table_path(folder, "customer"))
    return query(
        spark,
        """SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
           FROM crm.customer JOIN memory.nation ON n_nationkey = c_nationkey GROUP BY n_name""",
    )


def catalog_list(spark: SparkSession, folder: str) -> DataFrame:
    """The listed catalogs that hold a table of nations or regions, with its rows."""
    catalogs = Catalogs().with_catalog("places", {"connector.name": "memory"}).with_catalog("areas", {"connector.name": "memory"})
    catalogs.register(spark)
    counted = [
        spark.table(mount(spark, name, table, table_path(folder, table))).agg(
            F.lit(name).alias("catalog"), F.count(F.lit(1)).alias("held")
        )
        for name, table in (("places", "nation"), ("areas", "region"))
    ]
    return catalogs.show(spark).join(counted[0].union(counted[1]), "catalog")


def sql_query(spark: SparkSession, folder: str) -> DataFrame:
    """SQL text with a named parameter."""
    Catalogs().register(spark)
    mount(spark, "memory", "supplier", table_path(folder, "supplier"))
    return query(
        spark,
        "SELECT s_nationkey, max(s_acctbal) AS best FROM memory.supplier WHERE s_acctbal > :least GROUP BY s_nationkey",
        least=0.0,
    )


def federated_join(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in a document collection, orders in Parquet, nations in a catalog.

    Orders are summed per customer before the join, so a customer with very many
    orders is one row by then.
    """
    path = collection_path(new_path(spark, "documents"), "customers")
    customers = read_table(spark, folder, "customer")
    insert_documents(as_documents(customers, F.to_json(F.struct(*customers.columns))), path, "customers")
    Catalogs().register(spark)
    mount(spark, "memory", "nation", table_path(folder, "nation"))

    stored = read_documents(spark, path).select(
        F.variant_get("doc", "$.c_custkey", "bigint").alias("custkey"),
        F.variant_get("doc", "$.c_nationkey", "int").alias("n_nationkey"),
        F.variant_get("doc", "$.c_mktsegment", "string").alias("segment"),
    )
    spent = read_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent")
    )
    joined = stored.join(spent, "custkey").join(spark.table("memory.nation"), "n_nationkey")
    return joined.groupBy("n_name", "segment").agg(
        F.sum("orders").alias("orders"), F.round(F.sum("spent"), 2).alias("spent")
    )


def execute_statement(spark: SparkSession, folder: str) -> DataFrame:
    """DDL and two inserts, each run for its effect only."""
    path = new_path(spark, "facts")
    table = "facts_" + path.rsplit("-", 1)[-1]
    execute(spark, f"CREATE TABLE {table} (status STRING, facts BIGINT, total DOUBLE) USING parquet LOCATION '{path}'")
    orders, lineitem = table_path(folder, "orders"), table_path(folder, "lineitem")
    execute(
        spark,
        f"""INSERT INTO {table}
            SELECT o_orderstatus, count(*), sum(o_totalprice) FROM parquet.`{orders}` GROUP BY o_orderstatus""",
    )
    execute(
        spark,
        f"""INSERT INTO {table}
            SELECT l_linestatus, count(*), sum(l_extendedprice) FROM parquet.`{lineitem}` GROUP BY l_linestatus""",
    )
    return spark.table(table).groupBy("status").agg(
        F.sum("facts").alias("facts"), F.round(F.sum("total"), 2).alias("total")
    )


def seed_callback(spark: SparkSession, folder: str) -> DataFrame:
    """A custom step between two statements; its per-row code runs in Arrow batches."""

    @F.pandas_udf("string")
    def initials(names: pd.Series) -> pd.Series:
        return names.str.replace(r"[^A-Z0-9]", "", regex=True)

    def custom(session: SparkSession) -> DataFrame:
        people = session.table("seed_people").withColumn("short", initials("c_name"))
        people.createOrReplaceTempView("seed_short")
        return people

    plan = SeedPlan("people")
    plan.with_sql(
        f"""CREATE OR REPLACE TEMP VIEW seed_people AS
            SELECT c_custkey, c_name, c_mktsegment FROM parquet.`{table_path(folder, "customer")}`"""
    )
    plan.with_step(custom)
    plan.with_sql(
        "CREATE OR REPLACE TEMP VIEW seed_named AS SELECT c_custkey, concat(short, '/', c_mktsegment) AS name FROM seed_short"
    )
    plan.run(spark)
    return spark.table("seed_named")


QUERIES = {
    "seed_script": seed_script,
    "execute_statement": execute_statement,
    "seed_callback": seed_callback,
    "seed_script_file": seed_script_file,
    "catalog_query": catalog_query,
    "sql_query": sql_query,
    "catalog_list": catalog_list,
    "federated_join": federated_join,
}

SEEDED = """
SELECT o_custkey{alias}, sum(lines)::BIGINT AS lines, round(sum(quantity), 2) AS quantity
FROM orders JOIN (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
  ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'O' GROUP BY o_custkey"""

CHECKS = {
    "seed_script": SEEDED.format(alias=""),
    "execute_statement": """
SELECT status, count(*) AS facts, round(sum(total), 2) AS total
FROM (SELECT o_orderstatus AS status, o_totalprice AS total FROM orders
      UNION ALL SELECT l_linestatus, l_extendedprice FROM lineitem) GROUP BY 1""",
    "seed_callback": """
SELECT c_custkey, regexp_replace(c_name, '[^A-Z0-9]', '', 'g') || '/' || c_mktsegment AS name FROM customer""",
    "seed_script_file": SEEDED.format(alias=" AS customer"),
    "catalog_query": """
SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
    "sql_query": "SELECT s_nationkey, max(s_acctbal) AS best FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey",
    "catalog_list": """
SELECT 'places' AS catalog, count(*) AS held FROM nation UNION ALL SELECT 'areas', count(*) FROM region""",
    "federated_join": """
SELECT n_name, c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS spent
FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
GROUP BY n_name, c_mktsegment""",
}
