"""Aggregates and table functions in Python, search in cells, reachability and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseed.operators.aggregates import LongestStreak, aggregated
from lakeseed.operators.cells import build_index, nearest_in_cells
from lakeseed.operators.funnels import funnels
from lakeseed.operators.reach import reached
from lakeseed.operators.vectors import nearest
from lakeseed.plans.catalog import query
from lakeseed.plans.queries.surface import over_files
from lakeseed.plans.queries.vectors import DOCS, points
from lakeseed.sources.tables import read_table

NEIGHBOURS, QUERY_STEP = 10, 50
#: Of the cells, the share that a query searches: the given vectors lie in no clusters, so it takes more than half.
PROBED = 0.6
STEPS = ["view", "click", "purchase"]


def active_streak(spark: SparkSession, folder: str) -> DataFrame:
    """The most days in a row on which each user has an event."""
    events = read_table(spark, folder, "events").select("user_id", F.datediff("ts", F.lit("1970-01-01")).alias("day"))
    return aggregated(events, ["user_id"], ["day"], LongestStreak(), "streak")


def funnel_steps(spark: SparkSession, folder: str) -> DataFrame:
    """How many steps from view to click to purchase each user takes, and how often all three."""
    events = read_table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    return funnels(events, "user_id", ["ts", "event_id"], "event_type", STEPS)


def vector_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every 50th vector searched in an index of all of them: nine in ten of the true neighbours are found, or more."""
    rows = points(read_table(spark, folder, "embeddings"))
    index = build_index(rows, DOCS)
    asked = rows.where(F.col("id") % QUERY_STEP == 0).withColumnRenamed("id", "query_id")
    found = nearest_in_cells(index, asked, NEIGHBOURS, max(1, round(PROBED * len(index.centres))))
    true = nearest(rows, asked, DOCS, NEIGHBOURS).select("query_id", "id", F.lit(1).alias("true"))
    hits = found.join(true, ["query_id", "id"], "left").agg(
        F.count_distinct("query_id").alias("queries"), F.count("*").alias("found"), F.count("true").alias("hits")
    )
    indexed = index.points.agg(F.lit(0), F.lit(0), F.lit(0), F.count("*").alias("indexed"))
    counts = hits.withColumn("indexed", F.lit(0).cast("long")).union(indexed)
    sums = counts.agg(*(F.sum(name).alias(name) for name in counts.columns))
    return sums.select("queries", "found", "indexed", (F.col("hits") >= 0.9 * F.col("found")).alias("is_near"))


MENUS = r"(?i)<a\s[^>]*?href\s*=\s*\"([^\"]*)\""


def link_reach(spark: SparkSession, folder: str) -> DataFrame:
    """The links that follow from the first link of the first page of each language, going from link to next link of any page."""
    pages = read_table(spark, folder, "pages").select(
        "page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.regexp_extract_all("html", F.lit(MENUS), F.lit(1)).alias("links")
    )
    listed = pages.where(F.size("links") > 0)
    steps = F.explode(F.arrays_zip(F.slice("links", 1, F.size("links") - 1).alias("a"), F.slice("links", 2, F.size("links") - 1).alias("b")))
    # Languages keep to themselves: a node is a language and a link.
    edges = listed.where(F.size("links") > 1).select("lang", steps.alias("step"))
    edges = edges.select(F.struct("lang", F.col("step.a").alias("link")).alias("a"), F.struct("lang", F.col("step.b").alias("link")).alias("b"))
    seeds = listed.groupBy("lang").agg(F.min_by(F.col("links")[0], F.col("page_id")).alias("link"))
    flat = edges.select(F.to_json("a").alias("a"), F.to_json("b").alias("b"))
    found = reached(flat, seeds.select(F.to_json(F.struct("lang", "link")).alias("node")))
    told = F.from_json("node", "lang string, link string")
    return found.select(told.alias("at"), "steps").select("at.lang", "at.link", "steps")


#: The pages below every folder of a host, by going up from each page a folder at a time.
FOLDERS = """
WITH RECURSIVE up(host, folder, pages) AS (
    SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') AS folder, 1 AS pages
    FROM pages WHERE url LIKE '%://%/%'
    UNION ALL
    SELECT host, regexp_replace(folder, '/[^/]*$', '') AS folder, pages FROM up WHERE folder LIKE '%://%/%')
SELECT host, folder, sum(pages) AS pages FROM up GROUP BY host, folder"""


def p_recursive(spark: SparkSession, folder: str) -> DataFrame:
    # Recursion goes as deep as paths have folders, over any number of rows.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return query(spark, over_files(FOLDERS, folder))


QUERIES = {
    "active_streak": active_streak,
    "funnel_steps": funnel_steps,
    "vector_cells": vector_cells,
    "link_reach": link_reach,
    "p_recursive": p_recursive,
}

CHECKS = {
    "active_streak": """
WITH days AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
     runs AS (SELECT user_id, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INTEGER AS run FROM days)
SELECT user_id, max(days) AS streak FROM (SELECT user_id, run, count(*) AS days FROM runs GROUP BY user_id, run) GROUP BY user_id""",
    "funnel_steps": """
SELECT user_id, taken, taken // 3 AS completed FROM (
    SELECT user_id, list_reduce(list_prepend(0::BIGINT, list(list_position(['view', 'click', 'purchase'], event_type)::BIGINT - 1
        ORDER BY ts, event_id)), lambda a, x: CASE WHEN x = a % 3 THEN a + 1 ELSE a END) AS taken
    FROM events GROUP BY user_id)""",
    "vector_cells": """
SELECT count(*) FILTER (vec_id % 50 = 0) AS queries, (count(*) FILTER (vec_id % 50 = 0)) * least(10, count(*)) AS found,
       count(*) AS indexed, true AS is_near FROM embeddings""",
    "link_reach": """
WITH RECURSIVE listed AS (
        SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
               regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1) AS links FROM pages),
    edges AS (SELECT DISTINCT lang, links[i] AS a, links[i + 1] AS b FROM (SELECT *, unnest(range(1, len(links))) AS i FROM listed)),
    reach(lang, link, steps) AS (
        SELECT lang, arg_min(links[1], page_id), 0::BIGINT FROM listed WHERE len(links) > 0 GROUP BY lang
        UNION
        SELECT r.lang, e.b, r.steps + 1 FROM reach r JOIN edges e ON e.lang = r.lang AND e.a = r.link WHERE r.steps < 40)
SELECT lang, link, min(steps) AS steps FROM reach GROUP BY lang, link""",
    "p_recursive": FOLDERS.replace("sum(pages)", "sum(pages)::BIGINT"),
}
