"""The shared folder: what a stored frame leaves on disk."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from lakeseed import workspace as w


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        found.add(files.next().getName())
    return {name for name in found if name.startswith("shuffle_")}


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(w.CLEANUP_SETTING, None)
    rows = spark.range(0, 20_000, 1, 4).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    made = w.stored(rows.join(rows.withColumnRenamed("s", "t").hint("merge"), "k"), "joined")
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(w.CLEANUP_SETTING, None) == setting
    # The frame that was written and the one that is read both still give their rows.
    assert sorted(r.s for r in made.collect()) == sorted(r.s for r in rows.collect())


def test_what_is_discarded_is_deleted_and_the_rest_stays(spark):
    one, two = (w.stored(spark.range(n), "numbers") for n in (3, 4))
    places = [w.PLACES[one], w.PLACES[two]]
    w.discard(one)
    assert [w.is_folder(spark, place) for place in places] == [False, True]
    assert [place in w.MADE for place in places] == [False, True]
    assert two.count() == 4
