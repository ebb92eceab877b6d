"""Sources and sinks: objects, manifests, logs, documents, keyed tables, databases."""

from __future__ import annotations

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lakeseed.operators.keyed import count_documents, key_range, keyed_table, lookup
from lakeseed.sources.documents import as_documents, collection_path, insert_documents, read_documents
from lakeseed.sources.files import read_logs, read_manifests
from lakeseed.sources.jdbc import RowStore, Split, read_store, write_store
from lakeseed.sources.lake import LakeEnvironment, create_lake_table, insert_lake_rows
from lakeseed.sources.objects import file_objects, put_objects, read_objects, stat_objects
from lakeseed.workspace import new_path, shared_root

OBJECT = "bucket string, key string, content string, content_type string, seq int"


def test_object_of_five_bytes(spark):
    root = new_path(spark, "objects")
    rows = spark.createDataFrame([("uploads", "hello.txt", "hello", "text/plain", 1)], OBJECT)
    for _ in range(2):
        manifest = put_objects(rows, root)
    assert [tuple(row) for row in manifest.collect()] == [("uploads", "hello.txt", "text/plain", 5)]
    assert [tuple(row) for row in stat_objects(spark, root).collect()] == [("uploads", "hello.txt", "text/plain", 5)]
    read = read_objects(spark, root).head()
    assert (bytes(read["content"]), read["content_type"]) == (b"hello", "text/plain")


def test_any_module_makes_task_functions_travel():
    code = "import lakeseed.sources.objects as o; from pyspark.cloudpickle import list_registry_pickle_by_value as r; print(r())"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert "lakeseed" in done.stdout


def test_every_put_is_in_the_manifest_and_the_last_one_counts(spark):
    root = new_path(spark, "objects")
    put_objects(spark.createDataFrame([("b", "one", "1", "a/b", 1), ("b", "two", "22", "", 1)], OBJECT), root)
    put_objects(spark.createDataFrame([("b", "two", "333", "c/d", 1), ("c", "one", "", "", 1)], OBJECT), root)
    found = {(row["bucket"], row["key"]): (row["content_type"], bytes(row["content"])) for row in read_objects(spark, root).collect()}
    default = "application/octet-stream"
    assert found == {("b", "one"): ("a/b", b"1"), ("b", "two"): ("c/d", b"333"), ("c", "one"): (default, b"")}
    assert "binaryFile" not in stat_objects(spark, root)._jdf.queryExecution().executedPlan().toString()


def test_equal_keys_need_an_order(spark):
    rows = spark.createDataFrame([("b", "k", str(i), "", i) for i in range(40)], OBJECT).repartition(4)
    with pytest.raises(ValueError, match="need seq"):
        put_objects(rows, new_path(spark, "objects"))
    root = new_path(spark, "objects")
    put_objects(rows, root, seq=["seq"])
    assert bytes(read_objects(spark, root).head()["content"]) == b"39"


def test_files_are_fed_to_a_put(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one")
    (tmp_path / "in" / "deep" / "b c.md").write_text("two")
    root = new_path(spark, "objects")
    put_objects(file_objects(spark, str(tmp_path / "in"), "docs", "p/", "text/plain"), root)
    put_objects(file_objects(spark, str(tmp_path / "in" / "a.txt"), "single"), root)
    found = {(row["bucket"], row["key"]): bytes(row["content"]) for row in read_objects(spark, root).collect()}
    assert found == {("docs", "p/a.txt"): b"one", ("docs", "p/deep/b c.md"): b"two", ("single", "a.txt"): b"one"}


def test_tasks_list_a_folder_as_spark_does(spark, tmp_path):
    """No list of files is made on the driver; the same files are found, under the same keys."""
    top = tmp_path / "with blank%41"
    names = ["a.txt", "b c.md", "deep/er/x%3Ay", "deep/_seen=1", "_metadata/kept", "é1", "empty", "_hidden", ".hidden", "_gone/x", ".gone/x", "deep/_metadata", "z._COPYING_"]
    for name in names:
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text("" if name == "empty" else name)
    (tmp_path / "none").mkdir()
    frame = file_objects(spark, str(top), "docs", "p/", "text/plain")
    plan = frame._jdf.queryExecution().toString()
    assert "binaryFile" not in plan
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(top))
    want = {(row["path"].split("with blank%41/")[1], bytes(row["content"])) for row in files.collect()}
    assert {(row["key"], bytes(row["content"])) for row in frame.collect()} == {(f"p/{key}", content) for key, content in want}
    assert {key for key, _ in want} == {"a.txt", "b c.md", "deep/er/x%3Ay", "deep/_seen=1", "_metadata/kept", "é1"}
    assert frame.columns == ["bucket", "key", "content", "content_type"]
    assert file_objects(spark, str(tmp_path / "none"), "docs").count() == 0
    patterned = file_objects(spark, f"{tmp_path}/*/*.txt", "docs").collect()
    assert [(row["key"], bytes(row["content"])) for row in patterned] == [("a.txt", b"a.txt")]


def test_last_object_wins_and_awkward_keys_come_back(spark):
    root = new_path(spark, "objects")
    keys = ["a b%41+c.txt", "_hidden/x", ".dot/_y", "ü/é1", "p=1/q", "plain"]
    rows = [("b", key, "old", "", 1) for key in keys] + [("b", key, f"new {key}", "", 2) for key in keys]
    put_objects(spark.createDataFrame(rows, OBJECT), root, seq=["seq"])
    got = {row["key"]: bytes(row["content"]).decode() for row in read_objects(spark, root).collect()}
    assert got == {key: f"new {key}" for key in keys}
    assert stat_objects(spark, root).count() == len(keys)


@pytest.mark.parametrize(
    ("bucket", "key", "message"),
    [("", "k", "bucket name is required"), ("b", "", "object key is required"), ("b", "a//b", "empty part"),
     ("b/c", "k", "bucket name is required")],
)
def test_bad_object_names_fail(spark, bucket, key, message):
    rows = spark.createDataFrame([(bucket, key, "x", "", 1)], OBJECT)
    with pytest.raises(Exception, match=message):
        put_objects(rows, new_path(spark, "objects"))


def test_bucket_must_exist_unless_created(spark):
    root = new_path(spark, "objects")
    rows = spark.createDataFrame([("notes", "hello.txt", "x", "", 1)], OBJECT)
    with pytest.raises(Exception, match="bucket notes does not exist"):
        put_objects(rows, root, create_buckets=False)
    put_objects(rows, root)
    put_objects(rows, root, create_buckets=False, batch_id="1")
    assert stat_objects(spark, root).count() == 1


def test_manifests_by_suffix(spark, tmp_path):
    for name in ("a.yaml", "deep/b.yml", "deep/c.txt", "deep/er/d d%.yaml"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"name: {name}\nx: 1\n")
    found = read_manifests(spark, str(tmp_path)).collect()
    assert sorted(row["path"].rsplit("/", 1)[1] for row in found) == ["a.yaml", "b.yml", "d d%.yaml"]
    assert all(row["text"].count("\n") == 2 for row in found)
    single = read_manifests(spark, str(tmp_path / "deep" / "c.txt")).collect()
    assert [row["text"] for row in single] == ["name: deep/c.txt\nx: 1\n"]
    with pytest.raises(ValueError):
        read_manifests(spark, "https://example.com/a.yaml")


def test_logs_of_services_batch_and_stream(spark, tmp_path):
    for service, text in {"db": "one\ntwo\n", "web": "three\r\n"}.items():
        folder = tmp_path / service
        folder.mkdir()
        (folder / "out.log").write_text(text, newline="")
    paths = {"db": str(tmp_path / "db"), "web": str(tmp_path / "web")}
    want = [("db", "one"), ("db", "two"), ("web", "three\r")]
    assert sorted(map(tuple, read_logs(spark, paths).collect())) == want
    out = new_path(spark, "logs")
    run = read_logs(spark, paths, streaming=True).writeStream.format("parquet").option("path", f"{out}/rows")
    run.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{out}/rows").select("service", "line").collect())) == want


def test_documents(spark):
    assert collection_path("/r", "users") == "/r/test/users"
    path = collection_path(new_path(spark, "documents"), "users", "app")
    rows = spark.createDataFrame([('{"name":"Ada","n":{"x":1}}',), ('{"name":"Bob","n":{"x":"1"}}',)], "j string")
    insert_documents(as_documents(rows, F.col("j")), path, "0")
    documents = read_documents(spark, path)
    assert count_documents(documents, "doc", {"name": "Ada"}).head()["documents"] == 1
    assert count_documents(documents, "doc", {"name": "Ada", "n.x": 1}).head()["documents"] == 1
    assert count_documents(documents, "doc", {"name": "Eve"}).head()["documents"] == 0
    assert count_documents(documents, "doc", {}).head()["documents"] == 2
    assert count_documents(documents, "doc", {"n.x": 1}).head()["documents"] == 1
    assert count_documents(documents, "doc", {"n.x": 1.0}).head()["documents"] == 1
    assert count_documents(documents, "doc", {"n.x": "1"}).head()["documents"] == 1
    assert count_documents(documents, "doc", {"absent": None}).head()["documents"] == 2
    mixed = as_documents(spark.createDataFrame(
        [('{"x":1.5}',), ('{"x":2}',), ('{"x":2.0}',), ('{"x":true}',), ('{"x":null}',), ('{"x":9007199254740993}',)], "j string"
    ), F.col("j"))
    counts = {str(value): count_documents(mixed, "doc", {"x": value}).head()["documents"]
              for value in (1.5, 2, 2.0, True, None, 1, 9007199254740993, 9007199254740992)}
    assert counts == {"1.5": 1, "2": 2, "2.0": 2, "True": 1, "None": 1, "1": 0,
                      "9007199254740993": 1, "9007199254740992": 0}
    large = as_documents(spark.createDataFrame([('{"a.b":{"c\'d":1},"n":123456789012345678901234567890}',)], "j string"), F.col("j"))
    for equal, n in (
        ({("a.b", "c'd"): 1}, 1), ({"a.b": 1}, 0), ({"n": 123456789012345678901234567890}, 1),
        ({"n": 123456789012345678901234567891}, 0), ({"n": 10**40}, 0),
    ):
        assert count_documents(large, "doc", equal).head()["documents"] == n
    bad = spark.createDataFrame([("{",)], "j string")
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING|parse_json"):
        as_documents(bad, F.col("j")).collect()


def test_lookup_gives_null_for_a_missing_key(spark):
    stored = spark.createDataFrame([("feature:test", "enabled"), ("hello", "world")], "key string, value string")
    probes = spark.createDataFrame([(1, "hello"), (2, "nope"), (3, None)], "n int, key string")
    found = {row["n"]: row["value"] for row in lookup(probes, stored, "key").collect()}
    assert found == {1: "world", 2: None, 3: None}


def test_keyed_table(spark):
    path = new_path(spark, "items")
    rows = spark.range(0, 3000, 1, 4).select((F.col("id") % 3).alias("id"), F.format_string("%05d", "id").alias("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keyed_table(rows, "id", "at").write.parquet(path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    table = spark.read.parquet(path)
    assert dict(table.dtypes) == {"id": "string", "at": "string"}
    found = key_range(table, "id", "1", "at", "00100", "00110")
    assert sorted(row["at"] for row in found.collect()) == ["00100", "00103", "00106", "00109"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(at" in plan
    assert key_range(table, "id", "2").count() == 1000
    # Statistics of the sorted files let the scan skip what lies outside the range.
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.head().metrics().apply("numOutputRows").value() < 2000
    assert keyed_table(rows).count() == 3000


def test_hot_partition_key_without_sort_key_is_split(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(0, 4000, 1, 8).select(F.lit("hot").alias("id"), F.col("id").alias("n"))
        sizes = keyed_table(rows).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(row["count"] for row in sizes) <= 2000


def test_lake_partition_is_pruned(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"))
    environment = LakeEnvironment(catalog="lake_test")
    assert LakeEnvironment().bucket == "warehouse" and LakeEnvironment().catalog == "iceberg"
    name = "t" + new_path(spark, "x").rsplit("-", 1)[-1]
    table = create_lake_table(spark, environment, name, rows, "kind")
    insert_lake_rows(rows, table, "kind")
    found = spark.table(table).where("kind = 'a'")
    assert found.count() == 34
    assert "PartitionFilters: [isnotnull(kind" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        create_lake_table(spark, environment, name, rows, "kind")


def test_row_store_settings():
    store = RowStore("postgresql", "127.0.0.1", 5432, "app", "u", "p")
    assert store.connection_string() == "postgresql://u:p@127.0.0.1:5432/app?sslmode=disable"
    assert store.url() == "jdbc:postgresql://127.0.0.1:5432/app?sslmode=disable"
    other = RowStore("mysql", "127.0.0.1", 3306, "app", "u", "p")
    assert other.connection_string() == "u:p@tcp(127.0.0.1:3306)/app"
    assert "password" not in repr(other) and "'p'" not in repr(other)
    assert Split("id", 0, 100, 400).options()["numPartitions"] == "400"
    assert Split("id", 0, 100).options()["numPartitions"] == "25"
    with pytest.raises(ValueError):
        Split("id", 5, 5).options()
    with pytest.raises(ValueError):
        RowStore("oracle", "h", 1, "d")


def test_row_store_needs_its_driver(spark):
    """Nothing is started or reached: the settings go as far as the lookup of the driver."""
    store = RowStore("postgresql", "127.0.0.1", 5432, "app", "u", "p")
    with pytest.raises(Exception, match="No suitable driver"):
        read_store(spark, store, "users", Split("id", 0, 100))
    with pytest.raises(Exception, match="No suitable driver"):
        write_store(spark.range(1), store, "users")


class _Session:
    """As much of a session as the choice of the shared folder reads."""

    def __init__(self, master, setting=None, checkpoint=None):
        self.settings = {"spark.checkpoint.dir": setting} if setting else {}
        self.conf = self.sparkContext = self
        self.master, self.checkpoint = master, checkpoint

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, path):
        self.checkpoint = path


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(_Session("yarn"))
    assert shared_root(_Session("yarn", "hdfs://nn/shared/")) == "hdfs://nn/shared"
    assert shared_root(_Session("yarn", checkpoint="hdfs://nn/other")) == "hdfs://nn/other"
    local = _Session("local[2]")
    assert shared_root(local) == shared_root(local)


def test_shared_folder_is_the_session_setting(spark):
    setting = spark.conf.get("spark.checkpoint.dir", None)
    assert setting and shared_root(spark) == setting.rstrip("/")
    assert new_path(spark, "x") != new_path(spark, "x")
