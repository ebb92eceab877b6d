"""Typed objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeseed.operators.classes import DEFAULT_LIMIT, ObjectClass, Property, limited, typed_objects, validate


def test_typed_fields_override_raw():
    made = ObjectClass("Document", "none", [Property("body", ["text"])], {"class": "X", "vectorizer": "y", "extra": 1})
    assert made.body() == {
        "class": "Document", "vectorizer": "none", "extra": 1,
        "properties": [{"name": "body", "dataType": ["text"]}],
    }
    assert ObjectClass("D", raw={"properties": "kept", "class": "X"}).body() == {"class": "D", "properties": "kept"}
    assert ObjectClass("D").body() == {"class": "D"}


def test_validation_by_property(spark):
    of = ObjectClass("D", properties=[Property("body", ["text"]), Property("n", ["int", "boolean"]), Property("tags", ["text[]"]), Property("price", ["number"])])
    rows = [
        (1, '{"body":"hello","n":1,"tags":["a"],"price":1.5}'),
        (2, '{"body":5,"n":true,"tags":"a","price":2,"more":1,"other":2}'),
        (3, '{"body":null,"n":"1","tags":[1],"price":"x"}'),
        (4, "{}"),
    ]
    objects = spark.createDataFrame(rows, "id int, j string").select("id", F.parse_json("j").alias("properties"))
    got = {
        row["id"]: (row["body_state"], row["n_state"], row["tags_state"], row["price_state"], row["unknown_fields"])
        for row in validate(typed_objects(objects, of), of).collect()
    }
    assert got == {
        "1": ("valid", "valid", "valid", "valid", 0),
        "2": ("wrong_type", "valid", "wrong_type", "valid", 2),
        "3": ("missing", "wrong_type", "wrong_type", "wrong_type", 0),
        "4": ("missing", "missing", "missing", "missing", 0),
    }
    dotted = ObjectClass("D", properties=[Property("a.b", ["int"])])
    one = spark.createDataFrame([('{"a.b":1}',)], "j string").select(F.parse_json("j").alias("properties"))
    assert validate(one, dotted).head()["a.b_state"] == "valid"


def test_lists_dates_identifiers_and_references(spark):
    names = ["text[]", "number[]", "date", "date[]", "uuid", "object[]", "Author"]
    of = ObjectClass("D", properties=[Property(f"p{i}", [name]) for i, name in enumerate(names)])
    uuid = "f81d4fae-7dec-11d0-a765-00a0c91e6bf6"
    day = "2024-02-29T10:00:00.123Z"
    good = f'{{"p0":[],"p1":[1,2.5],"p2":"{day}","p3":["{day}"],"p4":"{uuid}","p5":[{{}}],"p6":[{{"beacon":"x"}}]}}'
    bad = '{"p0":["a",1],"p1":["x"],"p2":"nonsense","p3":["2024-02-30T10:00:00Z"],"p4":"1","p5":[1],"p6":"x"}'
    rows = spark.createDataFrame([(good,), (bad,)], "j string").select(F.parse_json("j").alias("properties"))
    found = validate(rows, of).collect()
    assert [found[0][f"p{i}_state"] for i in range(7)] == ["valid"] * 7
    assert [found[1][f"p{i}_state"] for i in range(7)] == ["wrong_type"] * 7


def test_typed_object_keeps_its_vector(spark):
    rows = spark.createDataFrame([(1, '{"body":"hello"}', [0.1, 0.2, 0.3])], "id int, j string, vector array<double>")
    made = typed_objects(rows.select("id", F.parse_json("j").alias("properties"), "vector"), ObjectClass("Document")).head()
    assert (made["class"], made["id"], made["vector"]) == ("Document", "1", [0.1, 0.2, 0.3])


def test_default_limit(spark):
    rows = spark.range(100)
    assert [row["id"] for row in limited(rows, F.desc("id")).collect()] == list(range(99, 99 - DEFAULT_LIMIT, -1))
    assert limited(rows, "id", limit=3).count() == 3
