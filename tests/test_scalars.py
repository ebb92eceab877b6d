"""Scalar functions: the cited inputs and the edge cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakeseed.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


def rows(spark, values, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row["out"] for row in frame.orderBy("i").select(make(F.col("v")).alias("out")).collect()]


@pytest.mark.parametrize(
    ("parts", "expected"),
    [
        (("SQS", "jobs", "URL"), "SQS_JOBS_URL"),
        (("SNS", "events", "ARN"), "SNS_EVENTS_ARN"),
        (("", "a"), "A"),
        (("", "", "a", "b"), "A_B"),
        (("a", ""), "A_"),
        (("a", "", "b"), "A__B"),
        (("",), ""),
        (("my-queue.x",), "MY_QUEUE_X"),
        (("é😀a",), "__A"),
        (("a\nb",), "A_B"),
    ],
)
def test_env_key(spark, parts, expected):
    assert value(spark, S.env_key(*[F.lit(part) for part in parts])) == expected


@pytest.mark.parametrize(
    ("url", "endpoint", "expected"),
    [
        ("http://127.0.0.1:4566/000000000000/jobs", "http://gateway:4566", "http://gateway:4566/000000000000/jobs"),
        ("http://a/x?q=1&r=#f", "https://b:1", "https://b:1/x?q=1&r=#f"),
        ("http://u:p@a/x", "http://x:y@b/ignored?z", "http://u:p@b/x"),
        ("a/b", "http://b", "a/b"),
        ("/only/path", "http://b", "/only/path"),
        ("http:///x", "http://b", "http:///x"),
        ("http://a/x", "b:80", "http://a/x"),
        ("http://a/x", "", "http://a/x"),
        ("http://a/%zz", "http://b", "http://a/%zz"),
        ("http://a/x?%zz", "http://b", "http://b/x?%zz"),
        ("http://a b/x", "http://b", "http://a b/x"),
        ("http://a:port/x", "http://b", "http://a:port/x"),
        ("http://a/x\ny", "http://b", "http://a/x\ny"),
        ("http://a", "http://b", "http://b"),
        ("http://a?x", "http://b", "http://b?x"),
        ("http://a/b c/é", "http://b", "http://b/b%20c/%C3%A9"),
        ("http://a/b%2Fc!", "http://b", "http://b/b%2Fc!"),
        ("http://a/x#", "http://b", "http://b/x"),
        ("http://a/x#a b", "http://b", "http://b/x#a%20b"),
        ("http://[::1]:80/x", "http://b", "http://b/x"),
        ("arn:aws:sns:us-east-1:000000000000:events", "http://b", "arn:aws:sns:us-east-1:000000000000:events"),
        ("", "http://b", ""),
        ("http://u!x:p:q@a/x", "http://b", "http://u%21x:p%3Aq@b/x"),
        ("http://a@b@c/x", "http://b", "http://a%40b@b/x"),
        ("http://u%2f:@a", "http://b", "http://u%2F:@b"),
        ("http://u<v@a/x", "http://b", "http://u<v@a/x"),
        ("http://a/x#<?!'>", "http://b", "http://b/x#%3C?!%27%3E"),
        ("http://a/(x) [y]", "http://b", "http://b/%28x%29%20%5By%5D"),
        ("http://a/x??y", "http://$1:2", "http://$1:2/x??y"),
    ],
)
def test_rewrite_endpoint(spark, url, endpoint, expected):
    assert value(spark, S.rewrite_endpoint(F.lit(url), endpoint)) == expected


def test_strip_registry(spark):
    images = {
        "docker.io/library/nginx:alpine": "library/nginx:alpine",
        "localhost/x": "x",
        "host:5000/a/b": "a/b",
        "library/nginx": "library/nginx",
        "nginx": "nginx",
        "a.b": "a.b",
        "   ghcr.io/a \n": "a",
        "x.y/": "",
        "/a": "/a",
        "a.b/c\nd/e": "c\nd/e",
    }
    assert rows(spark, list(images), S.strip_registry) == list(images.values())


def test_registry_image(spark):
    image = F.lit("docker.io/library/nginx:alpine")
    assert value(spark, S.registry_image(image, "127.0.0.1:5005")) == "127.0.0.1:5005/library/nginx:alpine"
    assert value(spark, S.registry_image(image, "")) == "docker.io/library/nginx:alpine"
    assert value(spark, S.registry_image(F.lit(""), "127.0.0.1:5005")) == ""


def test_overlay_right_side_wins(spark):
    base = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    top = F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4"))
    assert value(spark, S.overlay(base, top)) == {"a": "1", "b": "3", "c": "4"}


def test_unique_tokens(spark):
    tokens = F.array(*[F.lit(t) for t in [" s3", "sqs", "s3\t", "", " ", "sns", "sqs "]])
    assert value(spark, S.unique_tokens(tokens)) == "s3,sqs,sns"
    assert value(spark, S.unique_tokens(F.array().cast("array<string>"))) == ""


def test_property_lines_sort_whole_lines(spark):
    properties = F.create_map(F.lit("a"), F.lit("2"), F.lit("a.b"), F.lit("1"))
    assert value(spark, S.property_lines(properties)) == "a.b=1\na=2\n"
    assert value(spark, S.property_lines(F.create_map().cast("map<string,string>"))) == "\n"


def test_first_filled_does_not_trim(spark):
    assert value(spark, S.first_filled(F.lit(""), F.lit(" "), F.lit("x"))) == " "
    assert value(spark, S.first_filled(F.lit(""), F.lit(None).cast("string"))) == ""


def test_bytes_beyond_text_are_kept(spark):
    rewritten = S.rewrite_endpoint(F.lit("http://h/%ff%C3%a9 b%41"), "http://e")
    assert value(spark, rewritten) == "http://e/%FF%C3%A9%20bA"


def test_required_fields_appear_as_null(spark):
    made = S.json_without_blanks({"id": F.lit(1), "vector": F.lit(None).cast("array<double>")}, texts={"a": F.lit("")})
    assert value(spark, made) == '{"id":1,"vector":null}'
    assert value(spark, S.json_without_blanks({}, texts={"a": F.lit("}{")})) == '{"a":"}{"}'


def test_json_without_blanks(spark):
    empty = F.create_map().cast("map<string,string>")
    point = {"id": F.lit(1), "vector": F.array(F.lit(0.5))}
    assert value(spark, S.json_without_blanks(point, nested={"payload": empty})) == '{"id":1,"vector":[0.5]}'
    filled = S.json_without_blanks({"class": F.lit("A")}, texts={"id": F.lit("x")})
    assert value(spark, filled) == '{"class":"A","id":"x"}'
    assert value(spark, S.json_without_blanks({"class": F.lit("A")}, texts={"id": F.lit("")})) == '{"class":"A"}'


@pytest.mark.parametrize(
    ("user", "password", "database", "expected"),
    [
        ("", "", "", "mongodb://h:1"),
        ("", "", "a b/c", "mongodb://h:1/a%20b%2Fc"),
        ("u@x", "p w*~", "", "mongodb://u%40x:p+w%2A~@h:1/admin?authSource=admin"),
        ("u", "", "d$&+:=@;", "mongodb://u:@h:1/d$&+:=@%3B?authSource=admin"),
    ],
)
def test_document_store_dsn(spark, user, password, database, expected):
    dsn = S.document_store_dsn(F.lit("h:1"), F.lit(user), F.lit(password), F.lit(database))
    assert value(spark, dsn) == expected
