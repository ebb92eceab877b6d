"""JSON message streams that report errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseed.functions.scalars import trim_space, variant_kind

# The fields of a progress message and the kind each must have if present.
FIELDS = {
    "$.status": "STRING",
    "$.error": "STRING",
    "$.errorDetail": "OBJECT",
    "$.errorDetail.message": "STRING",
}


def _unreadable(body: str, parsed: str) -> Column:
    """Whether a message is not a JSON object with fields of the right kind, or null."""
    wrong = F.col(parsed).isNull() | ~F.col(body).rlike(r"^\s*(\{|null\s*$)")
    for path, kind in FIELDS.items():
        found = variant_kind(F.try_variant_get(parsed, path, "variant"))
        wrong = wrong | F.coalesce(~found.isin(kind, "VOID"), F.lit(False))
    return wrong


def _text(parsed: str, path: str) -> Column:
    return F.nullif(F.try_variant_get(parsed, path, "string"), F.lit(""))


def failures(messages: DataFrame, stream: str, seq: str, body: str) -> DataFrame:
    """The messages that fail: ``stream, seq, message``. Rows are judged one by one, so messages may be a stream.

    A message fails by a non-empty ``error``, else a non-empty ``errorDetail.message``,
    and also by not being a readable message at all. White space is no message,
    and of a repeated field the last one counts.
    """
    filled = messages.where(trim_space(F.col(body)) != "")
    # A generator keeps the parse in one place; inlined, it would run once per field.
    parsed = filled.select(stream, seq, body, F.explode(F.array(F.try_parse_json(body))).alias("_doc"))
    failure = F.when(
        _unreadable(body, "_doc"), F.concat(F.lit("malformed message: "), F.col(body))
    ).otherwise(F.coalesce(_text("_doc", "$.error"), _text("_doc", "$.errorDetail.message")))
    return parsed.select(stream, seq, F.explode(F.array_compact(F.array(failure))).alias("message"))


def first_error(messages: DataFrame, stream: str, seq: str, body: str) -> DataFrame:
    """First error of each stream: ``stream, seq, message``; a stream without one has no row.

    Partial minima keep a stream with very many messages from ever being gathered in one place.
    """
    failed = failures(messages, stream, seq, body)
    return failed.groupBy(stream).agg(F.min(seq).alias(seq), F.min_by("message", seq).alias("message"))
