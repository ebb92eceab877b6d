"""Secret scans: fixed patterns, and random strings that a token vocabulary compresses badly.

Besides the fixed kinds, a run of key characters that mixes letters and digits, or small letters and capitals, is
a secret when it has fewer than ``MAX_RATIO`` characters a token under a public byte-pair vocabulary, as a whole or in a window of
whole tokens of ``MIN_RANDOM`` characters or more: words and code compress to three or four characters a
token, random strings to less than two. Windows find secrets joined to words by separators, as in paths and
query strings; those that overlap are one span, from which words at the ends are left out and which ends at
separators. Known digests (hexadecimal of a usual length, UUIDs) and identifiers (words in one case, capitalised or
joined by capitals, with short numbers; parts of dates; formulas; all joined by separators) are left out, and of runs that touch a span found already the touched part.

Null texts have no spans; texts are scanned whole; repeated rows give repeated results; other columns
are ignored.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MIN_RANDOM = 16
MAX_RATIO = 2.2
#: A longer run is counted in pieces of so many characters, as one merge of it would take too long.
PIECE = 256

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(rf"[A-Za-z0-9+/=_-]{{{MIN_RANDOM},}}")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Digests and UUIDs within a run.
KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern}|{DIGEST.pattern})(?![A-Za-z0-9])")
SEPARATOR = re.compile("[+/=_-]")
#: A part of an identifier: a word and a number, a number and a unit, a formula, or a date and time.
PART = re.compile(
    r"(?:[a-z]+|[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*)?[0-9]{0,6}|[0-9]{1,6}[A-Za-z]{1,2}[0-9]{0,6}|(?:[A-Z][a-z]?[0-9]{0,2}){1,4}|[0-9]{8}T[0-9]{6}Z?"
)
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])|.*[a-z].*[A-Z]|.*[A-Z]{2}.*[a-z]")
#: How the vocabulary cuts texts into words before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Ranks of a public vocabulary file of a fixed size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}


def encoder(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """Digests and identifiers."""
    return (
        (len(run) in DIGEST_SIZES and DIGEST.fullmatch(run) is not None)
        or UUID.fullmatch(run) is not None
        or all(PART.fullmatch(part) for part in SEPARATOR.split(run))
    )


def ratio(run: str, coder: tiktoken.Encoding) -> float:
    tokens = sum(len(coder.encode_ordinary(run[at : at + PIECE])) for at in range(0, len(run), PIECE))
    return len(run) / tokens


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def free_parts(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the taken places, in order, leave of a run, where it is long enough."""
    for s, e in [*taken, (end, end)]:
        if min(s, end) - start >= MIN_RANDOM:
            yield start, min(s, end)
        start = max(start, e)


def dense(run: str, coder: tiktoken.Encoding) -> list[tuple[int, int]]:
    """Where windows of whole tokens have a low ratio, joined, without words at the ends, up to separators."""
    ends = [0]
    for at in range(0, len(run), PIECE):
        for token in coder.encode_ordinary(run[at : at + PIECE]):
            ends.append(ends[-1] + len(coder.decode_single_token_bytes(token)))
    found, last = [], 1
    for first in range(len(ends) - 1):
        while last < len(ends) and ends[last] - ends[first] < MIN_RANDOM:
            last += 1
        if last == len(ends):
            break
        if ends[last] - ends[first] < MAX_RATIO * (last - first):
            if found and first <= found[-1][1]:
                found[-1][1] = last
            else:
                found.append([first, last])
    spans = []
    for first, last in found:
        # A whole word, or no letter or digit, at an end is none of the secret.
        while first < last and _aside(run, ends[first], ends[first + 1], ""):
            first += 1
        while first < last and _aside(run, ends[last - 1], ends[last], "="):
            last -= 1
        start, end = ends[first], ends[last]
        while start and run[start - 1].isalnum() and run[start].isalnum():
            start -= 1
        while end < len(run) and run[end - 1].isalnum() and run[end].isalnum():
            end += 1
        if spans and start <= spans[-1][1]:
            start = spans.pop()[0]
        spans.append((start, end))
    return spans


def _aside(run: str, start: int, end: int, part: str) -> bool:
    token = run[start:end]
    if not any(c.isalnum() for c in token):
        return not part or part not in token
    alone = (start == 0 or not run[start - 1].isalnum()) and (end == len(run) or not run[end].isalnum())
    return alone and end - start > MAX_RATIO


def random_spans(text: str, taken: list[tuple[int, int, int]], coder: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    spans, begins, reach = [], [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))
    for m in RUN.finditer(text):
        if not MIXED.match(m[0]) or is_known(m[0]):
            continue
        touched = [(s, e) for s, _, e in taken[bisect_right(reach, m.start()) : bisect_left(begins, m.end())]]
        touched += [k.span() for k in KNOWN.finditer(text, m.start(), m.end()) if is_known(k[0]) and _digest(k[0])]
        for start, end in free_parts(m.start(), m.end(), sorted(touched)):
            run = text[start:end]
            if not MIXED.match(run) or is_known(run):
                continue
            parts = [(0, len(run))] if ratio(run, coder) < MAX_RATIO else dense(run, coder)
            for s, e in parts:
                part = run[s:e]
                if len(part) >= MIN_RANDOM and MIXED.match(part) and not is_known(part):
                    spans.append((start + s, 3, start + e))
    return spans


def _digest(part: str) -> bool:
    return len(part) in DIGEST_SIZES or "-" in part


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan(text: Column, ranks: dict[bytes, int], spark: SparkSession) -> Column:
    """A struct for each text: the number of spans of each base kind, base spans and all spans."""
    sent = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base string, spans string")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = encoder(sent.value)
        for texts in batches:
            rows = []
            for whole in texts:
                base = base_spans(whole or "")
                kinds = [kind for _, kind, _ in base]
                spans = base + random_spans(whole or "", base, coder)
                rows.append((*(kinds.count(k) for k in range(3)), _written(base), _written(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base", "spans"])

    return scanned(text)


def found(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Spans of every document."""
    rows = documents.select("doc_id", scan(F.col("text"), read_vocabulary(vocabulary), documents.sparkSession).alias("found"))
    return rows.select(
        "doc_id",
        "found.n_assign",
        "found.n_access",
        "found.n_hex",
        F.sha2(F.col("found.base").cast("binary"), 256).alias("base_sha256"),
        "found.spans",
    )


def clean(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents without any span, with all their columns."""
    return documents.where(scan(documents["text"], read_vocabulary(vocabulary), documents.sparkSession)["spans"] == "")
