"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Five statistics of every text are transformed to a vector: logarithms of the words and of the mean word
length, square roots of the shares of symbols, repeated lines and repeated words. For each language and
source the minimum covariance determinant gives a location and scatter that outliers cannot pull; texts
whose squared Mahalanobis distance passes a chi-squared cutoff are rejected.

The estimate runs over all rows without gathering a group. A group is cut into blocks of about
``BLOCK_ROWS`` vectors; each block takes concentration steps from deterministic starts until its core stays
the same, which finishes groups of one block. In larger groups the blocks are dealt to ``STARTS`` lots, and the
block of the smallest determinant in each lot is a start; concentration steps over all blocks follow until the
determinant falls no more, and the start that ends lowest is kept. In a step each task adds up its vectors by
distance class, so a group of any size is a few hundred sums; the nearest classes that hold ``CORE`` of the
rows, the last of them in part, give the next location and scatter. Scatters get the smallest spread ``FLOOR``
on the diagonal, as most texts repeat nothing at all.

Groups of every size are judged by one rule: a source's location and scatter are drawn towards its language's
as if ``PRIOR_ROWS`` further rows had those, and the scatter of a language likewise towards the wide spread
``WIDE``; its location is its own. So a small source is judged mostly by its language, a large one by itself, and
the only text of a language is kept. A null language or source is a group of its own. Null texts, and texts without words, fail
the fixed limits. Repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseed.workspace import stored

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

CORE = 0.75
BLOCK_ROWS = 4096
#: Blocks that a large group's steps start from.
STARTS = 3
#: A step that lowers the log determinant by less than this is the last one.
SETTLED = 1e-3
#: Rows that a language's estimate counts for in each of its sources, and ``WIDE`` in each language.
PRIOR_ROWS = 20
#: Smallest spread that a transformed statistic is given.
FLOOR = np.array([0.25, 0.08, 0.04, 0.1, 0.1])
#: The spread that a language of few texts is drawn to.
WIDE = np.array([1.0, 0.3, 0.15, 0.3, 0.3])
#: The squared distance that one in 10,000,000 normal vectors passes (chi-squared, five degrees of freedom).
CUTOFF = 40.86
#: Distance classes a doubling of the squared distance, from 2^-10 to 2^30.
CLASSES, LOWEST, HIGHEST = 8, -10, 30

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
SIZE = len(FLOOR)
#: Sums that a task holds at a time.
HELD = 20_000


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def repeated_words(words: list[bytes]) -> int:
    """Words inside a run of five that occurs twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    size = len(known)
    if size**WINDOW < 1 << 62:
        keys = ids[:n].copy()
        for k in range(1, WINDOW):
            keys = keys * size + ids[k : n + k]
    else:
        pairs = _ranks(ids[:-1] * size + ids[1:])
        fours = _ranks(pairs[:-2] * (int(pairs.max()) + 1) + pairs[2:])
        keys = fours[:n] * size + ids[WINDOW - 1 :]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[WINDOW : n + WINDOW] -= again
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def statistics(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode()
    words = raw.split()
    seen: set[bytes] = set()
    lines = doubled = 0
    for line in raw.split(b"\n"):
        if line.strip(BLANKS):
            lines += 1
            doubled += line in seen
            seen.add(line)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    chars = len(text or "") - (len(raw) - len(raw.translate(None, BLANKS)))
    return len(words), chars, symbols, lines, doubled, repeated_words(words)


def measured(text: Column) -> Column:
    @F.pandas_udf(STATS)
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=[f.split()[0] for f in STATS.split(", ")])

    return measure(text)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> Column:
    """The transformed statistics of a text with words."""
    return F.array(
        F.log("n_words"),
        F.log(F.col("word_chars") / F.col("n_words")),
        F.sqrt(F.col("n_symbols") / F.col("word_chars")),
        F.sqrt(F.col("n_dup_lines") / F.col("n_lines")),
        F.sqrt(F.col("n_repeat_words") / F.col("n_words")),
    )


def scatter(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (x - centre).T @ (x - centre) / len(x) + np.diag(FLOOR**2)


def distances(x: np.ndarray, centre: np.ndarray, cover: np.ndarray) -> np.ndarray:
    y = x - centre
    return np.einsum("ij,ij->i", y, np.linalg.solve(cover, y.T).T)


def block_estimate(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log determinant, location, scatter) of the best start, after concentration steps until the core stays."""
    x = x[np.lexsort(x.T)]
    h = max(1, int(CORE * len(x)))
    centre = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - centre), axis=0), FLOOR)
    z = (x - centre) / spread
    starts = [np.abs(z).max(axis=1), (z**2).sum(axis=1), (np.tanh(z) ** 2).sum(axis=1)]
    best = None
    for start in starts:
        last = np.inf
        near = np.argsort(start, kind="stable")[:h]
        while True:
            centre = x[near].mean(axis=0)
            cover = scatter(x[near], centre)
            determinant = float(np.linalg.slogdet(cover)[1])
            if determinant >= last - 1e-12:
                break
            last = determinant
            found = (determinant, centre, cover)
            near = np.argsort(distances(x, centre, cover), kind="stable")[:h]
        best = found if best is None or found[0] < best[0] else best
    return best


def packed(centre: np.ndarray, cover: np.ndarray) -> list[float]:
    return [*centre.tolist(), *cover.ravel().tolist()]


def unpacked(model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(model[:SIZE], float), np.asarray(model[SIZE:], float).reshape(SIZE, SIZE)


def _name(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def grouped(rows: DataFrame) -> DataFrame:
    """grp, n_grp and x: every vector in its language and in its language and source."""
    vectors = rows.select(F.explode(F.array(_name("lang"), _name("lang", "source"))).alias("grp"), "x")
    return vectors.join(vectors.groupBy("grp").agg(F.count("*").alias("n_grp")), "grp")


def starts(vectors: DataFrame) -> DataFrame:
    """grp, lot, determinant, model and whether it is final: the best block of every lot.

    The determinant of a start that is not final is infinite, so the first step over all rows replaces it.
    """
    parts = F.ceil(F.col("n_grp") / BLOCK_ROWS)
    blocks = vectors.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts))

    def estimate(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part.x.to_numpy())
        determinant, centre, cover = block_estimate(x)
        lot, final = int(part.block.iloc[0]) % STARTS, part.n_grp.iloc[0] <= BLOCK_ROWS
        row = {"lot": lot, "determinant": determinant, "model": [packed(centre, cover)], "final": final}
        return pd.DataFrame({"grp": part.grp[:1], **row})

    made = blocks.select("grp", "n_grp", "block", "x").groupBy("grp", "block")
    made = made.applyInPandas(estimate, "grp string, lot int, determinant double, model array<double>, final boolean")
    best = F.min_by(F.struct("determinant", "model"), F.struct("determinant", "model"))
    made = made.groupBy("grp", "lot", "final").agg(best.alias("best"))
    value = F.when(F.col("final"), F.col("best.determinant")).otherwise(F.lit(float("inf")))
    return made.select("grp", "lot", value.alias("determinant"), "best.model", "final")


def concentrated(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """grp, lot, determinant, model after one concentration step over all vectors of the models' groups."""
    key = ["grp", "lot"]
    names = [f"s{i}" for i in range(1 + SIZE + SIZE * SIZE)]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int, int], np.ndarray] = {}

        def told() -> pd.DataFrame:
            return pd.DataFrame([(*k, *add) for k, add in held.items()], columns=[*key, "class", *names])

        for batch in batches:
            for (grp, lot), part in batch.groupby(key):
                x = np.stack(part.x.to_numpy())
                d = distances(x, *unpacked(part.model.iloc[0]))
                classes = np.floor(CLASSES * np.log2(np.clip(d, 2.0**LOWEST, 2.0**HIGHEST))).astype(int)
                for c in np.unique(classes):
                    y = x[classes == c]
                    add = np.concatenate(([len(y)], y.sum(axis=0), (y.T @ y).ravel()))
                    held[grp, int(lot), int(c)] = held.get((grp, int(lot), int(c)), 0) + add
            if len(held) > HELD:
                yield told()
                held.clear()
        yield told()

    def step(part: pd.DataFrame) -> pd.DataFrame:
        total = part.sort_values("class")[names].to_numpy()
        core = CORE * total[:, 0].sum()
        before = np.cumsum(total[:, 0]) - total[:, 0]
        add = (total * np.clip((core - before) / total[:, 0], 0, 1)[:, None]).sum(axis=0)
        centre = add[1 : SIZE + 1] / add[0]
        cover = add[SIZE + 1 :].reshape(SIZE, SIZE) / add[0] - np.outer(centre, centre) + np.diag(FLOOR**2)
        row = {"determinant": float(np.linalg.slogdet(cover)[1]), "model": [packed(centre, cover)]}
        return pd.DataFrame({"grp": part.grp[:1], "lot": part.lot[:1], **row})

    rows = vectors.select("grp", "x").join(models.select(*key, "model"), "grp")
    parts = rows.mapInPandas(sums, f"grp string, lot int, class int, {', '.join(f'{n} double' for n in names)}")
    classes = parts.groupBy(*key, "class").agg(*(F.sum(n).alias(n) for n in names))
    return classes.groupBy(*key).applyInPandas(step, "grp string, lot int, determinant double, model array<double>")


def settled(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """The models after steps until no determinant falls any more; finished groups take no further part.

    Each round lowers the determinant of every model that goes on by ``SETTLED`` or more, and ``FLOOR``
    bounds it from below, so the rounds end.
    """
    while not models.where("NOT final").isEmpty():
        after = concentrated(vectors, models.where("NOT final"))
        after = after.select("grp", "lot", F.struct("determinant", "model").alias("after"))
        lower = F.coalesce(F.col("after.determinant") < F.col("determinant") - SETTLED, F.lit(False))
        chosen = [F.when(lower, F.col(f"after.{c}")).otherwise(F.col(c)).alias(c) for c in ("determinant", "model")]
        models = models.join(after, ["grp", "lot"], "left").select("grp", "lot", *chosen, (~lower).alias("final"))
        models = stored(models, "outlier-models")
    return models


def _distance(x: Column, model: Column) -> Column:
    @F.pandas_udf("double")
    def distance(xs: pd.Series, models: pd.Series) -> pd.Series:
        out = np.full(len(xs), np.nan)
        ready = (xs.notna() & models.notna()).to_numpy()
        if ready.any():
            flat = np.stack(models[ready].to_numpy())
            y = np.stack(xs[ready].to_numpy()) - flat[:, :SIZE]
            cover = flat[:, SIZE:].reshape(-1, SIZE, SIZE)
            out[ready] = np.einsum("ij,ij->i", y, np.linalg.solve(cover, y[:, :, None])[:, :, 0])
        return pd.Series(out)

    return distance(x, model)


def estimates(vectors: DataFrame) -> DataFrame:
    """grp, n_grp, model: location and scatter of every group."""
    models = settled(vectors, stored(starts(vectors), "outlier-models"))
    models = models.groupBy("grp").agg(F.min_by("model", F.struct("determinant", "model")).alias("model"))
    return vectors.groupBy("grp").agg(F.first("n_grp").alias("n_grp")).join(models, "grp")


def _mean(n: Column, own: Column, prior: Column) -> Column:
    """Of two arrays, the first of which counts for n rows and the second for ``PRIOR_ROWS``."""
    return F.zip_with(own, prior, lambda a, b: (n * a + PRIOR_ROWS * b) / (n + PRIOR_ROWS))


def drawn(keys: DataFrame, models: DataFrame) -> DataFrame:
    """lang, source, model: the estimates of sources drawn to those of their languages, and these to ``WIDE``."""
    own = models.select(F.col("grp").alias("own"), F.col("n_grp").alias("n_own"), F.col("model").alias("m_own"))
    joint = models.select(F.col("grp").alias("joint"), F.col("n_grp").alias("n_joint"), F.col("model").alias("m_joint"))
    rows = keys.withColumn("own", _name("lang", "source")).withColumn("joint", _name("lang"))
    rows = rows.join(own, "own").join(joint, "joint")
    wide = F.array(*map(F.lit, np.diag(WIDE**2).ravel().tolist()))
    tail = F.slice("m_joint", SIZE + 1, SIZE * SIZE)
    prior = F.concat(F.slice("m_joint", 1, SIZE), _mean(F.col("n_joint"), tail, wide))
    return rows.select("lang", "source", _mean(F.col("n_own"), F.col("m_own"), prior).alias("model"))


def judged(documents: DataFrame) -> DataFrame:
    """Statistics and verdict of every document."""
    rows = documents.select("doc_id", "lang", "source", measured(F.col("text")).alias("m"))
    rows = rows.select("doc_id", "lang", "source", "m.*").withColumn("base_failed", base_failed())
    rows = stored(rows.withColumn("x", F.when(~F.col("base_failed"), vector())), "outlier-vectors")
    fit = rows.where("x is not null").select("lang", "source", "x")
    models = stored(drawn(fit.select("lang", "source").distinct(), estimates(stored(grouped(fit), "outlier-groups"))), "outlier-models")
    same = [rows[c].eqNullSafe(models[c]) for c in ("lang", "source")]
    rows = rows.join(models, same, "left").drop(models["lang"]).drop(models["source"])
    rows = rows.withColumn("distance", _distance(F.col("x"), F.col("model")))
    near = F.col("distance").isNull() | F.isnan("distance") | (F.col("distance") <= F.lit(CUTOFF))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & near).alias("kept"),
        F.when(~F.isnan("distance"), F.col("distance")).alias("distance"),
    )
