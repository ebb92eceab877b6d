"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover it whole. Each byte is eight signs, its bits;
``FILTERS`` learned filters of ``WIDTH`` bytes slide over a chunk in steps of ``STRIDE``, and their
rectified outputs are max-pooled over pools of ``POOL`` steps and averaged over the chunk's pools. The
chunks' features are averaged by length, and a dense layer and a logistic turn them into one probability.
A null or empty text is one chunk of padding and gets a score like any other.

The network is trained with Adam on at most ``SAMPLE`` labelled ids, those with the smallest hashes, and on
the whole text of each; of several texts of one id and label the first in their order. Training and scoring hold
``GROUP`` chunks at a time, however long a text is. Rows without a label teach nothing. Without any
label every score is 0.5. Several labels of one id count once each; repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, STRIDE, POOL = 16, 4, 16
FILTERS, HIDDEN = 24, 16
CHUNK, OVERLAP = 4096, 64
SAMPLE, GROUP = 4000, 32
EPOCHS, BATCH, RATE, SEED = 12, 32, 3e-3, 7
THRESHOLD = 0.3

BITS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1) / 4


def pieces(raw: bytes) -> list[bytes]:
    """Overlapping chunks over all bytes, the last one padded with blanks to whole pools."""
    step = CHUNK - OVERLAP
    cut = [raw[at : at + CHUNK] for at in range(0, max(1, len(raw) - OVERLAP), step)]
    least = WIDTH + STRIDE * (POOL - 1)
    whole = least + -(-max(0, len(cut[-1]) - least) // (STRIDE * POOL)) * STRIDE * POOL
    cut[-1] = cut[-1].ljust(whole)
    return cut


def windows(raw: bytes) -> np.ndarray:
    """A row of bits for each position of the filters."""
    bits = BITS[np.frombuffer(raw, np.uint8)].ravel()
    n = (len(raw) - WIDTH) // STRIDE + 1
    return np.lib.stride_tricks.as_strided(bits, (n, WIDTH * 8), (STRIDE * 8 * bits.itemsize, bits.itemsize))


@dataclass
class Network:
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        def drawn(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        return cls({
            "filters": drawn(WIDTH * 8, FILTERS) * 4,
            "shift": np.zeros(FILTERS, np.float32),
            "dense": drawn(FILTERS, HIDDEN),
            "bias": np.zeros(HIDDEN, np.float32),
            "out": drawn(HIDDEN, 1),
            "level": np.zeros(1, np.float32),
        })

    def pooled(self, raw: bytes) -> np.ndarray:
        """Mean over the pools of a chunk of the largest output of each filter."""
        made = windows(raw) @ self.weights["filters"]
        full = len(made) // POOL * POOL
        return np.maximum(made[:full].reshape(-1, POOL, FILTERS).max(axis=1) + self.weights["shift"], 0).mean(axis=0)

    def probability(self, features: np.ndarray) -> float:
        w = self.weights
        hidden = np.tanh(features @ w["dense"] + w["bias"])
        return float(1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["level"], -30, 30))[0]))

    def score(self, text: str | None) -> float:
        chunks = pieces((text or "").encode())
        shares = np.array([len(c) for c in chunks], np.float32)
        return self.probability(np.average([self.pooled(c) for c in chunks], axis=0, weights=shares))

    def _pools(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Of some chunks the windows, each pool's largest outputs and where they are, and the pools of each chunk."""
        rows = [windows(c) for c in chunks]
        counts = [len(r) // POOL for r in rows]
        x = np.concatenate([r[: n * POOL] for r, n in zip(rows, counts, strict=True)])
        made = (x @ self.weights["filters"]).reshape(-1, POOL, FILTERS)
        top = made.argmax(axis=1)
        return x, np.take_along_axis(made, top[:, None], 1)[:, 0] + self.weights["shift"], top, counts

    def gradients(self, texts: list[list[bytes]], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over texts, each a list of chunks."""
        w = self.weights
        chunks = [c for text in texts for c in text]
        owner = np.repeat(np.arange(len(texts)), [len(text) for text in texts])
        sizes = np.array([len(c) for c in chunks], np.float32)
        part = sizes / np.bincount(owner, weights=sizes)[owner]
        groups = range(0, len(chunks), GROUP)
        first = self._pools(chunks[:GROUP])

        def group(at: int) -> tuple:
            # A batch of short texts is one group, whose pools serve both passes.
            x, value, top, counts = first if at == 0 else self._pools(chunks[at : at + GROUP])
            share = np.repeat((part[at : at + GROUP] / counts).astype(np.float32), counts)[:, None]
            return x, value, top, share, np.repeat(owner[at : at + GROUP], counts)

        features = np.zeros((len(texts), FILTERS), w["dense"].dtype)
        for at in groups:
            _, value, _, share, of = group(at)
            np.add.at(features, of, np.maximum(value, 0) * share)
        hidden = np.tanh(features @ w["dense"] + w["bias"])
        chance = 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["level"], -30, 30)))[:, 0]
        d_out = ((chance - labels) / len(texts)).astype(np.float32)[:, None]
        d_hidden = d_out @ w["out"].T * (1 - hidden**2)
        d_features = d_hidden @ w["dense"].T
        filters, shift = np.zeros_like(w["filters"]), np.zeros_like(w["shift"])
        for at in groups:
            x, value, top, share, of = group(at)
            d_value = d_features[of] * share * (value > 0)
            d_made = np.zeros((len(top), POOL, FILTERS), d_value.dtype)
            np.put_along_axis(d_made, top[:, None], d_value[:, None], 1)
            filters += x.T @ d_made.reshape(-1, FILTERS)
            shift += d_value.sum(axis=0)
        return {
            "filters": filters,
            "shift": shift,
            "dense": features.T @ d_hidden,
            "bias": d_hidden.sum(axis=0),
            "out": hidden.T @ d_out,
            "level": d_out.sum(axis=0),
        }


def train(texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS) -> Network | None:
    """Adam over shuffled batches of texts, the same for the same rows."""
    if not texts:
        return None
    rng = np.random.default_rng(SEED)
    net = Network.new(rng)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    steps, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(texts), BATCH):
            part = order[at : at + BATCH]
            slopes = net.gradients([pieces((texts[i] or "").encode()) for i in part], labels[part])
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            for k, g in slopes.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                move = first[k] / (1 - 0.9**steps) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
                net.weights[k] = net.weights[k] - np.float32(rate) * move.astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from the labelled documents that are not held out."""
    usable = labels.select("doc_id", "quality").where("quality is not null").where(~held_out(F.col("doc_id")))
    drawn = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    # A row for each drawn id and label, however many rows share the id.
    rows = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    held = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toPandas().sort_values(["doc_id", "quality"])
    return train(held.text.tolist(), held.quality.to_numpy(np.float32))


def scored(text: Column, net: Network | None, spark) -> Column:
    """The probability that a text is good."""
    shared = spark.sparkContext.broadcast(net and net.weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known = shared.value and Network(shared.value)
        return pd.Series([known.score(t) if known else 0.5 for t in texts], dtype=float)

    return score(text)


def classified(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and class of every document."""
    score = scored(F.col("text"), learn(documents, labels), documents.sparkSession)
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
