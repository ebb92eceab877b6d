from __future__ import annotations

import numpy as np
import pytest

from lakeseed.llm import quality as q


def text(rng, good):
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(rng.integers(20, 60))]
    return " ".join(w if good else w + "%%%" for w in words)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(2)
    return [(i, text(rng, i % 4 != 0), "en", "a") for i in range(300)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(1, None, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(documents, corpus, labels):
    found = q.classified(documents(corpus, clash=True), labels).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 300 and len(held) > 30
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)


@pytest.mark.parametrize("group", [2, 32])
def test_gradients_like_differences(monkeypatch, group):
    rng = np.random.default_rng(4)
    net = q.Network.new(rng)
    net.weights = {k: v.astype(float) for k, v in net.weights.items()}
    monkeypatch.setattr(q, "CHUNK", 512)
    monkeypatch.setattr(q, "GROUP", group)
    rows = [q.pieces(rng.integers(32, 120, n).astype(np.uint8).tobytes()) for n in (90, 300, 1700)]
    assert [len(r) for r in rows] == [1, 1, 4]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        total = 0.0
        for row, label in zip(rows, labels, strict=True):
            p = net.probability(np.average([net.pooled(c) for c in row], axis=0, weights=[len(c) for c in row]))
            total -= label * np.log(p) + (1 - label) * np.log(1 - p)
        return total / 3

    slopes = net.gradients(rows, labels)
    for name, slope in slopes.items():
        flat = net.weights[name].reshape(-1)
        at = int(np.abs(slope).argmax())
        step = 1e-5
        flat[at] += step
        up = loss()
        flat[at] -= 2 * step
        down = loss()
        flat[at] += step
        assert abs((up - down) / (2 * step) - slope.reshape(-1)[at]) < 1e-3, name


@pytest.mark.parametrize("size", [0, 1, 75, 76, 77, 4095, 4096, 4097, 10_000])
def test_chunks_cover_the_whole_text(size):
    raw = bytes(i % 251 for i in range(size))
    cut = q.pieces(raw)
    step = q.CHUNK - q.OVERLAP
    covered = b"".join(c[: step if i < len(cut) - 1 else None] for i, c in enumerate(cut))
    assert covered.startswith(raw) and not covered[size:].strip()
    for c in cut:
        n = (len(c) - q.WIDTH) // q.STRIDE + 1
        assert n >= q.POOL and (n // q.POOL * q.POOL - 1) * q.STRIDE + q.WIDTH >= min(len(c), q.CHUNK) - q.STRIDE * q.POOL


def plain_score(net, text):
    """The probability of a whole text, a filter and a window at a time."""
    raw, w = text.encode(), net.weights
    step, at, means, sizes = q.CHUNK - q.OVERLAP, 0, [], []
    while True:
        chunk = raw[at : at + q.CHUNK]
        last = at + q.CHUNK >= len(raw)
        if last:
            while len(chunk) < q.WIDTH + q.STRIDE * (q.POOL - 1) or (len(chunk) - q.WIDTH - q.STRIDE * (q.POOL - 1)) % (q.STRIDE * q.POOL):
                chunk += b" "
        outs = []
        for start in range(0, len(chunk) - q.WIDTH + 1, q.STRIDE):
            bits = [(1 if byte >> (7 - k) & 1 else -1) / 4 for byte in chunk[start : start + q.WIDTH] for k in range(8)]
            outs.append([sum(b * f for b, f in zip(bits, w["filters"][:, n].tolist(), strict=True)) for n in range(q.FILTERS)])
        pools = [outs[p : p + q.POOL] for p in range(0, len(outs) - q.POOL + 1, q.POOL)]
        means.append([sum(max(0, max(o[n] for o in pool) + w["shift"][n]) for pool in pools) / len(pools) for n in range(q.FILTERS)])
        sizes.append(len(chunk))
        if last:
            break
        at += step
    mean = [sum(m[n] * s for m, s in zip(means, sizes, strict=True)) / sum(sizes) for n in range(q.FILTERS)]
    hidden = [np.tanh(sum(mean[n] * w["dense"][n, h] for n in range(q.FILTERS)) + w["bias"][h]) for h in range(q.HIDDEN)]
    return 1 / (1 + np.exp(-sum(hidden[h] * w["out"][h, 0] for h in range(q.HIDDEN)) - w["level"][0]))


@pytest.mark.parametrize("size", [0, 40, 76, 700, 4096, 9_000])
def test_scores_like_a_plain_version(size):
    rng = np.random.default_rng(size)
    net = q.Network.new(rng)
    made = "".join(map(chr, rng.integers(32, 400, size)))
    assert abs(net.score(made) - plain_score(net, made)) < 1e-4


def test_every_row_of_a_drawn_id_is_one_text(documents, labels, monkeypatch):
    seen = []
    monkeypatch.setattr(q, "train", lambda texts, marks: seen.append((texts, marks.tolist())))
    rows = [(1, "b", "en", "a")] * 50 + [(1, "a", "en", "a"), (2, None, "en", "a")]
    q.learn(documents(rows), labels.where("doc_id in (1, 2)"))
    assert seen == [(["a", None], [1.0, 1.0])]


def test_late_bytes_count():
    net = q.train(["good words here " * 20, "bad%%% word%%% " * 20] * 40, np.array([1.0, 0.0] * 40, np.float32), 6)
    clean = "good words here " * 2000
    assert net.score(clean) > net.score(clean + "bad%%% word%%% " * 2000)


def test_odd_rows_and_empty_tables(documents, corpus, odd_rows, labels):
    frame = documents(odd_rows, clash=True)
    assert q.classified(frame, labels).count() == len(odd_rows)
    assert {r.score for r in q.classified(frame, labels.limit(0)).collect()} == {0.5}
    assert q.classified(documents([]), labels).count() == 0
