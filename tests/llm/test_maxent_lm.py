import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from symgrain.llm import maxent_lm as lm


def brute(rows):
    tokens = {}
    for k, (doc_id, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        tokens[k] = [*w, None]
    held = {k: doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2 for k, (doc_id, _) in enumerate(rows)}
    c = Counter(t for k, ts in tokens.items() if not held[k] for t in ts)
    n, v = sum(c.values()), len(c)
    return [(rows[k][0], held[k], len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)) for k, ts in tokens.items()]


def corpus(n):
    rng = random.Random(8)
    tongues = [[f"{p}{i}" for i in range(60)] for p in ("ba", "ko", "zu")]
    return [(i, " ".join(rng.choices(tongues[i % 3], k=rng.randint(5, 80)))) for i in range(n)]


@pytest.mark.parametrize("chunk_tokens", [lm.CHUNK_TOKENS, 500])
def test_counts_and_held_out_accuracy(spark, chunk_tokens):
    rows = corpus(300) + [(1000, None), (1001, ""), (None, "ba1 ba2"), (7, "BA1\tunseenword \n É"), (7, "BA1\tunseenword \n É"), (1002, "ba1 " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' as word", "1 as chunk", "2 as held")
    got = lm.train_and_score(docs, chunk_tokens=chunk_tokens).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
    unseen = [r for r in got if r["held_out"]]
    assert len(unseen) > 20 and sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen) + 0.1 * sum(r["n_tokens"] for r in unseen)
    assert all(r["score"] < 0 for r in got)


def test_the_model_is_a_distribution():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(lm.ROWS + 1, lm.CLASSES)).astype(np.float32)
    hashes = rng.integers(-(2**63), 2**63, 50)
    rows = lm.features(hashes, np.array([0, 20, 49]))
    assert rows.min() >= 0 and rows.max() < lm.ROWS
    assert np.allclose(lm._softmax(weights, rows).sum(axis=1), 1, atol=1e-5)
    assert (rows[:, 0] == rows[:, 20]).all() and (rows[:, 0] == rows[:, 49]).all()
    head = np.array([5, -3, 9])
    assert lm.classes_of(np.array([9, 4, -3, 5]), np.array([1, 2, 3, 4]), head).tolist() == [2, lm.HEAD + 2, 1, 0]


def test_descent_learns():
    rng = np.random.default_rng(4)
    weights, squares = np.zeros((lm.ROWS + 1, lm.CLASSES), np.float32), np.full((lm.ROWS + 1, lm.CLASSES), 1e-6, np.float32)
    context = rng.integers(0, 40, 4000)
    rows = np.stack([context, context + 100, context * 3])
    for _ in range(20):
        lm.descend(weights, squares, rows, context)
    assert lm._softmax(weights, rows)[np.arange(4000), context].mean() > 0.9


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(16, "a b"), (25, None)], "doc_id long, text string")
    assert lm.train_and_score(docs.limit(0)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.train_and_score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 3, 0, 0, 0.0)


def test_the_table_grows_with_the_vocabulary(spark, monkeypatch):
    assert (lm.HEAD, lm.TAIL) == (32, 16) and lm.rows_for(0) == lm.rows_for(1) == lm.rows_for(1_000_000) == 1 << 15
    assert lm.rows_for(5_000_000) == 1 << 16 and lm.rows_for(20_000_000) == 1 << 18
    row = np.random.default_rng(1).integers(0, 1 << 18, 5000).astype(np.int32)
    assert (lm._order(row, 1 << 18) == np.argsort(row, kind="stable")).all()
    made = []
    monkeypatch.setattr(lm, "rows_for", lambda n: made.append(n) or 1 << 16)
    rows = lm.train_and_score(spark.createDataFrame(corpus(60), "doc_id long, text string")).collect()
    assert made == [181] and len(rows) == 60 and all(r["score"] < 0 for r in rows)


def test_each_round_uses_all_chunks(spark):
    docs = spark.createDataFrame(corpus(200), "doc_id long, text string").coalesce(1)
    one, two = (sum(r["score"] for r in lm.train_and_score(docs, rounds=k).collect()) for k in (1, 2))
    assert two > one + 1


def test_context_tells_words_of_one_class_apart(spark):
    assert lm.leaves_for(0) == lm.leaves_for(5_000_000) == 32 and lm.leaves_for(30_000_000) == 64
    vocab, classes = np.array([4, -7, 9, 12]), np.array([lm.HEAD, lm.HEAD + 1, lm.HEAD, 3])
    assert lm.leaves_of(vocab, classes, np.array([-7, 9]), np.array([2, 5]), 32).tolist() == [16 + 4, 2, 5, 0]
    rng, ring = random.Random(5), [f"ba{i}" for i in range(150)]  # one class but for those that have their own
    rows = [(i, " ".join(ring[(k + j) % 150] for j in range(100))) for i in range(400) for k in [rng.randrange(150)]]
    held = [r for r in lm.train_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 1.0 * sum(r["n_tokens"] for r in held)


def test_a_step_equals_the_plain_sum_over_the_batch(monkeypatch):
    """In strides, with rows that a batch meets once, twice and often; a stride of 7 cuts groups of them. Logits beyond SAFE take their row's largest off."""
    monkeypatch.setattr(lm, "STRIDE", 7)
    rng = np.random.default_rng(5)
    for scale in (1, 200):
        weights = (rng.normal(size=(41, 5)) * scale).astype(np.float32)
        squares = np.ones_like(weights)
        rows = np.stack([rng.integers(0, 40, 60), np.minimum(rng.geometric(0.2, 60), 39), np.full(60, 3)]).astype(np.int32)
        classes = rng.integers(0, 5, 60)
        z = weights[-1].astype(np.float64) + sum(weights[r].astype(np.float64) for r in rows)
        plain = np.exp(z - z.max(axis=1, keepdims=True))
        plain /= plain.sum(axis=1, keepdims=True)
        assert np.allclose(lm._softmax(weights, rows), plain, atol=1e-4)
        slope = plain - np.eye(5)[classes]
        w, q = weights.astype(np.float64), squares.astype(np.float64)
        for at in (*rows, np.full(60, 40)):
            total = np.zeros_like(w)
            np.add.at(total, at, slope)
            q += total * total
            w -= lm.RATE * total / np.sqrt(q)
        lm.descend(weights, squares, rows, classes)
        assert np.allclose(weights, w, atol=1e-2 if scale > 1 else 1e-4)
        assert np.allclose(squares, q, atol=1e-2)


def test_a_batch_is_summed_in_strides(monkeypatch):
    """Sums by groups are asked for groups of three or more alone."""
    monkeypatch.setattr(lm, "STRIDE", 16)
    slope = np.arange(40.0).reshape(20, 2)
    times = np.array([1, 2, 3, 1, 5, 2, 6])
    order = np.random.default_rng(1).permutation(20)
    ends = np.cumsum(times)
    assert np.allclose(lm._totals(slope, order, times), [slope[order[e - t : e]].sum(axis=0) for e, t in zip(ends, times, strict=True)])
