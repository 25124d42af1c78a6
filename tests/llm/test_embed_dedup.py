import numpy as np
import pytest

from symgrain.llm import embed_dedup as e


def brute(rows, least=0.93):
    def unit(v):
        if v is None or not len(v) or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        return np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))

    units = [unit(v) if i is not None and label is not None else None for i, v, label in rows]
    near = [[a != b and units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= least for b in range(len(rows))] for a in range(len(rows))]
    comp = [r[0] for r in rows]
    while True:
        new = [min([comp[a], *(comp[b] for b in range(len(rows)) if near[a][b])]) if any(near[a]) else comp[a] for a in range(len(rows))]
        if new == comp:
            break
        comp = new
    return sorted(((r[0], sum(n), c, None if r[0] is None else r[0] == c) for r, n, c in zip(rows, near, comp, strict=True)), key=str)


def cluster(rng, dim, sizes, noise):
    out = []
    for s in sizes:
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        out += [(c + noise * rng.normal(size=dim) / np.sqrt(dim)).astype(np.float32).tolist() for _ in range(s)]
    return out


@pytest.mark.parametrize("cap, hashes", [(2048, None), (8, None), (2048, 3)])
def test_brute_force(spark, cap, hashes):
    rng = np.random.default_rng(3)
    vectors = cluster(rng, 64, [80, 30, 5, 5, 1, 1, 1, 2, 2], 0.25) + cluster(rng, 20, [6, 6], 0.2)
    rows = [(k * 2, v, int(k % 5 == 0)) for k, v in enumerate(vectors)]
    one = vectors[0]
    rows += [(1, one, 0), (3, one, 0), (3, one, 0), (5, one, None), (None, one, 0), (7, None, 0), (9, [], 0), (11, [0.0] * 64, 0), (13, [float("nan")] * 64, 0), (15, [None, *one[1:]], 0), (17, [float("inf"), *one[1:]], 0), (19, [2 * x for x in one], 0), (21, [1e30 * x for x in one], 0), (23, [-x for x in one], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'n' as node", "1 as n")
    got = sorted(map(tuple, e.near_duplicates(table, cap=cap, hashes=hashes).collect()), key=str)
    assert got == brute(rows)


def test_null_components_link_with_nothing(spark):
    rows = [(2, [0.5, None, 0.25], 1), (4, [0.5, 0.25], 1), (6, [0.5, 0.25], 1), (1, [None, 0.5, 0.25], 1), (3, [0.5, 0.25, None], 1), (8, [3.0], 1), (9, [3.0], 1), (10, [5.0], 1), (11, [-5.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    assert sorted(map(tuple, e.near_duplicates(table).collect()), key=str) == brute(rows)


def test_hashes_grow_with_the_vectors():
    assert [e.hashes_for(n, 64) for n in (0, 51_000, 10**6, 10**8, 10**10)] == [2, 2, 3, 4, 4]
    assert [e._width(n) for n in (1, 2, 3, 64, 65)] == [2, 2, 4, 64, 128]


@pytest.mark.parametrize("hashes", [1, 2, 3, 4])
def test_recall_at_the_bound(hashes):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    x, y = e.signatures(a, hashes), e.signatures(b, hashes)
    meet = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3))
    assert meet.any(axis=1).mean() > 0.9999
    assert all(len(set(t)) == hashes + 1 for row in x[:50].tolist() for t in row)
    assert np.allclose(e.hadamard(np.eye(8)) @ e.hadamard(np.eye(8)), 8 * np.eye(8))


def test_empty(spark):
    assert e.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
