"""Near-duplicate vectors against brute force."""

import numpy as np

from pacewright.llm.vectors import linked_vectors


def brute(ids, x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    label = np.arange(len(x))
    while True:
        low = np.where(near, label, len(x)).min(axis=1)
        if (low == label).all():
            break
        label = low
    return {ids[k]: (int(near[k].sum()) - 1, min(ids[j] for j in np.flatnonzero(label == label[k]))) for k in range(len(x))}


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 48))
    noisy = [base[rng.integers(150)] + rng.normal(size=48) * rng.uniform(0, 0.4) for _ in range(400)]
    x = np.vstack([base, noisy, np.repeat(base[:1], 60, axis=0), base[1:2] + rng.normal(size=(1300, 48)) * 0.05]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    expected = brute(ids, x.astype(float))
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    odd = [(9001, None), (9002, [0.0] * 48), (9003, [float("nan")] * 48), (9004, [float("inf")] + [0.0] * 47), (9005, [1.0] * 3), (9006, []), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 cid", "2 v")
    found = linked_vectors(df).collect()
    assert len(found) == len(rows) + len(odd)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found if r["vec_id"] is not None and r["vec_id"] < 9000}
    total = sum(n for n, _ in expected.values())
    assert sum(min(got[k][0], expected[k][0]) for k in expected) >= 0.99 * total
    assert all(got[k][0] <= expected[k][0] for k in expected)
    assert np.mean([got[k] == expected[k] for k in expected]) >= 0.98
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found if r["vec_id"] is None or r["vec_id"] > 9000} == {(k, 0, k, True) for k, _ in odd}
    assert linked_vectors(df.limit(0)).count() == 0


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    for pairs, others in ((200, 0), (1500, 9000)):
        x = rng.normal(size=(pairs, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side = rng.normal(size=(pairs, 64))
        side -= (side * x).sum(axis=1, keepdims=True) * x
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        cos = rng.uniform(0.9502, 0.97, size=(pairs, 1))
        every = np.vstack([x, cos * x + np.sqrt(1 - cos**2) * side, rng.normal(size=(others, 64))])
        df = spark.createDataFrame(list(enumerate(every.tolist())), "vec_id long, embedding array<double>")
        found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in linked_vectors(df).collect()}
        assert np.mean([found[k] == found[pairs + k] == (1, k) for k in range(pairs)]) >= 0.98
        assert all(found[k] == (0, k) for k in range(2 * pairs, len(every)))


def test_one_large_group(spark):
    """More members than a block: links inside it are counted once each."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=32)
    x = centre + rng.normal(size=(9500, 32)) * 0.16
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(unit[k : k + 500] @ unit.T >= 0.95).sum(axis=1) for k in range(0, len(x), 500)]) - 1
    found = {r["vec_id"]: r["n_links"] for r in linked_vectors(df).collect()}
    assert sum(found.values()) >= 0.99 * want.sum() and all(found[k] <= n for k, n in enumerate(want.tolist()))


def test_repeated_ids_are_rows_of_their_own(spark):
    """Two rows of one id: the same vector again, and another vector."""
    a, b = [1.0] + [0.0] * 15, [0.0, 1.0] + [0.0] * 14
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, a), (3, b), (4, [0.0] * 16)], "vec_id long, embedding array<double>")
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in linked_vectors(df).collect())
    assert found == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 0, 4)]
