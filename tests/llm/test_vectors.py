import numpy as np

from barloom.llm import embedding_dedup as ed


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows):
    good = lambda v, l: l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a, l) in enumerate(rows):
        for j, (_, b, m) in enumerate(rows[:i]):
            if good(a, l) and good(b, m) and l == m and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    n[i] += 1
                    n[j] += 1
                    up[find(i)] = find(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, n[i], least[find(i)]) for i, (k, _, _) in enumerate(rows))


def sample():
    r = np.random.default_rng(2)
    rows = []
    for base in range(8):
        v = r.standard_normal(32)
        for _ in range(12):
            rows.append((len(rows), (v + r.standard_normal(32) * r.choice([0.0, 0.2, 0.4])).tolist(), int(base % 3)))
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 32, 1), (503, [float("nan")] * 32, 1), (504, [float("inf")] + [1.0] * 31, 1), (505, [None] + [1.0] * 31, 1)]
    rows += [(506, [1.0] * 32, None), (507, [1.0] * 32, None), (508, [1.0, 2.0], 0), (509, [2.0, 4.0], 0), (510, [1.0, 2.0], 0), (510, [1.0, 2.0], 0), (511, [-1.0, -2.0], 0)]
    return rows


def test_equals_brute_force(spark):
    rows = sample()
    for block in (2048, 5):
        got = ed.near_vectors(table(spark, rows), block=block).collect()
        assert sorted((g.vec_id, g.n_links, g.component_id) for g in got) == brute(rows)
        assert all(g.kept == (g.vec_id == g.component_id) for g in got)


def test_empty_table(spark):
    assert ed.near_vectors(table(spark, [])).count() == 0


def test_null_keys(spark):
    big = (1 << 60) + 1  # no float holds it
    rows = [(None, [1.0, 0.0, 0.0], 1), (big, [0.0, 1.0, 0.0], 1), (None, [0.0, 1.0, 0.1], 1), (big + 1, [0.0, 1.0, 0.0], 1), (None, [0.0, 0.0, 1.0], 2), (7, [0.0, 0.0, 1.0], 2)]
    got = ed.near_vectors(table(spark, rows).coalesce(1)).collect()
    want = [(None, 0, None, True), (big, 2, big, True), (None, 2, big, False), (big + 1, 2, big, False), (None, 1, 7, False), (7, 1, 7, True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    words = ed.near_vectors(table(spark, rows).selectExpr("cast(vec_id as string) as vec_id", "embedding", "label")).collect()
    assert {r.component_id for r in words} == {None, str(big), "7"}


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(0)
    x = r.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[200:] = 0.9 * x[:200] + 0.1 * x[200:]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    errors, over = [], 0
    for seed in range(5):
        turn = ed.rotation(64, seed)
        bits, factor = ed.codes(x, turn)
        off = ed.estimates(bits, factor, x @ turn.T, 64) - x @ x.T
        errors.append(off.mean())
        over += (abs(off) > ed.bound(factor, 64, 6.0)[:, None] + 1e-5).sum()
    assert abs(np.mean(errors)) < 2e-3 and over == 0
