"""Vector duplicates against all pairs, and the estimates against true inner products."""

import numpy as np
import pytest

from dealflux.llm import embedding_dups as E


def brute(rows):
    ok = [label is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0 for _, v, label, *_ in rows]
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(repr((r[0], links[i], least.get(root(i)), r[0] is not None and r[0] == least.get(root(i)))) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 7])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.25, 0.4])).astype(np.float32).tolist(), int(rng.integers(3)), "x") for i in range(150)]
    rows += [(200, None, 1, "x"), (201, [], 1, "x"), (202, [0.0] * 16, 1, "x"), (203, [float("nan")] * 16, 1, "x"), (204, [None] + [1.0] * 15, 1, "x"), (205, rows[0][1], None, "x"),
             (None, rows[0][1], rows[0][2], "x"), (206, [1.0], 1, "x"), (207, [2.0], 1, "x"), (207, [2.0], 1, "x"), (208, [float("inf")] * 16, 1, "x"), (209, rows[3][1][:-1], rows[3][2], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    got = [repr((r.vec_id, r.n_links, r.component_id, r.kept)) for r in E.near_duplicates(df, block).collect()]
    assert sorted(got) == brute(rows)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_within_their_error():
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit + rng.normal(size=unit.shape) * 0.08
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    packed, factor, error, _ = E.codes(unit)
    guess = E.estimates(packed, factor, E.codes(near)[3])
    off = guess - unit @ near.T
    assert abs(off.mean()) < 0.01 and (np.abs(off) <= error[:, None]).mean() > 0.999


def test_long_labels_are_told_apart_by_their_ends(spark):
    rows = [(i, [1.0, 2.0], "x" * 64 + str(i % 2)) for i in range(4)]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 1)]


@pytest.mark.parametrize("dim", [16, 64, 128])
def test_no_link_near_the_threshold_is_missed(dim):
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(1200, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.91, 0.95, len(a))[:, None]
    b = cosine * a + np.sqrt(1 - cosine**2) * side
    found = {(x, y) for xs, ys in E.linked_pairs(a, b, E.codes(a)[:3]) for x, y in zip(xs.tolist(), ys.tolist())}
    assert found == set(zip(*(i.tolist() for i in np.nonzero(a @ b.T >= E.THRESHOLD))))
