"""Centroid clustering against Lloyd's rounds in plain Python."""

import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from echotide.llm import yinyang as Y  # noqa: E402
from echotide.llm.common import table  # noqa: E402


def brute(rows, k=40, rounds=5, dims=64):
    """[(vec_id, cluster, distance)] and centroids."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    for turn in range(rounds + 1):
        near = [min((far(v, w), n) for n, w in enumerate(c)) for _, v in kept]
        if turn < rounds:
            for n in range(len(c)):
                mine = [v for (_, v), (_, m) in zip(kept, near) if m == n]
                if mine:
                    c[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i if i is not None else -1, n, d) for (i, _), (d, n) in zip(kept, near))), c


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, cluster int, q int, Upper int")


def check(spark, rows, k=40, rounds=5, dims=64):
    found, c = Y.cluster(Y.whole_vectors(make(spark, rows), dims), k, rounds, per_group=3)
    want, centroids = brute(rows, k, rounds, dims)
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"]) for r in found.collect()) == want
    assert [[int(x) for x in row] for row in c] == centroids


def test_awkward_rows(spark):
    rng = np.random.default_rng(1)
    inf, nan = float("inf"), float("nan")
    some = [(i, (rng.integers(-4, 5, 3) / 256 * (1 + i % 3)).tolist()) for i in range(120)]
    odd = [(None, [0.1, 0.2, 0.3]), (None, [0.0, 0.0, 0.0]), (3, None), (4, []), (5, [1.0, 2.0]), (6, [1.0, None, 2.0]), (7, [inf, 0.0, 0.0]), (8, [nan, 0.0, 0.0]), (9, [0.0, -inf, 0.0]), (1, [0.5, 0.5, 0.5]), (1, [0.25, 0.5, 0.5]), (1, [0.5, 0.5, 0.5])]
    check(spark, some + odd, 7, 5, 3)
    check(spark, odd, 40, 5, 3)
    check(spark, [(i, [0.0, 0.0, 0.0]) for i in range(20)], 5, 3, 3)
    found, c = Y.cluster(Y.whole_vectors(make(spark, odd[2:9]), 3))
    assert found.count() == 0 and len(c) == 0


def test_large_numbers(spark):
    """Beyond what doubles hold exactly; an error where a long can't hold a number."""
    rows = [(i, [x * 3e5, -x * 7.77e4, float(i % 5)]) for i, x in enumerate(np.random.default_rng(2).standard_normal(60).tolist())]
    check(spark, rows, 6, 3, 3)
    with pytest.raises(Exception, match="fit a long"):
        Y.cluster(Y.whole_vectors(make(spark, [(1, [1e300, 0.0, 0.0])]), 3))


def test_bounds_lose_nothing():
    """Rounds by bounds give what all distances give, with ties, and take fewer of them."""
    rng = np.random.default_rng(5)
    means = rng.integers(-500, 500, (40, 16))
    for spread, most in ((1, 1.0), (20, 0.5), (300, 1.0)):
        q = (means[rng.integers(0, 40, 3000)] + rng.integers(-spread, spread + 1, (3000, 16))).astype(float)
        c = q[:40].copy()
        groups = Y.groups_of(c)
        assert sorted(np.concatenate(groups).tolist()) == list(range(40)) and len(groups) > 1
        cluster, upper, lower = Y.first_round(q, c, groups)
        total = 0
        for _ in range(6):
            before, c = c, np.array([np.floor(q[cluster == n].mean(0)) if (cluster == n).any() else c[n] for n in range(40)])
            cluster, upper, lower, n = Y.next_round(q, before, c, groups, cluster, upper, lower)
            d = ((q[:, None] - c) ** 2).sum(2)
            assert (cluster == d.argmin(1)).all()
            d = np.sqrt(d)
            assert (upper >= d[np.arange(len(q)), cluster] * (1 - 1e-9)).all()
            d[np.arange(len(q)), cluster] = np.inf
            assert all((lower[:, k] <= d[:, g].min(1) * (1 + 1e-9)).all() for k, g in enumerate(groups))
            total += n
        assert total < most * 6 * 3000 * 40


def test_query(spark, sf_dir):
    from echotide.llm.queries import QUERIES

    rows = [tuple(r) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    want, c = brute(rows)
    per = {n: sum(d for _, m, d in want if m == n) for n in range(40)}
    whole = {(i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, n, d in want}
    assert {tuple(r) for r in QUERIES["op13_yinyang"](spark, sf_dir).collect()} == whole
