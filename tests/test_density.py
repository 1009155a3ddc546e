"""Densities by tiles against the sum over all pairs."""

import numpy as np
import pytest

from roleweave.operators import density


def exact(x, y):
    def h(v):
        q1, q3 = np.quantile(v, [0.25, 0.75])
        return 4 * 1.06 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2 / 4

    hx, hy = h(x), h(y)
    k = np.exp(-0.5 * (((x[:, None] - x) / hx) ** 2 + ((y[:, None] - y) / hy) ** 2))
    scale = 2 * np.pi * hx * hy
    return k.sum(1) / (len(x) * scale), density.error_bound() / scale


def test_error_bound():
    assert density.error_bound() < 1e-10
    assert density.error_bound(terms=6) > density.error_bound(terms=10) > density.error_bound()
    # one source and one target at the worst places of their tiles
    e = density.SIDE / 2
    shifts = density._shifts()
    for d in range(-density.REACH, density.REACH + 1):
        for a in (-e, 0.0, e):
            for b in (-e, 0.3 * e, e):
                moments = a ** np.arange(density.TERMS) / np.array([float(np.prod(range(1, j + 1))) for j in range(density.TERMS)])
                got = moments @ shifts[d + density.REACH] @ b ** np.arange(density.TERMS)
                assert got == pytest.approx(np.exp(-0.5 * (d * density.SIDE + b - a) ** 2), abs=density.error_bound())


def test_density_is_the_exact_sum(spark):
    rng = np.random.default_rng(6)
    groups = {
        "a": rng.normal(size=(700, 2)),
        "b": np.concatenate([rng.normal(size=(300, 2)) * [0.01, 5], rng.normal(size=(300, 2)) + [9, -40]]),
        "c": np.concatenate([rng.normal(size=(200, 2)), rng.standard_cauchy((100, 2)) * 50]),
        "d": np.zeros((5, 2)) + [1.0, 2.0],
        "e": np.array([[1.0, 1.0]]),
    }
    rows = [(g, float(x), float(y), i, 1.5) for g, p in groups.items() for i, (x, y) in enumerate(p)]
    rows += [("a", None, 1.0, -1, 0.0), (None, 1.0, 1.0, -2, 0.0)]
    df = spark.createDataFrame(rows, "kind string, u double, v double, i long, n double").repartition(5)
    got = density.density_at_points(df, "u", "v", "kind")
    assert got.columns == [*df.columns, "density"]
    found = {(r["kind"], r["i"]): r for r in got.collect()}
    assert len(found) == len(rows)
    for g, p in groups.items():
        if g in "de":
            assert all(found[g, i]["density"] is None for i in range(len(p)))
            continue
        want, bound = exact(p[:, 0], p[:, 1])
        mine = np.array([found[g, i]["density"] for i in range(len(p))])
        assert np.abs(mine - want).max() <= bound + 1e-12 * want.max()
    assert found["a", -1]["density"] is None and found[None, -2]["density"] is None and found["a", 0]["n"] == 1.5
    assert density.density_at_points(df.limit(0), "u", "v", "kind").collect() == []
