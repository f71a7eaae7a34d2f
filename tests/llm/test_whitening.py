import math
import os

import numpy as np
import pytest

from tessera.llm import whitening as wh


def brute(rows, k=16):
    """Exact integers, then numpy's decomposition of the whole centred list."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[(n * c - t) / n for c, t in zip(x, s)] for x in fit])
    _, size, v = np.linalg.svd(z, full_matrices=False)
    e, v = size**2 / n, v.T
    out = {}
    for i, x in kept:
        dev = [n * c - t for c, t in zip(x, s)]
        w = (np.array([y / n for y in dev]) @ v) / np.sqrt(np.maximum(e, 1e-300))
        for c in range(min(k, len(s))):
            out.setdefault((i, c + 1), []).append((n, sum(y * y for y in dev), w[c], e[c] / e.sum()))
    return out


def held(got, want):
    signs = {}
    seen = {}
    for r in got:
        seen.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert set(seen) == set(want)
    for key, rs in seen.items():
        assert len(rs) == len(want[key])
        for r, (n, dev, w, ex) in zip(rs, want[key]):
            assert (r["n"], r["deviation"]) == (n, dev)
            assert r["explained"] == pytest.approx(ex, rel=1e-8)
            assert abs(r["whitened"]) == pytest.approx(abs(w), abs=1e-7)
            if abs(w) > 1e-4:
                assert signs.setdefault(key[1], np.sign(w * r["whitened"])) == np.sign(w * r["whitened"])
            assert 0 <= r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in got}) <= 1


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def run(spark, rows, k=16):
    x = wh.quantised(table(spark, rows).repartition(3)).select("vec_id", "x")
    w, fit = wh.fit_whitening(x, k)
    return wh.whiten(x, w, wh.identity_error(fit, w)).collect() if w else []


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN", 2)
    monkeypatch.setattr(wh, "BLOCK", 1)
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(20, 20)) * 2.0 ** -np.arange(20)[:, None] * 40
    rows = [(i, (rng.normal(size=20) @ mix + 3).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (900, rows[9][1]), (901, None), (902, [math.nan] * 20), (903, [1.0] * 19 + [None]), (904, [math.inf] * 20), (905, [1.0] * 19), (906, [])]
    want = brute([r for r in rows if r[0] not in (905, 906)])
    held(run(spark, rows), want)


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])]) == []
    assert run(spark, [(1, []), (2, None)]) == []
    got = run(spark, [(1, [0.0, 1.0, 2.0]), (2, [4.0, 1.0, 2.0]), (3, [8.0, 1.0, 3.0])])
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-9
    huge = run(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])])
    assert {r["deviation"] for r in huge if r["vec_id"] == 1} == {None} and len(huge) >= 3


def test_numbers_beyond_a_long_stay_exact():
    x = np.array([[2**50, 5], [7, -(2**50)]], np.int64)
    n, sums = 10**6, [3 * 10**15, -5]
    want = [[n * int(c) - s for c, s in zip(r, sums)] for r in x]
    assert wh._deviations(x, n, sums).tolist() == want
    assert wh.squared(x, n, sums) == [None if (v := sum(c * c for c in r)) >= 2**63 else v for r in want]
    assert wh.squared(x[:, :1] % 1000, 10, [1]) == [(10 * int(c) - 1) ** 2 for c in x[:, 0] % 1000]


def test_rotations(spark):
    rng = np.random.default_rng(1)
    for shape, fall in (((40, 17), 1.0), ((9, 9), 1e-3), ((6, 10), 0.3), ((64, 64), 0.8), ((3, 1), 1.0)):
        a = rng.normal(size=shape) @ np.diag(fall ** np.arange(shape[1]) if fall < 1 else np.ones(shape[1]))
        size, v = wh.jacobi(a)
        u = np.linalg.svd(a, compute_uv=False)
        k = len(u)
        assert size[:k] == pytest.approx(u, rel=1e-9, abs=1e-14 * u[0])
        assert np.abs(v.T @ v - np.eye(shape[1])).max() < 1e-12
        assert np.abs(np.linalg.norm(a @ v, axis=0) - size).max() < 1e-12 * u[0]


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    held(wh.op11_whitening(spark, d).collect(), brute(rows))
