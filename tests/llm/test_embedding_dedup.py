import numpy as np
import pytest

from tessera.llm import embedding_dedup as ed
from tests_brute import components_of_pairs


def _vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 16))
    near = [base[i] + 0.12 * rng.standard_normal(16) for i in range(40)]
    hub = rng.standard_normal(16)
    cluster = [hub + 0.1 * rng.standard_normal(16) for _ in range(120)]  # far more than a window holds
    return [v.astype(np.float32).tolist() for v in [*base, *near, *cluster, base[3], base[3], 2 * base[4]]]


def test_against_brute_force(spark, monkeypatch):
    vecs = _vectors()
    odd = [None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan"), *[1.0] * 15], [float("inf"), *[1.0] * 15], vecs[0][:8], [None] * 3]
    rows = [(i, v, 0) for i, v in enumerate([*vecs, *odd])]
    monkeypatch.setattr(ed, "BLOCK", 40)  # runs and components over several blocks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r["vec_id"]: r for r in ed.near_duplicates(df, window=8).collect()}
    x = np.array(vecs, float)
    u = x / np.sqrt((x * x).sum(1))[:, None]
    cos = u @ u.T
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if cos[i, j] >= 0.9]
    comp = components_of_pairs(pairs, range(len(rows)))
    links = np.zeros(len(rows), int)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    assert len(got) == len(rows)
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert [got[i]["n_links"] for i in range(len(rows))] == links.tolist()
    assert all(r["kept"] == (i == comp[i]) for i, r in got.items())


def test_nulls_repeats_and_empty(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(None, v), (4, v), (4, v), (2, v)], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in ed.near_duplicates(df).collect())
    assert got == [(-1, 3, 2), (2, 3, 2), (4, 3, 2), (4, 3, 2)]
    assert ed.near_duplicates(df.where("vec_id > 9")).count() == 0


def _brute(x):
    links = np.zeros(len(x), int)
    pairs = np.argwhere(np.triu(x @ x.T >= ed.COSINE, 1))
    np.add.at(links, pairs.ravel(), 1)
    return pairs, links


_cosines = np.linspace(0.9005, 0.99, 200)


def _planted(n, dense):
    """n vectors, spread or of mutual cosine about 0.8 (no links among them), and 200 that each link with one of them: every
    planted pair alone joins two components."""
    rng = np.random.default_rng(n)
    unit = lambda v: v / np.sqrt((v * v).sum(-1, keepdims=True))
    x = unit(rng.standard_normal((n, 64)))
    if dense:
        x = unit(2 * unit(rng.standard_normal(64)) + x)
    side = rng.standard_normal((200, 64))
    side = unit(side - (side * x[:200]).sum(1)[:, None] * x[:200])
    c = _cosines[:, None]
    return np.vstack([x, c * x[:200] + np.sqrt(1 - c * c) * side])


@pytest.mark.parametrize("n, dense", [(3000, True), (6000, True), (6000, False)])
def test_no_link_is_lost_whatever_the_density(spark, n, dense):
    x = _planted(n, dense)
    pairs, links = _brute(x)
    assert len(pairs) >= 200
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in ed.near_duplicates(df).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == links.tolist()
    assert {i: r["component_id"] for i, r in got.items()} == components_of_pairs(pairs.tolist(), range(len(x)))


def test_share_met_by_angle(spark):
    """A pass of one hash and no window to speak of: the share of planted links met is what meeting() says, in spread and
    in dense surroundings alike, and more passes miss as few as planned."""
    for dense in (False, True):
        x = _planted(2500, dense)
        rows, classes = ed._classes(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"))
        of = {bytes(r["id"]): r["vec_id"] for r in rows.collect()}
        for miss in (0.5, 0.05):
            _, passes = ed.plan(len(x), 64, miss)
            edges = [(of[bytes(r["a"])], of[bytes(r["b"])]) for r in ed.met(classes, 1, miss).collect()]
            comp = components_of_pairs(edges, range(len(x)))
            lost = np.array([comp[i] != comp[2500 + i] for i in range(200)])
            want = [(1 - ed.meeting(64, float(c))) ** passes for c in _cosines[::20]]
            assert abs(lost.mean() - np.mean(want)) < 0.13
            assert lost.mean() <= miss


def test_plan_follows_the_table():
    assert ed.plan(10_000, 64)[0] == 1 and ed.plan(10**8, 64)[0] > 1
    for rows in (10, 10**5, 10**9):
        hashes, passes = ed.plan(rows, 64)
        assert (1 - ed.meeting(64) ** hashes) ** passes <= ed.MISS
    assert ed.plan(5, 1)[1] >= 1 and ed.plan(5, 2)[1] >= 1


def test_blocks_decided_by_their_centres(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 30)
    rng = np.random.default_rng(9)
    hub, far = rng.standard_normal((2, 24))
    x = [hub + 0.01 * rng.standard_normal(24) for _ in range(100)]  # all link
    x += [hub + (far - hub) * t + 0.01 * rng.standard_normal(24) for t in np.linspace(0, 1, 60) for _ in range(3)]  # a chain
    x = np.array(x)
    pairs, links = _brute(x / np.sqrt((x * x).sum(1))[:, None])
    df = spark.createDataFrame([(i, v, "mine", 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, id string, n int")
    got = {r["vec_id"]: r for r in ed.near_duplicates(df).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == links.tolist()
    assert {i: r["component_id"] for i, r in got.items()} == components_of_pairs(pairs.tolist(), range(len(x)))


def test_a_cosine_of_exactly_the_threshold_links(spark):
    # 9 / (1 * 10) and 9 / (1 * sqrt(101))
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0, 0.0]), (3, [9.0, 4.0, -2.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ed.near_duplicates(df).collect()}
    assert got[1] == (1, 1) and got[2][1] == 1 and got[3][1] == 3
