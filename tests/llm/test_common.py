import random

from tessera.llm import common


def _brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(5, None), (300, 300)]
    got = {x["id"]: x["root"] for x in common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = _brute([e for e in edges if None not in e and e[0] != e[1]])
    assert got == want


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "v long")
    assert sorted((r["v"], r["rank"]) for r in common.global_rank(df, ["v"]).collect()) == [(i, i) for i in range(50)]
    assert common.global_rank(df.where("v < 0"), ["v"]).count() == 0


def test_saved_tables_survive_and_go(spark):
    t = common.saved(spark.range(5), "x")
    assert t.count() == 5
    common.forget(t)
    common.forget(t)
