import random

from tessera.operators.graph import Closure


def _closure(edges):
    reach = {}
    for root in {a for a, _ in edges}:
        seen, todo = set(), [root]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[root] = seen
    return {(a, b) for a, bs in reach.items() for b in bs}


def test_edges_that_come_and_go_equal_a_rebuild(spark):
    rng = random.Random(8)
    pick = lambda n: [(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(n)]
    frame = lambda e: spark.createDataFrame(e, "src int, dst int")
    held = lambda c: {(r["src"], r["dst"]) for r in c.pairs.collect()}
    now = set(pick(14))
    c = Closure(frame(list(now)))
    assert held(c) == _closure(now)
    for _ in range(2):
        more, less = pick(5), rng.sample(sorted(now), 5) + [(99, 99)]
        c.add(frame(more + more[:1]))
        now |= set(more)
        assert held(c) == _closure(now) and c.pairs.count() == len(_closure(now))
        c.remove(frame(less))
        now -= set(less)
        assert held(c) == _closure(now)
    assert {(r["src"], r["dst"]) for r in c.edges.collect()} == now


def test_chains_and_cycles(spark):
    frame = lambda e: spark.createDataFrame(e, "src int, dst int")
    c = Closure(frame([(k, k + 1) for k in range(30)]))
    assert c.pairs.count() == 31 * 30 // 2
    c.add(frame([(30, 0), (None, 3)]))
    assert c.pairs.count() == 31 * 31
    c.remove(frame([(15, 16)]))
    roots = spark.createDataFrame([(16,), (40,)], "node int")
    assert sorted(r["node"] for r in c.reachable(roots).collect()) == sorted([*range(17, 31), *range(0, 16)])
