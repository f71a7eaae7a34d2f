import random

import pytest

from tessera.operators import intervals, paths

POINT, SPAN = "file_id long, offset long", "file_id long, node_id long, start long, end long"


def _made(seed, n=150, m=150, wide=False):
    r = random.Random(seed)
    far = (1 << 61) if wide else 60
    spot = lambda: r.choice([None, *[r.randint(-far, far) for _ in range(30)]])
    file = lambda: r.choice([1, 1, 1, 2, None])
    points = [(file(), spot()) for _ in range(n)]
    spans = [(file(), k, s, s + r.choice([0, 1, 7, 64, 1000]) if s is not None and r.random() < 0.7 else spot()) for k, s in enumerate(spot() for _ in range(m))]
    return points, spans


@pytest.mark.parametrize("seed, wide", [(1, False), (2, False), (3, True)])
def test_points_and_spans_as_by_brute_force(spark, seed, wide):
    points, spans = _made(seed, wide=wide)
    p, s = spark.createDataFrame(points, POINT), spark.createDataFrame(spans, SPAN)
    within = lambda x, f, a, b: None not in (f, x, a, b) and a <= x <= b
    want = sorted((f, x, k) for f, x in points for g, k, a, b in spans if f == g and within(x, f, a, b))
    assert sorted((r["file_id"], r["offset"], r["node_id"]) for r in intervals.inside(p, s).collect()) == want
    least = {}
    for f, x, k in want:
        _, _, a, b = spans[k]
        least[f, x] = min(least.get((f, x), (b - a, k)), (b - a, k))
    assert {(r["file_id"], r["offset"]): r["node_id"] for r in paths.innermost(p, s).collect()} == {k: v[1] for k, v in least.items()}
    ok = [(f, k, a, b) for f, k, a, b in spans if None not in (f, a, b) and a <= b]
    pairs = sorted((j, k) for f, j, a, b in ok[:70] for g, k, c, d in ok[50:] if f == g and a <= d and c <= b)
    one, two = spark.createDataFrame(ok[:70], SPAN), spark.createDataFrame(ok[50:], SPAN)
    assert sorted((r["a_node_id"], r["b_node_id"]) for r in intervals.overlapping(one, two).collect()) == pairs


def test_bins_fill_a_span_exactly(spark):
    spans = [(0, k, s, e) for k, (s, e) in enumerate([(0, 0), (1, 6), (-5, 9), (0, 1023), (7, 7), (-8, -1), (3, 2)])]
    got = {}
    for r in intervals.binned(spark.createDataFrame(spans, SPAN)).collect():
        got.setdefault(r["node_id"], []).extend(range(r["_bin"] << r["_level"], (r["_bin"] + 1) << r["_level"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(s, e + 1)) for _, k, s, e in spans if s <= e}


def test_one_file_with_many_spans(spark):
    """Rows before the answer follow spans, points and answer, not their product."""
    n = 100_000
    spans = spark.range(n).selectExpr("0L as file_id", "id as node_id", "id * 10 as start", "id * 10 + 25 as end")
    points = spark.range(20_000).selectExpr("0L as file_id", "id * 50 + 3 as offset")
    b = intervals.binned(spans)
    levels = intervals.levels_of(b)
    assert b.count() < 10 * n and len(levels) < 7
    joined = intervals.inside(points, spans)
    assert "BETWEEN" not in joined._jdf.queryExecution().toString().upper()
    assert joined.count() == sum(sum(1 for k in (x // 10, x // 10 - 1, x // 10 - 2) if 0 <= k < n and k * 10 <= x <= k * 10 + 25) for x in range(3, 1_000_000, 50))
    assert paths.innermost(points, spans).count() == 20_000


def test_nested_spans_meet_a_point_once_a_level(spark):
    spans = spark.range(5000).selectExpr("0L as file_id", "id as node_id", "-id as start", "id as end")
    points = spark.createDataFrame([(0, 0)], POINT)
    (row,) = paths.innermost(points, spans).collect()
    assert row["node_id"] == 0
    assert intervals.best_inside(points, spans, intervals.F.min("node_id")).count() <= 14


def test_innermost_is_found_by_hashing(spark):
    """No sort of bins, no functions over arrays, and the number of spans without a row for each."""
    big = (1 << 63) - 1
    spans = spark.createDataFrame([(0, big, 1, 5), (0, -big - 1, 3, 7), (0, None, 0, 9), (0, 4, 0, 1 << 61)], SPAN)
    points = spark.createDataFrame([(0, 4), (0, 4), (0, 2), (0, 8), (0, 100), (0, -1)], POINT)
    got = paths.innermost(points, spans, "n")
    assert sorted(map(tuple, got.collect())) == [(0, 2, big, 3), (0, 4, -big - 1, 8), (0, 8, None, 2), (0, 100, 4, 1)]
    words = paths.innermost(points, spans.withColumn("node_id", spans["node_id"].cast("string")))
    assert sorted(map(tuple, words.collect())) == [(0, 2, str(big)), (0, 4, str(-big - 1)), (0, 8, None), (0, 100, "4")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "lambda" not in plan and plan.count("HashAggregate") >= 4


def test_empty(spark):
    p, s = spark.createDataFrame([], POINT), spark.createDataFrame([], SPAN)
    one = spark.createDataFrame([(1, 5)], POINT)
    assert intervals.inside(p, s).count() == intervals.inside(one, s).count() == intervals.overlapping(s, s).count() == 0
    assert [r["context"] for r in paths.context_of(one, s.withColumn("kind", intervals.F.lit("class"))).collect()] == ["top_level"]
