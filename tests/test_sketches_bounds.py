import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import index, store as stores


def _exact(values):
    v = [x for x in values if x is not None and math.isfinite(x)]
    return [float(np.percentile(v, p)) for p in (0, 50, 90, 99, 100)] if v else [None] * 5


def test_percentiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(index, "CELLS", 8)
    rng = random.Random(2)
    cases = [
        [rng.gauss(0, 1) for _ in range(501)], [5.0] * 40 + [None, math.nan, math.inf], [1e300, -1e300, 1e-300, 0.0, 7.0], [rng.choice([1.0, 2.0, 2.0000000001, 1e12]) for _ in range(300)],
        [3.5], [], [None], [-(1.7e308), 1.7e308, 0.0],
    ]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
        got = list(index.percentiles(df, "x").first())
        for a, b in zip(got, _exact(values)):
            assert a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300), values[:5]


def test_order_statistics_read_bounded_cells(spark, monkeypatch):
    monkeypatch.setattr(index, "CELLS", 64)
    df = spark.range(20_000).selectExpr("cast(pow(1.001, id) as double) as x")
    got = index.order_statistics(df, "x", [0, 10_000, 19_999, 30_000])
    assert sorted(got) == [0, 10_000, 19_999] and got[10_000] == df.orderBy("x").offset(10_000).first()["x"]


def test_ratio_bound_never_hides_a_name(spark):
    rng = random.Random(5)
    typed = ["", "a", "blue bolt", "Ünï", "aabbcc", "x" * 30]
    names = ["", None, "bolt blue", "blue", "aaa", "ïnÜ", *["".join(rng.choice("abc xüblot") for _ in range(rng.randint(0, 14))) for _ in range(400)]]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for p in typed:
        got = {r["name"]: r["b"] for r in df.select("name", t.ratio_bound("name", p).alias("b")).collect()}
        assert got[None] is None
        assert all(got[n] >= t.ratio(n, p) for n in names if n is not None)
    low = df.where(t.ratio_bound("name", "blue bolt") > t.MINIMUM_SCORE).count()
    assert low < 120  # few names are left to be aligned


def test_estimates_of_layers(spark, tmp_path):
    s = stores.IndexStore(spark, str(tmp_path / "s"))
    s.register(index.IndexDefinition("w", 1, index.words()))
    rows = lambda a, b: spark.range(a, b).selectExpr("id as file_id", "concat('/', id) as path", "array_join(transform(sequence(0, id % 40), k -> concat('w', (id * 7 + k * 31) % 3000)), ' ') as text", "1L as last_modified", "1L as length")
    none = rows(0, 0).select("file_id")
    for a, b in ((0, 700), (700, 1500)):
        s.apply(rows(a, b), none)
    (got,) = s.estimates().collect()
    exact = index.counters(None, s.entries()).first()
    assert got["entries"] == exact["entries"]
    assert abs(got["keys"] - exact["keys"]) < 0.05 * exact["keys"] and abs(got["files"] - exact["files"]) < 0.05 * exact["files"]
    per_file = [r["n"] for r in s.entries().groupBy("file_id").agg(F.count_distinct("key").alias("n")).collect()]
    for name, p in (("p50", 50), ("p90", 90), ("p99", 99)):
        assert np.percentile(per_file, p - 4) <= got[name] <= np.percentile(per_file, min(100, p + 4))
    assert s.estimates().where("index_id = 'none'").count() == 0
    s.invalidate()
    assert s.estimates().collect() == []
