import datetime as dt
import random

import duckdb
import numpy as np
import pytest

from tessera.llm import sale_enrichment as se

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, client string, slot string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, batch string"


def _rows(n, m, seed=4):
    """Sales and changes, half of them of one client; ties in time, nulls, repeats, late rows."""
    rng = random.Random(seed)
    day0 = dt.datetime(2024, 1, 1)
    at = lambda: day0 + dt.timedelta(hours=rng.choice([rng.randint(0, 2900), 24 * rng.randint(0, 120)]))
    client = lambda: rng.choice([7, 7, 7, None, *range(12)])
    sales, changes = [], []
    for k in range(n):
        sold = at() if rng.random() > 0.03 else None
        come = (sold or at()) + dt.timedelta(hours=rng.choice([0, 0, 1, 30, 400])) if rng.random() > 0.01 else None
        sales.append((k if rng.random() > 0.01 else None, client(), "done", 1.0, sold, come, 1, "mine", "mine"))
    for k in range(m):
        changes.append((k, client(), 0, rng.choice(["I", "U", "D", None, "käse"]), at() if rng.random() > 0.02 else None, "web", None, "x", rng.choice([None, -0.005, 12.345, rng.uniform(-900, 900)]), "mine"))
    return sales + rng.sample(sales, 20), changes + rng.sample(changes, 20)


def _sql(path):
    con = duckdb.connect()
    for t in ("sales", "client_changes"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    return sorted(map(repr, con.execute(se.SQL).fetchall()))


def test_equals_sql_with_sliced_clients(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(se, "SLICE_ROWS", 120)
    monkeypatch.setattr(se, "KEY_ROWS", 300)
    monkeypatch.setattr(se, "HOT_SHARE", 10**9)
    monkeypatch.setattr(se, "PACKED", 250)
    sales, changes = _rows(1500, 900)
    spark.createDataFrame(sales, SALES).repartition(2).write.parquet(f"{tmp_path}/sales.parquet")
    spark.createDataFrame(changes, CHANGES).repartition(2).write.parquet(f"{tmp_path}/client_changes.parquet")
    got = sorted(map(repr, map(tuple, se.op13_sale_enrichment(spark, str(tmp_path)).collect())))
    want = _sql(tmp_path)
    assert got == want
    assert sum("'late'" in x for x in want) > 20 and sum("None, None, None)" not in x for x in want) > 500


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SALES).write.parquet(f"{tmp_path}/sales.parquet")
    spark.createDataFrame([], CHANGES).write.parquet(f"{tmp_path}/client_changes.parquet")
    assert se.op13_sale_enrichment(spark, str(tmp_path)).collect() == []


def test_slices_cut_a_hot_client_evenly(spark, monkeypatch):
    monkeypatch.setattr(se, "SLICE_ROWS", 100)
    monkeypatch.setattr(se, "HOT_SHARE", 10**9)
    s = spark.range(1000).selectExpr("0L as batch", "id", "CASE WHEN id % 2 = 0 THEN 7L ELSE id END as client", "id * 1000 as at")
    c = spark.range(0).selectExpr("id as client", "id as at")
    (hot,) = se.sliced(s, c, 1000).collect()
    sizes = np.diff(np.searchsorted(np.arange(0, 1000, 2) * 1000, [0, *hot["bounds"], 10**9]))
    assert hot["client"] == 7 and len(sizes) == 6 and sizes.max() < 140  # 501 rows


def test_watermarks(spark):
    s = spark.createDataFrame([(0, 50), (1, 20), (4, 90)], "batch long, at long")
    c = spark.createDataFrame([(1, 40), (2, 60), (3, None)], "batch long, at long")
    marks, rows = se.watermarks(s, c)
    low = se._NEVER
    assert rows == 6 and marks[:6] == [(low, low), (low, low), (40, 40), (50, 60), (50, 60), (60, 60)]


@pytest.mark.parametrize("seed", range(5))
def test_last_at_or_before(seed):
    rng = np.random.default_rng(seed)
    v = np.array(sorted(zip(rng.integers(0, 5, 40 * (seed > 0)), rng.integers(0, 9, 40))), np.int64).reshape(-1, 2)
    s = np.stack([rng.integers(-1, 7, 60), rng.integers(-2, 11, 60)], axis=1)
    got = se._last_at_or_before((v[:, 0], v[:, 1]), (s[:, 0], s[:, 1]))
    for (c, a), g in zip(s.tolist(), got.tolist()):
        assert g == max([k for k, (x, y) in enumerate(v.tolist()) if x == c and y <= a], default=-1)


def test_batches(spark):
    days = [19722, 19723, 19735, 19736, 19874, 19875, 19999]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in days], "d int").select(se.arrival(se.F.col("d"))).collect()]
    assert got == [max(0, min(11, (d - 19723) * 12 // 152)) for d in days]


class _State:
    """A key's state as Spark hands it over."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None


def test_one_stage_holds_sales_and_versions():
    """A sale waits beside its client's versions until H passes it, and what is held is given back when nothing is left."""
    state, none = _State(), se._NEVER
    sale, change = np.array([[1, 7, 50, 0]], np.int64), np.array([[3, 7, 40, 900, 0, 0]], np.int64)
    put = lambda kind, rows, names: se.pd.DataFrame({"slot": [0], "kind": [kind], "rows": [rows.tobytes()], "names": [names]})
    run = lambda stage, *pdfs: [r for t in stage((0,), iter(pdfs), state) for r in t.to_dict("records")]
    assert run(se.Versions(0, none, none, none, 4), put("sale", sale, None), put("change", change, ["käse"])) == []
    assert state.exists and run(se.Versions(1, 50, none, 40, 4)) == []
    (got,) = run(se.Versions(2, 51, 50, 45, 4))
    assert (got["rec"], got["id"], got["batch"], got["n_held"], got["change_id"], got["balance_cents"], got["op"]) == ("sale", 1, 2, 1, 3, 900, "käse")
    (late,) = run(se.Versions(3, 51, 51, 45, 4), put("change", change, ["käse"]))
    assert (late["rec"], late["id"], late["batch"]) == ("late", 3, 3)
    other = _State()
    assert list(se.Versions(0, none, none, none, 4)((1,), iter([put("sale", sale, None)]), other)) == [] and other.exists
    assert [t["change_id"].isna().all() for t in se.Versions(se.BATCHES, none, none, none, 4)((1,), iter([]), other)] == [True] and not other.exists
