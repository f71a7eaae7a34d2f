import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, sharding


def _docs(prose, n=400):
    rows = [(i, prose(i % 300, 3 + i * 7 % 60), "en", f"s{i % 3}" if i % 5 else "hot") for i in range(n)]
    rows += [(10_000 + i, prose(1, 30), "en", "hot") for i in range(120)]  # a large group of copies
    return rows + [(20_000, None, None, None), (20_001, "", "en", None), (None, "no id", "en", "s0"), (None, None, "en", "s1"), (5, "again", "en", "s1"), (5, "again", "en", "s1"), (-3, "minus", "en", "s2")]


def test_shards(spark, prose, doc):
    rows = _docs(prose)
    df = doc(spark, rows, extra=True).repartition(5)
    out = sharding.shard(df, 8).select("doc_id", "text", "shard_size", "shard_shard", "shard_slot", "row").collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((a, b) for a, b, *_ in rows)
    assert all(r["shard_size"] == len((r["text"] or "").encode()) + 1 and r["row"] == "mine-row" for r in out)
    by, size = defaultdict(list), Counter()
    for r in out:
        by[r["shard_shard"]].append(r["shard_slot"])
        size[r["shard_shard"]] += r["shard_size"]
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    mean, largest = sum(size.values()) / 8, max(r["shard_size"] for r in out)
    assert set(size) <= set(range(8)) and all(abs(s - mean) <= 0.02 * mean * 2 + largest for s in size.values())
    homes = defaultdict(set)
    for r in out:
        homes[r["text"] or ""].add(r["shard_shard"])
    assert sum(len(h) > 1 for h in homes.values()) <= 7  # groups are cut at boundaries only


def _sql(df, text):
    import duckdb

    documents = df.select("doc_id", "text", "source").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    cur = duckdb.sql(text)
    return Counter(map(tuple, cur.fetchall())), cur.columns


@pytest.mark.parametrize("few, part", [(4096, 32 << 20), (3, 700)])
def test_shards_equal_sql(spark, prose, doc, monkeypatch, tmp_path, few, part):
    # with few rows read and small parts: many rounds of probes, a group of copies cut between doc_ids, parts within shards
    monkeypatch.setattr(sharding, "FEW", few)
    monkeypatch.setattr(sharding, "PART_BYTES", part)
    rows = _docs(prose) + [(30_000 + i, prose(2, 400 if i == 3 else 30), "en", "hot") for i in range(600)] + [(40_000, prose(3, 30_000), "en", "s0")]
    df = doc(spark, rows).repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want, names = _sql(df, sharding.SQL)
    got = sharding.op4_sharding(spark, str(tmp_path))
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == want and set(got.columns) == set(names)


def test_histogram_counts_exactly(spark, prose, doc):
    slim = sharding.with_keys(doc(spark, _docs(prose))).select("shard_key", "shard_size")
    rows = [(int.from_bytes(r[0], "big"), r[1]) for r in slim.collect()]
    probes = sorted({k for k, _ in rows[::17]} | {1 << 127, (1 << 128) - 1, 256})
    assert sharding.histogram(slim, probes) == [(sum(s for k, s in rows if k < p), sum(k < p for k, _ in rows)) for p in probes]


def test_many_part_edges(spark):
    """Edges of many parts are even where texts are small, and exact everywhere; a text of many parts is one of them."""
    df = spark.range(30_000).selectExpr("id as doc_id", "CASE WHEN id = 7 THEN repeat('long ', 20000) ELSE concat('text ', id) END as text")
    slim = sharding.with_keys(df).select("shard_key", "shard_size").cache()
    rows = sorted((int.from_bytes(r[0], "big"), r[1]) for r in slim.collect())
    keys, below = [k for k, _ in rows], [0, *np.cumsum([s for _, s in rows]).tolist()]
    n, total = 3000, below[-1]
    edges = sharding._part_edges(slim, n, total, len(rows))
    assert all(under == bisect_left(keys, k) for k, under in edges)
    cuts = [0, *(under for _, under in edges), len(rows)]
    share, longest = total / n, max(s for _, s in rows)
    sizes = [below[b] - below[a] for a, b in zip(cuts, cuts[1:])]
    assert len(edges) > 2000 and sum(s > 2 * share for s in sizes) <= 1 and max(sizes) <= longest + 2 * share


def test_parts_are_bounded_over_all_shards(spark, prose, doc, monkeypatch):
    df = doc(spark, _docs(prose))
    want = Counter((r["doc_id"], r["text"], r["shard_shard"]) for r in sharding.shard(df).collect())
    asked, edges = [], sharding._part_edges
    monkeypatch.setattr(sharding, "_part_edges", lambda slim, n, *a: asked.append(n) or edges(slim, n, *a))
    monkeypatch.setattr(sharding, "PART_BYTES", 1)
    for most in (5, 64):  # fewer than shards: one part each
        monkeypatch.setattr(sharding, "MAX_CUTS", most)
        got = sharding.shard(df).collect()
        assert Counter((r["doc_id"], r["text"], r["shard_shard"]) for r in got) == want
        for s in range(sharding.SHARDS):
            slots = sorted(r["shard_slot"] for r in got if r["shard_shard"] == s)
            assert slots == list(range(len(slots)))
    assert asked == [64]


def test_shards_of_nothing_and_one(spark, doc):
    df = doc(spark, [(1, "x", "en", "s")])
    assert sharding.shard(df.where("doc_id > 5")).count() == 0
    assert sharding.shard(df).select("shard_slot").first()[0] == 0


def _water(sizes):
    """Targets by hand: share, cap, reshare."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


def test_mix(spark, prose, doc):
    rows = _docs(prose)
    out = mixing.mix(doc(spark, rows).repartition(4)).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in out:
        n = len((r["text"] or "").split())
        assert r["mix_size"] == n and 0 <= r["mix_copies"] <= 2
        sizes[r["source"]] += n
        taken[r["source"]] += n * r["mix_copies"]
        largest[r["source"]] = max(largest[r["source"]], n)
    target = _water(sizes)
    for r in out:
        assert r["mix_source_size"] == sizes[r["source"]] and abs(r["mix_target"] - target[r["source"]]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in sizes)
    again = mixing.mix(doc(spark, rows[::-1]).repartition(2)).collect()
    key = lambda rs: Counter((r["doc_id"], r["text"], r["mix_copies"]) for r in rs)
    assert key(out) == key(again)


def test_take_repeats_rows_and_keeps_columns(spark, prose, doc):
    df = doc(spark, _docs(prose), extra=True)
    got = mixing.take(df)
    assert got.columns == df.columns
    want = {(r["doc_id"], r["text"]): r["mix_copies"] for r in mixing.mix(df).collect()}
    have = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert have[(5, "again")] == 2 * want[(5, "again")]
    assert all(have[k] == n for k, n in want.items() if k != (5, "again"))
    assert got.where("mix_size <> 'mine-mix_size'").isEmpty()
    assert mixing.take(df.where("doc_id < -9")).count() == 0


def test_mixing_joins_by_shuffle_and_decides_ties(spark, prose, doc, monkeypatch, tmp_path):
    df = doc(spark, _docs(prose) + [(50_000, prose(4, 30_000), "en", "long")])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda d: Counter((r["doc_id"], r["text"], r["mix_copies"], round(r["mix_target"], 6)) for r in d.collect())
    one = key(mixing.mix(df))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert key(mixing.mix(df)) == one
    two = doc(spark, [(1, "a b", "en", "s")])
    # one word of two wanted: taking it is as near as leaving it, so it is left
    assert [mixing.mix(two, share=s).first()["mix_copies"] for s in (0.5, 0.51, 1.0)] == [0, 1, 1]


def test_larger_budgets_keep_what_smaller_take(spark, prose, doc):
    df = doc(spark, _docs(prose))
    a, b = ({(r["doc_id"], r["text"]): r["mix_copies"] for r in mixing.mix(df, share=s).collect()} for s in (0.3, 0.6))
    assert all(b[k] >= n for k, n in a.items())


def test_crc(spark):
    d = spark.createDataFrame([("é",), ("",)], "t string")
    assert [r[0] for r in d.select(F.crc32(F.col("t").cast("binary"))).collect()] == [zlib.crc32("é".encode()), 0]
