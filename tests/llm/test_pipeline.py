import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import decontamination, mixing, ngram_join, quality
from tessera.llm.common import saved

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages(spark):
    from tests_brute import linked, shingle_set

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    cols, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = saved(stage(spark, docs, DIR))
        seen.append((name, before, docs))
    assert all(d.columns == cols for _, _, d in seen[:-1])
    ids = lambda d: [r["doc_id"] for r in d.select("doc_id").collect()]
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    assert {i for i in ids(a) if labels.get(i) == 1} <= set(ids(b))
    texts = {r["doc_id"]: shingle_set(r["text"]) for r in b.collect()}
    kept = set(ids(c))
    assert not any(linked(texts[x], texts[y]) for x in kept for y in kept if x < y)
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert set(ids(d)) == kept - {r["doc_id"] for r in decontamination.matches(c, bench).collect()}
    assert set(ids(e)) <= set(ids(d))
    assert sorted(ids(f)) == sorted(ids(e)) and {"size", "shard", "slot"} <= set(f.columns)
    assert callable(mixing.take) and callable(ngram_join.one_per_group) and callable(quality.filter_quality)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_registered_queries_equal_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "sales", "client_changes"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    sql = {k: v for k, v in entry.oracle_sql().items() if re.match(r"op\d+_", k)}
    assert set(sql) == {"op2_embedding_dedup", "op3_ngram_join", "op4_sharding", "op6_url_filter", "op8_mixing", "op9_warc", "op10_line_dedup", "op13_sale_enrichment"}
    for name, text in sql.items():
        df = entry.queries()[name](spark, DIR)
        cols = sorted(df.columns)
        cur = con.execute(text)
        at = [c[0] for c in cur.description]
        show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
        want = sorted([show(r[at.index(c)]) for c in cols] for r in cur.fetchall())
        assert sorted([show(r[c]) for c in cols] for r in df.collect()) == want, name


def _tables(spark, doc, prose, path, rows, labels=None, items=None):
    doc(spark, rows, extra=True).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 60, 2)] if labels is None else labels
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, prose(900, 30)), (2, None), (None, prose(901, 20))] if items is None else items
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows_through_all_stages(spark, doc, prose, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, copies, columns with names the stages use."""
    good = lambda k, n=40: prose(k, n).capitalize() + "."
    rows = [(i, good(i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, None, None, None), (101, "", "en", None), (None, good(200), None, "s1"), (None, good(200) + " more", "en", "s0"), (102, good(201, 60_000), "en", "s2")]
    rows += [(103, good(1), "en", "s0"), (103, good(202), "en", "s0"), (104, good(203) + " " + prose(900, 30), "en", "s1"), (105, good(204), "en", "s1"), (105, good(204), "en", "s1")]
    # labels that say nothing, so that all documents pass the first stage
    d = _tables(spark, doc, prose, tmp_path, rows, labels=[(1, None, 0), (2, 7, 1), (None, 1, 0), (3, 1, 0)])
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, d))
        seen.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(seen[0]) == len(rows)
    # of copies one stays, of an id with two texts only the one that is a copy goes, equal rows are one document
    left = Counter(seen[1])
    assert left[103, good(1)] == 0 and left[103, good(202)] == 1 and left[1, good(1)] == 1 and left[105, good(204)] == 2
    assert left[None, good(200)] + left[None, good(200) + " more"] == 1 and len(seen[1]) == len(rows) - 2
    assert Counter(seen[2]) == left - Counter({(104, rows[-3][1]): 1})
    assert set(seen[3]) <= set(seen[2]) and sorted(map(str, seen[4])) == sorted(map(str, seen[3]))
    out, slots = docs.collect(), {}
    assert {"row", "key", "mix_size", "shard_key", "a", "id", "size", "shard", "slot"} <= set(docs.columns)
    assert all(r["row"] == "mine-row" and r["mix_size"] == "mine-mix_size" and r["size"] == len((r["text"] or "").encode()) + 1 for r in out)
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables_through_all_stages(spark, doc, prose, tmp_path, empty):
    rows = [] if empty == "documents" else [(i, prose(i, 30), "en", f"s{i % 3}") for i in range(40)]
    d = _tables(spark, doc, prose, tmp_path, rows, [] if empty == "labels" else None, [] if empty == "benchmark" else None)
    out = corpus_pipeline.run(spark, d)
    assert {"doc_id", "text", "size", "shard", "slot"} <= set(out.columns)
    n = out.count()
    assert n == 0 if empty == "documents" else n > 0


def test_stages_against_plain_ones(spark, doc, prose, tmp_path):
    """Joining, decontamination and mixing as a whole against versions written out in Python."""
    import hashlib
    import random

    from test_decontamination import held
    from test_sharding_mixing import _water
    from tests_brute import components_of_pairs, linked, shingle_set

    r = random.Random(6)
    item = prose(900, 30)
    rows = []
    for i in range(120):
        w = prose(i % 70, 30).split()
        if i >= 70:
            w[r.randrange(len(w))] = "changed"
        if i % 11 == 0:
            w += item.split()
        rows.append((i, " ".join(w), "en", f"s{i % 4}"))
    d = _tables(spark, doc, prose, tmp_path, rows, labels=[])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    joined = corpus_pipeline.dedup_stage(spark, docs, d)
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    comp = components_of_pairs([(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])], sets)
    assert sorted(x["doc_id"] for x in joined.collect()) == sorted(set(comp.values()))
    clean = corpus_pipeline.decontamination_stage(spark, docs, d)
    want = [(i, t, s) for i, t, _, s in rows if not held(t, item)]
    assert sorted(x["doc_id"] for x in clean.collect()) == [i for i, *_ in want]
    # mixing: by hash, each source until its words are nearest to the target
    sizes = Counter()
    for i, t, s in want:
        sizes[s] += len(t.split())
    target, taken = _water(sizes), Counter()
    for s in sizes:
        mine = sorted((int(hashlib.md5(f"{i}:{t}".encode()).hexdigest()[:15], 16), i, len(t.split())) for i, t, x in want if x == s)
        rounds, rest, below = int(target[s] // sizes[s]), target[s] % sizes[s], 0
        for _, i, n in mine:
            taken[i] += rounds
            if below + n <= rest or below <= rest and below + n - rest < rest - below:
                taken[i] += 1
            below += n
    mixed = corpus_pipeline.mixing_stage(spark, clean, d)
    assert Counter(x["doc_id"] for x in mixed.collect()) == +taken
