import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import line_dedup as ld, quality as ql, url_filter as uf, warc
from tessera.llm.common import fresh_path

# --- url filter -----------------------------------------------------------------------------------------------------


def _urls():
    r = random.Random(4)
    out = []
    for i in range(300):
        host = r.choice(["a", "m.b", "blog.c"]) + r.choice([".example.com", ".example.net", ".example.org"])
        out.append(f"http{'s' * (i % 2)}://{host}/{r.choice(['en', 'de', 'es', 'fr'])}/{r.choice('0123456789')}{i}")
    return out + [None, "", "no scheme", "HTTP://WWW.Example.COM", "http://x.com?q=/en/", "http://com/en/x", "http://xcom/en/7", "http://example.com/en/71#f", "http://ÉXAMPLE.com/en/", out[0], out[0]]


def _host_path(u):
    if not u or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[k:]
    j = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), tail[:j]


def test_hosts_rules_and_scores(spark):
    urls = _urls()
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("mine")).withColumn("score", F.lit(1))
    got = {r["page_id"]: r for r in uf.judge_urls(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = _host_path(u)
        fit = [x for x in uf.RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fit, key=lambda x: len(x[0] + x[1]), default=None)
        r = got[i]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (best and best[0] + best[1]) and (best is None or r["verdict"] == best[2]) and r["verdict"] in ("allow", "block")
    # scores against the models written out
    want = _brute_scores(urls)
    assert all(abs(got[i]["score"] - want[u or ""]) < 1e-9 for i, u in enumerate(urls))


def test_rules_say_what_the_contract_says(spark):
    said = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: v for h, p, v in uf.RULES} == said
    urls = {f"http://{'www.' * sub}{rule}1": (rule, verdict) for rule, verdict in said.items() for sub in (0, 1)}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in uf.judge_urls(df).select("url", "rule", "verdict").collect()}
    assert got == urls
    # the SQL, too
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    assert {list(urls)[r[0]]: (r[3], r[4]) for r in con.execute(uf.SQL).fetchall()} == urls


def _brute_scores(urls):
    pad = lambda u: "\x02" * uf.ORDER + "".join(c.lower() if "A" <= c <= "Z" else c for c in u or "") + "\x03"
    n = defaultdict(lambda: [0, 0])
    grams = set()
    for u in urls:
        host, path = _host_path(u)
        fit = [x for x in uf.RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fit, key=lambda x: len(x[0] + x[1]), default=None)
        t = pad(u)
        side = None if best is None or int(hashlib.md5((u or "").encode()).hexdigest()[:8], 16) % 5 == 0 else 0 if best[2] == "allow" else 1
        for i in range(uf.ORDER, len(t)):
            grams.add(t[i - uf.ORDER : i + 1])
            for k in range(uf.ORDER + 1):
                if side is not None:
                    n[t[i - k : i + 1]][side] += 1
    letters = len({g[-1] for g in grams}) + 1
    ctx = defaultdict(lambda: [0, 0])
    for g, c in n.items():
        for s in (0, 1):
            ctx[len(g), g[:-1]][s] += c[s]

    def p(g, s):
        low = 1 / letters if len(g) == 1 else p(g[1:], s)
        return ((n[g][s] if g in n else 0) + uf.STRENGTH * low) / (ctx[len(g), g[:-1]][s] + uf.STRENGTH)

    out = {}
    for u in urls:
        t = pad(u)
        xs = [math.log(p(t[i - uf.ORDER : i + 1], 0) / p(t[i - uf.ORDER : i + 1], 1)) for i in range(uf.ORDER, len(t))]
        out[u or ""] = sum(xs) / len(xs)
    return out


def test_urls_need_no_python(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/1")], "page_id long, url string")
    plan = uf.grams(uf.by_rules(uf.host_path(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert uf.judge_urls(df.where("page_id > 5")).count() == 0


def test_urls_join_by_shuffle_and_may_be_long(spark, monkeypatch):
    urls = _urls() + ["http://a.example.com/en/" + "x" * 40_000, "http://m.b.example.net/de/" + "y" * 3000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("mine")).withColumn("gram", F.lit("mine"))
    row = lambda r: (r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], round(r["score"], 9))
    one = sorted(map(row, uf.judge_urls(df).collect()), key=str)
    monkeypatch.setattr(uf, "BROADCAST_GRAMS", 0)
    assert sorted(map(row, uf.judge_urls(df).collect()), key=str) == one and len(one) == len(urls)


# --- WARC -----------------------------------------------------------------------------------------------------------

FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: zz"


def _pages(prose):
    big = "<p>" + prose(1, 400)
    rows = [(i, f"http://x/{i}", f"<html>{prose(i, 5 + i * 3)}é\r\n\r\n{'x' if i % 4 else FAKE}tail{i}") for i in range(40)]
    rows += [(100, "u", big), (103, "u\r\nEvil: 1", big), (101, None, big), (200, "u", "small"), (201, "u", "small"), (300, None, None), (301, "u", ""), (302, "u", FAKE + FAKE), (103, "u", big), (None, "u", "no id"), (None, "v", big)]
    return rows


@pytest.mark.parametrize("split", ["128m", "4k"])
def test_round_trip(spark, prose, split):
    rows = _pages(prose)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    path = fresh_path(spark, "t")
    warc.write_warc(df, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)  # small splits cut records over tasks
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    top = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            top[b] = max(top.get(b, -1), i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and b in top and i != top[b] and Counter(x[2] for x in rows)[h] > 1
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[b] if again else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["digest_ok"] for r in got)


def test_splits_that_move_between_reads_lose_nothing(spark, prose, monkeypatch):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"{prose(i, 40)}{'' if i % 3 else FAKE}{prose(i + 1, 40)}") for i in range(60)], "page_id long, url string, html string").coalesce(2)
    path = fresh_path(spark, "t")
    warc.write_warc(df, path)
    read, parts = warc.pieces, iter(["3", "7", "2", "11"])

    def moved(*a):
        spark.conf.set("spark.sql.files.minPartitionNum", next(parts))
        return read(*a)

    monkeypatch.setattr(warc, "pieces", moved)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 60 and all(r["digest_ok"] for r in got)


def test_groups_of_equal_payloads_join_by_shuffle(spark, prose, monkeypatch):
    rows = _pages(prose) + [(500 + i, "u", "y" * 300_000) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.withColumns({c: F.lit("mine") for c in ("digest", "bytes", "leader", "value", "off", "file")})
    got = []
    for most in (warc.BROADCAST_ROWS, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        path = fresh_path(spark, "t")
        warc.write_warc(df, path)
        got.append(Counter(map(tuple, warc.read_warc(spark, path).collect())))
    assert got[0] == got[1] and sum(got[0].values()) == len(rows)


def test_pages_that_share_an_id_keep_their_payloads_apart(spark):
    a, b = "a" * 1500, "b" * 2500
    df = spark.createDataFrame([(9, "u", a), (9, "u", b), (3, "u", a), (4, "u", b), (4, "u", b)], "page_id long, url string, html string")
    path = fresh_path(spark, "t")
    warc.write_warc(df, path)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["digest_ok"]) for r in warc.read_warc(spark, path).collect())
    assert got == [(3, "revisit", 9, 1500, True), (4, "revisit", 9, 2500, True), (4, "revisit", 9, 2500, True), (9, "response", None, 1500, True), (9, "response", None, 2500, True)]


def test_files_are_warc(spark, prose, tmp_path):
    df = spark.createDataFrame(_pages(prose), "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, str(tmp_path / "w"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    n, at = 0, 0
    while at < len(raw):  # a plain reader: header, length, body, two line ends
        assert raw.startswith(b"WARC/1.1\r\n", at)
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length:")).split(b":")[1])
        at += len(head) + 4 + size
        assert raw[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == len(_pages(prose))


def test_empty_archive(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = fresh_path(spark, "t")
    warc.write_warc(df, path)
    assert warc.read_warc(spark, path).count() == 0


# --- line dedup -----------------------------------------------------------------------------------------------------


def _lines(prose):
    common = [prose(700 + i, 8) for i in range(6)]
    rows = []
    for i in range(60):
        ls = [prose(i * 10 + k, 4) for k in range(i % 4)]
        for k, c in enumerate(common):
            if (i + k) % (k + 2) == 0:
                ls.insert(i % (len(ls) + 1), ["  " + c.upper() + "\t", c, c + " "][i % 3])
        if i % 9 == 0:
            ls += [common[0], "short", "", "short"]
        rows.append((i, "\n".join(ls), "en", "s"))
    return rows + [(90, None, "en", "s"), (91, "", "en", "s"), (92, "\n\n", "en", "s"), (93, "x" * 19 + "\r\n" + "É" * 20, "en", "s"), (94, "É" * 20 + "\n" + "é" * 20, "en", "s"), (95, "É" * 20, "en", "s")]


def _brute_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    out = {}
    for i, t, *_ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)]))]
        out[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def _got(df):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()}


def test_lines_against_brute_force(spark, prose, doc):
    rows = _lines(prose)
    assert _got(ld.dedup_lines(doc(spark, rows, extra=True).repartition(3))) == _brute_lines(rows)
    assert ld.dedup_lines(doc(spark, [])).count() == 0


def test_lines_are_reversible(spark, prose, doc):
    rows = _lines(prose)
    a, b = rows[:40], rows[40:]
    one = ld.LineIndex.empty(spark, 4).insert(doc(spark, a))
    both = one.insert(doc(spark, b))
    assert _got(both.render(doc(spark, rows))) == _brute_lines(rows)
    back = both.delete(doc(spark, b).select("doc_id"))
    refs = lambda x: Counter((bytes(r["key"]), r["n_docs"], r["owner"]) for r in x.refs.collect())
    assert refs(back) == refs(one)
    assert _got(back.render(doc(spark, a))) == _brute_lines(a)
    cells = {r["shard"]: [] for r in back.filters.collect()}
    for r in back.filters.collect():
        cells[r["shard"]].append(bytes(r["cells"]))
    left = sum(int(np.count_nonzero(np.frombuffer(c, "<u2"))) for cs in cells.values() for c in cs)
    assert left == len(refs(one))  # each key has one fingerprint, forgotten keys have none


def test_documents_are_distinct_ids(spark, doc):
    import duckdb

    line = "a line of more than twenty characters"
    for more in ([], [(4, line + "\nx", "en", "s")]):
        rows = [(1, line, "en", "s"), (1, line, "en", "s"), (None, line, "en", "s"), (None, line, "en", "s"), (2, "x\n" + line, "en", "s"), *more]
        df = doc(spark, rows)
        got = sorted(str(tuple(r)) for r in ld.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect())
        assert sum("1, 1, 1" in r for r in got) == (2 if more else 0)
        documents = df.toPandas()
        documents["doc_id"] = documents["doc_id"].astype("Int64")
        assert got == sorted(str(r) for r in duckdb.sql(ld.SQL).fetchall()) and len(documents) == len(rows)


def test_index_equals_a_rebuild_after_any_history(spark, doc, monkeypatch):
    """Lines in pairs that share a fingerprint and its places; filters that are outgrown; ids that come back. The state is
    always as if only the documents that are in had ever been inserted."""
    many = [f"a line of some length, number {k}" for k in range(150_000)]
    met, lines = {}, []
    for line, *place in zip(many, *ld.Cuckoo.places(np.frombuffer(b"".join(ld.line_key(x)[:8] for x in many), "<u8"))):
        fp, one, two = map(int, place)
        other = met.setdefault((fp, min(one, two)), line)
        lines += [other, line] if other != line else []
    lines = lines[:14]
    assert len(lines) == 14
    monkeypatch.setattr(ld, "SHARD_KEYS", 12)
    rng = random.Random(11)
    state = lambda x: (Counter((bytes(r["key"]), r["n_docs"], r["owner"]) for r in x.refs.collect()), Counter((bytes(r["key"]), r["doc_id"]) for r in x.postings.collect()))
    index, have = ld.LineIndex.empty(spark, 1), {}
    for turn in range(4):
        add = {i: "\n".join(rng.sample(lines, 4)) for i in rng.sample(range(12), 4) if i not in have}
        again = {i: have[i] for i in rng.sample(sorted(have), min(2, len(have)))}
        index = index.insert(doc(spark, [(i, t, "en", "s") for i, t in (add | again).items()]))
        have |= add
        gone = rng.sample(sorted(have), 2)
        index = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        have = {i: t for i, t in have.items() if i not in gone}
        fresh = ld.LineIndex.empty(spark).insert(doc(spark, [(i, t, "en", "s") for i, t in have.items()]))
        assert state(index) == state(fresh)
        cells = sum(int(np.count_nonzero(np.frombuffer(r["cells"], "<u2"))) for r in index.filters.collect())
        assert cells == index.n_keys == len(state(fresh)[0])
    assert index.shards > 1
    rows = [(i, t, "en", "s") for i, t in have.items()]
    assert _got(index.render(doc(spark, rows))) == _brute_lines(rows)


def test_very_long_text_of_lines(spark, prose, doc):
    rows = [(i, "\n".join([prose(k, 5) for k in range(i, 3000 + i)] + [prose(1, 200_000)]), "en", "s") for i in range(3)]
    assert _got(ld.dedup_lines(doc(spark, rows))) == _brute_lines(rows)


def test_lines_with_one_fingerprint(spark, doc):
    # two lines that a filter can't tell apart: inserting and deleting one must not make it forget the other
    met, k = {}, 0
    while True:
        line = f"a line of some length, number {k}"
        fp, one, two = (int(x[0]) for x in ld.Cuckoo.places(np.frombuffer(ld.line_key(line)[:8], "<u8")))
        if (fp, min(one, two)) in met:
            break
        met[fp, min(one, two)], k = line, k + 1
    x, y = met[fp, min(one, two)], line
    rows = [(1, x, "en", "s"), (2, x, "en", "s"), (3, y, "en", "s"), (4, x, "en", "s")]
    index = ld.LineIndex.empty(spark, 1).insert(doc(spark, rows[:2])).insert(doc(spark, rows[2:3]))
    index = index.delete(doc(spark, rows[2:3]).select("doc_id")).insert(doc(spark, rows[3:]))
    left = [rows[0], rows[1], rows[3]]
    assert [(r["n_docs"], r["owner"]) for r in index.refs.collect()] == [(3, 4)]
    assert _got(index.render(doc(spark, left))) == _brute_lines(left)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**63), unique=True, max_size=400), st.integers(0, 400))
def test_cuckoo_remembers_and_forgets(keys, cut):
    h = np.array(keys, np.uint64)
    c = ld.Cuckoo()
    c.insert(h)
    assert c.contains(h).all()
    c.delete(h[:cut])
    assert c.contains(h[cut:]).all()
    assert sum(np.count_nonzero(b) for b in c.blocks) == len(h[cut:])


# --- quality --------------------------------------------------------------------------------------------------------


def _quality(prose):
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        t = prose(i, 80)
        if not good:
            t = " ".join(w.upper() + "!!" if i % 8 else w + "$%&" for w in t.split())
        rows.append((i, t + ".", "en", f"s{i % 7}"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_held_out(spark, prose, doc):
    rows, labels = _quality(prose)
    extra = [(900, None, None, None), (901, "", "en", None), (None, rows[1][1], "en", "new"), (1, rows[1][1], "en", "s1")]
    df = doc(spark, rows + extra, extra=True)
    lab = spark.createDataFrame([x for x in labels if x[0] % 2] + [x for x in labels if x[0] % 4 == 0 and x[0] % 8] + [(3, None, 0), (8, 5, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = ql.filter_quality(df, lab)
    assert kept.columns == df.columns and kept.where("quality_score <> 'mine-quality_score'").isEmpty()
    ids = {r["doc_id"] for r in kept.collect()}
    assert {i for i, q, _ in labels if q} <= ids and not {i for i, q, _ in labels if not q and i % 8 == 4} & ids and None in ids
    assert ql.score(df, lab).count() == len(rows) + len(extra)
    assert ql.filter_quality(df.where(F.lit(False)), lab).count() == 0
    none = lab.where(F.lit(False))
    assert ql.filter_quality(df, none).count() == len(rows) + len(extra)


def _brute_shifts(rows, labels, w):
    """The posterior algebra written out: rows of (host, path, logit), labels of (host, path, 0 or 1)."""
    p = [1 / (1 + math.exp(-z)) for *_, z in rows]
    each = [(h, t, 1.0, v) for (h, t, _), v in zip(rows, p)] + [(h, t, w, w * y) for h, t, y in labels]

    def sums(key):
        out = defaultdict(lambda: [0.0, 0.0])
        for h, t, n, v in each:
            out[key(h, t)][0] += n
            out[key(h, t)][1] += v
        return out

    path, host = sums(lambda h, t: (h, t)), sums(lambda h, t: h)
    n, s = (sum(x[k] for x in path.values()) for k in (0, 1))
    mean = min(max(s / n, 1e-4), 1 - 1e-4)

    def strength(sites):
        v = sum(x[0] * (x[1] / x[0] - mean) ** 2 for x in sites.values())
        between = max((v - len(sites) * mean * (1 - mean)) / n, 1e-9)
        return min(1e4, max(1.0, mean * (1 - mean) / between - 1))

    kh, kp = strength(host), strength(path)
    out = []
    for (h, t, _), own in zip(rows, p):
        m = (host[h][1] - own + kh * mean) / (host[h][0] - 1 + kh)
        m = (path[h, t][1] - own + kp * m) / (path[h, t][0] - 1 + kp)
        out.append(round(math.log(m / (1 - m)) - math.log(mean / (1 - mean)), 9))
    return out


def _shifts(spark, rows, labels):
    s = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, _host string, _path string, quality_logit double").repartition(3)
    r = ql.posteriors(s.drop("i"), spark.createDataFrame(labels, "_host string, _path string, _y double"))
    t = r.table.withColumnsRenamed({"_host": "h", "_path": "t"})
    j = s.join(t, s["_host"].eqNullSafe(t["h"]) & s["_path"].eqNullSafe(t["t"])).withColumn("x", r.shift())
    return [x["x"] for x in j.orderBy("i").collect()]


def test_posteriors_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["big", "big", "mid", None, "rare" + str(rng.randrange(30))]), rng.choice(["en", "de", None]), rng.gauss(1, 2)) for _ in range(600)]
    labels = [(h, t, float(rng.random() < 0.7)) for h, t, _ in rows if rng.random() < 0.2]
    got = _shifts(spark, rows, labels)
    assert len(got) == len(rows) and np.allclose(got, _brute_shifts(rows, labels, ql.LABEL_WEIGHT), atol=2e-9)


def test_sparse_sites_shrink_to_their_parents(spark):
    rows = [("big", "en", 2.0)] * 300 + [("big", "de", -2.0)] * 300 + [("big", "fr", -2.0)] + [("good", "en", 3.0)] * 200 + [("one", "en", -3.0)]
    got = dict(zip(((h, t) for h, t, _ in rows), _shifts(spark, rows, [])))
    assert got["big", "en"] > 0 > got["big", "de"] and got["good", "en"] > 0
    # one bad document says nothing about itself: its site is its parents
    assert got["big", "de"] < got["big", "fr"] and abs(got["one", "en"]) < 1e-6
    # labels at a site count
    bad = dict(zip(((h, t) for h, t, _ in rows), _shifts(spark, rows, [("good", "en", 0.0)] * 100)))
    assert bad["good", "en"] < got["good", "en"]


def test_quality_joins_by_shuffle_and_scores_at_the_threshold(spark, prose, doc, monkeypatch):
    rows, labels = _quality(prose)
    df, lab = doc(spark, rows + [(401, prose(1, 30_000), "en", "s1")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = {r["doc_id"]: r["quality_score"] for r in ql.score(df, lab, host="lang", path=("source", "lang")).collect()}
    monkeypatch.setattr(ql, "BROADCAST_SITES", 0)
    two = {r["doc_id"]: r["quality_score"] for r in ql.score(df, lab, host="lang", path=("source", "lang")).collect()}
    assert len(one) == len(rows) + 1 and np.allclose([one[i] for i in sorted(one)], [two[i] for i in sorted(one)])
    # no evidence and one site: every score is exactly one half, and what scores the threshold stays
    none = lab.where(F.lit(False))
    assert ql.filter_quality(df, none, reject_below=0.5).count() == len(rows) + 1
