import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join as nj
from tests_brute import components_of_pairs, linked, shingle_set


def _texts(prose):
    r = random.Random(2)
    out = [prose(i, r.choice([1, 2, 3, 5, 7, 9, 12, 30, 80])) for i in range(60)]
    base, base2 = prose(900, 100), prose(901, 11)
    for k in range(70):  # a group of near copies, some of them only linked through others
        w = base.split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        out.append(" ".join(w))
    for k in range(30):  # short near copies, the light side
        w = base2.split()
        if k % 3:
            w = w[: r.randint(9, 11)] + [f"y{k % 5}"] * (k % 2)
        out.append(" ".join(w))
    out += [out[0].upper(), "  " + out[5].replace(" ", "\t\n") + " ", "one two", "ONE  two", "one two three", None, "", " \t ", "é É", "É É"]
    shared = prose(950, 60)
    out += [shared + " " + prose(1000 + i, 100) for i in range(10)]  # a common passage links nobody
    return out


def _brute(texts):
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if linked(sets[i], sets[j])]
    return {i: (len(s), c) for (i, c), s in zip(sorted(components_of_pairs(pairs, range(len(sets))).items()), sets)}


@pytest.mark.parametrize("light", [None, 0, 24])
def test_against_brute_force(spark, prose, doc, monkeypatch, light):
    if light is not None:
        monkeypatch.setattr(nj, "boundary", lambda *_: light)
    texts = _texts(prose)
    df = doc(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], extra=True).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.components_of(df).collect()}
    assert got == _brute(texts)


def test_frequent_shingles_leave_tasks_as_numbers(spark, prose, doc, monkeypatch):
    monkeypatch.setattr(nj, "LOCAL", 3)  # read where rows are made: pickled with the function's module in local mode
    texts = [prose(1, 40) + f" end{i}" for i in range(12)] + [prose(2, 40)]
    got = {r["doc_id"]: r["component_id"] for r in nj.components_of(doc(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: (0 if i < 12 else 12) for i in range(13)}


def test_shingles(prose, monkeypatch):
    import numpy as np

    s = nj.shingles([prose(1, 30)])[0]
    assert (nj._unpack(nj._pack(s)) == s).all() and len(nj._unpack(nj._pack(s[:0]))) == 0
    texts = ["a b", " ", "", None, "a b c d", "a b c d e", "A b\x0bc\tD e ", "é b c d e", "É b c d e", "a\xa0b c d e f", "x" * 3000 + " y", "a b c d e a b c d e a b c d e f", "\ud800 b"]
    texts += [prose(k, k % 40) + "\n" * (k % 3) for k in range(200)]
    for size in (1 << 17, 50):  # in one batch, in many
        monkeypatch.setattr(nj, "BATCH_BYTES", size)
        got, of = nj.shingles(texts), {}
        for t, g in zip(texts, got):
            want = shingle_set(t)
            assert len(g) == len(want) and (np.diff(g.astype(np.int64)) > 0).all()
            of.setdefault(want, set()).add(g.tobytes())
        # equal sets have equal hashes, and shingles are told apart as well as sets
        assert all(len(v) == 1 for v in of.values()) and len({x for v in of.values() for x in v}) == len(of)
        assert len({h for g in got for h in g.tolist()}) == len({x for t in texts for x in shingle_set(t)})


def test_subset_sizes():
    for a in range(1, 40):
        for b in range(a, 60):
            k = nj.overlap(a, b)
            for inter in (k - 1, k):
                assert (100 * inter >= 75 * (a + b - inter)) == (inter >= k)
        assert nj.need(a) == min(nj.overlap(a, b) for b in range(1, 200) if nj.overlap(a, b) <= min(a, b))


def test_one_per_group_and_rows(spark, prose, doc):
    t = prose(5, 50)
    rows = [(3, t, "en", "s"), (1, t + " more", "en", "s"), (None, t, "en", "s"), (8, None, "en", "s"), (9, "", "en", "s"), (8, None, "en", "s")]
    df = doc(spark, rows, extra=True)
    left = nj.one_per_group(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 8, 8, 9]
    assert nj.components_of(df.where(F.lit(False))).count() == 0
    assert nj.one_per_group(df.where(F.lit(False))).count() == 0
    got = {(r["doc_id"], r["component_id"]) for r in nj.components_of(df).collect()}
    assert got == {(3, 1), (1, 1), (None, 1), (8, 8), (9, 9)}


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_per_group_tells_null_and_reused_ids_apart(spark, prose, doc, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(nj, "sized", lambda rows: rows)
    t, u, v = prose(5, 50), prose(6, 50), prose(7, 50)
    # no id at all; an id with two texts of different groups; an id with two texts of one group; a document met twice
    rows = [(None, t), (None, t + " x"), (4, u), (4, v), (7, u + " y"), (7, v + " z"), (2, prose(8, 50)), (2, prose(8, 50) + " w"), (5, prose(9, 40)), (5, prose(9, 40))]
    df = doc(spark, [(i, x, "en", "s") for i, x in rows]).repartition(4)
    left = [(r["doc_id"], r["text"]) for r in nj.one_per_group(df).collect()]
    assert len(left) == 6 and sum(x in (t, t + " x") for _, x in left) == 1
    assert sorted(i for i, x in left if x[:-2] in (u, v) or x in (u, v)) == [4, 4]
    assert sum(i == 2 for i, _ in left) == 1 and left.count((5, prose(9, 40))) == 2


def test_scans_of_lists_that_stay_apart(spark, prose, doc, monkeypatch):
    monkeypatch.setattr(nj, "SCAN_BYTES", 2000)  # many blocks
    r = random.Random(4)
    passage = prose(70, 45)
    # the passage is most of each text and links none of them; a chain of copies, each unlike all but its neighbours
    texts = [f"{passage} " + " ".join(f"t{r.randrange(60)}" for _ in range(25)) for _ in range(150)]
    chain = prose(71, 60).split()
    for k in range(40):
        chain[(7 * k) % 60] = f"c{k % 9}"
        texts.append(" ".join(chain))
    texts += [f"{passage} " + prose(72 + k % 3, 25) for k in range(12)]
    r.shuffle(texts)
    pairs = []
    scan = nj._scanned
    monkeypatch.setattr(nj, "_scanned", lambda *a: pairs.append(scan(*a)) or pairs[-1])
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in nj.components_of(doc(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3)).collect()}
    assert got == _brute(texts)
    a = pairs[0].collect()
    sets = {t: shingle_set(t) for t in texts}
    assert len(a) < 4 * len(sets)  # a forest for each pair of blocks, not pairs


def test_cost_picks_a_light_boundary(spark, doc):
    """Short texts that share their rarest shingles: here subsets cost less than scans, and the rule says so itself."""
    r = random.Random(3)
    texts = []
    for k in range(400):
        words = [f"s{r.randrange(3)}" for _ in range(r.choice([5, 6, 7, 8]))]
        texts.append(" ".join(words))
    df = doc(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    _, sets = nj.classes(df)
    lists = nj.inverted(sets)
    assert nj.boundary(sets, lists) > 0
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in nj.components_of(df).collect()}
    assert got == _brute(texts)


def test_subsets_come_a_few_at_a_time(spark, prose, doc, monkeypatch):
    toks = lambda n: np.arange(n, dtype="<u8").tobytes()
    for n in (1, 6, 14, 18):  # partners of all sizes: as many as the cost counts
        assert sum(1 for _ in nj.subsets_of([(b"s", n, toks(n))], 100)) == nj._subsets(n, n)
    first = next(nj.subsets_of(((bytes([k]), 60, toks(60)) for k in range(250)), 100))  # more than memory holds: never listed whole
    assert len(first[0]) == 16 and first[1:] == (False, b"\0")
    monkeypatch.setattr(nj, "boundary", lambda *_: 24)
    monkeypatch.setattr(nj, "SUBSETS", 5)
    texts = [t for i in range(12) for t in (prose(i, 9), prose(i, 9) + " end", prose(i, 9) + " two ends")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in nj.components_of(doc(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == _brute(texts)


def test_very_long_text_and_exact_threshold(spark, prose, doc):
    long = prose(80, 60_000)
    # sets of 7 shingles that share 6 of 8 link (75 of 100), sets of 6 that share 5 of 7 don't
    tie = [" ".join(f"w{i}" for i in range(11)), " ".join(f"w{i}" for i in range(10)) + " q", " ".join(f"v{i}" for i in range(10)), " ".join(f"v{i}" for i in range(9)) + " q"]
    texts = [long, long + " and more", "x " + long, *tie]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in nj.components_of(doc(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == _brute(texts) and got[4][1] == 3 and got[6][1] == 6
