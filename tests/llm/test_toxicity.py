import itertools
import random
import zlib

import numpy as np

from tessera.llm import toxicity as tox


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    a = ((1.3, 0.4), (0.7, 2.1))
    seqs = [rng.normal(0, 2, n) for n in (5, 0, 1, 3, 7)]
    pairs = []
    got = tox.marginal(seqs, a, pairs)
    moves = np.zeros(4)
    for s, p in zip(seqs, got):
        total, one = 0.0, np.zeros(len(s))
        two = np.zeros(4)
        for y in itertools.product((0, 1), repeat=len(s)):
            w = np.exp(sum(e for e, v in zip(s, y) if v)) * np.prod([a[i][j] for i, j in zip(y, y[1:])])
            total += w
            one += w * np.array(y, float)
            for i, j in zip(y, y[1:]):
                two[2 * i + j] += w
        if len(s):
            np.testing.assert_allclose(p, one / total, rtol=1e-9)
            moves += two / total
        else:
            assert len(p) == 0
    np.testing.assert_allclose(np.sum(pairs, axis=0), moves, rtol=1e-9)
    none = []
    tox.marginal(seqs, a, none=none)
    for s, z in zip(seqs, none):
        total = sum(np.exp(sum(e for e, v in zip(s, y) if v)) * np.prod([a[i][j] for i, j in zip(y, y[1:])]) for y in itertools.product((0, 1), repeat=len(s)))
        np.testing.assert_allclose(z, np.log(a[0][0] ** max(0, len(s) - 1) / total), rtol=1e-9, atol=1e-12)


def test_the_pull_of_a_label_is_its_posterior(prose):
    """fit's gradient for a toxic document: expectations given that not all tokens are clean, less the free ones."""
    rng = np.random.default_rng(4)
    a, s = ((1.2, 0.5), (0.6, 1.9)), rng.normal(-1, 1, 6)
    none: list = []
    p = tox.marginal([s], a, none=none)[0]
    total, some, one = 0.0, 0.0, np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(e for e, v in zip(s, y) if v)) * np.prod([a[i][j] for i, j in zip(y, y[1:])])
        total += w
        if any(y):
            some += w
            one += w * np.array(y, float)
    z = none[0]
    np.testing.assert_allclose(one / some - p, np.exp(z - np.log(-np.expm1(z))) * p, rtol=1e-9)


def test_company_against_brute_force():
    rng = np.random.default_rng(6)
    for n in (0, 1, 40, 300):
        at, word = np.sort(rng.choice(2000, n, replace=False)), rng.integers(0, 5, n)
        want = [min(tox.CROWD, sum(abs(int(at[i] - at[j])) <= tox.NEAR and word[i] != word[j] for j in range(n))) for i in range(n)]
        assert tox.company(at, word).tolist() == want


def _corpus(prose, n, seed=0):
    bad = ["vaxor", "grumpf", "zoltek"]
    out = []
    for i in range(n):
        t = prose(seed + i, 60).split()
        y = int(i % 4 == 0)
        for k in range(3 * y):
            t.insert((i * 13 + 17 * k) % len(t), bad[(i + k) % 3])
        out.append((" ".join(t), y))
    return out


def test_held_out_accuracy_and_spans(spark, prose, doc):
    rows = _corpus(prose, 400)
    docs = doc(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(rows)] + [(1000, None, "en", "s"), (1001, "", None, None), (None, rows[0][0], "en", "s"), (7, rows[7][0], "en", "s")], extra=True)
    labels = spark.createDataFrame([(i, None, y) for i, (_, y) in enumerate(rows)] + [(5000, 1, 1), (None, 1, 1), (3, 1, None), (4, 1, 7)], "doc_id long, quality int, toxic int")
    out = tox.tag(docs, tox.train(docs, labels)).collect()
    assert len(out) == len(rows) + 4
    by = {r["doc_id"]: r for r in out}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((by[i]["score"] >= tox.THRESHOLD) == (rows[i][1] == 1) for i in held)
    i = next(i for i in held if rows[i][1])
    assert {rows[i][0][s["first"] : s["past"]] for s in by[i]["spans"]} <= {"vaxor", "grumpf", "zoltek"} and by[i]["spans"]
    assert by[1000]["score"] == by[1001]["score"] < tox.THRESHOLD and by[None]["score"] >= tox.THRESHOLD
    assert all(0 <= r["score"] <= 1 for r in out)


def test_copies_dont_teach(prose):
    # forty copies of one toxic text: its rare words have a single context each and mark nothing
    rows = _corpus(prose, 200)
    copies = [("qwerx qworz " + rows[0][0] + f" {k}", 1) for k in range(40)]
    m = tox.fit(rows + copies)
    assert {"vaxor", "grumpf", "zoltek"} <= set(m.weights) and not {"qworz"} & set(m.weights)


def test_a_word_may_be_clean_alone_and_toxic_in_company(prose):
    """Endings differ, so only beginnings can be learned; clean documents hold such a word too, but one alone."""
    r = random.Random(2)
    ends = [a + b for a in ("un", "ta", "ri", "mo", "ke", "sol") for b in ("pen", "dat", "lin", "gur", "fes", "om")]
    rows = []
    for i in range(900):
        t = prose(i, 120).split()
        bad = i % 6 == 0
        for _ in range(4 if bad else int(i % 3 == 0)):
            t.insert(r.randrange(len(t)), r.choice(["brask", "gloim"]) + r.choice(ends))
        rows.append((" ".join(t), int(bad)))
    m = tox.fit(rows[:600])
    score, spans = m.score([t for t, _ in rows[600:]])
    assert all((s >= tox.THRESHOLD) == (y == 1) for s, (_, y) in zip(score, rows[600:]))
    assert m.near[0] < m.near[1]
    words = {t[a:b][:5] for (t, y), found in zip(rows[600:], spans) for a, b in found if y}
    assert {"brask", "gloim"} <= words


def test_no_labels(spark, doc):
    docs = doc(spark, [(1, "a b", "en", "s")])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in tox.tag(docs, tox.train(docs, empty)).collect()] == [0.0]
    assert tox.tag(docs.where("doc_id > 5"), tox.train(docs.where("doc_id > 5"), empty)).count() == 0


def test_long_text():
    m = tox.Model({"bad": 9.0}, -12.0, (7.0, 8.0, 9.0), ((1.0, 0.5), (0.5, 1.0)), (1.0, 1.0, 1.0, -3.0))
    s, spans = m.score(["bad " + "word " * 300_000 + "bad", "bad", None])
    assert spans[0] == [(0, 3), (1_500_004, 1_500_007)] and spans[1] == [(0, 3)] and s[2] < s[1]


def test_the_field_is_fitted_on_every_document(prose, monkeypatch):
    # words of texts that sort last, behind far more than 250,000 tokens of others
    rows = [("a " + prose(i, 1500), 0) for i in range(200)] + [("b " + prose(900 + i, 20) + " vaxor", 1) for i in range(30)]
    late = [("я " + prose(2000 + i, 20) + " зхыъ " + prose(3000 + i, 5), 1) for i in range(30)] + [("я " + prose(4000 + i, 40), 0) for i in range(30)]
    seen, real = [], tox.marginal
    monkeypatch.setattr(tox, "marginal", lambda seqs, a, pairs=None, none=None: (seen.append(sum(map(len, seqs))), real(seqs, a, pairs, none))[1])
    m = tox.fit(rows + late, rounds=6)
    assert sum(seen) == 7 * sum(len(tox._TOKEN.findall(t)) for t, _ in rows + late)  # the last for calibration
    assert {"vaxor", "зхыъ"} <= set(m.weights)


def test_repeated_rows_and_labels_of_both_kinds(spark, prose, doc):
    rows = _corpus(prose, 120)
    docs = doc(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(rows)] * 2)
    # a document with both labels is toxic
    labels = spark.createDataFrame([(i, 0, y) for i, (_, y) in enumerate(rows)] + [(i, 0, 0) for i, (_, y) in enumerate(rows) if y], "doc_id long, quality int, toxic int")
    got = {(r["doc_id"], r["score"]) for r in tox.tag(docs, tox.train(docs, labels)).collect()}
    assert len(got) == len(rows) and all((x >= tox.THRESHOLD) == (rows[i][1] == 1) for i, x in got)
