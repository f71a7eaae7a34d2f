import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontamination as dc


def _bench(prose):
    items = {i: prose(500 + i, 14 + i) for i in range(10)}
    items[20] = "Anna has 12 apples and gives 5 of them to Bert, then walks 3 km home; how many apples has Anna left?"
    items[21] = "short item here now please"
    items[22] = "tiny one"
    return items


def _naive(text, items):
    """Items held word by word."""
    w = [x.lower() for x in dc._TOKEN.findall(text or "")]
    out = set()
    for i, t in items.items():
        v = [x.lower() for x in dc._TOKEN.findall(t or "")]
        if v and (any(w[k : k + len(v)] == v for k in range(len(w) - len(v) + 1)) if len(v) > 4 else w == v):
            out.add(i)
    return out


def test_verbatim_against_brute_force(spark, prose, doc):
    items, r = _bench(prose), random.Random(3)
    rows = []
    for i in range(120):
        t = prose(i, r.randint(0, 80))
        if i % 3 == 0:
            k = r.choice(list(items))
            t = t + ". " + (items[k].upper() if i % 2 else items[k]) + "\n" + prose(1000 + i, 5)
        rows.append((i, t, "en", "s"))
    rows += [(200, None, "en", "s"), (201, "", "en", "s"), (202, "tiny one", "en", "s"), (203, "a tiny one", "en", "s"), (None, items[3], "en", "s"), (3, items[4], "en", "s"), (3, items[4], "en", "s")]
    df = doc(spark, rows, extra=True)
    b = spark.createDataFrame([*items.items(), (30, None), (31, ""), (0, items[0])], "item_id long, text string")
    every = dc.matches(df, b).collect()
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in every if r["kind"] == "whole")
    want = sorted((str(i), k) for i, t, *_ in rows for k in _naive(t, items))
    assert got == want
    short = {(r["doc_id"], r["item_id"]) for r in every if r["kind"] == "short"}
    assert short == {(i, 22) for i, t, *_ in rows if " tiny one" in f" {t or ''}".lower() and t != "tiny one"}
    clean = dc.decontaminate(df, b)
    assert clean.columns == df.columns
    assert clean.count() == sum(not _naive(t, items) for _, t, *_ in rows)
    strict = dc.decontaminate(df, b, short=True)
    assert strict.count() == sum(not _naive(t, items) and (i, 22) not in short for i, t, *_ in rows)
    assert dc.matches(df.where(F.lit(False)), b).count() == 0 and dc.matches(df, b.where(F.lit(False))).count() == 0


def held(text, item):
    """What is told of every alignment there is, those of shared windows as the join makes them."""
    (x, kx, _), (y, ky, _) = dc.encode([text]), dc.encode([item])
    n = min(dc.WINDOW, len(y))
    own = {(h, p) for ps, hs, weak in dc.windows(y, ky, n) if dc.wordy(ky) or not weak for p, h in zip(ps.tolist(), hs.tolist())}
    shifts = {p - q for ps, hs, _ in dc.windows(x, kx, n) for p, h in zip(ps.tolist(), hs.tolist()) for g, q in own if g == h}
    return dc.judge(x, kx, y, ky, shifts)


def find(text, items):
    return [i for i, t in items.items() if held(text, t)]


def test_reparameterised_questions(prose):
    q = _bench(prose)[20]
    again = q.replace("Anna", "Clara").replace("Bert", "David").replace("12", "40").replace(" 5 ", " 17 ").replace("3 km", "9 miles")
    assert find("So: " + again, {20: q}) == [20]
    m = held(again, q)
    assert m[3] is False and m[1] == m[2]
    # one name becoming two different ones breaks the slots apart
    mixed = again.replace("has Clara left", "has Emil left")
    assert held(mixed, q)[1] < m[2]
    assert find(prose(1, 200), {20: q}) == []


def test_partly_quoted_items(prose):
    item = prose(77, 30)
    w = item.split()
    assert find(" ".join(w[:14]), {1: item}) == [1]
    assert find(" ".join(w[:9]), {1: item}) == []
    broken = " ".join(w[:10] + ["zzz"] + w[11:20] + ["yyy"] + w[21:])
    assert find(broken, {1: item}) == [1]


def test_low_content_windows_match_only_unchanged():
    item = "1 2 3 4 5 6 7 8 9 10 11 12 13 14"
    assert find(item, {1: item}) == [1]
    assert find("21 22 23 24 25 26 27 28 29 30 31 32 33 34", {1: item}) == []


def test_long_text_and_joins_by_shuffle(spark, prose, doc, monkeypatch):
    items = _bench(prose)
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(dc, "sized", lambda rows: rows)
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    df = doc(spark, [(1, prose(1, 200_000) + " " + items[7] + " " + prose(2, 1000), "en", "s"), (2, prose(3, 50), "en", "s")])
    assert [(r["doc_id"], r["item_id"]) for r in dc.matches(df, b).collect()] == [(1, 7)]
    assert [r["doc_id"] for r in dc.decontaminate(df, b).collect()] == [2]


def test_questions_of_few_words_between_slots():
    a = "Ann pays 5 dollars for 3 kg and Bob pays 7 dollars for 4 kg of rice"
    b = "Anna drives 120 km in 2 hours and Ben drives 90 km in 3 hours. Who is faster?"
    items = {1: a, 2: b}
    assert find("So: Carla pays 6 dollars for 2 kg and Dirk pays 9 dollars for 8 kg of rice.", items) == [1]
    assert find("Carl drives 150 km in 4 hours and Dora drives 80 km in 5 hours. Who is faster?", items) == [2]
    # slots that don't map one to one, and the same types with other words
    assert find("Carla pays 6 dollars for 6 kg and Carla pays 6 dollars for 6 kg of rice", items) == []
    assert find("Carl sells 150 km by 4 hours or Dora sells 80 km by 5 hours. Who was slower?", items) == []


def test_reparameterised_items_against_brute_force(spark, prose, doc):
    """Questions asked again with other names, numbers and units, or broken, against every alignment of every pair."""
    r = random.Random(8)
    names, units = ["Ann", "Bob", "Carla", "Dirk", "Eva", "Finn"], ["kg", "km", "miles", "dollars", "hours"]
    verbs = [w for w in prose(60, 300).split()]
    shapes = [[r.choice(verbs) for _ in range(14)] for _ in range(12)]

    def asked(shape, k):
        q, who, what = random.Random(k), random.Random(k).sample(names, 2), random.Random(k).sample(units, 2)
        a, b = q.randrange(2, 90), q.randrange(2, 90)
        w = list(shape)
        return " ".join([who[0], w[0], w[1], str(a), what[0], *w[2:5], who[1], w[5], str(b), what[1], *w[6:9], who[0], *w[9:14]])

    items = {i: asked(s, i) for i, s in enumerate(shapes)}
    rows = []
    for i in range(160):
        k = i % 12
        t = asked(shapes[k], 100 + i)
        if i % 4 == 1:  # one name for two: not the same question any more
            for x in names:
                t = t.replace(x, "Gus")
        if i % 4 == 2:
            t = " ".join(w if r.random() < 0.8 else "else" for w in t.split())
        if i % 4 == 3:
            t = prose(i, 40)
        rows.append((i, prose(300 + i, 9) + ". " + t + " " + prose(600 + i, 9), "en", "s"))
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(m["doc_id"], m["item_id"]): (m["first_token"], m["n_tokens"], m["item_tokens"], m["verbatim"]) for m in dc.matches(doc(spark, rows).repartition(4), b).collect()}
    want = {(i, k): h[:4] for i, t, *_ in rows for k, item in items.items() if (h := held(t, item))}
    assert got == want
    asked_again = {(i, i % 12) for i in range(0, 160, 4)}
    assert asked_again <= set(got)  # recall 1.0 on what was only asked with other values
    assert not {(i, k) for i, k in got if i % 4 == 3}


def test_filter_lets_all_members_through(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 50_000)
    filt = dc.bloom(spark.createDataFrame([(int(x),) for x in h], "h long"), len(h))
    assert len(dc.passing(h.view(np.uint64), filt)) == len(h)
    assert len(dc.passing(rng.integers(0, 2**63 - 1, 100_000).view(np.uint64), filt)) < 100


def _plain(text):
    """Tokens and kinds, one by one."""
    out = []
    for x in dc._TOKEN.findall(text or ""):
        if x[0].isdigit() and x[0].isdecimal():
            kind = dc.NUMBER
        elif x.lower() in dc.UNITS:
            kind = dc.UNIT if out and out[-1][1] == dc.NUMBER else dc.WORD
        else:
            kind = dc.NAME if x[0].isupper() and (len(x) == 1 or x[1:].islower()) else dc.WORD
        out.append((x.lower(), kind))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aAbé Éñ0123.,-_kmKM\n²ǅßΣσ\U00020000", max_size=60)), max_size=6))
def test_tokens_of_a_batch_are_those_of_the_pattern(texts):
    import numpy as np

    lit, kind, start = dc.encode(texts)
    want = [_plain(t) for t in texts]
    assert np.diff(start).tolist() == [len(w) for w in want] and kind.tolist() == [k for w in want for _, k in w]
    flat, known = [x for w in want for x, _ in w], {}
    for h, x in zip(lit.tolist(), flat):
        # equal lower-cased tokens have equal hashes, others don't (but for special cases of lower())
        if all(len(c.lower()) == 1 for c in x) and "ς" not in x and "σ" not in x:
            assert known.setdefault(x, h) == h
    assert len(set(known.values())) == len(known)
