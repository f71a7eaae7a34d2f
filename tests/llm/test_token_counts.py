import random

import pytest

from tessera.llm import token_counts as tc

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(tc.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "  a", "a  b", "a \n b", "it's we'll they've I'm 're 'd 'x ''s \"'s '", "don't  'tis  's", "x'llama'vest'reD'S", "é's 12's 1a2b 3½ ²x", "\t\tif x:\r\n\r\n  y",
    "a\u00a0b \u00a0 \u2003c\u3000", "\x1c\x1d a\x1fb \x85c", "日本語 テスト 한국어 ١٢٣ ⅷ", "e\u0301 \u0327 👍🏽 👍 family", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c  <|endoftext|>", "<|endof", "\x00\x00 a\x00", "\U0001e900 \u0e3f\u1c80 \u2fff",
]


def test_splits_as_the_library(library):
    splitter = tc.Splitter(PATH)
    rng = random.Random(3)
    alphabet = ["'", "s", "t", "re", "ll", " ", " ", "  ", "\n", "\t", "a", "B", "7", "½", "é", "\u00a0", "\u2028", "!", "-", "語", "\u0301", "\x1c", "\x85", "👍", "\u0e3f"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    chunk = tc._Chunk(splitter)
    for k, t in enumerate(texts):
        chunk.add(k, t or "")
    meta, *rows = chunk.rows(0, 3)
    n = [0] * len(texts)
    for k, a in enumerate(tc._wide(meta["added"]).tolist()):
        n[k] += a
    for r in rows:
        at, words = 0, []
        for size in tc._wide(r["lengths"]).tolist():
            words.append(r["words"][at : at + size])
            at += size
        held = [w for w, h in zip(words, tc._wide(r["holders"]).tolist()) for _ in range(h)]
        for w, d, f in zip(held, tc.np.frombuffer(r["documents"], tc.np.uint16).tolist(), tc._wide(r["times"]).tolist()):
            n[d] += f * splitter.pieces(w)
    assert n == [library(t) for t in texts]


def test_every_character_is_classed_as_by_the_library():
    splitter, classes = tc.Splitter(PATH), tc._classes()
    sure = [c for c in range(0x3000) if classes[c] != tc._UNSURE and not 0xD800 <= c < 0xE000]
    # After a letter, a number and a mark: the one a character joins is of its class; white space comes in runs of two.
    text = "".join(f"\na{chr(c)}\n1{chr(c)}\n!{chr(c)}\n" for c in sure)
    got = {}
    for p in splitter.slow(text):
        if len(p) == 2 and p[0] in "a1!":
            got.setdefault(p[1], set()).add(p[0])
    for c in sure:
        want = {tc._LETTER: {"a"}, tc._NUMBER: {"1"}, tc._OTHER: {"!"}, tc._SPACE: set()}[classes[c]]
        assert got.get(chr(c), set()) == want, hex(c)


def test_equals_library(spark, doc, prose, library, monkeypatch):
    monkeypatch.setattr(tc, "CHUNK_DOCUMENTS", 7)
    monkeypatch.setattr(tc, "BLOCK", 900)
    rows = [(k, t, "en", "s") for k, t in enumerate(ODD)] + [(None, "one two", None, None), (2**62 + 1, "big id", None, None), (3, "same id", "en", "s"), (3, "same id", "en", "s")]
    rows += [(100 + k, prose(k, 5 + 30 * k), "en", "s") for k in range(20)] + [(200, prose(1, 3000) + "'s <|endoftext|> " + "x" * 5000 + "  \n" + prose(2, 2000), "en", "s"), (201, " " * 4000 + "a", "en", "s")]
    got = tc.count_tokens(doc(spark, rows, extra=True).repartition(3)).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(tuple, got), key=key) == sorted([(r[0], len((r[1] or "").encode()), library(r[1])) for r in rows], key=key)


def test_empty(spark, doc):
    assert tc.count_tokens(doc(spark, [])).collect() == []


def test_other_kinds_raise():
    with pytest.raises(ValueError, match="byte-level"):
        tc.Splitter(public_tokenizers.path("word_bpe_49k.json"))


def test_registered_query(spark, library):
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), library(r["text"]), library(r["text"]) > 1024) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    assert sorted(map(tuple, tc.op12_token_counts(spark, d).collect())) == want
