import random

import numpy as np
import pytest

from octetloom.llm import substrings
from tests.llm import brute

SCHEMA = "doc_id long, text string, kept string, block long"


def run(spark, docs, parts=3, **how):
    df = spark.createDataFrame([(i, t, None, i) for i, t in docs], SCHEMA).repartition(parts)
    return {r.doc_id: (r.n_words, r.kept) for r in substrings.without_repeats(df, **how).collect()}


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_words_are_those_between_blanks(chunk, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = ["".join(rng.choice(["a", "bc", "é", " ", "\n", "\t", "\x0b", "\xa0", "z" * 130]) for _ in range(rng.randrange(90))).encode() for _ in range(60)] + [b"", b" "]
    block = substrings.Block(np.arange(len(texts)), np.ones(len(texts), bool), texts)
    block.hash(True)
    words = [w for t in texts for w in t.split()]
    assert len(block.h) == len(words) and np.diff(block.first).tolist() == [len(t.split()) for t in texts]
    for h in (block.h, block.h2):
        assert len({(w, int(x)) for w, x in zip(words, h)}) == len(set(words)) == len(set(h.tolist()))


@pytest.mark.parametrize("window,period,cover", [(50, 31, substrings.COVER), (10, 7, (1, 2, 4)), (7, 7, (0, 1, 3))])
def test_matches_brute_force(spark, window, period, cover, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 3000)
    rng = random.Random(window)
    vocab = [f"w{i}" for i in range(40)] + ["é", "日本"]
    passages = [rng.choices(vocab, k=rng.choice([window - 1, window, window + 1, 2 * window, 3 * window])) for _ in range(8)]
    docs = []
    for i in range(120):
        ws = []
        for _ in range(rng.randrange(0, 4)):
            ws += rng.choices(vocab, k=rng.randrange(0, 30))
            p = rng.choice(passages)
            a = rng.randrange(0, 3)
            ws += p[a : len(p) - rng.randrange(0, 3)]
        docs.append((i * 7 % 120, rng.choice([" ", "\n", " \t"]).join(ws)))
    docs += [(200, None), (201, ""), (202, " \n"), (203, " ".join(["again"] * 400)), (204, " ".join(["again"] * 60))]
    want = {d: (n, " ".join(ws)) for d, (n, ws) in brute.without_repeats(dict(docs), window).items()}
    assert run(spark, docs, window=window, period=period, cover=cover) == want


def test_repeats_nulls_and_no_rows(spark):
    text = " ".join(f"t{i}" for i in range(80))
    df = spark.createDataFrame([(4, text, None, 1), (4, text, None, 1), (None, text, None, 1), (9, text + " end", None, 1)], SCHEMA).coalesce(1)
    got = sorted((str(r.doc_id), r.n_removed) for r in substrings.without_repeats(df).collect())
    assert got == [("4", 0), ("4", 0), ("9", 80), ("None", 0)]
    assert run(spark, []) == {}
