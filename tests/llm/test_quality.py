import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from octetloom.llm import quality as q
from tests.llm import brute

DOCS = "doc_id long, text string, kept boolean, n_words string"


def plain(text):
    ws = brute.words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if brute.words(line):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {j for i in range(len(ws) - 2) if win[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (len(ws), sum(map(len, ws)), sum(c in q.SYMBOLS for c in text or ""), dup, len(covered))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "a b a", " ", "\n", "\t\n", "é", "日本", "#*", "a b\n", "\x1c", " ", "\x0b", "$"]), max_size=30).map("".join))
def test_counts_match_brute_force(text):
    assert q.text_counts(text)[:5] == plain(text)


def test_rules_are_found_and_ordered():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 100, size=(3000, len(q.TESTED)))
    low = (x[:, 1] > 80) | (x[:, 5] <= 10) & (x[:, 2] > 30)
    rules = q.learn(x, low)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= q._covers(r, x)
    assert (hit == low).mean() > 0.99 and len(rules) <= 6
    assert q.learn(x, np.zeros(3000)) == [] and q.learn(x[:0], low[:0]) == []


def test_expression_says_what_the_rules_say(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        ws = [rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(60, 90))]
        if i % 4 == 0:
            ws = [w + "***" for w in ws]
        rows.append((i, " ".join(ws), None, None))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 600, 2)], "doc_id long, quality int")
    rules = q.fit(docs, labels)
    got = q.judged(docs, rules).select("doc_id", "kept", "base_failed", *[q.value(n).alias(n + "_") for n in q.TESTED]).collect()
    for r in got:
        x = np.array([[r[n + "_"] for n in q.TESTED]])
        assert r.kept == (not r.base_failed and not any(q._covers(rule, x)[0] for rule in rules))
        assert r.kept == (r.doc_id % 4 > 0)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "", True, "x"), (2, "w " * 100, None, None), (2, "w " * 100, None, None), (3, " ".join(map(str, range(200_000))), None, None)], DOCS)
    got = sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in q.judged(docs, q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))).collect())
    assert got == [("1", 0, True, False), ("2", 100, True, False), ("2", 100, True, False), ("3", 200_000, False, True), ("None", 0, True, False)]
    assert q.judged(docs.where(F.lit(False)), []).count() == 0
