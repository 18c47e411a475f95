import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from octetloom.llm import toxicity as tx

DOCS = "doc_id long, text string, toxic int, score double"


@pytest.mark.parametrize(
    "text,kind",
    [
        ("a calm day", -1),
        ("the fool came", 0),
        ("you are a fool", 1),
        ("he is not a fool", 2),
        ("not that i mind but what a fool he is", 1),
        ("she said what a fool", 3),
        ("i will kill you", 4),
        ("they kill time", 4),
        ("kill the process", -1),
    ],
)
def test_grammar_reads_clauses(text, kind):
    model = tx.Model({"fool": 2.0})
    state = 0
    for w in text.split():
        state = tx.GRAMMAR.step[state][model.read(w)[0]]
    assert tx._KIND_OF[state] == kind


def test_composition_runs_both():
    a, b = tx._seen(tx.INSULT), tx._before(tx.NEGATE, 2, (tx.INSULT,))
    both, rng = a.compose(b), random.Random(0)
    for _ in range(200):
        word, x, y, z = [rng.randrange(6) for _ in range(8)], 0, 0, 0
        for c in word:
            x, y, z = a.step[x][c], b.step[y][c], both.step[z][c]
        assert both.out[z] == a.out[x] + b.out[y]


def plain_score(model, text):
    """A document's score by splitting it into clauses and looking at the words around the first insult or threat of each."""
    worth, clauses = 0.0, {tuple(re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+)*", c)) for c in re.split(r"[.!?;\n]", (text or "").lower())}
    for words in clauses:
        arcs = [max([model.whole.get(w, 0.0)] + [x for start, x in model.starts.items() if w.startswith(start) and w != start]) for w in words]
        threats = [0.0 if a else model.threats.get(w, 0.0) for a, w in zip(arcs, words)]
        hot = [i for i, (a, t) in enumerate(zip(arcs, threats)) if a or t]
        if not hot:
            continue
        rest = [w if i not in hot else "" for i, w in enumerate(words)]
        near = lambda listed, n: any(w in listed for w in rest[max(0, hot[0] - n) : hot[0]])
        # A word of several lists is of the last of them.
        spoken = any(w in tx.TARGET and w not in tx.NEGATION and w not in tx.REPORT for w in rest)
        if not any(arcs) and not spoken:
            continue
        reported, negated = near(tx.REPORT, 8), near([w for w in tx.NEGATION if w not in tx.REPORT], 3)
        kind = "reported" if reported else "negated" if negated else "threat" if not any(arcs) else "aimed" if spoken else "plain"
        worth += model.factors[tx.KINDS.index(kind)] * (sum(arcs) + sum(threats))
    z = model.bias + model.slope * math.log1p(worth)
    return 1 / (1 + math.exp(-z))


MODEL = tx.Model({"gromp": 6.0, "snarf": 2.5}, {"quax": 3.0, "quaxu": 4.0}, {"kill": 6.0, "hurt": 4.0}, bias=-6.0, slope=3.0)


def test_scores_match_brute_force():
    rng, automaton, seen = random.Random(9), MODEL.automaton(), set()
    words = ["gromp", "snarf", "quaxula", "quaxel", "quax", "kill", "hurt", "x-gromp", "you", "she", "not", "never", "said", "called", "le", "tree", "İx", "9"]
    for _ in range(3000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "\n", "!"]) for _ in range(rng.randrange(0, 25)))
        got = MODEL.score(text.upper() if rng.random() < 0.1 else text, automaton)
        assert got == pytest.approx(plain_score(MODEL, text.upper() if "ə" in text else text)), text
        seen.add(round(got, 3))
    assert len(seen) > 50


def test_kinds_are_in_order():
    score = lambda t, a=MODEL.automaton(): MODEL.score(t, a)
    aimed, plain = score("you are a gromp"), score("what a gromp")
    weak = [score("you are not a gromp"), score("she said you gromp"), score("they called him a gromp")]
    assert aimed > plain > max(weak) and score("i will kill you") > 0.5 and score("kill the process") == score("")
    assert score("gromp. " * 90) == plain
    for factors in ([f[i] for i, f in zip(at, tx.FACTORS)] for at in [(0, a, n, r, t) for a in range(3) for n in range(3) for r in range(3) for t in range(3)]):
        assert factors[1] > factors[0] > max(factors[2], factors[3])


def test_threat_arcs_follow_the_labels(spark):
    toxic = [(i, f"word{i} i will stab him word{i + 1}. other{i * 7}", 1, None) for i in range(60)]
    clean = [(1000 + i, f"word{i} they beat him{' ' * (i % 3)} other{i * 5}", 0, None) for i in range(240)]
    docs = spark.createDataFrame(toxic + clean, DOCS)
    model = tx.fit(docs, docs.select("doc_id", "toxic"))
    assert "stab" in model.threats and model.threats["stab"] > model.threats["beat"] and model.threats["kill"] == tx.THREAT_WEIGHT


def corpus(n=900):
    rng = random.Random(4)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("ra", "no", "ti", "sel", "mor")]
    bad = ["gromp", "snarf", "blick"] + [f"quaxu{x}" for x in ("la", "ren", "tis", "mo", "dik", "ba")]
    for i in range(n):
        ws = rng.choices(vocab, k=rng.randrange(5, 80))
        toxic = int(i % 7 == 0)
        for _ in range(rng.randrange(2, 5) * toxic):
            ws[rng.randrange(len(ws))] = rng.choice(bad)
        yield i, " ".join(w + rng.choice(["", "", "", ".", ","]) for w in ws), toxic


def test_held_out_rows_are_told_apart(spark):
    rows = [(i, t, y, None) for i, t, y in corpus()]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    model = tx.fit(docs, docs.select("doc_id", "toxic"))
    assert {"gromp", "snarf", "blick"} <= set(model.whole) and any(s.startswith("qua") for s in model.starts)
    got = {r.doc_id: r.score for r in tx.scores(docs, model).collect()}
    held = [(got[i], y) for i, _, y, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((s >= 0.5) == bool(y) for s, y in held) and len(held) > 100
    again = tx.fit(docs.repartition(7), docs.select("doc_id", "toxic"))
    assert again.whole == model.whole and (*again.factors, again.bias, again.slope) == pytest.approx((*model.factors, model.bias, model.slope), abs=1e-6)
    left = tx.without_toxic(docs, model)
    assert left.columns == docs.columns and {r.toxic for r in left.collect()} == {0}


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "", None, None), (2, "İ x" * 50_000, None, None), (2, "fool", None, None)], DOCS)
    model = tx.fit(docs, docs.where("false").select("doc_id", "toxic"))
    assert [r.score < 0.5 for r in tx.scores(docs, model).collect()] == [True] * 4
    model = tx.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")))
    assert tx.scores(docs.where("false"), model).count() == 0
