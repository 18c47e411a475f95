import random

import pytest
from pyspark.sql import functions as F

from octetloom.llm import components, simhash
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], SCHEMA)


def test_components_of_near_copies_match_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    texts, n = [], 0
    for _ in range(25):
        base = rng.choices(vocab, k=rng.choice([5, 60, 300]))
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append((n, " ".join(copy)))
            n += 1
    texts += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One"), (n + 4, "oNE"), (n + 5, "É one two"), (n + 6, "x" * 100_000)]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(rows(spark, texts).repartition(3)).collect()}
    fps = {i: brute.fingerprint(t) for i, t in texts}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == brute.components(fps)


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_links_lose_no_pair(spark, bits):
    rng = random.Random(bits)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = {0, (1 << 64) - 1}
    for s in seeds:
        fps.add(s)
        for k in range(0, bits + 2):
            x = s
            for b in rng.sample(range(64), k):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {frozenset((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits).collect()}
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits}
    assert got == want


def test_long_chain_is_one_component(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.connected_components(links.union(links).union(spark.createDataFrame([(900, 900), (950, 940)], "a long, b long")))
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(201)} | {(950, 940), (940, 940)}


def test_repeats_nulls_and_no_rows(spark):
    docs = rows(spark, [(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "other words here now")])
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([("3", 3), ("5", 3), ("5", 3), ("None", 3), ("None", None)], key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "None"]
    assert simhash.near_duplicates(rows(spark, [])).count() == 0


def test_unlike_texts_of_one_id_or_none_all_stay(spark):
    texts = [(None, "a b c d"), (None, "other words here now"), (None, "other words here now"), (None, "third text without an id"), (3, "a b c d"), (7, "one text of seven"), (7, "quite another text under seven"), (7, "one text of seven"), (8, "one text of seven"), (9, "alone")]
    docs = rows(spark, texts).repartition(3)
    kept = simhash.one_of_each(docs)
    want = [(3, "a b c d"), (None, "other words here now"), (None, "third text without an id"), (7, "one text of seven"), (7, "quite another text under seven"), (9, "alone")]
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
