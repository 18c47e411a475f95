import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from octetloom.llm import mixing
from tests.llm import brute

DOCS = "doc_id long, text string, source string, size long, copies int"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, s, None, None) for d, s, t in docs], DOCS).repartition(3)


def corpus(seed, sources):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), rng.choice(["", None, "w " * rng.randrange(1, 60), "\tx\n" * rng.randrange(1, 9)])) for i in range(150)]


@pytest.mark.parametrize("sources,small", [(["a"] * 6 + ["b", "é", None], 20_000), (["a"] * 6 + ["b", "é", None], 60), (["a", "b"], 9), (["z"] * 20 + ["y"], 100), (["only"], 20_000)])
def test_mix_matches_brute_force(spark, monkeypatch, sources, small):
    monkeypatch.setattr(mixing, "SMALL_ROWS", small)
    docs = corpus(len(sources), sources)
    want = brute.mix(docs)
    total = Counter()
    for _, s, t in docs:
        total[s] += len(brute.words(t))
    target = brute.targets(total)
    rows = mixing.mix(frame(spark, docs)).collect()
    assert {r.doc_id: r.copies for r in rows} == want
    for r in rows:
        assert r.taken == r.copies * r["size"] <= 3 * r["size"] and r.source_size == total[r.source]
        assert r.target == pytest.approx(target[r.source])
    assert sum(r.taken for r in rows) <= sum(total.values())


@pytest.mark.parametrize("small", [20_000, 40])
def test_ids_that_are_null_or_repeated_are_split_and_mixed(spark, monkeypatch, small):
    monkeypatch.setattr(mixing, "SMALL_ROWS", small)
    rng = random.Random(1)
    docs = [(rng.choice([None, None, 7, 8]), rng.choice("aab"), rng.choice(["x", "y y", "z z z", "q " * 9])) for _ in range(400)]
    want = brute.mix(docs)
    by = lambda pairs: Counter(pairs)
    rows = mixing.mix(frame(spark, docs)).collect()
    # Rows alike in id, source and words may stand for each other.
    assert by((r.doc_id, r.source, r["size"], r.copies) for r in rows) == by((d, s, len(brute.words(t)), want[i]) for i, (d, s, t) in enumerate(docs))
    out = mixing.mixed_documents(frame(spark, docs)).collect()
    taken = by((docs[i][0], docs[i][1], docs[i][2]) for i in brute.mix_order(docs))
    assert by((r.doc_id, r.source, r.text) for r in out) == taken


def test_a_group_meets_in_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SMALL_ROWS", 0)
    rows = spark.range(4000).selectExpr("0L AS n", "'k' AS key", "cast(null AS long) AS doc_id", "1L AS size", "id AS row")
    out = mixing.running(rows, ["n"], [F.col(c) for c in ("key", "doc_id", "size", "row")], {"upto": "size"}, 4000)
    assert out.where("upto <> row + 1").count() == 0 and out.count() == 4000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cut = rows.repartitionByRange("n", "key", "doc_id", "size", "row").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(cut) == 4 and max(r["count"] for r in cut) < 2000


def test_mixed_documents_repeat_rows(spark):
    docs = corpus(5, ["a", "b", "c"])
    want = Counter({i: n for i, n in brute.mix(docs).items() if n})
    assert [r.doc_id for r in mixing.mixed_documents(frame(spark, docs)).collect()] == brute.mix_order(docs)
    out = mixing.mixed_documents(frame(spark, docs))
    assert out.columns == ["doc_id", "text", "source", "size", "copies"]
    texts = {d: t for d, _, t in docs}
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == want and all(r.text == texts[r.doc_id] for r in rows)


def test_odd_rows(spark):
    docs = [(1, "a", "x y"), (1, "a", "x y"), (None, "a", "x y z"), (None, None, "q"), (2, "b", None)]
    rows = sorted(((str(r.doc_id), str(r.source), r["size"], r.source_size) for r in mixing.mix(frame(spark, docs)).collect()))
    assert rows == sorted([("1", "a", 2, 7), ("1", "a", 2, 7), ("None", "a", 3, 7), ("None", "None", 1, 1), ("2", "b", 0, 0)])
    taken = sum(r.copies for r in mixing.mix(frame(spark, docs)).collect())
    assert mixing.mixed_documents(frame(spark, docs)).count() == taken > 0
    assert mixing.mix(frame(spark, docs).where("false")).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, "a", ""), (2, None, None)])).collect()] == [0, 0]
