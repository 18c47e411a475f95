import random

import numpy as np
import pytest

from octetloom.llm import topk

ROWS = "vec_id long, embedding array<double>, rank int, score string"


@pytest.mark.parametrize("n,d,spread", [(1, 3, 5), (40, 1, 3), (300, 8, 2), (500, 16, 1000)])
def test_no_bound_excludes_a_winner(n, d, spread):
    rng = np.random.default_rng(n)
    rows = rng.integers(-spread, spread + 1, size=(n, d)).astype(float)
    rows[n // 2 :: 3] = rows[0]
    queries = rng.integers(-spread, spread + 1, size=(20, d)).astype(float)
    for k in (1, 5, 11):
        for q, (ids, scores) in zip(queries, topk.no_random_access(rows, queries, k)):
            full = rows @ q
            bar = np.sort(full)[-min(k, n)]
            assert set(np.flatnonzero(full >= bar)) <= set(ids.tolist())
            assert (full[ids] == scores).all()


def plain(rows, k):
    good = [(i, topk.quantised(v)) for i, v in rows if i is not None and topk.quantised(v) is not None]
    out = []
    for q, a in good:
        if q % 100 == 0:
            best = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale,broadcast", [(1.0, 1 << 20), (1e6, 1 << 20), (1.0, 0)])
def test_blocks_merge_to_the_exact_answer(spark, monkeypatch, scale, broadcast):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(topk, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(topk, "BLOCKS_PER_GROUP", 2)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) * scale for _ in range(6)]) for i in range(700)]
    rows[5:200:7] = [(i, [0.5 * scale] * 6) for i, _ in rows[5:200:7]]
    rows += [(800, None), (801, [None, 1.0]), (900, [float("nan")] * 6), (901, [float("inf")] * 6), (None, [1.0] * 6), (1000, []), (1100, [1.0])]
    df = spark.createDataFrame([(*r, None, None) for r in rows], ROWS).repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect())
    assert got == plain(rows, 10)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], None, None), (0, [1.0], None, None), (7, [2.0], None, None)], ROWS)
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 7, 1024 * 2048)]
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def test_rows_with_the_querys_id_crowd_nothing_out(spark):
    df = spark.createDataFrame([(0, [9.0, 1.0], None, None)] * 12 + [(i, [float(i), 0.0], None, None) for i in range(1, 21)], ROWS).coalesce(1)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect())
    assert [(r[1], r[2]) for r in got] == [(r, 21 - r) for r in range(1, 11)]


def test_a_bar_from_elsewhere_ends_the_reading():
    rng = np.random.default_rng(1)
    rows, queries = rng.normal(size=(400, 4)).round(2) * 100, rng.normal(size=(6, 4)).round(2) * 100
    scores = queries @ rows.T
    bars = np.sort(scores)[:, -3]
    own = (np.arange(6), scores.argmax(axis=1))
    for q, (ids, got) in enumerate(topk.no_random_access(rows, queries, 10, own, bars)):
        assert sorted(got) == sorted(scores[q])[-3:-1] and own[1][q] not in ids
    assert all(len(ids) == 0 for ids, _ in topk.no_random_access(rows, queries, 10, own, np.full(6, 1e9)))
