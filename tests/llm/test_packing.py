import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from octetloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'aé1.日  "), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encoder_agrees_with_the_tokenizer(text):
    assert packing.encoder(PATH)(text).tolist() == OWN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "x" * 5000, "a " * 3000, " " * 3000 + "b", "<|endoftext|> it's", "a<|endoftext|>b <|endoftext|>"])
def test_encoder_on_odd_texts(text):
    assert packing.encoder(PATH)(text).tolist() == OWN.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_is_best_fit(sizes):
    bins, fills = packing.best_fit(np.array(sizes, np.int64), 20)
    rooms = []
    for size, b in zip(sizes, bins):
        fits = [r for r in rooms if r >= size]
        if fits:
            assert rooms[b] == min(fits)
        else:
            assert b == len(rooms)
            rooms.append(20)
        rooms[b] -= size
    assert [20 - r for r in rooms] == fills.tolist()


def check_places(rows, texts, capacity):
    want = []
    for i, t in texts:
        ids = np.array(OWN.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        a = (len(ids) % capacity or capacity) if len(ids) > capacity else len(ids)
        cuts = [0, *range(a, len(ids) + 1, capacity)]
        want += [(i, k, x, y - x, zlib.crc32(ids[x:y].tobytes())) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= capacity
    return len(seqs)


@pytest.mark.parametrize("items", [200_000, 30])
def test_pieces_fill_few_sequences(spark, items, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", items)
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices(["alpha", "be", "gamma's", "12"], k=rng.choice([3, 20, 40, 63, 64, 200])))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "z" * 3000), (7, "again"), (7, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in texts], "doc_id long, text string, key string, piece int").repartition(5)
    rows = packing.packed_documents(df, capacity=64).collect()
    n = check_places(rows, texts, 64)
    assert n <= 1.06 * -(-sum(r.length for r in rows) // 64) + 1


def test_no_rows(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_on_demand(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    (row,) = packing.pieces(df, PATH, with_ids=True).collect()
    assert row.ids == OWN.encode("one two three").ids + [0]
