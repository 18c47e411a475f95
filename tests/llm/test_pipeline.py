"""The pipeline against a plain version of each stage, over what the stage before it kept."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from octetloom.llm import pii, simhash, toxicity
from tests.llm import brute
from tests.llm.test_packing import check_places

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("ra", "no", "ti", "sel", "mor")]
    rows = []
    for i in range(240):
        ws = rng.choices(vocab, k=rng.randrange(3, 90))
        if i % 6 == 0:
            for _ in range(3):
                ws[rng.randrange(len(ws))] = rng.choice(["gromp", "snarf"])
        if i % 9 == 1:
            ws[1:1] = [f"me{i}@mail.example.com"]
        rows.append((i, " ".join(ws), "en", rng.choice(["a", "a", "b", "c", None]), None))
    rows += [(300 + i, rows[7 * i + 1][1], "en", "b", 5) for i in range(20)] + [(400, None, None, None, None), (401, "", "en", "a", 0)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_each_stage_matches_a_plain_version(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        kept.append((docs, docs.collect()))
        if k < 4:
            after = spark.read.parquet(f"{tmp_path}/{k}")
            assert after.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    rows = [r for _, r in kept] + [docs.collect()]
    model = toxicity.fit(kept[0][0], spark.read.parquet(f"{folder}/labels.parquet"))
    auto = model.automaton()
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in rows[0] if model.score(r.text, auto) < 0.5}
    assert {r.doc_id for r in rows[0]} - {r.doc_id for r in rows[1]} >= {i for i in range(0, 240, 6)}
    found = brute.components({r.doc_id: brute.fingerprint(r.text) for r in rows[1]})
    assert {r.doc_id for r in rows[2]} == {d for d, c in found.items() if d == c}
    field = pii.fit(kept[2][0])
    texts = {r.doc_id: r.text for r in rows[2]}
    assert {r.doc_id: r.text for r in rows[3]} == {d: t and pii.redacted_text(t, field) for d, t in texts.items()}
    assert not any(r.text and "@" in r.text for r in rows[3]) and len(rows[3]) == len(rows[2])
    mixed = brute.mix([(r.doc_id, r.source, r.text) for r in rows[3]])
    assert Counter(r.doc_id for r in rows[4]) == Counter({rows[3][i].doc_id: n for i, n in mixed.items() if n})
    check_places(rows[5], [(r.doc_id, r.text) for r in rows[4]], 2048)


def test_run_chains_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[0] == "doc_id" and out.count() > 100
