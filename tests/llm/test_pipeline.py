"""The pipeline's stages on a small corpus: each against plain Python on what its predecessor kept."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from concord.llm import mixing, quality, sentencepiece as sp

from test_llm import DOCS, WORD, brute_components, prose

pytestmark = pytest.mark.skipif(not os.path.exists(cp.PIECES), reason="no piece file")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, d = random.Random(20), tmp_path_factory.mktemp("corpus")
    texts = [prose(rng, rng.randrange(20, 80), 900) + "\n" + prose(rng, 20, 900) for _ in range(60)]
    texts += [texts[0], texts[1].replace("w1", "w2", 1), "too short", None, "### " * 40, "a b c d e " * 20]
    texts += [f"{texts[5].split(chr(10))[0]}\n{prose(rng, 40, 900)}"]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), int(i % 9 == 0)) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "mixing", "sentencepiece"]
    steps = [docs]
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, steps[-1], corpus).cache()
        assert i == 4 or out.columns == docs.columns
        steps.append(out)
    raw, good, lined, single, mixed, done = ([r.asDict() for r in s.orderBy("doc_id").collect()] for s in steps)
    kept = {r["doc_id"] for r in quality.quality_report(docs).where("kept").collect()}
    assert {r["doc_id"] for r in good} == kept and not kept & {62, 63, 64, 65} and len(kept) >= 60
    # Lines: the first of equal lines stays (no two lines here are nearly equal but not equal, except document 61's).
    by = {r["doc_id"]: r for r in lined}
    assert 60 not in by and all(by[i]["text"] == r["text"] for i, r in enumerate(raw[:60]))
    assert by[66]["text"] == raw[66]["text"].split("\n")[1] and by[66]["n_chars"] == len(by[66]["text"])
    want = brute_components([r["text"] for r in lined], 5, 80)
    assert [r["doc_id"] for r in single] == [r["doc_id"] for i, r in enumerate(lined) if want[i][1] == i]
    rates = {r["doc_id"]: r["mix_copies"] for r in mixing.mix_rates(steps[3], mixing.label_domains(spark.read.parquet(f"{corpus}/labels.parquet"))).collect()}
    assert [r["doc_id"] for r in mixed] == [i for i in sorted(rates) for _ in range(rates[i])]
    dec = sp.Decoder(sp.Model.load(cp.PIECES))
    assert [dec.decode(r["ids"]) for r in done] == [r["text"] for r in mixed]
    assert all(WORD.search(r["text"]) for r in mixed)


def test_run_is_the_stages_and_takes_no_rows(spark, corpus, tmp_path):
    assert cp.run(spark, corpus).columns == ["doc_id", "source", "n_pieces", "ids"]
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_ids(spark):
    text = prose(random.Random(3), 30)
    docs = spark.createDataFrame([(1, text, "a", "s", 1), (1, text, "b", "s", 1), (2, text, "c", "s", 1), (None, text, "d", "s", 1)], DOCS)
    out = cp.near(spark, docs, "").select("doc_id", F.lit(1)).collect()
    assert sorted(r["doc_id"] or 0 for r in out) == [0, 1]


def test_repeated_ids_with_other_texts_stay(spark, monkeypatch):
    rng = random.Random(4)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, c), (2, b + " more"), (3, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    for gate in (8 << 20, -1):
        monkeypatch.setattr(cp, "BROADCAST_BYTES", gate)
        out = [(r["doc_id"], r["text"]) for r in cp.near(spark, docs, "").collect()]
        # a stands under 1 and, alone, under 3; b under 1 twice and, nearly, under 2.
        assert len(out) == 3 and (2, c) in out and ((1, a) in out) != ((3, a) in out) and ((1, b) in out) != ((2, b + " more") in out)


def test_stages_take_other_columns_and_none(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, prose(rng, 40), "x") for i in range(4)], "doc_id long, text string, n_words string")
    for _, stage in cp.STAGES[:3]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 4
