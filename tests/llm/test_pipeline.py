"""The pipeline's stages against brute force, each on what its predecessor kept."""

import collections

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sitelens.llm import langid, mixing, quality
from sitelens.llm.store import settle
from sitelens.llm.text import bucket
from tests.llm.test_tables import brute_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(settle(stage(spark, kept[-1], SF), f"test-{name}"))
    return kept


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixing", "packing"]
    for df in stages:
        assert df.columns == stages[0].columns


def test_filters_decide_alike(spark, stages):
    docs, good, known = stages[0], stages[1], stages[2]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels.filter(bucket("doc_id", 4) != 2))
    x = docs.collect()
    scores = model.score(quality.feature_matrix([r["text"] for r in x]))
    assert ids(good) == collections.Counter(r["doc_id"] for r, s in zip(x, scores) if s >= 0.7)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(r["doc_id"], s >= 0.7) for r, s in zip(x, scores) if r["doc_id"] in marks]
    assert sum(ok == (marks[i] == 1) for i, ok in judged) >= 0.97 * len(judged)
    found = langid.predict(good, langid.train(good.filter(bucket("doc_id", 4) != 2)))
    want = found.filter("lang_pred <> 'und' and score >= 0.3").select("row.doc_id")
    assert ids(known) == ids(want)


def test_one_of_each_class_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert ids(stages[3]) == collections.Counter(set(brute_classes(rows, 5).values()))


def test_mix_and_packing(spark, stages):
    plan = mixing.mixed(stages[3]).select("row.doc_id", "copies").collect()
    assert ids(stages[4]) == collections.Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})
    pieces = corpus_pipeline.STAGES[-1][1](spark, stages[4], SF).collect()
    tokenizer = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = collections.Counter()
    for r in stages[4].collect():
        want[r["doc_id"]] += len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert got == want


def test_run_is_the_chain_of_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r["doc_id"] for r in rows.select("doc_id").distinct().collect()} == set(ids(stages[4]))


def test_odd_rows_and_an_empty_table(spark, odd, labelled, none, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns go through every stage; so does an empty table."""
    for name, docs in (("odd", odd), ("none", none)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labelled.write.parquet(f"{folder}/labels.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            kept = settle(f(spark, kept, folder), f"odd-{stage}")
            assert kept.columns == odd.columns
        rows = corpus_pipeline.run(spark, folder)
        assert rows.agg({"length": "sum"}).first()[0] == (corpus_pipeline.STAGES[-1][1](spark, kept, folder).agg({"length": "sum"}).first()[0])
        if name == "none":
            assert rows.count() == 0
