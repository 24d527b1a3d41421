"""Ids beyond 2**53 beside a null one, and columns that pandas would change, come back as they are."""

import pytest

import corpus_pipeline
from changerisk.llm.decontamination import contamination
from changerisk.llm.fingerprints import compare_with_edits
from changerisk.llm.language import identify
from changerisk.llm.lm import score_held_out
from changerisk.llm.neardup import classes
from changerisk.llm.quality import resample
from changerisk.llm.tokens import count_tokens
from changerisk.llm.toxicity import assess

BIG = 2**60 + 1
IDS = [None, BIG, BIG + 1, 3]


@pytest.fixture
def tables(spark, prose):
    texts = prose(len(IDS) - 1) + ["the same words as before and then some more of them"]
    rows = [(i, t, "en", "a", len(t), BIG + n if n % 2 else None, [n, None]) for n, (i, t) in enumerate(zip(IDS, texts, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, seen long, parts array<int>").coalesce(1)
    labels = spark.createDataFrame([(BIG, 1, 0), (BIG + 1, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "words that stand in no text of these documents at all I hope")], "item_id long, text string")
    return docs, labels, benchmark


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6", "op7", "op8", "op10"])
def test_operators_keep_ids(tables, name):
    docs, labels, benchmark = tables
    found = {
        "op2": lambda: assess(docs, labels), "op3": lambda: resample(docs, labels), "op4": lambda: identify(docs), "op5": lambda: count_tokens(docs),
        "op6": lambda: classes(docs), "op7": lambda: contamination(docs, benchmark), "op8": lambda: compare_with_edits(docs), "op10": lambda: score_held_out(docs, 4),
    }[name]()
    assert sorted(str(r.doc_id) for r in found.select("doc_id").collect()) == sorted(map(str, IDS))


def test_stages_keep_ids_and_columns(spark, tables, tmp_path):
    docs, labels, benchmark = tables
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {str(r.doc_id): (r.seen, r.parts) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        for r in stage(spark, docs, str(tmp_path)).collect():
            assert want[str(r.doc_id)] == (r.seen, r.parts), name
