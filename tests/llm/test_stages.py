"""Each pipeline stage over edge rows and over empty tables."""

import pytest

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
PASSAGE = "one two three four five six seven eight nine ten"


@pytest.fixture
def folder(spark, tmp_path):
    labels = [(5, 1, 0), (7, 1, 0), (None, 1, 0), (99, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def ids(df):
    return sorted(("" if r.doc_id is None else str(r.doc_id)) for r in df.select("doc_id").collect())


def test_stages_over_edges(spark, documents, edge_rows, folder):
    tail = " then come more words of its own which no item holds at all and so it stays"
    rows = edge_rows + [(20, f"Here it is: {PASSAGE}!{tail}", "en", "a"), (21, PASSAGE, "en", "a")]
    df = documents(rows)
    everything = sorted("" if r[0] is None else str(r[0]) for r in rows)
    without = lambda *gone: [x for x in everything if x not in gone]
    # No text, no letter: neither has a language. Of the rows without an id the one with words stays.
    spoken = without("1", "2", "3", "4")
    spoken.remove("")
    assert set(ids(STAGES["language"](spark, df, folder))) <= set(spoken)
    assert {"", "6", "7", "20"} <= set(ids(STAGES["language"](spark, df, folder)))
    # No document of the table is labelled as bad.
    assert ids(STAGES["quality"](spark, df, folder)) == everything
    # Three rows share a text; empty texts are no copies of each other.
    assert ids(STAGES["near_duplicates"](spark, df, folder)) == sorted([*without("7", "8"), "7"])
    clean = STAGES["decontamination"](spark, df, folder)
    assert ids(clean) == without("21")
    left = {r.doc_id: r for r in clean.collect()}
    assert left[20].text == "Here it is: " + tail.strip() and left[20].n_chars == len(left[20].text)
    assert left[1].text is None and left[2].text == ""
    mixed = STAGES["mixing"](spark, df, folder)
    assert set(ids(mixed)) <= set(everything) and all(r.copies in (1, 2) for r in mixed.collect())


@pytest.mark.parametrize("name", STAGES)
def test_stages_over_an_empty_table(spark, documents, folder, name):
    df = documents([], clash=False)
    got = STAGES[name](spark, df, folder)
    assert got.count() == 0
    assert got.columns == df.columns + (["copies"] if name == "mixing" else [])
