"""Token files, fingerprints, conversations and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changerisk.llm import tokens
from changerisk.llm.chat import maximal, prefix_hashes, render
from changerisk.llm.fingerprints import compare_with_edits
from changerisk.session import work_folder

SMALL = "/root/testdata/sf0.001"


def test_flat_files_are_scanned_across_blocks(spark):
    rng = random.Random(6)
    texts = [[rng.randrange(1000) for _ in range(rng.choice([0, 0, 1, 5, 60]))] for _ in range(80)]
    flat = [x for t in texts for x in (*t, 7777)] + [1, 2, 3]
    path = work_folder(spark)
    data = np.array(flat, "<u2").tobytes()
    spark.createDataFrame([(data[:-6],)], "b binary").select(F.col("b").cast("string")).coalesce(1).write.option("lineSep", data[-6:].decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    for block in (2, 10, 64, 1 << 20):
        got = tokens.scan(tokens.read_blocks(spark, path, block=block), end=7777, block=block).orderBy("begin").collect()
        assert [r.n_tokens for r in got] == [len(t) for t in texts] + [3]
        assert [r.closed for r in got] == [True] * len(texts) + [False]


def test_token_counts_of_documents(documents, edge_rows):
    tiktoken = pytest.importorskip("tiktoken")
    coder = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_vocabulary(), special_tokens={})
    rows = [*edge_rows, (-5, "negative", None, None), ((1 << 62) + 3, "large <|endoftext|>", None, None)]
    got = tokens.count_tokens(documents(rows), block=4096)
    want = sorted(((d, len(coder.encode_ordinary(t or ""))) for d, t, _, _ in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == want
    assert tokens.count_tokens(documents([])).count() == 0


def test_fingerprints_and_edits(documents, edge_rows, prose):
    rows = [r for r in edge_rows if r[0] is not None] + [(100 + i, t, None, None) for i, t in enumerate(prose(150, seed=3, sizes=(40, 160)))]
    rows += [(500, rows[-1][1], None, None)]
    got = compare_with_edits(documents(rows).repartition(5)).collect()
    assert len(got) == len(rows)
    # Equal ids hold equal texts here, so their order does not matter.
    order = sorted(rows, key=lambda r: r[0])
    for r in got:
        mine = next(i for i, x in enumerate(order) if x[0] == r.doc_id)
        t = order[mine][1] or ""
        if r.doc_id != 7:
            after = order[(mine + 1) % len(order)][1] or ""
            edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.n_chars == len(t) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    for r in got:
        prints.setdefault(next(x[1] or "" for x in order if x[0] == r.doc_id), set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in got if 100 <= r.doc_id < 249]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)
    assert np.mean([r.near_edited for r in long]) > 0.3 > 0.15 > np.mean([r.near_next for r in long])


def test_fingerprints_of_few_rows(documents):
    assert compare_with_edits(documents([])).count() == 0
    one = compare_with_edits(documents([(None, "alone here", None, None)])).collect()
    assert len(one) == 1 and one[0].doc_id is None and one[0].near_next == 1.0


def conversation(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string")


def test_snapshots_collapse(spark, monkeypatch):
    import changerisk.llm.chat as m

    turns = lambda c, texts, at=0: [(c, at + i, "user" if i % 2 == 0 else None, t) for i, t in enumerate(texts)]
    rows = turns(1, ["a"]) + turns(2, ["a", "b"], 5) + turns(3, ["a", "b", "c"]) + turns(4, ["a", "b", "c"]) + turns(5, ["a", "x"]) + turns(6, [None]) + turns(7, [""]) + turns(8, ["b", "a"])
    rows += turns(3, ["a", "b", "c"])[:1] + [(None, None, None, None), (9, 0, "user", "t"), (9, 0, "user", "s")]
    for size in (1024, 2):
        monkeypatch.setattr(m, "SLICE", size)
        got = {r.conv_id: (r.n_turns, r.n_equal, r.rendered) for r in render(conversation(spark, rows)).collect()}
        assert set(got) == {3, 5, 6, 7, 8, 9, None}
        assert got[3] == (3, 2, "<|user|>\na<|end|>\n<|unknown|>\nb<|end|>\n<|user|>\nc<|end|>\n")
        assert got[9][2] == "<|user|>\ns<|end|>\n<|user|>\nt<|end|>\n" or got[9][2] == "<|user|>\nt<|end|>\n<|user|>\ns<|end|>\n"
    assert render(conversation(spark, [])).count() == 0


def test_a_long_conversation_is_cut_into_rows(spark, monkeypatch):
    import changerisk.llm.chat as m

    monkeypatch.setattr(m, "SLICE", 50)
    rows = [(1, i, "user", f"t{i}") for i in range(700)] + [(2, i, "user", f"t{i}") for i in range(699)]
    got = render(conversation(spark, rows)).orderBy("part").collect()
    assert [(r.conv_id, r.part) for r in got] == [(1, 0), (1, 1), (1, 2)]
    assert "".join(r.rendered for r in got) == "".join(f"<|user|>\nt{i}<|end|>\n" for i in range(700))
    assert maximal(prefix_hashes(conversation(spark, rows))).count() == 1


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline
    from changerisk.llm.shared import stored, table

    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stored(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 0.75 * len(before), name
    good = {r.doc_id for r in table(spark, SMALL, "labels").where("quality = 1").collect()}
    mixed = corpus_pipeline.mixing(spark, docs, SMALL)
    assert mixed.columns == [*columns, "copies"]
    assert len(after & good) > 0.85 * len(good)
    empty = corpus_pipeline.near_duplicates(spark, docs.limit(0), SMALL)
    assert empty.count() == 0 and empty.columns == columns
