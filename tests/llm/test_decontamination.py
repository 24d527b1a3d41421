import hashlib
import random
import re

from changerisk.llm.decontamination import Automaton, contamination, decontaminate, without

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    out = []
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    wins = {}
    for i, t in items:
        w = split(t)
        if w:
            k = min(10, len(w))
            for p in range(len(w) - k + 1):
                wins.setdefault(tuple(w[p : p + k]), set()).add("" if i is None else str(i))
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                found = wins.get(tuple(w[p : p + k]))
                if found:
                    hit |= set(range(p, p + k))
                    names |= found
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_random_words_match_brute_force(spark, documents):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("a b c".split()) for _ in range(rng.randint(1, 25)))) for i in range(30)]
    items += [(30, "Only THIS, item."), (31, None), (32, ""), (33, "?!"), (None, "nameless item")]
    docs = [(i, " ".join(rng.choice("a b c d this only item nameless".split()) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "only\nthis -- ITEM! only this"), (62, "only this")]
    for i in (3, 7):
        docs.append((70 + i, "x " + items[i][1] + " y " + items[i][1]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents([(d, t, None, None) for d, t in docs])
    got = sorted((tuple(r) for r in contamination(df, bench).collect()), key=str)
    assert got == brute(docs, items)


def test_shards_give_the_same(spark, documents, monkeypatch, prose):
    import changerisk.llm.decontamination as m

    items = list(enumerate(prose(12, seed=3, sizes=(3, 40))))
    docs = [(i, t + " " + items[i % 12][1]) for i, t in enumerate(prose(20, seed=4))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents([(d, t, None, None) for d, t in docs])
    monkeypatch.setattr(m.shards, "__defaults__", (10, 50))
    assert sorted((tuple(r) for r in contamination(df, bench).collect()), key=str) == brute(docs, items)


def test_automaton_reports_longest_matches():
    a = Automaton([("1", [1, 2, 3, 1, 2]), ("2", [3, 3, 1])], 10)
    seq = [1, 2, 3, 1, 9, 3, 3, 1, 2]
    lists = [[1, 2, 3, 1, 2], [3, 3, 1]]
    inside = lambda s: any(s == x[i : i + len(s)] for x in lists for i in range(len(x)))
    want = [max(n for n in range(i + 2) if inside(seq[i + 1 - n : i + 1])) for i in range(len(seq))]
    assert [m for _, _, m in a.stream(seq)] == want


def test_passages_are_cut_out(spark, documents, edge_rows):
    item = " ".join(f"w{i}" for i in range(20))
    clean = " ".join(f"c{i}" for i in range(60))
    rows = [*edge_rows, (50, f"{clean}. {item.upper()}! Then on, {clean}", None, None), (51, item, None, None), (52, clean, None, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = documents(rows)
    got = decontaminate(df, bench)
    assert got.columns == df.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert got.count() == len(rows) - 1 and 51 not in texts
    assert texts[50] == f"{clean}. Then on, {clean}" and texts[52] == clean
    assert without("a b c", [0, 3]) == ""


def test_empty_tables(spark, documents, edge_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in contamination(documents(edge_rows), none).collect())
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(documents([]), bench).count() == 0
