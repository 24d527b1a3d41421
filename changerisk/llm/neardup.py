"""Near-duplicate classes: DartMinHash signatures, banded joins, exact checks.

A document is a weighted set: runs of five words (a text of fewer words is one run), each weighing
as often as it occurs. DartMinHash throws darts into the region of each element, a unit of weight
at a time: hashed arrival times of a process of rate one. A dart belongs to a hashed coordinate,
and a coordinate keeps its earliest dart; two documents agree in a coordinate with the probability
of their weighted Jaccard similarity.

Rows with the same text are merged first. Documents that agree in a band of coordinates share a
bucket; of buckets with the same texts one is worked on. The texts of a bucket are compared on their
whole sets until links connect them or none is left to try; only links that connect are passed on,
never a bucket's pairs. A large bucket is dealt into parts of bounded size with some texts in common;
what then still stands apart from the bucket's largest class is compared with all of the bucket.
Links are joined to classes by passing on the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from changerisk.llm.blocks import ALNUM, cut, hashes, mix, occurrences, unit, windows, words
from changerisk.llm.shared import map_exactly, set_aside, stored

SHINGLE = 5
SIMILARITY = 0.8
#: Bands of ROWS coordinates: documents of similarity 0.8 miss each other in all with p < 0.0001.
BANDS, ROWS = 24, 5

#: Texts compared in one task; of a larger bucket, about LEADERS texts are in each part.
CHUNK, LEADERS = 256, 16

_U = np.uint64
#: Elements are compared by so many bytes of their hashes.
_CELL = np.uint32


def elements(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each unit of weight: the n-th occurrence of a run is an element of its own."""
    w = words(texts, ALNUM)
    h, d = windows(hashes(w), w.doc, size)
    d, h, n = occurrences(d, h)
    return d, mix(h + n.astype(_U) * _U(0x9E3779B97F4A7C15), 3)


def dart_signatures(d: np.ndarray, cells: np.ndarray, docs: int, k: int) -> np.ndarray:
    """Signatures (docs x k) of sets of unit cells; ``d`` is sorted. Documents without cells get zeros."""
    weight = np.bincount(d, minlength=docs)
    out = np.zeros((docs, k), _U)
    # Times up to which about k (ln k + 3) darts arrive; repeated further out where a coordinate is missed.
    limit = k * (np.log(k) + 3.0) / np.maximum(weight, 1)
    missing = weight > 0
    while missing.any():
        on = missing[d]
        doc, cell = d[on], cells[on]
        time = np.zeros(len(doc))
        at, coord, ident, who = [], [], [], []
        dart = 0
        while len(doc):
            dart += 1
            h = mix(cell, 100 + dart)
            time = time - np.log(unit(h))
            near = time <= limit[doc]
            doc, cell, time, h = doc[near], cell[near], time[near], h[near]
            e = mix(h, 7)
            at.append(time)
            coord.append((e % _U(k)).astype(np.int64))
            ident.append(e)
            who.append(doc)
        time, coord, ident, who = map(np.concatenate, (at, coord, ident, who))
        # Later assignments win, so the earliest dart of a coordinate comes last.
        order = np.lexsort((ident, -time))
        filled = np.zeros((docs, k), bool)
        out[who[order], coord[order]] = ident[order]
        filled[who, coord] = True
        missing = missing & ~filled.all(axis=1)
        limit = np.where(missing, limit * 2, limit)
    return out


def band_keys(sig: np.ndarray, present: np.ndarray, bands: int, rows: int) -> list[list[int]]:
    keys = np.zeros((len(sig), bands), _U)
    for b in range(bands):
        run = np.full(len(sig), b + 1, _U)
        for r in range(rows):
            run = mix(run ^ sig[:, b * rows + r], 20 + r)
        keys[:, b] = run
    signed = keys.view(np.int64).tolist()
    return [k if p else [] for k, p in zip(signed, present, strict=True)]


def _signed(parts: Iterator[pd.DataFrame], size: int, bands: int, rows: int) -> Iterator[pd.DataFrame]:
    for part in parts:
        texts = [t if isinstance(t, str) else None for t in part["text"]]
        keys: list[list[int]] = []
        for lo, hi in cut(texts, 1 << 19):
            d, cells = elements(texts[lo:hi], size)
            present = np.bincount(d, minlength=hi - lo) > 0
            keys += band_keys(dart_signatures(d, cells, hi - lo, bands * rows), present, bands, rows)
        yield part[["_at"]].assign(bands=keys)


def _compact(parts: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Sorted elements of each text, as bytes."""
    for part in parts:
        texts = [t if isinstance(t, str) else None for t in part["text"]]
        sets: list[bytes] = []
        for lo, hi in cut(texts, 1 << 19):
            d, cells = elements(texts[lo:hi], size)
            cells = (cells >> _U(32)).astype(_CELL)
            order = np.lexsort((cells, d))
            cells, ends = cells[order], np.cumsum(np.bincount(d, minlength=hi - lo))
            sets += [x.tobytes() for x in np.split(cells, ends[:-1])]
        yield pd.DataFrame({"same": part["same"], "cells": sets})


def _same() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def classes(docs: DataFrame, id_col: str = "doc_id", size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: ``id_col``, class_id (the least id of its class), linked (a link or copy exists).

    Two documents are linked if the weighted Jaccard similarity of their runs of ``size`` words is
    at least ``similarity``; a class is what links connect. Equal texts are of one class, but for
    texts without words, null ones too: they have nothing to compare and stay alone. Rows that
    repeat keep a row each. Rows without an id take part, with a null id, which is no class's least
    id unless all are null. Extra columns are ignored. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), _same().alias("same"), "text")
    fields = base.select("id", "same", F.array().cast("array<long>").alias("bands")).schema
    signed = stored(map_exactly(base, lambda p: _signed(p, size, bands, rows), fields, ["text"]))
    worded = signed.where(F.size("bands") > 0)
    texts = stored(worded.groupBy("same").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.count("*").alias("copies")))
    buckets = stored(_distinct_buckets(texts.select("same", F.explode("bands").alias("bucket"))))
    # All that is ever compared shares a bucket.
    needed = texts.join(buckets.select("same").distinct(), "same", "left_semi").select("same", "id")
    chosen = base.alias("d").join(needed.alias("n"), F.col("d.same").eqNullSafe(F.col("n.same")) & F.col("d.id").eqNullSafe(F.col("n.id"))).select("d.same", "d.text")
    sets = stored(chosen.mapInPandas(lambda p: _compact(p, size), "same binary, cells binary").dropDuplicates(["same"]))
    links = stored(_linked(_dealt(buckets), sets, similarity))
    labels = _components(texts.select("same", "id", "copies"), links)
    large = buckets.where(F.col("n") > CHUNK)
    if not large.isEmpty():
        more = stored(_linked(_odd_ones(large, labels), sets, similarity))
        if not more.isEmpty():
            labels = _components(texts.select("same", "id", "copies"), stored(links.unionByName(more)))
    s, c = signed.alias("s"), labels.alias("c")
    return s.join(c, (F.size("s.bands") > 0) & (F.col("s.same") == F.col("c.same")), "left").select(
        F.col("s.id").alias(id_col),
        F.when(F.col("c.same").isNull(), F.col("s.id")).otherwise(F.col("c.label")).alias("class_id"),
        F.coalesce(F.col("c.linked"), F.lit(False)).alias("linked"),
    )


def _distinct_buckets(rows: DataFrame) -> DataFrame:
    """bucket, same, n: buckets of two texts at least, one of those with the same texts."""
    each = rows.groupBy("bucket").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("same", F.lit(s))).alias(f"x{s}") for s in (1, 2)])
    kept = each.where("n > 1").groupBy("n", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return rows.join(kept, "bucket")


#: Bits of a text's place in an order of all texts; the others deal it into a part.
_RANK_BITS = 40


def _rank() -> Column:
    return F.pmod(F.xxhash64("same"), F.lit(1 << _RANK_BITS))


def _dealt(buckets: DataFrame) -> DataFrame:
    """bucket, part, same, old: the groups to compare. Large buckets are dealt into parts.

    About LEADERS texts of a large bucket are put into each of its parts, so that what is linked to
    any of them meets across parts. They are those that come first in an order of all texts, so that
    buckets with much the same texts have much the same leaders.
    """
    rows = buckets.withColumn("parts", F.ceil(F.col("n") / CHUNK))
    leads = (F.col("parts") > 1) & (_rank() < F.lit(float(1 << _RANK_BITS)) * LEADERS / F.col("n"))
    own = F.pmod(F.shiftrightunsigned(F.xxhash64("same"), _RANK_BITS), F.col("parts"))
    return rows.select("bucket", F.explode(F.when(leads, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(own))).alias("part"), "same", F.lit(None).cast("string").alias("known"), _rank().alias("rank"))


def _odd_ones(large: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups that compare each text of a large bucket that is outside its largest class with all others.

    What is in one class needs no comparison, so this leaves no pair of the bucket out.
    """
    held = stored(large.join(labels.select("same", F.coalesce("root", "same").alias("root")), "same"))
    sizes = held.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("k", "root")).getField("root").alias("main"), F.sum("k").alias("all"), F.max("k").alias("k"))
    main = main.where("all > k").withColumn("odds", F.ceil((F.col("all") - F.col("k")) / CHUNK)).withColumn("parts", F.ceil(F.col("all") / CHUNK))
    rows = held.join(main, "bucket").withColumn("draw", F.xxhash64("same", "bucket"))
    known = F.hex("root").alias("known")
    odd = rows.where("root != main").select("bucket", F.pmod("draw", F.col("odds")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"), "same", known, "parts")
    every = rows.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("odds") - 1)).alias("i"), F.pmod("draw", F.col("parts")).alias("j"), "same", known, "parts")
    return odd.unionByName(every).select("bucket", (F.col("i") * F.col("parts") + F.col("j")).alias("part"), "same", "known", _rank().alias("rank")).distinct()


def _linked(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs that connect all texts of each group that links connect.

    Each text is paired with the first of what it is linked to in its group, by the order of all
    texts. Groups that hold much the same texts so give the same pairs, which count once.
    """

    def connect(part: pd.DataFrame) -> pd.DataFrame:
        cells = [np.frombuffer(c, _CELL) for c in part["cells"]]
        names, known = part["same"].tolist(), part["known"].tolist()
        root = list(range(len(names)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        met: dict[str, int] = {}
        for i, k in enumerate(known):
            if k is not None:
                root[top(i)] = top(met.setdefault(k, i))
        found = []
        order = sorted(range(len(names)), key=lambda i: (len(cells[i]), names[i]))
        for at, i in enumerate(order):
            # Nearest sizes first; sizes too far apart cannot be similar.
            for j in reversed(order[:at]):
                if len(cells[j]) < similarity * len(cells[i]):
                    break
                if top(i) != top(j) and _similarity(cells[i], cells[j]) >= similarity:
                    root[top(i)] = top(j)
                    found += [i, j]
        rank, first = part["rank"].tolist(), {}
        for i in sorted(set(found), key=lambda i: (rank[i], names[i])):
            first.setdefault(top(i), i)
        pairs = [(names[i], names[first[top(i)]]) for i in sorted(set(found)) if first[top(i)] != i]
        return pd.DataFrame(pairs, columns=["a", "b"])

    return groups.join(sets, "same").groupBy("bucket", "part").applyInPandas(connect, "a binary, b binary").distinct()


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(large):
        return 0.0
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both / (len(a) + len(b) - both)


def _components(texts: DataFrame, links: DataFrame) -> DataFrame:
    """same, label (least id reached over links), linked, root (a text of the class; null if it is alone)."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    ends = both.select(F.col("a").alias("same")).distinct()
    label = stored(texts.join(ends, "same", "left_semi").select("same", F.struct(F.col("id").isNull().alias("none"), "id", "same").alias("label")))
    while True:
        around = both.join(label.select(F.col("same").alias("b"), "label"), "b").groupBy(F.col("a").alias("same")).agg(F.min("label").alias("near"))
        stepped = label.join(around, "same").select("same", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # A label is an element too: take on what that element has been labelled meanwhile.
        jumped = stepped.alias("x").join(stepped.select(F.col("same").alias("root"), F.col("label").alias("further")), F.col("x.label.same") == F.col("root"))
        new = stored(jumped.select("x.same", "x.was", F.least("x.label", "further").alias("label")))
        label = new.select("same", "label")
        if new.where("was != label").isEmpty():
            break
    done = label.select("same", F.col("label.id").alias("label"), F.col("label.same").alias("root"))
    t = texts.alias("t").join(done.alias("l"), "same", "left")
    return t.select("same", F.when(F.col("l.root").isNull(), F.col("t.id")).otherwise(F.col("l.label")).alias("label"), (F.col("l.root").isNotNull() | (F.col("t.copies") > 1)).alias("linked"), "l.root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one row of each class: that of the least id, of rows that repeat one.

    The rows are numbered in a stored copy first, so that rows with equal or null ids are told apart.
    """
    docs, back = set_aside(docs, (id_col, "text"))
    numbered = stored(docs.select("*", F.monotonically_increasing_id().alias("_row")))
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("_row"))
    found = classes(numbered, "_row", **how)
    # The class ids are row numbers here; its document of the least id stays.
    narrow = numbered.select("_row", order.alias("_order"))
    first = found.where("linked").join(narrow, "_row").groupBy("class_id").agg(F.min("_order").alias("o"))
    stays = first.select(F.col("o._row").alias("_row"))
    goes = found.where("linked").select("_row").join(stays, "_row", "left_anti")
    return back(numbered.join(stored(goes), "_row", "left_anti"))
