"""Approximate nearest neighbours by cosine, in a hierarchical k-means tree.

The tree is fitted on a bounded sample and every vector is put into one of its leaves. A query goes
down best-bin-first: to the nearest child at each node, with the other children in a priority queue
that says where to go on. How many leaves each query visits is calibrated: some vectors are
searched exactly against all rows, and the visits are widened until enough of their true
neighbours lie in visited leaves.

Leaves that follow each other in the tree make pages of bounded size, larger leaves are cut into
parts, and queries are dealt into blocks; a task compares one block with one page. Of equal vectors
only the rows of smallest id can be among the nearest, so a vector that much of the table repeats is
one small entry.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from changerisk.llm.shared import hashed_sample, stored

#: Children of a node, and sample vectors below which a node is a leaf.
BRANCHES, LEAF_SAMPLE = 12, 48
#: Vectors the tree is fitted on: this many, or fewer where that many numbers are reached.
SAMPLE, SAMPLE_NUMBERS = 16_384, 1 << 21
#: Vectors searched exactly to calibrate the visits, and the share of their neighbours to reach.
CALIBRATED, REACH = 256, 0.95
#: Vectors of a page, queries of a block, queries compared at once.
PAGE_ROWS, BLOCK_ROWS, CHUNK = 4_096, 16_384, 512
_ROUNDS = 8
#: Leaves are numbered from the vectors' length times this.
_WIDTH = 1 << 24


@dataclass
class Tree:
    """Nodes with their centres; ``kids`` of inner nodes, ``leaf`` (from 0, in tree order) of the others."""

    centres: np.ndarray
    kids: list[np.ndarray]
    leaf: np.ndarray
    leaves: int

    def place(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each row, by the nearest child at every node."""
        out = np.zeros(len(unit), np.int64)
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                kids = self.kids[node]
                near = _gaps(unit[rows], self.centres[kids]).argmin(1)
                todo += [(int(k), rows[near == i]) for i, k in enumerate(kids)]
        return out

    def visits(self, unit: np.ndarray, least: int, rows: np.ndarray, least_rows: int) -> list[list[int]]:
        """Leaves of each row in the order of a best-bin-first walk.

        A walk ends when it has seen ``least`` leaves and these hold ``least_rows`` vectors.
        """
        gaps = _gaps(unit, self.centres)
        out = []
        for gap in gaps:
            seen: list[int] = []
            held = 0
            queue = [(0.0, 0)]
            while queue and (len(seen) < least or held < least_rows):
                node = heapq.heappop(queue)[1]
                while self.leaf[node] < 0:
                    kids = self.kids[node]
                    best = int(kids[gap[kids].argmin()])
                    for kid in kids:
                        if kid != best:
                            heapq.heappush(queue, (gap[kid], int(kid)))
                    node = best
                seen.append(int(self.leaf[node]))
                held += int(rows[seen[-1]])
            out.append(seen)
        return out


def _gaps(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(1)[None, :] - 2.0 * (unit @ centres.T)


def fit_tree(unit: np.ndarray, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE, seed: int = 1) -> Tree:
    """Cluster the rows by k-means, then each cluster again, until clusters are small or all alike."""
    rng = np.random.default_rng(seed)
    centres, kids, leaf = [unit.mean(0)], [np.zeros(0, np.int64)], [-1]
    leaves = 0

    def split(node: int, rows: np.ndarray) -> None:
        nonlocal leaves
        x = unit[rows]
        groups = [] if len(rows) <= leaf_sample else _kmeans(x, branches, rng)
        if len(groups) < 2:
            leaf[node] = leaves
            leaves += 1
            return
        first = len(centres)
        for group in groups:
            centres.append(x[group].mean(0))
            kids.append(np.zeros(0, np.int64))
            leaf.append(-1)
        kids[node] = np.arange(first, first + len(groups))
        for i, group in enumerate(groups):
            split(first + i, rows[group])

    split(0, np.arange(len(unit)))
    return Tree(np.array(centres), kids, np.array(leaf), leaves)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    centre = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(_ROUNDS):
        near = _gaps(x, centre).argmin(1)
        used = np.unique(near)
        centre = np.array([x[near == i].mean(0) for i in used])
    near = _gaps(x, centre).argmin(1)
    return [np.flatnonzero(near == i) for i in np.unique(near)]


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a column of vectors, length by length: (length, row numbers, matrix).

    A row is scaled by a power of two to a largest component of about one: that is exact, leaves every
    cosine as it is, and keeps squares finite.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(length) - length
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        x = flat[start[rows][:, None] + np.arange(n)[None, :]]
        yield int(n), rows, np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision; equal rows give equal numbers."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as integers, and where they are null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False), null


def _top(group: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Of each group the ``k`` rows of largest score, ties to the smaller id, null ids last."""
    order = np.lexsort((ids, null, -score, group))
    g = group[order]
    first = np.flatnonzero(np.diff(g, prepend=-1))
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[place < k]


def _best(query: np.ndarray, x: np.ndarray, allowed: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the ``k`` nearest allowed rows of each query.

    The matrix product only proposes: what is within its rounding of the k-th best is measured again.
    """
    s = np.where(allowed, unit_rows(query) @ unit_rows(x).T, -np.inf)
    edge = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    q, row = np.nonzero(np.isfinite(s) & (s >= edge[:, None] - 1e-9))
    score = cosines(query[q], x[row])
    top = _top(q, score, ids[row], null[row], k)
    return q[top], row[top], score[top]


def measurable(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, vector) whose vector is neither null nor zero and holds finite numbers only."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.select("vec_id", F.col("embedding").alias("vector")).where(F.coalesce(fine, F.lit(False)))


def index_rows(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (row, vec_id, vector) without those that ``k`` rows of the same vector and smaller id precede.

    Spark limits each group while it is still with the task that read it, so a vector with many copies
    is not gathered.
    """
    first = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    return rows.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= k).drop("_nth")


def fit_forest(indexed: DataFrame, sample: int = SAMPLE, numbers: int = SAMPLE_NUMBERS) -> dict[int, Tree]:
    """A tree for each length of vectors, fitted on at most about ``sample`` rows or ``numbers`` numbers."""
    widest = indexed.agg(F.max(F.size("vector"))).first()[0]
    if widest is None:
        return {}
    taken = hashed_sample(indexed, [], max(256, min(sample, numbers // widest)), F.col("vec_id"), F.col("row"))
    found = taken.select("row", "vector").toArrow().sort_by("row")
    return {n: fit_tree(unit_rows(x)) for n, _, x in _by_length(found["vector"])}


def _in_leaves(indexed: DataFrame, forest: dict[int, Tree]) -> DataFrame:
    schema = T.StructType([*indexed.schema.fields, T.StructField("leaf", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.zeros(batch.num_rows, np.int64)
            for n, rows, x in _by_length(batch["vector"]):
                leaf[rows] = n * _WIDTH + (forest[n].place(unit_rows(x)) if n in forest else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], schema.names)

    return indexed.mapInArrow(place, schema)


def exact_neighbours(indexed: DataFrame, some: pa.Table, k: int) -> DataFrame:
    """(query, near, leaf, score, nth): nearest rows of the vectors ``some`` (row, vector), by brute force."""
    asked = [(n, rows, x) for n, rows, x in _by_length(some["vector"])]
    own = some["row"].to_numpy()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            ids, null = _ids(batch["vec_id"])
            row, leaf = batch["row"].to_numpy(), batch["leaf"].to_numpy()
            for n, at, x in _by_length(batch["vector"]):
                for m, which, query in asked:
                    if m == n:
                        q, r, s = _best(query, x, own[which][:, None] != row[at][None, :], ids[at], null[at], k)
                        new = [own[which][q], row[at][r], leaf[at][r], s, ids[at][r], null[at][r]]
                        kept = new if kept is None else [np.concatenate(c) for c in zip(kept, new)]
                        kept = [c[_top(kept[0], kept[3], kept[4], kept[5], k)] for c in kept]
        if kept is not None:
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, kept[:4]), pa.array(kept[4], mask=kept[5])], ["query", "near", "leaf", "score", "vec_id"]
            )

    found = indexed.select("row", "vec_id", "vector", "leaf").mapInArrow(compare, "query long, near long, leaf long, score double, vec_id long")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "near"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)


def calibrated_visits(indexed: DataFrame, forest: dict[int, Tree], k: int, reach: float = REACH, n: int = CALIBRATED) -> int:
    """How many leaves a query must visit so that ``reach`` of the true neighbours are in them.

    Measured on ``n`` hashed vectors, each searched exactly against all rows: the visits are widened
    leaf by leaf, in the order of each walk, until that share is met.
    """
    some = hashed_sample(indexed, [], n, F.col("row"), F.col("vec_id")).select("row", "vector").toArrow().sort_by("row")
    if not some.num_rows:
        return 1
    found = exact_neighbours(indexed, some, k).select("query", "leaf").toArrow()
    walk = {}
    for length, rows, x in _by_length(some["vector"]):
        if length in forest:
            tree = forest[length]
            for row, seen in zip(rows, tree.visits(unit_rows(x), tree.leaves, np.zeros(tree.leaves), 0)):
                walk[some["row"][int(row)].as_py()] = {leaf + length * _WIDTH: i + 1 for i, leaf in enumerate(seen)}
    need = sorted(walk.get(q, {}).get(leaf, 1) for q, leaf in zip(found["query"].to_pylist(), found["leaf"].to_pylist()))
    visits = 1
    while need and sum(v <= visits for v in need) < reach * len(need):
        visits += 1
    return visits


def _pages(sizes: dict[int, int], page_rows: int = PAGE_ROWS) -> list[tuple[int, int, int]]:
    """(leaf, page, parts): leaves packed in tree order; a larger leaf is a page of several parts."""
    out, page, held = [], 0, 0
    for leaf in sorted(sizes):
        n = sizes[leaf]
        if held and held + n > page_rows:
            page, held = page + 1, 0
        out.append((leaf, page, -(-n // page_rows) if n > page_rows else 1))
        held += n
    return out


def nearest_neighbours(rows: DataFrame, is_query: Column | None = None, k: int = 5, reach: float = REACH) -> DataFrame:
    """The ``k`` nearest rows found for each query of ``rows`` (vec_id, embedding).

    ``is_query`` says which rows are queries (default: ``vec_id`` divisible by 50; a null id is none);
    candidates are all rows but the query's own. Rows (query_id, rank, vec_id, score), by largest
    cosine, ties to the smaller id (null last). Vectors that are null, zero or hold nulls or
    non-finite components take no part; those of different lengths have no cosine and are not
    compared. A repeated row is a candidate, and as a query has its own result; a query with fewer
    than ``k`` candidates gets all; an empty table gives no rows; other columns are not read.
    """
    if is_query is None:
        is_query = F.col("vec_id") % 50 == 0
    numbered = stored(measurable(rows).withColumn("row", F.monotonically_increasing_id()))
    indexed = stored(index_rows(numbered, k + 1))
    forest = fit_forest(indexed)
    indexed = stored(_in_leaves(indexed, forest))
    sizes = {r.leaf: r.n for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row per leaf of the fitted trees
    visits = calibrated_visits(indexed, forest, k, reach)
    return _search(numbered.where(is_query), indexed, forest, sizes, visits, k)


def _search(queries: DataFrame, indexed: DataFrame, forest: dict[int, Tree], sizes: dict[int, int], visits: int, k: int) -> DataFrame:
    spark = queries.sparkSession
    paged = _pages(sizes)
    of_leaf = {leaf: (page, parts) for leaf, page, parts in paged}
    held = {n: np.array([sizes.get(n * _WIDTH + i, 0) for i in range(t.leaves)]) for n, t in forest.items()}
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, part, at, leaves = [], [], [], []
            for n, rows, x in _by_length(batch["vector"]):
                ways = forest[n].visits(unit_rows(x), visits, held[n], k + 1) if n in forest else [[0]] * len(rows)
                for row, way in zip(rows.tolist(), ways):
                    goal: dict[tuple[int, int], list[int]] = {}
                    for leaf in way:
                        leaf += n * _WIDTH
                        if leaf in of_leaf:
                            goal.setdefault(of_leaf[leaf], []).append(leaf)
                    for (p, parts), inside in goal.items():
                        for i in range(parts):
                            page.append(p), part.append(i), at.append(row), leaves.append(inside)
            if at:
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page, pa.int64()), pa.array(part, pa.int64()), taken["block"], taken["row"], taken["vec_id"], taken["vector"], pa.array(leaves, pa.list_(pa.int64()))],
                    ["page", "part", "block", "row", "query_id", "query", "leaves"],
                )

    id_type, vector_type = indexed.schema["vec_id"].dataType, indexed.schema["vector"].dataType
    fields = [("page", T.LongType()), ("part", T.LongType()), ("block", T.LongType()), ("row", T.LongType()), ("query_id", id_type), ("query", vector_type), ("leaves", T.ArrayType(T.LongType()))]
    dealt = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), n).cast("long")
    asked = queries.select("row", "vec_id", "vector", dealt(F.lit(blocks), 1).alias("block")).mapInArrow(walk, T.StructType([T.StructField(*f) for f in fields]))
    table = spark.createDataFrame(paged, "leaf long, page long, parts long")
    held_rows = (
        indexed.join(F.broadcast(table), "leaf")  # a row per leaf of the fitted trees
        .select("page", dealt(F.col("parts"), 2).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "row", "vec_id", "vector", "leaf")
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        query, score, near, near_id, query_id = [], [], [], [], []
        ids, null = _ids(left["vec_id"].combine_chunks()) if left.num_rows else (None, None)
        row, leaf = left["row"].to_numpy(), left["leaf"].to_numpy()
        asked_row = right["row"].to_numpy()
        ways = right["leaves"].to_pylist()
        held = list(_by_length(left["vector"]))
        for n, which, q_rows in _by_length(right["query"]):
            for m, at, x in held:
                if m != n:
                    continue
                names, local = np.unique(leaf[at], return_inverse=True)
                spot = {int(v): i for i, v in enumerate(names)}
                for a in range(0, len(which), CHUNK):
                    some = which[a : a + CHUNK]
                    goes = np.zeros((len(some), len(names)), bool)
                    for i, w in enumerate(some):
                        goes[i, [spot[v] for v in ways[w] if v in spot]] = True
                    allowed = goes[:, local] & (asked_row[some][:, None] != row[at][None, :])
                    q, r, s = _best(q_rows[a : a + CHUNK], x, allowed, ids[at], null[at], k)
                    query.append(some[q]), near.append(at[r]), score.append(s)
        if not query:
            return pa.Table.from_pylist([], pa.schema([("row", pa.int64()), ("query_id", right["query_id"].type), ("near", pa.int64()), ("vec_id", right["query_id"].type), ("score", pa.float64())]))
        q, r = np.concatenate(query), np.concatenate(near)
        return pa.table(
            {"row": asked_row[q], "query_id": right["query_id"].take(pa.array(q)), "near": row[r], "vec_id": left["vec_id"].take(pa.array(r)), "score": np.concatenate(score)}
        )

    keys = ["page", "part", "block"]
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("query_id", id_type), T.StructField("near", T.LongType()), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])
    found = held_rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(compare, out)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "near"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
