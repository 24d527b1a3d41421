"""Exact integer k-means; each vector finds its centroid in a vantage-point tree.

The tree over the centroids is rebuilt on the driver and sent with the tasks in every round (some
dozens of vectors, whatever the input). A vector walks it best-first: it opens the node of smallest
lower bound next and stops when that bound is beyond its best distance; a bound that just equals it
is still opened, because a tie may go to a smaller number. Distances that decide are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from changerisk.llm.shared import stored

#: Components, factor to integers, centroids, rounds, seed of the starting order.
DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Centroids of a leaf.
LEAF = 4
#: Vectors that walk side by side.
CHUNK = 4096
_LIMIT = 2**63 - 1


def integer_vectors(rows: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``rows`` (vec_id, embedding) with ``v``, the floors of ``scale`` times the components.

    Vectors that are null, of another length, or hold nulls, NaN or infinities are left out.
    Integers beyond ``2**bits`` are set to it, so that squared distances fit a long (27 bits for
    64 components: components beyond half a million).
    """
    bits = (62 - (dims - 1).bit_length()) // 2 - 1
    edge = float(2**bits) / scale
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select("vec_id", "embedding").where((F.size("embedding") == dims) & F.coalesce(fine, F.lit(False)))
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double"), F.lit(-edge)), F.lit(edge)) * scale).cast("long")
    return kept.select("vec_id", F.transform("embedding", whole).alias("v"))


@dataclass
class _Node:
    #: Centroids measured when the node is opened: a leaf's, or the vantage point alone.
    members: np.ndarray
    #: (node, least, greatest distance from the vantage point to the centroids below it).
    below: list[tuple[int, float, float]]


def vantage_tree(centroids: np.ndarray, leaf: int = LEAF) -> list[_Node]:
    """Nodes of the tree, the root first. The vantage point is the smallest number of its part."""
    nodes: list[_Node] = []

    def build(ids: np.ndarray) -> int:
        me = len(nodes)
        if len(ids) <= leaf:
            nodes.append(_Node(ids, []))
            return me
        nodes.append(_Node(ids[:1], []))
        rest = ids[1:]
        gap = centroids[rest] - centroids[ids[0]]
        far = np.sqrt((gap * gap).sum(1).astype(np.float64))
        order = np.argsort(far, kind="stable")
        middle = len(rest) // 2
        for part in (np.sort(order[:middle]), np.sort(order[middle:])):
            if len(part):
                nodes[me].below.append((build(rest[part]), float(far[part].min()), float(far[part].max())))
        return me

    build(np.arange(len(centroids)))
    return nodes


def nearest(x: np.ndarray, centroids: np.ndarray, nodes: list[_Node]) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid (ties: the smaller number)."""
    number = np.full(len(x), len(centroids), np.int64)
    best = np.full(len(x), _LIMIT, np.int64)
    bound = np.full((len(x), len(nodes)), np.inf)
    bound[:, 0] = 0.0
    rows = np.arange(len(x))
    while len(rows):
        pick = bound[rows].argmin(1)
        least = bound[rows, pick]
        # Bounds are differences of rounded roots: leave a margin, then open what could still tie.
        open_ = np.isfinite(least) & (least * (1 - 1e-9) - 1e-6 <= np.sqrt(best[rows].astype(np.float64)))
        rows, pick = rows[open_], pick[open_]
        for node in np.unique(pick):
            r = rows[pick == node]
            now = bound[r, node]
            bound[r, node] = np.inf
            for c in nodes[node].members:
                gap = x[r] - centroids[c]
                d = np.einsum("ij,ij->i", gap, gap)
                better = (d < best[r]) | ((d == best[r]) & (c < number[r]))
                best[r[better]], number[r[better]] = d[better], c
            if nodes[node].below:
                reach = np.sqrt(d.astype(np.float64))
                for child, low, high in nodes[node].below:
                    bound[r, child] = np.maximum(now, np.maximum(reach - high, low - reach))
    return number, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _assigner(centroids: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    nodes = vantage_tree(centroids)

    def assign(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [nearest(x[a : a + CHUNK], centroids, nodes) for a in range(0, len(x), CHUNK)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    return assign


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: each task returns its sums, at most a row per centroid."""
    k, dims = centroids.shape
    assign = _assigner(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["v"], dims)
                number, _ = assign(x)
                order = np.argsort(number, kind="stable")
                first = np.flatnonzero(np.diff(number[order], prepend=-1))
                total[number[order][first]] += np.add.reduceat(x[order], first, axis=0)
                n += np.bincount(number, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["c", "n", "s"])

    parts = vectors.select("v").mapInArrow(sums, "c long, n long, s array<long>")
    whole = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s"))
    moved = centroids.copy()
    for row in whole.collect():  # one row per centroid
        moved[row.c] = [s // row.n for s in row.s]
    return moved


def start_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of smallest SHA-256 of seed and id, in that order; rows of one id by their vectors."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.select(F.sha2(text.cast("binary"), 256).alias("_h"), "v").orderBy("_h", "v").limit(k)
    return np.array([row.v for row in first.collect()], np.int64)


def cluster_vectors(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Cluster of each vector of ``rows`` (vec_id, embedding) after ``rounds`` rounds of exact k-means.

    Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256). Vectors that
    :func:`integer_vectors` leaves out have no row; repeated rows each have one, and each may start
    a centroid; fewer vectors than ``k`` make fewer centroids; a null id counts as the empty text
    in the starting order; an empty table gives no rows; other columns are not read. Sums of
    distances beyond a long are given as the largest long.
    """
    vectors = stored(integer_vectors(rows, dims, scale))
    out = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = start_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(out)]).limit(0)
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)
    assign = _assigner(centroids)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, d = assign(_matrix(batch["v"], dims))
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(number.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    fields = [T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    labelled = stored(vectors.mapInArrow(label, T.StructType(fields)))
    sums = {r.cluster: int(r.s) for r in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = min(sum(sums.values()), _LIMIT)
    facts = [
        (c, min(s, _LIMIT), inertia, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())
    ]
    known = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per centroid: k rows, whatever the input.
    return labelled.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
