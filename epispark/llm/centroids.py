"""Centroid clustering with a vantage-point tree over the centroids, in whole numbers.

Each round builds the tree anew from the few centroids, broadcasts it (its size is bounded by ``LARGEST``), and every vector
looks its nearest centroid up: best first, by branch and bound. A node has a vantage point, and its subtree the least and
greatest distance to it; the triangle inequality bounds what the subtree can hold. A subtree is pruned only if its bound is above
the best distance so far: one that may hold an equally near centroid is visited (inclusive radius), since of
equally near centroids the smallest number counts. Distances of vectors to centroids are exact integers; bounds, which are roots,
give way by more than their rounding.

Tasks search for all vectors of a batch in step (each vector has its own queue, a row of bounds), and sum their vectors by cluster,
so a round sends one row a task and cluster, whatever the clusters' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import session_defaults, stage, unused

#: Components a tree holds at most: 64 MB.
LARGEST = 1 << 23
#: Components of vectors: with whole numbers up to this, squared distances of 64 components fit in 64 bits.
MOST = 1 << 27
#: Centroids in a leaf at most, and vectors searched in step.
LEAF, STEP = 4, 2048
#: Bounds give way by this share of the distances that they are made from.
SLACK = 1e-9


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers."""
    d = x - y
    return np.einsum("...i,...i->...", d, d)


@dataclass
class Tree:
    """Nodes by number; node 0 is the root. ``near`` and ``far`` are the inner and outer child (-1: none), ``least`` and ``most`` the
    range of distances from the parent's vantage point; ``members`` are the centroids that a node compares: a leaf's, or the vantage point."""

    points: np.ndarray
    members: list[np.ndarray]
    near: np.ndarray
    far: np.ndarray
    least: np.ndarray
    most: np.ndarray


def build(points: np.ndarray) -> Tree:
    """The tree of the centroids (rows of whole numbers). The vantage point of a node is the centroid farthest from its first one."""
    members, near, far, least, most = [], [], [], [], []

    def node(own: np.ndarray, low: float, high: float) -> int:
        at = len(members)
        for x, value in ((members, own), (near, -1), (far, -1), (least, low), (most, high)):
            x.append(value)
        if len(own) > LEAF:
            lead = own[np.argmax(squared(points[own], points[own[0]]))]
            rest = own[own != lead]
            away = squared(points[rest], points[lead])
            order = np.argsort(away, kind="stable")
            half = len(rest) // 2
            members[at] = np.array([lead])
            for side, part in ((near, order[:half]), (far, order[half:])):
                side[at] = node(rest[part], float(np.sqrt(away[part].min())), float(np.sqrt(away[part].max())))
        return at

    if len(points):
        node(np.arange(len(points)), 0.0, 0.0)
    return Tree(points, members, np.array(near, np.int64), np.array(far, np.int64), np.array(least), np.array(most))


def nearest(tree: Tree, x: np.ndarray, visits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; of equally near ones the smallest number. ``visits`` gets the
    number of distances computed."""
    n, count = len(x), len(tree.members)
    best, where = np.full(n, np.iinfo(np.int64).max), np.full(n, len(tree.points))
    queue = np.full((n, count), np.inf)
    queue[:, :1] = 0.0
    active = np.arange(n)
    while len(active):
        node = queue[active].argmin(axis=1)
        bound = queue[active, node]
        going = bound <= np.sqrt(best[active].astype(float)) * (1 + SLACK)
        active, node = active[going], node[going]
        queue[active, node] = np.inf
        for v in np.unique(node).tolist():
            at = active[node == v]
            for c in tree.members[v].tolist():
                away = squared(x[at], tree.points[c])
                if visits is not None:
                    visits.append(len(at))
                closer = (away < best[at]) | ((away == best[at]) & (c < where[at]))
                best[at[closer]], where[at[closer]] = away[closer], c
            if tree.near[v] >= 0:
                root = np.sqrt(away.astype(float))
                for child in (tree.near[v], tree.far[v]):
                    bound = np.maximum(tree.least[child] - root, root - tree.most[child])
                    queue[at, child] = np.maximum(bound - SLACK * (root + tree.most[child]), 0.0)
        active = active[np.isfinite(queue[active].min(axis=1))] if count else active[:0]
    return where, best


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def batches_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for s in range(0, len(batch), STEP):
        part = batch.slice(s, STEP)
        yield part, matrix(part.column("q"), width)


def sums(rows: DataFrame, tree: Tree, width: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, count, sums of components) of the clusters that have vectors: one row a centroid reaches the driver."""
    sent, k = rows.sparkSession.sparkContext.broadcast(tree), len(tree.points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x in batches_of(batch, width):
                where, _ = nearest(sent.value, x)
                order = np.argsort(where, kind="stable")
                found, at = np.unique(where[order], return_index=True)
                total[found] += np.add.reduceat(x[order], at, axis=0)
                count += np.bincount(where, minlength=k)
        full = np.flatnonzero(count)
        if len(full):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(full.astype(np.int32)), "n": count[full], "s": pa.array(list(total[full]), pa.list_(pa.int64()))})

    parts = rows.select("q").mapInArrow(run, "cluster int, n long, s array<long>")
    # a component's sum may pass 64 bits: exact decimals
    whole = parts.select("cluster", "n", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(28, 0)")).alias("x"), F.sum("n").alias("n"))
    found = whole.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).collect()
    sent.unpersist()
    return [(r["cluster"], r["n"], [int(c["x"]) for c in r["s"]]) for r in found]


def cluster(
    df: DataFrame,
    k: int = 8,
    rounds: int = 10,
    seed: int = 3,
    width: int = 64,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Assign each kept vector to one of ``k`` centroids: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of ``width`` components, none null, NaN or infinite; a component x becomes floor(scale * x). The first centroids are the kept
    vectors with the smallest sha256 of ``seed:id``. Each round replaces a centroid by its vectors' componentwise floor(sum / count); one without
    vectors stays. Inertia is the sum of squared distances, of the cluster and of all.

    Other vectors (null ones too) have no row. A null id counts as the text ``null`` in the hash; repeated rows count each and, like other
    ties in the hash, are taken in the order of their components. With fewer than ``k`` kept vectors there are as many centroids; equal centroids leave
    all vectors to the first. An empty table gives no rows. A component of over 2**27 in whole numbers is an error: distances would not fit in 64 bits.
    Columns other than those two are not read, whatever their names.
    """
    if k < 1 or k * width > LARGEST:
        raise ValueError(f"k must be 1 at least, and k * width {LARGEST} at most")
    spark = df.sparkSession
    session_defaults(spark)
    vector = F.col(f"`{vector_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    rows = rows.filter((F.size("x") == width) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    whole = F.transform("x", lambda x: F.floor(F.when(F.abs(x * scale) <= MOST, x * scale).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("double"))).cast("int"))
    kept = stage(rows.select("id", whole.alias("q")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    points = np.array([r["q"] for r in kept.select("q", digest.alias("h")).orderBy("h", "q").limit(k).collect()], np.int64).reshape(-1, width)
    for _ in range(rounds):
        if not len(points):
            break
        points = points.copy()
        for c, n, x in sums(kept, build(points), width):
            points[c] = [s // n for s in x]
    sent = spark.sparkContext.broadcast(build(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in batches_of(batch, width):
                where, best = nearest(sent.value, x)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(where.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])

    placed = stage(kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, cluster int, distance long"))
    # one row a centroid: k is bounded
    each = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28, 0)")).alias("cluster_inertia"))
    every = each.agg(F.sum("cluster_inertia").alias("inertia"))
    names = spark.createDataFrame([(i, ",".join(map(str, p))) for i, p in enumerate(points.tolist())], "cluster int, c string").select("cluster", F.sha2("c", 256).alias("centroid_sha256"))
    about = each.crossJoin(F.broadcast(every)).join(names, "cluster").select("cluster", F.col("cluster_inertia").cast("bigint"), F.col("inertia").cast("bigint"), "centroid_sha256")
    own = unused(placed, id_col)
    out = placed.withColumnRenamed("id", own).join(F.broadcast(about), "cluster")
    return out.select(F.col(own).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
