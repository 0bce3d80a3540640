"""Similarity joins in a metric space: pivots, Voronoi regions, windows from the triangle inequality.

Input are *regions*, rows (region, pivot, node) such that any two nodes within the threshold share a region,
and a *sketch* of every node. A sketch is the parity of the node's features in 2**k cells. Sketches
differ in at most as many bits as sets differ in features, so the number of differing bits, a metric on
sketches, never exceeds the distance of what they stand for. ``reach`` says how many bits two nodes within the
threshold can differ by. So pivots, cells and windows work on sketches, and what they leave is verified exactly.

Each region is joined exactly, but only as far as needed to know which nodes are connected:

1. The region's pivot is compared with all its members (a star: as many pairs as members) and leaves.
   Regions with the same members are one.
2. Links join nodes to components. A region whose members are all in one component is settled.
3. A large open region chooses several pivots and falls apart into Voronoi cells: a member goes to its
   nearest pivot's cell and, as a boundary member, to each cell whose pivot is at most two thresholds
   farther away. Cells are regions again, and fall apart in turn. Where the caller knows ``finer`` regions, the
   members of open regions of more than LEAF get those instead, with new stars. Regions that cells would not make
   smaller, or that have few members outside their largest component, are dealt to pairs of blocks of members.
4. Small regions, cells and pairs of blocks are joined where they are: members are sorted by their distance
   to the pivot, and by the triangle inequality only those in a window of one threshold are compared (all of
   a region that tasks gave several pivots, whose distances don't compare).
   Pairs in different components whose sketches are near are candidates. A region sends on the nearest few of each
   component, and of these the nearest few of each component are verified. What is left of candidates after
   components have grown goes into the next round, which sends eight times as many, until none are left.

A pair within the threshold is never lost: with d(x,y) <= e, x in the cell of its nearest pivot p and q nearest
to y, d(y,p) <= d(x,p) + e <= d(x,q) + e <= d(y,q) + 2e, so y is in the cell of p too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.common import map_batches, stage

#: Regions of more members than CELLS fall apart into cells. Up to LEAF members are joined where they are.
CELLS, LEAF = 128, 1024
#: Members compared with pivots in one group.
GROUP = 2048
#: Pivots of a large region (about), and the rows that a task gathers before it works on whole groups.
PIVOTS, GATHER = 8, 4096
#: Links that one partition holds at most when it finds their components.
EDGES = 250_000


def stars(emitted: DataFrame) -> DataFrame:
    """From rows (region, node, pivot), those of regions that several nodes share: (region, pivot, node).

    The rows are dealt by region and read in order, so a region of any size needs no memory. What a task
    has of a region was merged before (``local_stars``): of a hot region it sends one row there, and the
    rows that already have a pivot are dealt evenly. Rows without a region pass through, with all columns.
    """
    deal = F.when(F.col("region").isNull(), F.xxhash64("node", "pivot", F.spark_partition_id())).when(F.col("pivot").isNull(), F.col("region")).otherwise(F.xxhash64("region", "node"))
    dealt = emitted.repartition(deal).sortWithinPartitions("region", "node")
    extra = [f for f in dealt.schema.fields if f.name not in ("region", "node", "pivot")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_region = last_pivot = None
        for batch in batches:
            named = batch.column("region").is_valid()
            if extra and (aside := batch.filter(pc.invert(named))).num_rows:
                yield aside.select(["region", "pivot", "node", *(f.name for f in extra)])
            batch = batch.filter(named)
            if not batch.num_rows:
                continue
            region, node = (batch.column(c).to_numpy() for c in ("region", "node"))
            local = batch.column("pivot").is_valid().to_numpy(zero_copy_only=False)
            pivot = batch.column("pivot").fill_null(0).to_numpy()
            out = [(region[local], pivot[local], node[local])]
            region, node = region[~local], node[~local]
            if len(region):
                first = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
                ends = np.r_[first[1:], len(region)]
                lead = np.repeat(node[first], ends - first)
                if last_region == region[0]:  # the region goes on from the batch before
                    lead[: ends[0]] = last_pivot
                last_region, last_pivot = region[-1], lead[-1]
                other = lead != node
                out.append((region[other], lead[other], node[other]))
            region, pivot, node = (np.concatenate(x) for x in zip(*out))
            if len(region):
                nothing = {f.name: pa.nulls(len(region), batch.schema.field(f.name).type) for f in extra}
                yield pa.RecordBatch.from_pydict({"region": region, "pivot": pivot, "node": node} | nothing)

    return map_batches(dealt, run, T.StructType([T.StructField(c, T.LongType()) for c in ("region", "pivot", "node")] + extra))


def local_stars(region: np.ndarray, node: np.ndarray) -> dict[str, np.ndarray]:
    """Merge a task's rows before they are sent: of each region one row, without a pivot, and for the other
    nodes rows that already name the first node as their pivot. Repeated rows are dropped."""
    order = np.lexsort((node, region))
    region, node = region[order], node[order]
    if len(region):
        keep = np.r_[True, (region[1:] != region[:-1]) | (node[1:] != node[:-1])]
        region, node = region[keep], node[keep]
    start = np.r_[True, region[1:] != region[:-1]] if len(region) else np.zeros(0, bool)
    first = np.flatnonzero(start)
    lead = np.repeat(node[first], np.diff(np.r_[first, len(region)]))
    return {"region": region, "node": node, "pivot": pa.array(lead, pa.int64(), mask=start)}


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) of every node of the edges (a, b) but the roots: the smallest node of what the edges connect."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])  # roots hang on smaller ones
        while not np.array_equal(up := root[root], root):
            root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[child]], nodes[child]


def local_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b) of each partition replaced by stars around the smallest node of what they connect.

    A narrow step in bounded memory: a task holds 2 * ``EDGES`` edges at most. When it has so many, it makes them
    stars; if those are still over half as many, it sends them on and begins anew, so that one partition's stars
    can then still touch each other. A partition of up to ``EDGES`` edges ends as whole stars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def shrunk() -> tuple[np.ndarray, np.ndarray]:
            return forest(*(np.concatenate(x) for x in zip(*held)))

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            count += batch.num_rows
            if count >= 2 * EDGES:
                held = [shrunk()]
                count = len(held[0][0])
                if count > EDGES:
                    yield pa.RecordBatch.from_pydict(dict(zip("ab", held[0])))
                    held, count = [], 0
        if count:
            yield pa.RecordBatch.from_pydict(dict(zip("ab", shrunk())))

    return map_batches(edges, run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link (a, b).

    Each partition first shrinks its links to stars. As long as more than ``EDGES`` are left, nodes are contracted into
    their smallest neighbour. Nodes are hashes, so neighbours' order is random and a round leaves a fraction of
    the nodes. Up to ``EDGES`` links are one partition's, which makes them stars around the roots.
    """
    edges, found = stage(local_forest(links.select("a", "b").filter("a <> b"))), None
    while True:
        count = edges.count()
        last = count <= EDGES
        if last:
            whole = local_forest(edges.coalesce(1))
            to = stage(whole.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("to")).distinct())
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            to = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        if found is None:
            found = to.withColumnRenamed("to", "root")
        elif count:
            moved = found.join(to.withColumnsRenamed({"node": "root", "to": "_to"}), "root", "left")
            found = stage(moved.select("node", F.coalesce("_to", "root").alias("root")))
        if last:
            return found
        hop = lambda side: to.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to"))
        left = edges.join(hop("a"), "a").join(hop("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).filter("a <> b")
        edges = stage(local_forest(left))


def parity(values: np.ndarray, log2_bits: int) -> bytes:
    """The sketch of a set of 64-bit hashes: the parity of its members in each of 2**log2_bits cells (6 or more)."""
    cells = np.bincount((values & np.uint64((1 << log2_bits) - 1)).astype(np.int64), minlength=1 << log2_bits)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches as rows of ``words`` 64-bit words; longer ones are folded, which merges their cells."""
    out = np.empty((len(sketches), words), np.uint64)
    size = np.array([len(s) for s in sketches]) // 8
    for w in np.unique(size).tolist():
        at = np.flatnonzero(size == w)
        part = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint64).reshape(len(at), w)
        while part.shape[1] > words:
            half = part.shape[1] // 2
            part = part[:, :half] ^ part[:, half:]
        out[at] = part
    return out


def bits_apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of differing bits of rows of words."""
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)


def sketch_pairs(pairs: DataFrame, points: DataFrame, reach: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b, na, nb, wa, wb, apart, near, even) of pairs (a, b): sizes, words of the sketches, the bits these differ by,
    whether that is within reach, and whether they are equally long."""
    side = lambda n: points.select(F.col("node").alias(n), F.col("n").alias(f"n{n}"), F.col("sk").alias(f"s{n}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, total = batch.column("a"), batch.column("b"), batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            left, right = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            wa, wb = (np.array([len(x) // 8 for x in side], np.int32) for side in (left, right))
            words = np.minimum(wa, wb)
            apart = np.zeros(len(words), np.int64)
            for w in np.unique(words).tolist():
                at = np.flatnonzero(words == w)
                apart[at] = bits_apart(folded([left[i] for i in at], w), folded([right[i] for i in at], w))
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "na": batch.column("na"), "nb": batch.column("nb"), "wa": wa, "wb": wb, "apart": apart.astype(np.int32), "near": apart <= reach(total), "even": wa == wb})

    return map_batches(both, run, T.StructType([both.schema[c] for c in ("a", "b", "na", "nb")]).add("wa", T.IntegerType()).add("wb", T.IntegerType()).add("apart", T.IntegerType()).add("near", T.BooleanType()).add("even", T.BooleanType()))


def by_group(rows: DataFrame, keys: list[str], within: list[str], work: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """Deal rows by ``keys``, order them also by ``within``, and let ``work`` turn whole groups into other rows.

    ``work`` gets columns by name and ``_start``, where groups begin; several groups at a time, about ``GATHER`` rows.
    Groups must be bounded.
    """
    names = rows.columns
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *within)

    def columns(table: pa.Table) -> dict:
        return {c: table.column(c).to_pylist() if pa.types.is_binary(table.schema.field(c).type) else table.column(c).to_numpy() for c in names}

    def starts(table: pa.Table) -> np.ndarray:
        marks = np.zeros(len(table), bool)
        marks[:1] = True
        for k in keys:
            x = table.column(k).to_numpy()
            marks[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(marks)

    def done(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = work(columns(table) | {"_start": at})
        if out is not None:
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            count += len(batch)
            if count >= GATHER:
                table = pa.Table.from_batches(held).combine_chunks()
                at = starts(table)
                if at[-1]:
                    yield from done(table.slice(0, at[-1]), at[:-1])
                rest = table.slice(at[-1])
                held, count = rest.to_batches(), 0
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from done(table, starts(table))

    return map_batches(dealt, run, schema)


def nearest_edges(region: np.ndarray, left: np.ndarray, right: np.ndarray, apart: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Which edges between components are among the ``many`` shortest of one of their two components in their
    region; and whether the edge's region has others."""
    edge = np.tile(np.arange(len(region)), 2)
    end = np.concatenate([left, right])
    order = np.lexsort((edge, apart[edge], end, region[edge]))
    r, x = region[edge[order]], end[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])]
    place = np.arange(len(order))
    rank = place - np.maximum.accumulate(np.where(new, place, 0))
    kept = np.zeros(len(region), bool)
    kept[edge[order[rank < many]]] = True
    return kept, np.isin(region, region[~kept])


def candidates(reach: Callable[[np.ndarray], np.ndarray], many: int) -> Callable[[dict], dict | None]:
    """Work for ``by_group``: the near pairs of members with different roots, the nearest of each component.

    Rows are sorted by ``dp``, the distance to the pivot, which their group has in common; a pair farther
    apart in it than the group's reach isn't compared. (``even``: dp is of sketches of one length; a group where
    that isn't so has no window.) In a group of two blocks only pairs across are compared.
    """

    def work(c: dict) -> dict | None:
        start = c["_start"]
        total = len(c["node"])
        group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, total]))
        size = np.array([len(x) for x in c["sk"]]) // 8
        words = np.minimum.reduceat(size, start)[group]
        even = np.minimum.reduceat(c["even"].astype(np.int8), start)[group] > 0
        window = np.where(even, reach(2 * c["high"]).astype(np.int64), np.iinfo(np.int64).max)
        across = c["bi"] != c["bj"]
        found = []
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)
            bits, g = folded([c["sk"][i] for i in at], w), group[at]
            dp, root, n, win, block, cross = (x[at] for x in (c["dp"], c["root"], c["n"], window, c["block"], across))
            for k in range(1, len(at)):
                open_ = (g[k:] == g[:-k]) & (np.abs(dp[k:] - dp[:-k]) <= win[:-k])
                if not open_.any():
                    break
                i = np.flatnonzero(open_ & (root[k:] != root[:-k]) & (~cross[:-k] | (block[k:] != block[:-k])))
                if len(i):
                    apart = bits_apart(bits[i], bits[i + k])
                    ok = apart <= reach(n[i] + n[i + k])
                    found.append((at[i[ok]], at[i[ok] + k], apart[ok]))
        if not found:
            return None
        i, j, apart = (np.concatenate(x) for x in zip(*found))
        if not len(i):
            return None
        low, high = np.minimum(c["root"][i], c["root"][j]), np.maximum(c["root"][i], c["root"][j])
        kept, more = nearest_edges(group[i], low, high, apart, many)
        i, j, apart, low, high, more = (x[kept] for x in (i, j, apart, low, high, more))
        a, b = c["node"][i], c["node"][j]
        return {"a": np.minimum(a, b), "b": np.maximum(a, b), "ra": low, "rb": high, "apart": apart.astype(np.int32), "more": more}

    return work


def voronoi(reach: Callable[[np.ndarray], np.ndarray]) -> Callable[[dict], dict | None]:
    """Work for ``by_group``: groups hold a region's pivots and some of its members; returns the members' cells.

    All sketches of a region are folded to the same length (``low``), so that distances are of one metric.
    """

    def work(c: dict) -> dict | None:
        out = []
        ends = np.r_[c["_start"][1:], len(c["node"])]
        for s, e in zip(c["_start"].tolist(), ends.tolist()):
            bits = folded(c["sk"][s:e], int(c["low"][s]))
            lead = c["pivot"][s:e]
            pivots, members = np.flatnonzero(lead), np.flatnonzero(~lead)
            if not len(members):
                continue
            apart = np.stack([bits_apart(bits[members], bits[p]) for p in pivots], axis=1)
            inside = apart <= apart.min(axis=1)[:, None] + 2 * reach(2 * c["high"][s : s + 1])
            m, p = np.nonzero(inside)
            out.append((np.full(len(m), c["region"][s]), c["node"][s:e][pivots[p]], c["node"][s:e][members[m]], apart[m, p].astype(np.int32), np.full(len(m), c["size"][s])))
        if not out:
            return None
        return dict(zip(("region", "cell", "node", "dp", "size"), (np.concatenate(x) for x in zip(*out))))

    return work


def open_regions(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (region, node, n, words, dp, even, whole) of regions that are not settled, with their roots and the region's
    size, members outside its largest component, that component, least sketch and largest set."""
    placed = stage(members.join(roots, "node", "left").select(*members.columns, F.coalesce("root", "node").alias("root")))
    parts = placed.groupBy("region", "root").agg(F.count(F.lit(1)).alias("c"), F.min("words").alias("w"), F.max("n").alias("h"))
    found = parts.groupBy("region").agg(F.sum("c").alias("size"), F.max("c").alias("top"), F.max_by("root", F.struct("c", "root")).alias("major"), F.min("w").alias("low"), F.max("h").alias("high"))
    found = found.filter("top < size").select("region", "size", (F.col("size") - F.col("top")).alias("rest"), "major", "low", "high")
    return stage(placed.join(found, "region"))


def split_regions(members: DataFrame, roots: DataFrame, points: DataFrame, reach: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Large open regions replaced by their Voronoi cells, and these by theirs, as long as that makes them smaller."""
    done: DataFrame | None = None
    depth = 0
    while True:
        depth += 1
        placed = open_regions(members, roots)
        large = (F.col("size") > CELLS) & (F.col("rest") > CELLS // 2) & ~F.col("whole")
        small = placed.filter(~large).select(*members.columns)
        done = small if done is None else done.unionByName(small)
        large = placed.filter(large)
        if large.isEmpty():
            return done
        rank = F.pmod(F.xxhash64(F.lit(depth), "node"), F.lit(1 << 30))
        least = large.groupBy("region").agg(F.min(rank).alias("_least"))
        parts = F.ceil(F.col("size") / GROUP).cast("int")
        picked = stage(large.join(least, "region").filter((rank == F.col("_least")) | (rank / float(1 << 30) * F.col("size") < PIVOTS)).select("region", "node", "size", "low", "high", parts.alias("_parts")))
        fields = ["region", "node", "size", "low", "high"]
        dealt = picked.select(*fields, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(True).alias("pivot"))
        dealt = dealt.unionByName(large.select(*fields, F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.lit(False).alias("pivot")))
        cells = by_group(dealt.join(points.select("node", "sk"), "node"), ["region", "part"], ["pivot", "node"], voronoi(reach), "region long, cell long, node long, dp int, size long")
        cells = stage(cells)
        counts = cells.groupBy("region", "cell").agg(F.count(F.lit(1)).alias("c"), F.max("size").alias("size"))
        grown = counts.groupBy("region").agg(((F.sum("c") > 1.5 * F.max("size")) | (F.max("c") > 0.75 * F.max("size"))).alias("grown"))
        judged = stage(grown)
        fresh = cells.join(judged.filter("not grown"), "region").select(F.xxhash64("region", "cell").alias("region"), "node", "dp")
        fresh = fresh.join(large.select("node", "n", "words").dropDuplicates(["node"]), "node").select("region", "node", "n", "words", "dp", F.lit(True).alias("even"), F.lit(False).alias("whole"))
        stuck = large.join(judged.filter("grown"), "region").select("region", "node", "n", "words", "dp", "even", F.lit(True).alias("whole"))
        members = stage(fresh.unionByName(stuck))


def deal_blocks(placed: DataFrame) -> DataFrame:
    """Members of open regions dealt to groups (region, bi, bj) of about ``LEAF`` members.

    A region of up to ``LEAF`` members is one group. In others the members outside the largest component are
    in blocks that meet each other and the blocks of the largest component.
    """
    half = LEAF // 2
    minor = F.ceil(F.col("rest") / half).cast("int")
    major = F.ceil((F.col("size") - F.col("rest")) / half).cast("int")
    out = placed.withColumn("_outside", F.col("root") != F.col("major"))
    one = F.col("size") <= LEAF
    block = F.when(one, 0).when(F.col("_outside"), F.pmod(F.xxhash64("node"), minor)).otherwise(minor + F.pmod(F.xxhash64("node"), major)).cast("int")
    others = F.when(one, F.array(F.lit(0))).when(F.col("_outside"), F.sequence(F.lit(0), minor + major - 1)).otherwise(F.sequence(F.lit(0), minor - 1))
    out = out.withColumn("block", block).withColumn("_o", F.explode(others))
    return out.select("region", F.least("block", "_o").alias("bi"), F.greatest("block", "_o").alias("bj"), "block", "node", "root", "n", "dp", "even", "high")


def connect(
    starred: DataFrame,
    points: DataFrame,
    reach: Callable[[np.ndarray], np.ndarray],
    verify: Callable[[DataFrame], DataFrame],
    finer: Callable[[DataFrame, int], DataFrame | None] | None = None,
) -> DataFrame:
    """(node, root) of the nodes in ``starred`` (region, pivot, node) that have links.

    ``points`` holds (node, n, sk): each node's size and sketch. ``reach`` takes the sum of two nodes' sizes and
    returns the bits that the sketches of nodes within the threshold differ by at most. ``verify`` returns
    those of its pairs (a, b) that are within the threshold. ``finer`` takes nodes and a depth, from 1 on, and returns
    the nodes' starred regions of that depth, such that any two nodes within the threshold share one, or None.
    """
    points = stage(points)
    tested, links, roots, measured = star_links(starred, points, reach, verify)
    members, depth, done = region_members(starred, measured), 1, None
    while finer is not None:
        placed = open_regions(members, roots)
        large = (F.col("size") > LEAF) & (F.col("rest") > LEAF // 2)
        crowd = stage(placed.filter(large).select("node").distinct())
        starred = None if crowd.isEmpty() else finer(crowd, depth)
        small = (placed if starred is None else placed.filter(~large)).select(*members.columns)
        done = small if done is None else done.unionByName(small)
        if starred is None:
            break
        tested, links, roots, measured = star_links(starred, points, reach, verify, (tested, links, roots))
        members, depth = region_members(starred, measured), depth + 1
    members = split_regions(members, roots, points, reach) if finer is None else done
    many = 2 if finer is None else LEAF  # what finer regions leave has few candidates
    while True:
        placed = open_regions(members, roots)
        if placed.isEmpty():
            return roots
        dealt = deal_blocks(placed).join(points.select("node", "sk"), "node")
        found = by_group(dealt, ["region", "bi", "bj"], ["dp", "node"], candidates(reach, many), "a long, b long, ra long, rb long, apart int, more boolean")
        # groups whose sketches are folded differently measure a pair differently; the longest sketches say the most
        found = stage(found.groupBy("a", "b", "ra", "rb").agg(F.max("apart").alias("apart"), F.max("more").alias("more")))
        best = Window.partitionBy("r").orderBy("apart", "a", "b")
        ranked = found.select(F.explode(F.array("ra", "rb")).alias("r"), "a", "b", "apart").withColumn("_k", F.row_number().over(best))
        kept = stage(ranked.filter(F.col("_k") <= many).select("a", "b").distinct())
        total = found.agg(F.count(F.lit(1)).alias("n"), F.max("more").alias("more")).first()
        more = bool(total["more"]) or total["n"] > kept.count()
        fresh = stage(kept.join(tested, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            tested, links = stage(tested.unionByName(fresh)), stage(links.unionByName(verify(fresh)))
            roots = components(links)
        if not more:
            return roots
        many *= 8


def ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def star_links(
    starred: DataFrame, points: DataFrame, reach: Callable[[np.ndarray], np.ndarray], verify: Callable[[DataFrame], DataFrame], before: tuple[DataFrame, ...] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Compare members with their pivots: the pairs (a, b) tested, those that link, (node, root), and all pairs' distances.
    ``before`` holds the first three of earlier stars, whose pairs, and those within a component, are not tested again."""
    measured = stage(sketch_pairs(starred.select(*ordered("pivot", "node")).distinct(), points, reach))
    near = measured.filter("near").select("a", "b", "apart")
    if before:
        near = stage(apart_pairs(near.join(before[0], ["a", "b"], "left_anti"), before[2]))
    # first each node's nearest pivot, then the pairs that are still apart
    nearest = near.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "apart").groupBy("node").agg(F.min(F.struct("apart", "a", "b")).alias("x"))
    tested = stage(nearest.select("x.a", "x.b").distinct())
    links = stage(verify(tested))
    if before:
        links = before[1].unionByName(links)
    roots = components(links)
    left = stage(apart_pairs(near.join(tested, ["a", "b"], "left_anti"), roots).select("a", "b"))
    tested = tested.unionByName(left)
    if not left.isEmpty():
        links = links.unionByName(stage(verify(left)))
        roots = components(links)
    return before[0].unionByName(tested) if before else tested, links, roots, measured


def region_members(starred: DataFrame, measured: DataFrame) -> DataFrame:
    """Members (region, node, n, words, dp, even, whole) of what stars don't settle: regions of three nodes and more.

    The pivot has been compared and leaves. Tasks may have sent a node several times, and with pivots of their own: it is
    one member, and where a region has several pivots dp has no common origin (not ``even``).
    """
    held = starred.groupBy("region", "node").agg(F.min("pivot").alias("pivot"), F.max("pivot").alias("_last"))
    sizes = held.groupBy("region").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), (F.min("pivot") == F.max("_last")).alias("one"))
    once = stage(sizes.filter("c > 1").groupBy("c", "x", "y").agg(F.min(F.struct("region", "one")).alias("r")).select("r.*"))
    placed = held.join(once, "region").select("region", "node", "one", *ordered("pivot", "node"))
    own = lambda x: F.when(F.col("node") == F.col("a"), F.col(f"{x}a")).otherwise(F.col(f"{x}b"))
    fields = [own("n").alias("n"), own("w").alias("words"), F.col("apart").alias("dp"), (F.col("even") & F.col("one")).alias("even"), F.lit(False).alias("whole")]
    return stage(placed.join(measured, ["a", "b"]).select("region", "node", *fields))


def apart_pairs(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, ...) whose nodes have different roots."""
    side = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"r{n}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)
