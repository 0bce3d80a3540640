"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

1. Vectors are scaled to length one; equal ones are merged, with their number as weight. What moves between tasks are components of 16 bits. They
   tell angles up to a known bound, so all but the pairs that are that near to the threshold are decided by them.
2. Balls: one tree without overlap deals the vectors to groups, and each group covers its vectors by balls so small that any two members of a
   ball link. A dense group of near copies costs some balls, not all its pairs.
3. Forest: many trees split the balls' centres by random directions at random quantiles near the median. Centres close to a split go to both
   sides. Only thresholds are kept: they are taken in rounds from samples of the groups that are still too large. Projections are exact sums of
   whole numbers, so any task that has a vector can tell its groups.
4. Groups: each centre is sent to its groups, in parts of a bounded number of rows, whose shuffle files are gone before the next part begins:
   the forest's copies grow faster than the table, what lies on disk at once does not. A group so dense that splits don't shrink it, or only by
   sending most members to both sides, is dealt to pairs of blocks of its members. By the triangle inequality two balls link wholly, or not at
   all, or are open. A pair that shares several groups counts in the first of them, so no pairs are sent to be made distinct, only sums, and the
   edges of a spanning forest.
5. Open pairs of balls are compared member by member, also in parts. What is left, pairs of vectors too near to the threshold for 16 bits, is
   compared in double precision, with vectors from the table. Components are joined over balls.

Links that count are those of cosine in double precision; splits can miss links near the threshold only: a pair is missed if every tree parts it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.common import OUT_ROWS, discard, map_batches, mix64, session_defaults, stage, unused
from epispark.llm.metric_join import by_group, components, forest

#: Members that a group has at most, members of it that are compared with the others at a time, and members of a block of a group that splits don't shrink.
GROUP, LEAF, BLOCK = 2048, 256, 1024
#: A split is worth it if no side keeps more than this share of its group, and if both sides together hold at most so many times its members.
SHRUNK, GROWN = 0.9, 1.35
#: Vectors of a large group from which thresholds are taken (about), and the depth to which they split it in a round.
SAMPLE, DEPTH = 1024, 5
#: Groups of a tree without overlap (about): of tables so large that there would be more, groups are larger.
GROUPS = 16_384
#: Rows that a part sends at once: so many times the number of centres, or so many.
PART, ROWS = 3, 500_000
#: Bytes of vectors that a task gathers, to pack what it has of a group in one row.
PACK = 8 << 20
#: Columns of what groups and pairs give: what it is, two balls or vectors, and a number.
OUTCOME = "what int, a long, b long, n long"
#: Deletes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def whole_numbers(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of 16-bit components, and their lengths."""
    q = np.frombuffer(b"".join(column), np.int16).reshape(len(column), -1).astype(np.float64)
    return q, np.sqrt((q * q).sum(axis=1))


@lru_cache(maxsize=256)
def directions(tree: int, levels: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The random directions of a tree's levels, as columns of whole numbers, and their lengths."""
    d = np.array([np.rint(np.random.default_rng([tree, level, width]).standard_normal(width) * 4096) for level in range(levels)]).reshape(levels, width).T
    return np.ascontiguousarray(d), np.maximum(np.sqrt((d * d).sum(axis=0)), 1)


def hashed(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(x.view(np.uint64) + mix64(np.asarray(y, np.int64).view(np.uint64) + np.uint64(1))).view(np.int64)


def found_in(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``x`` in a sorted array, and which of them are there."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


class Forest:
    """The thresholds of some trees: a few numbers a group. Kinds of few vectors aren't split: they are groups of the first tree.

    ``splits`` has for each tree paths, which are hashes, and cuts; ``tables`` its nodes, groups too: sorted paths, cuts (of groups NaN), and the places of
    their two sides."""

    def __init__(self, first: int, trees: int, about: float):
        self.first, self.trees, self.about = first, trees, about
        self.kinds, self.depth = np.zeros(0, np.int64), [0] * trees
        self.splits = [(np.zeros(0, np.int64), np.zeros(0)) for _ in range(trees)]
        self.tables = [(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 2), np.int32)) for _ in range(trees)]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"splits": None}

    def roots(self, tree: int, kind: np.ndarray) -> np.ndarray:
        return hashed(kind, self.first + tree)

    def margin(self, width: int) -> float:
        return self.about / np.sqrt(width)

    def project(self, q: np.ndarray, length: np.ndarray, tree: int, levels: int) -> np.ndarray:
        """Rows' places along the directions of a tree's levels. Sums are of whole numbers, so they are the same wherever they are made."""
        d, long = directions(self.first + tree, levels, q.shape[1])
        return q @ d / length[:, None] / long

    def add(self, tree: int, paths: np.ndarray, cuts: np.ndarray, depth: int) -> None:
        paths, cuts = (np.concatenate(x) for x in zip(self.splits[tree], (paths, cuts)))
        self.splits[tree], self.depth[tree] = (paths, cuts), max(self.depth[tree], depth)
        sides = np.stack([hashed(paths, 1), hashed(paths, 2)], axis=1)
        every = np.unique(np.concatenate([paths, sides.ravel()]))
        at, cut, to = np.searchsorted(every, paths), np.full(len(every), np.nan), np.zeros((len(every), 2), np.int32)
        cut[at], to[at] = cuts, np.searchsorted(every, sides)
        self.tables[tree] = every, cut, to

    def route(self, tree: int, q: np.ndarray, length: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, path, level): the groups of a tree that rows are in."""
        kinds, own = np.unique(kind, return_inverse=True)
        paths, cuts, to = self.tables[tree]
        root = self.roots(tree, kinds)
        at, split = found_in(paths, root)
        whole = np.flatnonzero(~split[own] if tree == 0 else found_in(self.kinds, kinds)[1][own] & ~split[own])
        row = np.flatnonzero(split[own] & (found_in(self.kinds, kinds)[1][own] if tree else True))
        out, level, at = [(whole, root[own[whole]], np.zeros(len(whole), np.int64))], 0, at[own[row]]
        x, margin = self.project(q, length, tree, self.depth[tree]) if len(row) else None, self.margin(q.shape[1])
        while len(row):
            cut = cuts[at]
            if (done := np.isnan(cut)).any():
                out.append((row[done], paths[at[done]], np.full(done.sum(), level)))
                row, at, cut = row[~done], at[~done], cut[~done]
                if not len(row):
                    break
            away = x[row, level] - cut
            low, high = away < margin, away >= -margin
            row, at = np.concatenate([row[low], row[high]]), np.concatenate([to[at[low], 0], to[at[high], 1]])
            level += 1
        return tuple(np.concatenate(x) for x in zip(*out))


def by_width(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Larger batches, of about ``most`` bytes of vectors (q) of equally many components."""
    held, count = [], 0

    def parts() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        size = pc.binary_length(table.column("q"))
        widths = pc.unique(size).to_pylist()
        for w in widths:
            yield from (table if len(widths) == 1 else table.filter(pc.equal(size, w)).combine_chunks()).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.column("q").nbytes
            if count >= most:
                yield from parts()
                held, count = [], 0
    if held:
        yield from parts()


def counted(rows: DataFrame, forest_: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tree, path, members) of the groups of large kinds, ordered by tree and path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(forest_.trees)]
        for batch in by_width(batches, PACK):
            batch = batch.filter(pa.array(found_in(forest_.kinds, batch.column("kind").to_numpy())[1]))
            if not batch.num_rows:
                continue
            (q, length), kind = whole_numbers(batch.column("q").to_pylist()), batch.column("kind").to_numpy()
            for tree, (path, n) in enumerate(held):
                new, more = np.unique(forest_.route(tree, q, length, kind)[1], return_counts=True)
                path, at = np.unique(np.concatenate([path, new]), return_inverse=True)
                held[tree] = path, np.bincount(at, np.concatenate([n, more])).astype(np.int64)
        for tree, (path, n) in enumerate(held):
            yield pa.RecordBatch.from_pydict({"tree": np.full(len(path), tree), "path": path, "n": n})

    sums = map_batches(rows.select("kind", "q"), run, "tree long, path long, n long").groupBy("tree", "path").agg(F.sum("n").alias("n")).toPandas()
    tree, path, n = (sums[c].to_numpy(np.int64) for c in ("tree", "path", "n"))
    order = np.lexsort((path, tree))
    return tree[order], path[order], n[order]


def thresholds(forest_: Forest, target: int) -> Callable[[dict], dict]:
    """Work for ``by_group``: from a group's sample the thresholds of its splits; NaN where a split is not worth it, so that the part stays whole (it
    is dense: comparing it as it is costs less)."""

    def work(c: dict) -> dict:
        out: list[tuple[int, int, float, int]] = []
        for s, e in zip(c["_start"].tolist(), np.r_[c["_start"][1:], len(c["path"])].tolist()):
            tree, level, size = (int(c[n][s]) for n in ("tree", "level", "size"))
            depth = depth_of(size, target)
            q, length = whole_numbers(c["q"][s:e])
            x, margin = forest_.project(q, length, tree, level + depth), forest_.margin(q.shape[1])
            parts = [(int(c["path"][s]), level, np.arange(e - s))]
            while parts:
                path, at, own = parts.pop()
                if at > level and (at == level + depth or size * len(own) <= 0.75 * target * (e - s) or len(own) < SAMPLE >> DEPTH):
                    continue
                rng = np.random.default_rng([path & 0xFFFFFFFF, (path >> 32) & 0xFFFFFFFF])
                cut = float(np.quantile(x[own, at], rng.uniform(0.4, 0.6)))
                sides = [own[x[own, at] - cut < margin], own[x[own, at] - cut >= -margin]]
                if max(map(len, sides)) > SHRUNK * len(own) or sum(map(len, sides)) > GROWN * len(own):
                    cut, sides = float("nan"), []
                out.append((tree, path, cut, at))
                parts += [(int(hashed(np.array([path]), k + 1)[0]), at + 1, side) for k, side in enumerate(sides)]
        return dict(zip(("tree", "path", "cut", "level"), map(np.array, zip(*out))))

    return work


def depth_of(size: int, target: int) -> int:
    return min(DEPTH, max(1, int(np.ceil(np.log2(size / target))) + 1))


def sample(forest_: Forest, names: np.ndarray, sizes: np.ndarray, share: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Step over rows (node, kind, q) that sends on about a share of the members of some groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_width(batches):
            (q, length), kind, node = whole_numbers(batch.column("q").to_pylist()), batch.column("kind").to_numpy(), batch.column("node").to_numpy()
            for t in range(forest_.trees):
                row, path, level = forest_.route(t, q, length, kind)
                at, there = found_in(names, path)
                there &= (hashed(node[row], path).view(np.uint64) >> np.uint64(11)) / float(1 << 53) < share[at]
                row = row[there]
                yield pa.RecordBatch.from_pydict({"tree": np.full(len(row), t), "path": path[there], "level": level[there], "size": sizes[at[there]], "node": node[row], "q": batch.column("q").take(pa.array(row))})

    return run


def fit(rows: DataFrame, first: int, trees: int, about: float, target: int, most: int) -> tuple[Forest, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A forest whose groups have up to ``target`` members, but for those that splits don't shrink; and the groups of ``counted``. rows: (node,
    kind, q), of which about ``most`` are sent at once."""
    out = Forest(first, trees, about)
    kinds = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > target).toPandas().sort_values("kind")
    out.kinds = kinds["kind"].to_numpy(np.int64)
    tree, path = np.repeat(np.arange(trees), len(kinds)), np.concatenate([out.roots(t, out.kinds) for t in range(trees)])
    order = np.lexsort((path, tree))
    groups = tree[order], path[order], np.tile(kinds["n"].to_numpy(np.int64), trees)[order]
    whole: set[int] = set()
    while len(todo := np.array([i for i in np.flatnonzero(groups[2] > target).tolist() if int(groups[1][i]) not in whole], np.int64)):
        wanted = np.array([max(SAMPLE >> (DEPTH - depth_of(n, target)), SAMPLE // 4) for n in groups[2][todo].tolist()])
        part = np.cumsum(np.minimum(wanted, groups[2][todo])) // most
        for p in np.unique(part).tolist():
            own = todo[part == p]
            names, sizes, share = (x[np.argsort(groups[1][own])] for x in (groups[1][own], groups[2][own], wanted[part == p] / groups[2][own]))
            taken = map_batches(rows.select("node", "kind", "q"), sample(out, names, sizes, share), "tree long, path long, level long, size long, node long, q binary")
            made = by_group(taken, ["path"], ["node"], thresholds(out, target), "tree long, path long, cut double, level long").toPandas()
            whole |= set(made.loc[made["cut"].isna(), "path"].tolist()) | (set(names.tolist()) - set(made["path"].tolist()))
            for t, split in made[made["cut"].notna()].groupby("tree"):
                out.add(int(t), split["path"].to_numpy(np.int64), split["cut"].to_numpy(np.float64), int(split["level"].max()) + 1)
        # what the first tree leaves whole is compared there, all pairs of it
        out.kinds = out.kinds[found_in(out.tables[0][0], out.roots(0, out.kinds))[1] | (trees == 1)]
        groups = counted(rows, out)
        if trees > 1 and len(kept := kinds[~kinds["kind"].isin(out.kinds)]):
            path = out.roots(0, kept["kind"].to_numpy(np.int64))
            whole |= set(path.tolist())
            groups = tuple(np.concatenate(x) for x in zip((np.zeros(len(path), np.int64), path, kept["n"].to_numpy(np.int64)), groups))
            order = np.lexsort((groups[1], groups[0]))
            groups = tuple(x[order] for x in groups)
    return out, groups


class Parts:
    """Groups dealt to parts of up to ``rows`` rows each. A group over ``target`` goes to pairs of blocks, in slices that may be of several parts."""

    def __init__(self, groups: tuple[np.ndarray, np.ndarray, np.ndarray], target: int, rows: int):
        tree, path, size = groups
        blocks = np.where(size > target, -(-size // BLOCK), 1)
        slices = np.minimum(blocks, np.maximum(1, -(-(size * blocks) // rows)))
        each = np.repeat(size * blocks / slices, slices)
        part = (np.cumsum(each) // rows).astype(np.int64)
        self.number = int(part.max(initial=0)) + 1
        self.trees = [sorted({0} & {p} | set(np.repeat(tree, slices)[part == p].tolist())) for p in range(self.number)]
        order = np.argsort(path)
        self.path, self.blocks, self.slices, self.start, self.part = path[order], blocks[order], slices[order], (np.cumsum(slices) - slices)[order], part

    def places(self, p: int, row: np.ndarray, path: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(place among ``row``, low, high, block) of what part ``p`` sends."""
        at, known = found_in(self.path, path)
        if not known.all() and p == 0:  # small kinds
            own = np.flatnonzero(~known)
            yield own, *np.zeros((3, len(own)), np.int64)
        one = np.flatnonzero(known)
        one = one[self.blocks[at[one]] == 1]
        one = one[self.part[self.start[at[one]]] == p]
        yield one, *np.zeros((3, len(one)), np.int64)
        many = np.flatnonzero(known)
        many = many[self.blocks[at[many]] > 1]
        for k in range(0, len(many), step := max(1, 65_536 // int(self.blocks.max(initial=1)))):
            own = many[k : k + step]
            n = self.blocks[at[own]]
            block = (hashed(node[row[own]], 7).view(np.uint64) % n.astype(np.uint64)).astype(np.int64)
            own, block, other = np.repeat(own, n), np.repeat(block, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            here = self.part[self.start[at[own]] + (block + other) % self.slices[at[own]]] == p
            own, block, other = own[here], block[here], other[here]
            yield own, np.minimum(block, other), np.maximum(block, other), block


def placed(centres: DataFrame, forest_: Forest, parts: Parts, p: int) -> DataFrame:
    """The rows of part ``p``. What a task has of the members of a group, or of a pair of blocks of it, is packed in one row: (tree, leaf, low, high,
    kind, q, rest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_width(batches, PACK):
            packed, node, kind = batch.column("q").to_pylist(), batch.column("node").to_numpy(), batch.column("kind").to_numpy()
            q, length = whole_numbers(packed)
            whole = q.astype(np.int16)
            rest = np.stack([node, batch.column("radius").to_numpy().view(np.int64), batch.column("weight").to_numpy(), batch.column("many").to_numpy(), np.zeros_like(node)], axis=1)
            for tree in parts.trees[p]:
                row, path, _ = forest_.route(tree, q, length, kind)
                for own, low, high, block in parts.places(p, row, path, node):
                    order = np.lexsort((high, low, path[own]))
                    for k in range(0, len(order), step := max(1, PACK // (2 * q.shape[1]))):
                        at = order[k : k + step]
                        yield packs(tree, path[own[at]], low[at], high[at], block[at], row[own[at]], kind, whole, rest)

    return map_batches(centres, run, "tree long, leaf long, low long, high long, kind long, q binary, rest binary")


def packs(tree: int, leaf: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray, row: np.ndarray, kind: np.ndarray, q: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    """Sorted members, packed by group."""
    start = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    rest = rest[row]
    rest[:, 4] = block

    def binary(x: np.ndarray) -> pa.Array:
        offsets = (np.r_[start, len(x)] * x.itemsize * x.shape[1]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())

    return pa.RecordBatch.from_pydict({"tree": np.full(len(start), tree), "leaf": leaf[start], "low": low[start], "high": high[start], "kind": kind[row[start]], "q": binary(q[row]), "rest": binary(rest)})


def by_pack(rows: DataFrame, work: Callable[[dict, np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """Deal the rows of ``placed`` by group, or pair of blocks, and let ``work`` turn each whole one (its keys, q, rest) into parts of columns (what,
    a, b, n). Groups must be bounded."""
    keys = ["leaf", "low", "high"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def done(held: list[dict]) -> list[tuple]:
        rest = np.frombuffer(b"".join(r["rest"] for r in held), np.int64).reshape(-1, 5)
        q = np.frombuffer(b"".join(r["q"] for r in held), np.int16).reshape(len(rest), -1)
        order = np.argsort(rest[:, 0])
        return work(held[0], q[order].astype(np.float64), rest[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        made: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and any(held[0][k] != r[k] for k in keys):
                    made += done(held)
                    held = []
                held.append(r)
                if sum(len(x[1]) for x in made) >= OUT_ROWS:
                    yield outcome(made)
                    made = []
        yield outcome(made + (done(held) if held else []))

    return map_batches(dealt, run, OUTCOME)


def outcome(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Columns (what, a, b, n) of parts (what, a, b, n)."""
    what = np.repeat(np.array([x[0] for x in parts], np.int32), [len(x[1]) for x in parts])
    return pa.RecordBatch.from_pydict({"what": what} | {n: np.concatenate([np.zeros(0, np.int64), *(x[i] for x in parts)]) for i, n in ((1, "a"), (2, "b"), (3, "n"))})


def located(rows: DataFrame, forest_: Forest) -> DataFrame:
    """Rows with the group ``leaf`` of the first tree, which has no overlap."""
    schema = T.StructType([*rows.schema.fields, T.StructField("leaf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_width(batches):
            row, path, _ = forest_.route(0, *whole_numbers(batch.column("q").to_pylist()), batch.column("kind").to_numpy())
            batch = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(path)], [*batch.schema.names, "leaf"])

    return map_batches(rows, run, schema)


def rounding(length: np.ndarray, width: int) -> np.ndarray:
    """The angle, at most, between a vector and its 16-bit components, which are off by up to a half."""
    return np.arcsin(np.minimum(1, np.sqrt(width) / 2 / length)) + 1e-9


def balls_of(radius: float):
    """Work for ``by_group``: covers each group's vectors by balls around some of them, whatever is left the first. Gives the members with their
    ball; a ball's centre has its radius, number of members and weight."""

    def work(c: dict) -> dict:
        total = len(c["node"])
        ball, weight, many, around = c["node"].copy(), c["weight"].copy(), np.ones(total, np.int64), np.zeros(total)
        for s, e in zip(c["_start"].tolist(), np.r_[c["_start"][1:], total].tolist()):
            q, length = whole_numbers(c["q"][s:e])
            unit, off = q / length[:, None], rounding(length, q.shape[1])
            small, free = unit.astype(np.float32), np.ones(e - s, bool)
            near = [np.flatnonzero(x) for k in range(0, e - s, LEAF) for x in small[k : k + LEAF] @ small.T >= np.cos(radius)]
            for i, own in enumerate(near):
                if not free[i]:
                    continue
                free[i] = False
                if len(own := own[free[own]]):
                    angle = 2 * np.arcsin(np.minimum(1, np.sqrt(((unit[own] - unit[i]) ** 2).sum(axis=1)) / 2)) + off[own] + off[i]
                    own, angle = own[angle <= radius * 1.01], angle[angle <= radius * 1.01]
                if len(own):
                    free[own] = False
                    ball[s + own], many[s + i], around[s + i] = c["node"][s + i], len(own) + 1, angle.max()
                    weight[s + i] += c["weight"][s + own].sum()
        return {n: pa.array(c[n], pa.binary()) if n == "q" else c[n] for n in ("node", "kind", "q", "id", "named")} | {"own": c["weight"], "ball": ball, "weight": weight, "many": many, "radius": around}

    return work


def judge(value: np.ndarray, slack: np.ndarray, error: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs link for sure, and which may, by a cosine up to ``error`` off, of an angle up to ``slack`` off."""
    sure = (slack <= reach) & (value - error >= np.cos(np.maximum(reach - slack, 0)))
    return sure, ~sure & (value + error >= np.cos(np.minimum(reach + slack, np.pi)))


def before(forest_: Forest, tree: int, leaf: int, q: np.ndarray, length: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """For each row a bit for each group, before the group ``leaf`` of a tree, that it shares with other rows."""
    rows, paths = [], []
    for t in range(tree + 1):
        row, path, _ = forest_.route(t, q, length, kind)
        own = path < leaf if t == tree else np.ones(len(path), bool)
        rows.append(row[own]), paths.append(path[own])
    row, (_, name, n) = np.concatenate(rows), np.unique(np.concatenate(paths), return_inverse=True, return_counts=True)
    row, name = row[n[name] > 1], np.cumsum(n > 1)[name[n[name] > 1]] - 1
    bits = np.zeros((len(kind), int(name.max(initial=0)) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row, name >> 6), np.uint64(1) << (name & 63).astype(np.uint64))
    return bits


def compare(similarity: float, forest_: Forest) -> Callable[[dict, np.ndarray, np.ndarray], list[tuple]]:
    """Work for ``by_pack``: balls of a group, or of two blocks of one. Kind 0: ``n`` members that all members of ball a link with; kind 1: an
    edge; kind 2: an open pair of balls of ``n`` members; kind 3: a pair of vectors, balls of their own, near the threshold."""
    reach = float(np.arccos(similarity))

    def work(key: dict, q: np.ndarray, rest: np.ndarray) -> list[tuple]:
        order = np.argsort(-rest[:, 1].copy().view(np.float64), kind="stable")
        q, (node, radius, weight, many, block) = q[order], rest[order].T.copy()
        length, radius, size, width = np.sqrt((q * q).sum(axis=1)), radius.view(np.float64), *q.shape
        unit = (q / length[:, None]).astype(np.float32)
        slack, error = 2 * float(rounding(length, width).max()), (width + 4) * 6e-8
        least = (np.cos(np.minimum(reach + 2 * radius + slack, np.pi)) - error).astype(np.float32)  # of balls that aren't larger
        left, right, known = [], [], []
        for k in range(0, size, LEAF):
            cosine = unit[k : k + LEAF] @ unit[k:].T
            i, j = np.divmod(np.flatnonzero(cosine >= least[k : k + LEAF, None]), size - k)
            upper = j > i
            if key["low"] != key["high"]:
                upper &= block[k + i] != block[k + j]
            i, j = i[upper], j[upper]
            sure, maybe = judge(cosine[i, j].astype(np.float64), radius[k + i] + radius[k + j] + slack, error, reach)
            left.append(k + i[sure | maybe]), right.append(k + j[sure | maybe]), known.append(sure[sure | maybe])
        i, j, sure = (np.concatenate(x) for x in (left, right, known))
        if not len(i):
            return []
        # not those that share an earlier group
        some = np.unique(np.concatenate([i, j]))
        bits = before(forest_, key["tree"], key["leaf"], q[some], length[some], np.full(len(some), key["kind"]))
        x, y = np.searchsorted(some, i), np.searchsorted(some, j)
        fresh = np.concatenate([~(bits[x[k : k + 65_536]] & bits[y[k : k + 65_536]]).any(axis=1) for k in range(0, len(x), 65_536)])
        i, j, sure = i[fresh], j[fresh], sure[fresh]
        a, b = i[sure], j[sure]
        total = (np.bincount(a, weight[b], size) + np.bincount(b, weight[a], size)).astype(np.int64)
        some, (a, b) = np.flatnonzero(total), forest(a, b)
        i, j = i[~sure], j[~sure]
        both = many[i] + many[j]
        out = [(0, node[some], node[some], total[some]), (1, node[a], node[b], np.zeros(len(a), np.int64))]
        return out + [(what, node[i[at]], node[j[at]], both[at]) for what, at in ((2, both > 2), (3, both == 2))]

    return work


def opened(pairs: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Open pairs (a, b) of balls, member by member. Rows (what, a, b, n), kind 1: an edge between balls; kind 3: a pair of vectors near the threshold;
    kind 4: ``n`` members of the other ball that vector a links with."""
    reach = float(np.arccos(similarity))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    packed = members.join(wanted, "ball", "left_semi").groupBy("ball").agg(F.collect_list(F.struct("node", "own", "q")).alias("m"))
    side = lambda n: packed.select(F.col("ball").alias(n), F.col("m.node").alias(f"n{n}"), F.col("m.own").alias(f"w{n}"), F.col("m.q").alias(f"q{n}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("a", "b", "na", "nb", "wa", "wb", "qa", "qb")}
                (q, length), (p, long) = whole_numbers(r["qa"]), whole_numbers(r["qb"])
                slack = rounding(length, q.shape[1])[:, None] + rounding(long, q.shape[1])
                sure, maybe = judge((q / length[:, None]) @ (p / long[:, None]).T, slack, 1e-12, reach)
                na, nb = np.array(r["na"]), np.array(r["nb"])
                if sure.any():
                    out.append((1, np.array([r["a"]]), np.array([r["b"]]), np.zeros(1, np.int64)))
                    for nodes, total in ((na, sure @ np.array(r["wb"])), (nb, np.array(r["wa"]) @ sure)):
                        at = np.flatnonzero(total)
                        out.append((4, nodes[at], nodes[at], total[at]))
                i, j = np.nonzero(maybe)
                out.append((3, na[i], nb[j], np.zeros(len(i), np.int64)))
            yield outcome(out)

    return map_batches(both, run, OUTCOME)


def exact(pairs: DataFrame, vectors: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Pairs of vectors near the threshold, by cosine in double precision: staged rows as of ``opened``. vectors: (node, u), of equal nodes any."""
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    u = vectors.join(wanted, "node", "left_semi").dropDuplicates(["node"])
    known = stage(members.select("node", "ball", "own").join(wanted, "node", "left_semi").join(u, "node"))
    side = lambda n: known.select(F.col("node").alias(n), F.col("ball").alias(f"b{n}"), F.col("own").alias(f"w{n}"), F.col("u").alias(f"u{n}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("ua").to_pylist(), batch.column("ub").to_pylist()
            linked = np.array([np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64) >= similarity for x, y in zip(left, right)], bool)
            a, b, ba, bb, wa, wb = (batch.column(c).to_numpy()[linked] for c in ("a", "b", "ba", "bb", "wa", "wb"))
            yield outcome([(1, ba, bb, np.zeros(len(a), np.int64)), (4, a, a, wb), (4, b, b, wa)])

    out = stage(map_batches(both, run, OUTCOME))
    discard(wanted, known)
    return out


def scaled(df: DataFrame, vector: str) -> DataFrame:
    """An array column of doubles as bytes ``u``, scaled to length one (without overflow), and ``q``, components of 16 bits; null for a vector that
    is null, empty, zero, or holds null or non-finite components."""
    kept = [f for f in df.schema.fields if f.name != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vector)
            width = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            start, u, q = np.cumsum(width) - width, np.full(len(width), None, object), np.full(len(width), None, object)
            for w in np.unique(width[width > 0]).tolist():
                own = np.flatnonzero(width == w)
                x = flat[start[own][:, None] + np.arange(w)]
                top = np.abs(x).max(axis=1)
                good = np.isfinite(top) & (top > 0)
                own, x = own[good], x[good] / top[good, None]
                unit, whole = x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0, np.rint(x * 32767).astype(np.int16)
                u[own], q[own] = [r.tobytes() for r in unit], [r.tobytes() for r in whole]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(u, pa.binary()), pa.array(q, pa.binary())], [*(f.name for f in kept), "u", "q"])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("u", T.BinaryType()), T.StructField("q", T.BinaryType())]))


def near_embeddings(
    df: DataFrame,
    similarity: float = 0.93,
    trees: int = 8,
    spill: float = 0.75,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id (smallest id reachable by links, itself included), kept.

    Rows link when their labels are equal and their cosine is ``similarity`` or more (0 to 1). ``spill`` is the overlap at either side of a
    split, in standard deviations of the projected difference of two vectors just within the threshold.

    Nulls: rows with a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing. Vectors of different
    numbers of components don't link. Equal vectors link with each other; repeated rows count each. Rows with a null id link too, but are in no
    component's minimum, and aren't kept. An empty table gives no rows. Other columns are not read, whatever their names. Vectors are told apart
    by 64-bit hashes: among N different ones the chance of any mistake is about N*N/2**65.
    """
    if not 0 < similarity < 1:
        raise ValueError("similarity must be above 0 and below 1")
    spark = df.sparkSession
    session_defaults(spark)
    read = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").alias("label"), F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double")).alias("x"))
    named = scaled(read, "x").withColumn("node", F.when(F.col("label").isNotNull() & F.col("u").isNotNull(), F.xxhash64("label", "u")))
    found = named.filter("node is not null")
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        result = links_of(found, similarity, trees, spill)
    finally:
        spark.conf.set(CLEANUP, was) if was is not None else spark.conf.unset(CLEANUP)
    linked = found.select("id", "node").join(result, "node").select("id", "n_links", "component_id")
    alone = named.filter("node is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    own = unused(linked, id_col)
    out = linked.unionByName(alone).withColumnRenamed("id", own)
    return out.select(F.col(own).alias(id_col), "n_links", "component_id", F.coalesce(F.col(own) == F.col("component_id"), F.lit(False)).alias("kept"))


def links_of(found: DataFrame, similarity: float, trees: int, spill: float) -> DataFrame:
    """Rows (id, label, u, q, node) to staged rows (node, component_id, n_links)."""
    reach = float(np.arccos(similarity))
    kinds = found.select("node", F.xxhash64("label", F.length("u")).alias("kind"), "q", "id")
    nodes = stage(kinds.groupBy("node", "kind", "q").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")).select("node", "kind", "q", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("named"), "weight"))
    union = lambda parts: parts[0] if len(parts) == 1 else union(parts[: len(parts) // 2]).unionByName(union(parts[len(parts) // 2 :]))

    # balls: angles of up to 0.8 of the threshold's between members
    size = nodes.count()
    target = max(GROUP, -(-size // GROUPS))
    single, groups = fit(nodes.select("node", "kind", "q"), 0, 1, 0.0, target, max(ROWS, size))
    dealt = located(nodes, single)
    large = dict(zip(groups[1][groups[2] > target].tolist(), (-(-groups[2][groups[2] > target] // (target // 2))).tolist()))
    part = F.lit(0).cast("long")
    if large:  # not shrunk by splits: dealt out
        many = found.sparkSession.createDataFrame(list(large.items()), "leaf long, m long")
        dealt, part = dealt.join(F.broadcast(many), "leaf", "left"), F.coalesce(F.pmod(F.xxhash64("node"), F.col("m")), F.lit(0))
    dealt = dealt.select("leaf", part.alias("part"), "node", "kind", "q", "id", "named", "weight")
    members = stage(by_group(dealt, ["leaf", "part"], ["node"], balls_of(0.4 * reach), "node long, kind long, q binary, id long, named boolean, own long, ball long, weight long, many long, radius double"))
    discard(nodes)
    centres = members.filter("node = ball").select("node", "kind", "q", "radius", "weight", "many")

    # the forest
    size = centres.count()
    target = max(GROUP, -(-size // GROUPS))
    split, groups = fit(centres.select("node", "kind", "q"), 1, trees, spill * 2 * float(np.sin(reach / 2)), target, max(ROWS, size))
    parts = Parts(groups, target, max(ROWS, PART * size))
    judged = union([stage(by_pack(placed(centres, split, parts, p), compare(similarity, split))) for p in range(parts.number)])

    # open pairs
    every, pairs = [judged], judged.filter("what = 2")
    sent = pairs.agg(F.sum("n")).first()[0] or 0
    for p in range(number := -(-sent // max(ROWS, PART * size))):
        every.append(stage(opened(pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(number)) == p), members, similarity)))
    close = union(every).filter("what = 3")
    if close.count():
        every.append(exact(close, found.select("node", "u"), members, similarity))
    sums = union(every)

    roots = components(sums.filter("what = 1").select("a", "b"))
    whole_links = sums.filter("what = 0").groupBy(F.col("a").alias("ball")).agg(F.sum("n").alias("sure"))
    own_links = sums.filter("what = 4").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("some"))
    balls = members.groupBy("ball").agg(F.min(F.expr("case when named then id end")).alias("id"), F.sum("own").alias("weight"))
    classes = balls.join(roots.withColumnsRenamed({"node": "ball"}), "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    classes = stage(classes.join(whole_links, "ball", "left").select("ball", "root", "id", (F.col("weight") - 1 + F.coalesce("sure", F.lit(0))).alias("links")))
    smallest = stage(classes.groupBy("root").agg(F.min("id").alias("component_id")))
    classes = classes.join(smallest, "root").select("ball", "component_id", "links")
    result = members.select("node", "ball").join(classes, "ball").join(own_links, "node", "left")
    result = stage(result.select("node", "component_id", (F.col("links") + F.coalesce("some", F.lit(0))).alias("n_links")))
    discard(members, sums)
    return result
