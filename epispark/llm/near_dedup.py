"""N-gram Jaccard join: near duplicates by the exact Jaccard distance of word shingle sets.

The Jaccard distance is a metric, and ``metric_join`` joins its regions by pivots, Voronoi cells and
windows. Pivot documents alone would not divide a corpus, because nearly all pairs of documents
are at distance 1, and at distance 1 from every pivot. So the first regions come from the metric's parts:
the shingle universe is cut into m cells, and the distance of two sets of given sizes bounds how many
shingles they differ by, d. Differences add up over the cells, so sets within the threshold agree on at
least m - d cells. Documents that agree on a cell (and have shingles in it) are a region.

Sizes are handled in bands: documents within the threshold are in the same band or in neighbouring ones,
and m is chosen for each band. A document's empty cells prove nothing; m leaves room for a few of them,
and documents with more than those also send their empty cells, to meet only each other.
Equal sets are merged first, by a hash of the set.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import bit_filter, join_on_key, may_hold, mix64, rows_of_text, session_defaults, stage
from epispark.llm.metric_join import connect, local_stars, parity, stars

_CACHED = 600_000
#: Region rows that a task holds back, to merge them before they are sent.
_PENDING = 1_000_000


class WordHashes(dict):
    """word (UTF-8) -> 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) >= _CACHED:
            self.clear()
        self[word] = found
        return found


def shingles(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles.

    Bytes are lower-cased in A-Z only and split at the six ASCII spaces only, as the contract wants.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    width = min(words, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, 0x9E3779B97F4A7C15 * width & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(width):
            out = mix64(out * np.uint64(3) + h[k : n - width + 1 + k])
    return np.unique(out)


class Bands:
    """Size bands and numbers of cells for the threshold ``num / den`` on the similarity."""

    def __init__(self, num: int, den: int, rare: float = 1e-3, largest: int = 1 << 40):
        starts = [1]
        while starts[-1] <= largest:
            starts.append(max(starts[-1] + 1, (starts[-1] - 1) * den // num + 1))
        self.starts = np.array(starts, dtype=np.int64)
        self.num, self.den, self.rare = num, den, rare
        self.known: dict[int, tuple[int, int]] = {}

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def cells(self, band: int) -> tuple[int, int]:
        """(m, spare): cells for pairs whose smaller set is in ``band``; empty cells that a set may have.

        m is 0 where sets within the threshold are equal. The spare is the smallest that fewer than ``rare`` of
        the band's sets exceed (their number of empty cells is nearly Poisson), or else the one that the
        fewest exceed.
        """
        if band not in self.known:
            low, small = int(self.starts[band]), int(self.starts[band + 1]) - 1
            differ = (small + small * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
            best = (2.0, 0)
            for spare in range(1, differ + 6) if differ else ():
                m = differ + 1 + spare
                mean = m * math.exp(-low / m)
                term = below = math.exp(-mean)
                for k in range(1, spare + 1):
                    term *= mean / k
                    below += term
                best = min(best, (1 - below, spare))
                if 1 - below < self.rare:
                    best = (1 - below, spare)
                    break
            self.known[band] = (differ + 1 + best[1], best[1]) if differ else (0, 0)
        return self.known[band]

    def roles(self, size: int) -> list[int]:
        """The bands in which a set of this size can be in a pair: its own, and as the larger one the band below."""
        own = self.band(size)
        below = own > 0 and size <= (int(self.starts[own]) - 1) * self.den // self.num
        return [own, own - 1] if below else [own]


def set_hash(found: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles; 0 only for the empty set."""
    if not len(found):
        return 0
    value = xxhash.xxh3_64_intdigest(found.tobytes()) or 1
    return value - ((value >> 63) << 64)


@lru_cache(maxsize=2048)
def _cell_edges(m: int) -> np.ndarray:
    """The m - 1 inner edges of m equal ranges of the 64-bit hashes."""
    return np.array([(k << 64) // m for k in range(1, m)], dtype=np.uint64)


@lru_cache(maxsize=2048)
def _cell_names(m: int, band: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band * 1_000_003 + 1))


def signatures(found: np.ndarray, bands: Bands) -> np.ndarray:
    """The regions of a set: one hash for each band role and non-empty cell."""
    out = []
    mixed = mix64(found)
    total = np.zeros(len(found) + 1, np.uint64)
    np.cumsum(mixed, out=total[1:])
    for band in bands.roles(len(found)):
        m, spare = bands.cells(band)
        if not m:
            continue
        # cells are equal ranges of the hash, so a sorted set has each cell's shingles side by side
        cut = np.concatenate(([0], np.searchsorted(found, _cell_edges(m)), [len(found)]))
        inside = total[cut[1:]] - total[cut[:-1]]
        empty = cut[1:] == cut[:-1]
        with np.errstate(over="ignore"):
            name = mix64(inside + _cell_names(m, band))
        out.append(name if empty.sum() > spare else name[~empty])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch_of(found: np.ndarray) -> bytes:
    """The parity sketch of a set: one to two bits for each of its shingles (64 at least, 2**20 at most)."""
    return parity(mix64(found), min(20, max(6, (len(found) - 1).bit_length())))


def emit_sets(df: DataFrame, id_col: str, text_col: str, words: int, bands: Bands) -> DataFrame:
    """Rows (region, node, pivot) of all sets, merged within each task, and for each row of ``df`` one without a
    region: its id as pivot, its set's hash and size, and (where the task first has this set) sketch."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("t"))

    def make():
        hashes = WordHashes()
        seen: set[int] = set()
        regions, nodes, held = [], [], 0
        own: list[tuple[int | None, int, int, bytes | None]] = []

        def flush():
            nonlocal held
            out = local_stars(np.concatenate([*regions, np.zeros(0, np.int64)]), np.concatenate([*nodes, np.zeros(0, np.int64)]))
            k, more = len(out["node"]), len(own)
            ids, hashed, sizes, sketches = zip(*own) if own else ((), (), (), ())
            found = {
                "region": pa.concat_arrays([pa.array(out["region"], pa.int64()), pa.nulls(more, pa.int64())]),
                "node": np.concatenate([out["node"], np.array(hashed, np.int64)]),
                "pivot": pa.concat_arrays([out["pivot"], pa.array(ids, pa.int64())]),
                "n": pa.concat_arrays([pa.nulls(k, pa.int32()), pa.array(sizes, pa.int32())]),
                "sk": pa.concat_arrays([pa.nulls(k, pa.binary()), pa.array(sketches, pa.binary())]),
            }
            regions.clear(), nodes.clear(), own.clear(), seen.clear()
            held = 0
            return found

        def run(ids, texts):
            nonlocal held
            for i, t in zip(ids or (), texts or ()):
                s = shingles(t or "", words, hashes)
                h = set_hash(s)
                new = len(s) > 0 and h not in seen
                own.append((i, h, len(s), sketch_of(s) if new else None))
                if new:
                    seen.add(h)
                    regions.append(signatures(s, bands).view(np.int64))
                    nodes.append(np.full(len(regions[-1]), h, np.int64))
                    held += len(regions[-1])
            return flush() if texts is None or held > _PENDING or len(own) > _PENDING else None

        return run

    return rows_of_text(rows, ["id", "t"], "region long, node long, pivot long, n int, sk binary", make, finish=True)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links).

    Rows link when den * |intersection| >= num * |union| for ``similarity`` = (num, den). A text of fewer
    than ``words`` words is one shingle. Ids are whole numbers (cast to long). Nulls: a null text counts as empty; empty sets link with nothing,
    so their component is their own id; rows with a null id link as others do, but are in no component's
    minimum (the component of nothing but such rows is null). Repeated rows and ties are in one component. An
    empty table gives no rows. Extra columns are not read. Sets are told apart by 64-bit hashes: among N
    different sets the chance of any mistake is about N*N/2**65.
    """
    session_defaults(df.sparkSession)
    num, den = similarity
    made = stage(stars(emit_sets(df, id_col, text_col, words, Bands(num, den))))
    starred = made.filter("region is not null").select("region", "pivot", "node")
    sets = made.filter("region is null").select(F.col("pivot").alias("id"), "n", "node")
    nodes = stage(starred.select(F.explode(F.array("pivot", "node")).alias("node")).distinct())
    points = made.filter("region is null and sk is not null").select("node", "n", "sk").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    # the id is null for sets that only rows without an id have
    first = stage(sets.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n")))
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("t"))
    carried: list[DataFrame] = []

    def carry(wanted: DataFrame) -> None:
        """Stage the sets of these nodes (node, id). Other rows are filtered out by a bitmap before they move:
        by their id before they are cut into shingles, or by their set's hash where they have no id."""
        bits = df.sparkSession.sparkContext.broadcast((bit_filter(wanted.filter("id is not null"), "id"), bit_filter(wanted.filter("id is null"), "node")))

        def make():
            hashes = WordHashes()
            by_id, by_node = (b.view(np.uint64) for b in bits.value)

            def run(ids, texts):
                kept = {}
                for i, t in zip(ids, texts):
                    if i is None or may_hold(by_id, i):
                        s = shingles(t or "", words, hashes)
                        h = set_hash(s)
                        if i is not None or may_hold(by_node, h):
                            kept[h] = s
                return {"node": list(kept), "s": pa.array([s.view(np.int64) for s in kept.values()], pa.list_(pa.int64()))} if kept else None

            return run

        found = rows_of_text(rows, ["id", "t"], "node long, s array<long>", make)
        carried.append(stage(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]).select("node", "s")))
        bits.destroy()

    def verify(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        for held in carried:
            needed = needed.join(held.select("node"), "node", "left_anti")
        needed = stage(first.select("node", "id").join(needed, "node", "left_semi"))
        if not needed.isEmpty():
            carry(needed)
        shingled = reduce(DataFrame.unionByName, carried)
        left = shingled.select(F.col("node").alias("a"), F.col("s").alias("sa"))
        right = shingled.select(F.col("node").alias("b"), F.col("s").alias("sb"))
        both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
        return both.filter(F.col("i") * den >= (F.size("sa") + F.size("sb") - F.col("i")) * num).select("a", "b")

    roots = connect(starred, points, lambda total: total * (den - num) // (den + num), verify)
    classes = first.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = classes.join(smallest, "root").select("node", "component_id")
    out = join_on_key(sets, classes, ["node"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
