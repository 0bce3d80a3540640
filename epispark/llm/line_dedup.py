"""Line dedup: a segment-partition edit join over the distinct lines of a corpus.

Lines within ``threshold`` edits of each other share one of threshold + 1 segments: a line's segments are
index keys (length, segment number, content), and a longer or equally long line probes with those of
its substrings that could be such a segment, in windows around the segment's place. Lines that share a
key are a region of ``metric_join``, on sketches of their character pairs, of which an edit changes four at most;
candidates are verified by a bit-parallel edit distance in a band of 2 * threshold + 1 diagonals. Keys are made
only of what each task has once. One join serves all lengths: a line has the keys for each number of edits that it may have.

Many lines may share a segment without being near: copies of a passage that differ in words here and there. Lines of
regions too large for one task are cut into more segments, of which a near pair shares all but ``threshold``: a finer key is all
segments but that many, with the shifts that so many edits leave them. Groups of 6, 12, 24 and then 48 segments follow
each other, each for lines whose groups are still large. A line has a number of keys for each that doesn't depend on how
many lines there are. What is then still large (only lines that differ in two 48ths of their length) goes to pairs of blocks.

Of a group of (nearly) equal lines one stays: the one whose first document has the smallest id. Equal lines
are found at any length; the edits that short lines may have are scaled to their length. Blank lines always stay.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, pairwise, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.common import bit_filter, join_on_key, map_batches, map_text, may_hold, mix64, rows_of_text, session_defaults, stage, unused
from epispark.llm.metric_join import connect, local_stars, parity, stars

_PENDING = 1_000_000


#: Bits of a line's sketch, as a power of two, and how many of them one edit changes at most.
SKETCH, PER_EDIT = 8, 4


def _signed(value: int) -> int:
    return value - ((value >> 63) << 64)


def line_digest(line: str) -> tuple[int, int]:
    """Two signed 64-bit hashes of a line, by which equal lines are told: among 2**50 lines the chance of any mistake is 2**-29."""
    found = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return _signed(found & 0xFFFFFFFFFFFFFFFF), _signed(found >> 64)


def line_hash(line: str) -> int:
    """A signed 64-bit hash of a line."""
    return line_digest(line)[0]


def line_sketch(line: str) -> bytes:
    """The parity sketch of a line's pairs of neighbouring characters."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return parity(mix64(codes[:-1] << np.uint64(32) | codes[1:]), SKETCH)


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, end) of the threshold + 1 segments of a line of this length, the longer ones last."""
    parts = threshold + 1
    short, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, at + size))
        at += size
    return out


@lru_cache(4096)
def key_plan(n: int, threshold: int) -> list[tuple[int, int, int]]:
    """(start, end, seed) of the index keys of a line of this length and of the keys with which it probes for shorter
    or equally long ones.

    A probe for segment i, which starts at p in a line shorter by d, looks from p - i to p + i and from
    p + d - (threshold - i) to p + d + (threshold - i): what is left or right of the segment can't take
    more edits than there are segments on that side (multi-match-aware windows).
    """
    out = []
    for shorter in range(threshold + 1):
        length = n - shorter
        if length <= threshold:
            break
        for i, (a, b) in enumerate(segments(length, threshold)):
            low = max(0, a - i, a + shorter - (threshold - i))
            high = min(n - (b - a), a + i, a + shorter + (threshold - i))
            out += [(start, start + b - a, length * 16 + i) for start in range(low, high + 1)]
    return out


def line_keys(line: str, threshold: int) -> set[int]:
    """The keys of a line's segments and probes."""
    key = xxhash.xxh3_64_intdigest
    if line.isascii():  # bytes are characters
        coded = line.encode()
        return {key(coded[a:b], seed=seed) for a, b, seed in key_plan(len(line), threshold)}
    return {key(line[a:b].encode("utf-8", "surrogatepass"), seed=seed) for a, b, seed in key_plan(len(line), threshold)}


@lru_cache(64)
def finer_plan(n: int, threshold: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (a row for each key) and seeds of the finer keys of a line of n characters.

    A line y of ``length`` characters is cut into ``parts`` segments. Of an alignment with a line x at most ``threshold`` edits
    longer, some ``threshold`` segments hold all edits (an insertion counts to the segment that goes on behind it, or to the last). The
    stretches between them are in both lines, shifted in x by the edits before: shifts change by as many as there are
    edits, and end at the difference of the lengths.
    """
    starts, ends, seeds = [], [], []
    for shorter in range(threshold + 1):
        length = n - shorter
        if length <= threshold:
            break
        count = min(parts, length)
        cuts = segments(length, count - 1)
        shifts = [s for s in product(range(-threshold, threshold + 1), repeat=threshold) if s[-1] == shorter and abs(s[0]) + sum(abs(y - x) for x, y in pairwise(s)) <= threshold]
        for left_out in combinations(range(count), threshold):
            for moved in shifts:
                a = [0] + [cuts[i][1] + s for i, s in zip(left_out, moved)]
                b = [cuts[i][0] + s for i, s in zip(left_out, (0, *moved))] + [n]
                if all(x <= y for x, y in zip(a, b)) and all(x <= y for x, y in zip(b, a[1:])):
                    starts.append(a)
                    ends.append(b)
                    seeds.append(hash((length, parts, left_out)) & 0xFFFFFFFFFFFFFFFF)
    shape = (len(starts), threshold + 1)
    return np.array(starts, np.int64).reshape(shape), np.array(ends, np.int64).reshape(shape), np.array(seeds, np.uint64)


#: The base of a line's polynomial hash modulo 2**64, and how many segments the finer keys of each depth are made of.
_BASE, FINER = 0x9E3779B97F4A7C15, (6, 12, 24, 48)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


def finer_keys(line: str, threshold: int, parts: int) -> np.ndarray:
    """Keys of all segments but ``threshold`` (see ``finer_plan``). Lines that share one by chance are told apart later."""
    starts, ends, seeds = finer_plan(len(line), threshold, parts)
    codes = mix64(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))
    head = np.r_[np.uint64(0), np.cumsum(codes * _powers(_BASE, len(codes) - 1))]
    back = _powers(pow(_BASE, -1, 1 << 64), len(codes))  # divides a stretch's hash by its place
    out = mix64(seeds)
    for k in range(starts.shape[1]):
        out = mix64(out ^ mix64((head[ends[:, k]] - head[starts[:, k]]) * back[starts[:, k]]) + np.uint64(k))
    return out


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance of two strings, or ``most`` + 1 where it is larger.

    Common ends are cut off. Then the columns of the distance table go by as bit vectors of vertical
    steps (+1 and -1) inside a band of diagonals, which moves down by one row with each column. The
    distance is followed along the band's lowest diagonal until that reaches the last row, then along it.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    start, n = 0, len(b)
    while start < n and a[start] == b[start]:
        start += 1
    end = 0
    while end < n - start and b[n - 1 - end] == a[len(a) - 1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : n - end]
    if not b:
        return min(len(a), most + 1)
    band = min(most, len(a))
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    width = 2 * band + 2
    mask, last = (1 << width) - 1, len(a) - band
    up, down = mask & (-1 << (width - band - 1)), 0
    lowest, row = 1 << (width - 1), 1 << (width - 2)
    distance = band
    for j, c in enumerate(b):
        below = j + band + 1 - width  # the row of the band's lowest bit
        same = places.get(c, 0)
        same = (same >> below if below >= 0 else same << -below) & mask
        diagonal = ((((same & up) + up) ^ up) | same | down) & mask
        right, left = (down | ~(diagonal | up)) & mask, diagonal & up
        if j < last:
            distance += not diagonal & lowest
            if distance > 2 * band + most:
                return most + 1
        else:
            distance += bool(right & row) - bool(left & row)
            row >>= 1
        up, down = (left | ~((diagonal >> 1) | right)) & mask, (diagonal >> 1) & right
    return min(distance, most + 1)


def edit_levels(threshold: int, near_chars: int) -> list[tuple[int, int, int | None]]:
    """(edits, shortest, longest) of the joins that find all near lines.

    A pair may have as many edits as ``threshold`` times its shorter line's share of ``near_chars``, rounded
    down, and ``threshold`` at most. A join takes the lines that are the shorter one of a pair with so many edits,
    and those that are longer by these edits.
    """
    starts = [-(-near_chars * k // threshold) for k in range(1, threshold + 1)]
    return [(k, low, starts[k] - 1 + k if k < threshold else None) for k, low in enumerate(starts, 1)]


def line_rows(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, line, check): one row for each row and distinct line, but for blank ones and those below ``min_chars`` characters."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("t"))

    def make():
        def run(ids, texts):
            out_ids, out, checks = [], [], []
            for i, t in zip(ids, texts):
                found = {line_digest(x) for x in set((t or "").split("\n")) if len(x) >= min_chars and not x.isspace()}
                for h, c in found:
                    out.append(h)
                    checks.append(c)
                out_ids += [i] * len(found)
            return {"id": out_ids, "line": out, "check": checks}

        return run

    return rows_of_text(rows, ["id", "t"], "id long, line long, check long", make)


def keyed_regions(rows: DataFrame, column: str, takes: Callable[[str], bool], keys_of: Callable[[str], list[int]]) -> DataFrame:
    """Starred regions (region, pivot, node) of the distinct lines in a column of texts that ``takes`` lets in, by the
    lines' keys, merged in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, counts, nodes = array("Q"), array("q"), array("q")

        def merged() -> pa.RecordBatch:
            out = local_stars(np.array(keys, np.uint64).view(np.int64), np.repeat(np.array(nodes, np.int64), np.array(counts, np.int64)))
            seen.clear()
            for held in (keys, counts, nodes):
                del held[:]
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for x in (t or "").split("\n"):
                    if takes(x) and (h := line_hash(x)) not in seen:
                        seen.add(h)
                        found = keys_of(x)
                        keys.extend(found)
                        counts.append(len(found))
                        nodes.append(h)
                        if len(keys) > _PENDING:
                            yield merged()
        if keys:
            yield merged()

    return stage(stars(map_batches(rows.select(F.col(f"`{column}`")), run, "region long, node long, pivot long")))


def near_lines(df: DataFrame, text_col: str, levels: list[tuple[int, int, int | None]]) -> DataFrame:
    """(node, root, check): hashes of the distinct lines that have another one within the edits of a level (``edit_levels``), by
    component."""
    shortest = levels[0][1]
    threshold = max(k for k, _, _ in levels)

    def edits(chars: int) -> int:
        """What a pair may have whose shorter line has so many characters."""
        return max((k for k, low, _ in levels if low <= chars), default=0)

    def levels_of(line: str) -> list[int]:
        return [k for k, low, high in levels if low <= len(line) <= (high or sys.maxsize)]

    def takes(line: str) -> bool:
        return len(line) >= shortest and not line.isspace()

    starred = keyed_regions(df, text_col, takes, lambda line: [x for k in levels_of(line) for x in line_keys(line, k)])
    nodes = stage(starred.select(F.explode(F.array("pivot", "node")).alias("node")).distinct())
    shared = df.sparkSession.sparkContext.broadcast(bit_filter(nodes, "node"))

    # the texts of candidate lines only; the rest is filtered out by a bitmap before anything moves
    def make():
        bits = shared.value.view(np.uint64)

        def run(texts):
            kept = {}
            for t in texts:
                for x in (t or "").split("\n"):
                    if len(x) >= shortest:
                        h, c = line_digest(x)
                        if h not in kept and may_hold(bits, h):
                            kept[h] = (c, x)
            if not kept:
                return None
            checks, lines = zip(*kept.values())
            return {"node": list(kept), "check": checks, "n": pa.array([len(x) for x in lines], pa.int32()), "sk": pa.array([line_sketch(x) for x in lines], pa.binary()), "s": lines}

        return run

    found = rows_of_text(df.select(F.col(f"`{text_col}`").alias("t")), ["t"], "node long, check long, n int, sk binary, s string", make)
    lines = stage(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    shared.destroy()

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(lines.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(lines.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")

        def make():
            def run(left, right):
                most = [edits(min(len(x), len(y))) for x, y in zip(left, right)]
                return [pa.array([edit_distance(x, y, k) <= k for x, y, k in zip(left, right, most)], pa.bool_())]

            return run

        return map_text(both, ["sa", "sb"], [T.StructField("near", T.BooleanType())], make, drop=("sa", "sb")).filter("near").select("a", "b")

    def finer(crowd: DataFrame, depth: int) -> DataFrame | None:
        """Lines of large regions by all but a few of more segments, for each number of edits that they may have."""
        if depth > len(FINER):
            return None
        parts = FINER[depth - 1]

        return keyed_regions(lines.join(crowd, "node", "left_semi"), "s", takes, lambda line: [x for k in levels_of(line) for x in finer_keys(line, k, parts).tolist()])

    roots = connect(starred, lines.select("node", "n", "sk"), lambda total: np.full_like(total, PER_EDIT * threshold), verify, finer)
    return roots.join(lines.select("node", "check"), "node")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, min_chars: int | None = None, drop_emptied: bool = False, near_chars: int = 40) -> DataFrame:
    """The rows of ``df`` with repeated lines taken out of the text; adds n_lines and n_dropped.

    Lines are what stands between line feeds. A line that is not blank is dropped where an equal line
    stands before it in its text or in a text of a smaller id, and everywhere if lines near it (directly or by a
    chain) begin in a text of a smaller id. Of lines that begin in the same text the one with the smallest hash
    stays. Lines of at least ``near_chars`` characters are near within ``threshold`` edits, shorter ones within
    fewer edits in proportion (``edit_levels``). Where ``min_chars`` is given, shorter lines always stay and
    all others are near within ``threshold`` edits. With ``drop_emptied`` rows go whose text loses every line
    but blank ones, and one at least to another row.

    Nulls: a null text counts as empty and stays null; rows with a null id never lose a line to another
    row, nor take one. Ids are whole numbers (cast to long); repeated ids count as one text. Very long texts are
    read whole. An empty table gives no rows. Extra columns pass through, whatever their names; columns named
    n_lines and n_dropped are replaced.
    """
    session_defaults(df.sparkSession)
    levels = edit_levels(threshold, near_chars) if min_chars is None else [(threshold, min_chars, None)]
    shortest = 1 if min_chars is None else max(min_chars, 1)
    held = stage(line_rows(df.filter(F.col(f"`{id_col}`").isNotNull()), id_col, text_col, shortest))
    first = held.groupBy("line", "check").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("texts"))
    roots = near_lines(df, text_col, levels)
    grouped = roots.withColumnRenamed("node", "line").join(first, ["line", "check"]).select("line", "check", "root", F.struct("first", "line").alias("rank"))
    best = grouped.groupBy("root").agg(F.min("rank").alias("best"))
    losers = grouped.join(best, "root").filter(F.col("rank") > F.col("best")).select("line", "check", F.lit(True).alias("loses"))
    # only lines that lose somewhere: held by several texts, or not the best of their group
    verdicts = first.join(losers, ["line", "check"], "left").filter("texts > 1 or loses").select("line", "check", "first", F.coalesce("loses", F.lit(False)).alias("loses"))
    drops = join_on_key(held, verdicts, ["line", "check"]).filter("loses or id <> first").groupBy("id").agg(F.collect_set("line").alias("_drop"))
    key, drop, new, gone_all = unused(df, "id", "drop", "new", "all")
    rows = df.withColumn(key, F.col(f"`{id_col}`").cast("bigint")).join(drops.withColumnsRenamed({"id": key, "_drop": drop}), key, "left").drop(key)
    fields = [T.StructField(new, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField(gone_all, T.BooleanType())]

    def make():
        def run(texts, drops):
            texts_left, lines, dropped, every = [], [], [], []
            for t, d in zip(texts, drops):
                parts = t.split("\n")
                out, gone, seen = [], set(d), set()
                for x in parts:
                    if len(x) >= shortest and not x.isspace():
                        h = line_hash(x)
                        if h in gone or h in seen:
                            continue
                        seen.add(h)
                    out.append(x)
                texts_left.append("\n".join(out) if len(out) < len(parts) else t)
                lines.append(len(parts))
                dropped.append(len(parts) - len(out))
                every.append(bool(d) and not any(x.strip() for x in out))
            return [pa.array(texts_left, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(every, pa.bool_())]

        return run

    out = map_text(rows, [text_col, drop], fields, make, drop=(drop,))
    text = F.when(F.col("n_dropped") > 0, F.col(new)).otherwise(F.col(f"`{text_col}`"))
    out = out.withColumn(text_col, text)
    if drop_emptied:
        out = out.filter(~F.col(gone_all))
    return out.drop(new, gone_all)
