"""Phrase collocations by top-order marginalisation: only the longest windows are counted, and a ROLLUP sums their prefixes.

Every word opens one window: its own column and ``most`` - 1 lead columns, padded with 0 where the piece ends. Every occurrence
of a phrase is the prefix of exactly one window, so the sums over windows that begin with it, which ROLLUP makes for all lengths
at once, are its exact count. Windows end early where no candidate can go on: behind a run of one, two or three words that occurs
too seldom. That is told by bitmaps (16 MB each at most), made of counts in hashed places, that never lose a frequent run; beyond some 4 million
frequent runs of a length they let more through, which costs time but changes no count.

In windows words are 64-bit keys. Keys are checked: if two different (language, word) of the corpus share one, all is made
again with another seed, so counts are those of words, not of hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epispark.llm.common import mix64, session_defaults, stage, text_of

#: Kinds of bytes: of words, blanks between words, ends of pieces (fixed by the contract).
BLANKS, ENDS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
#: Bytes of text that are cut into words at once (a single longer text is not divided).
CHUNK = 1 << 21
#: Bits of the keys by which runs of words are counted.
PLACES = 36

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(ENDS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Cutter:
    """Cuts texts into words, all words of a chunk at once, and gives each its key."""

    def __init__(self, seed: int) -> None:
        self.base = np.uint64(xxhash.xxh64_intdigest(b"base", seed) | 1)
        self.seed, self.powers, self.salts = seed, np.ones(1, np.uint64), {}

    def salt(self, lang: str) -> np.uint64:
        if lang not in self.salts:
            self.salts[lang] = np.uint64(xxhash.xxh64_intdigest(lang.encode(), self.seed))
        return self.salts[lang]

    def power(self, n: int) -> np.ndarray:
        """base ** 0, 1, ... as often as words are long."""
        with np.errstate(over="ignore"):
            while len(self.powers) < n:
                self.powers = np.concatenate([self.powers, self.powers * self.powers[-1] * self.base])
        return self.powers

    def chunks(self, texts: pa.StringArray, langs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, starts, ends, keys, pieces, rows) of the words in some of the texts."""
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        at = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        salts = np.array([self.salt(x) for x in langs], np.uint64)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
            low, offsets = _LOWER[data[at[first] : at[last]]], at[first : last + 1] - at[first]
            kind, begins = _KIND[low], np.zeros(len(low) + 1, bool)
            begins[offsets] = True
            word = kind == 0
            starts = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | begins[:-1])) if len(low) else np.zeros(0, np.int64)
            if len(starts):
                ends = np.flatnonzero(word & (np.r_[~word[1:], True] | begins[1:])) + 1
                pieces = np.cumsum((kind == 2) | begins[:-1], dtype=np.int64)[starts]
                rows = np.searchsorted(offsets, starts, "right") - 1
                inside = np.flatnonzero(word)
                length = ends - starts
                opens = np.r_[0, np.cumsum(length)[:-1]]
                place = np.arange(len(inside)) - np.repeat(opens, length)
                with np.errstate(over="ignore"):
                    summed = np.add.reduceat((low[inside].astype(np.uint64) + np.uint64(1)) * self.power(int(length.max()))[place], opens)
                    keys = mix64(mix64(summed) + salts[first + rows])
                keys[keys == 0] = 1
                yield low, starts, ends, keys, pieces, first + rows
            first = last


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[start:end]."""
    length = ends - starts
    offsets = np.r_[0, np.cumsum(length)]
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], length)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])]).cast(pa.string())


def by_chunk(docs: DataFrame, seed: int, schema: str, work: Callable[..., dict | None]) -> DataFrame:
    """Rows that ``work(bytes, starts, ends, keys, pieces, languages of the words)`` makes of each chunk of docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(seed)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for low, starts, ends, keys, pieces, rows in cutter.chunks(batch.column("text"), langs):
                out = work(low, starts, ends, keys, pieces, lambda at: pa.array([langs[i] for i in rows[at]], pa.string()))  # noqa: B023  called at once
                if out is not None:
                    yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})

    return docs.mapInArrow(run, schema)


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """(key, lang, word, f) of all words."""

    def work(low, starts, ends, keys, pieces, lang_of):
        made, at, many = np.unique(keys, return_index=True, return_counts=True)
        return {"key": made.view(np.int64), "lang": lang_of(at), "word": slices(low, starts[at], ends[at]), "f": many}

    return by_chunk(docs, seed, "key long, lang string, word string, f long", work).groupBy("key", "lang", "word").agg(F.sum("f").alias("f"))


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(left * np.uint64(0x9E3779B97F4A7C15) + right)


def key_bits(keys: DataFrame, log2_most: int = 27) -> np.ndarray:
    """A bitmap by the first bits of evenly spread 64-bit keys (column ``key``): 32 bits a key, 2**log2_most bits at most."""
    log2_bits = min(log2_most, max(20, (32 * keys.count()).bit_length()))
    at = keys.select(F.shiftrightunsigned("key", 64 - log2_bits).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).toPandas()
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of the bitmap."""
    at = keys >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def runs(keys: np.ndarray, pieces: np.ndarray, known: list[np.ndarray], most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For 1, 2, ... ``most`` words: where runs begin that lie in one piece and hold only shorter runs (and are themselves, where there is a
    bitmap) that ``known`` lets through; and the keys of the runs that begin everywhere."""
    alive, names = [in_bits(known[0], keys)], [keys]
    for m in range(2, most + 1):
        name, on = np.zeros_like(keys), np.zeros(len(keys), bool)
        if len(keys) >= m:
            name[: 1 - m] = pair_keys(names[-1][: 1 - m], keys[m - 1 :])
            on[: 1 - m] = alive[-1][: 1 - m] & alive[-1][1 : len(keys) - m + 2] & (pieces[: 1 - m] == pieces[m - 1 :])
            if len(known) >= m:
                at = np.flatnonzero(on)
                on[at] = in_bits(known[m - 1], name[at])
        alive.append(on), names.append(name)
    return alive, names


def frequent_runs(docs: DataFrame, seed: int, known: list[np.ndarray], least: int) -> DataFrame:
    """(key) of the runs, one word longer than those of the last bitmap, that occur ``least`` times. They are counted in 2 ** ``PLACES``
    places; those that share one only let more through."""
    sent, size = docs.sparkSession.sparkContext.broadcast(known), len(known) + 1

    def work(low, starts, ends, keys, pieces, lang_of):
        alive, names = runs(keys, pieces, sent.value, size)
        made, many = np.unique(names[-1][alive[-1]] >> np.uint64(64 - PLACES), return_counts=True)
        return {"key": made.view(np.int64), "f": many} if len(made) else None

    counted = by_chunk(docs, seed, "key long, f long", work).groupBy("key").agg(F.sum("f").alias("f"))
    return counted.filter(F.col("f") >= least).select(F.shiftleft("key", 64 - PLACES).alias("key"))


def count_windows(docs: DataFrame, seed: int, known: list[np.ndarray], most: int) -> DataFrame:
    """(w0, w1, ..., f): the padded windows and how often they occur."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    names = [f"w{i}" for i in range(most)]

    def work(low, starts, ends, keys, pieces, lang_of):
        alive, _ = runs(keys, pieces, sent.value, most)
        kept = np.flatnonzero(alive[0])
        if not len(kept):
            return None
        columns = [np.where(on[kept], keys[np.minimum(kept + i, len(keys) - 1)], np.uint64(0)) for i, on in enumerate(alive)]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
        return {n: c[new].view(np.int64) for n, c in zip(names, columns)} | {"f": np.diff(np.r_[new, len(order)])}

    made = by_chunk(docs, seed, ", ".join(f"{n} long" for n in [*names, "f"]), work)
    return made.groupBy(*names).agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, seed: int, words: DataFrame, least: int, most: int) -> DataFrame:
    """(w0, w1, ..., f) of phrases of 1 to ``most`` words that occur ``least`` times; the columns behind a phrase are 0."""
    known = [key_bits(words.filter(F.col("f") >= least).select("key"))]
    while len(known) < most - 1:
        known.append(key_bits(stage(frequent_runs(docs, seed, known, least))))
    names = [f"w{i}" for i in range(most)]
    summed = count_windows(docs, seed, known, most).rollup(*names).agg(F.sum("f").alias("f")).filter(F.col("w0").isNotNull() & (F.col("f") >= least))
    # a sum over padding (0) is not a phrase's; a column that is rolled up is null
    whole = summed.filter(" and ".join(f"coalesce({n} <> 0, true)" for n in names))
    return whole.select(*[F.coalesce(n, F.lit(0)).alias(n) for n in names], "f")


def mine_phrases(
    df: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = 30,
    most: int = 4,
    top: int = 2000,
    covered: tuple[int, int] = (80, 100),
    scale: int = 2_000_000,
) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces and words. Phrases of 2 to ``most`` words that occur ``least`` times within pieces
    are candidates. Cut behind its first words, a candidate has l (count of the first part), r (of the rest) and the score
    floor(scale * a / (l + r)); the lowest-scoring cut counts. Candidates inside a longer one that covers the share ``covered`` of their
    occurrences go.

    Nulls: a null text counts as empty, a null language as ``und``. Repeated rows count each. Ties: of equally low cuts the
    first, of equal scores the higher count, then the phrase in byte order. Texts of any length are cut whole. An empty table, or one without
    frequent phrases, gives no rows. Columns other than those two are not read, whatever their names.
    """
    if most < 2 or least < 1:
        raise ValueError("phrases have two words at least, and occur once at least")
    session_defaults(df.sparkSession)
    docs = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    seed = 0
    while True:
        words = stage(count_words(docs, seed))
        if words.groupBy("key").count().filter("count > 1").isEmpty():
            break
        seed += 1
    names = [f"w{i}" for i in range(most)]
    counts = stage(phrase_counts(docs, seed, words, least, most))
    size = F.lit(0)
    for n in names:
        size = size + (F.col(n) != 0).cast("int")
    phrases = counts.withColumn("w", F.slice(F.array(*names), 1, size)).select("w", F.size("w").alias("size"), "f")
    parts = phrases.filter(F.col("size") < most).select("w", "f")
    candidates = phrases.filter("size > 1")

    cuts = candidates.select("w", "size", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("w", "a", "k", F.expr("slice(w, 1, k)").alias("first"), F.expr("slice(w, k + 1, size - k)").alias("rest"))
    cuts = cuts.join(parts.select(F.col("w").alias("first"), F.col("f").alias("l")), "first").join(parts.select(F.col("w").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr(f"(cast({scale} as decimal(18, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = cuts.groupBy("w", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select("w", "a", "x.score", "x.l", "x.r")

    # what lies inside a longer candidate: its runs of words, shorter by one or more
    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> slice(w, i, m))))")
    inside = candidates.filter("size > 2").select(F.explode(spans).alias("w"), "f").groupBy("w").agg(F.max("f").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(19, 0)")
    kept = best.join(inside, "w", "left").filter(F.col("longer").isNull() | (covered[1] * wide("longer") < covered[0] * wide("a")))

    # a phrase has the language of its first word
    lexicon = words.filter(F.col("f") >= least).select("key", "lang", "word")
    kept = kept.withColumn("key", F.col("w")[0]).join(lexicon.select("key", "lang"), "key").drop("key")
    order = [F.desc("score"), F.desc("a")]
    leading = stage(kept.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_rank") <= top).drop("_rank"))
    spelled = leading.select("w", F.posexplode("w").alias("i", "key")).join(lexicon.select("key", "word"), "key")
    spelled = spelled.groupBy("w").agg(F.expr("array_join(transform(array_sort(collect_list(struct(i, word))), x -> x.word), ' ')").alias("phrase"))
    ranked = leading.join(spelled, "w").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    out = ranked.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
