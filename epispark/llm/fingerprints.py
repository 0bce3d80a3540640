"""Document fingerprints: I-Match over several randomised lexicon subsets.

1. Count in how many documents each term occurs, over all rows.
2. Keep the terms within an inverse-document-frequency band. Terms with idf <= ``idf_high`` number at most
   (mean distinct terms a document) * exp(idf_high), at any input size. So the lexicon is mostly small enough
   to hand to every task; one of more than ``most_terms`` is joined instead, with the same fingerprints.
3. A document's band terms, sorted and distinct, are hashed as a whole, and fall into randomised lexicon
   subsets: at level l a subset keeps one term in 2**l. Each of ``subsets`` disjoint subsets is hashed. A
   document uses the level at which a subset holds about one of its terms, and the next; so the subsets are a
   sample of its terms, of ``subsets`` terms about, and the hash of the whole tells any change of band terms.

The likeness of two fingerprints is the share of equal subset hashes among the subsets that are not
empty in both, at the lowest level that both have; 0 if they have none in common (their numbers of terms
then differ by more than a factor of two).
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.common import join_on_key, map_text, mix64, rows_of_text, stage, unused

_CACHED = 400_000
_PENDING = 200_000


def terms(text: str) -> set[str]:
    """The distinct terms of a text: its lower-cased words between white space."""
    return set(text.lower().split())


def hash_terms(words: list[str]) -> np.ndarray:
    """The signed 64-bit hashes of terms."""
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)).view(np.int64)


class BandHashes(dict):
    """term -> its hash if the lexicon has it, else 0, remembered for a bounded number of terms."""

    def __init__(self, lexicon: np.ndarray):
        super().__init__()
        self.lexicon = lexicon

    def learn(self, words: set[str]) -> None:
        """Look up, all at once, those of the terms that aren't remembered."""
        fresh = [w for w in words if w not in self]
        if len(self) + len(fresh) > _CACHED:
            self.clear()
            fresh = list(words)
        found = hash_terms(fresh)
        if len(self.lexicon):
            held = self.lexicon[np.minimum(np.searchsorted(self.lexicon, found), len(self.lexicon) - 1)] == found
            found = np.where(held, found, 0)
        else:
            found = np.zeros_like(found)
        self.update(zip(fresh, found.tolist()))


#: The hashes that this Python worker has looked up last, by a name of their lexicon; its later tasks go on with them.
_LAST: dict[str, BandHashes] = {}


def worker_hashes(name: str, lexicon: np.ndarray) -> BandHashes:
    """The ``BandHashes`` of a lexicon in this Python worker."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = BandHashes(lexicon)
    return _LAST[name]


def term_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): the 64-bit hash of each term, and the number of rows that have it."""

    def make():
        counts: Counter[str] = Counter()

        def flush():
            found = list(counts)
            out = {"term": hash_terms(found), "df": np.fromiter(counts.values(), np.int64, len(found))}
            counts.clear()
            return out if found else None

        def run(texts):
            if texts is None:
                return flush()
            for text in texts:
                counts.update(terms(text or ""))
            return flush() if len(counts) > _PENDING else None

        return run

    return rows_of_text(df, [text_col], "term long, df long", make, finish=True).groupBy("term").agg(F.sum("df").alias("df"))


def band_lexicon(df: DataFrame, text_col: str = "text", idf_low: float = 2.0, idf_high: float = 8.0, most_terms: int = 4_000_000) -> np.ndarray | DataFrame:
    """The hashes of the terms with idf = ln(rows / df) within the band: sorted, or as a table (term) where
    they are more than ``most_terms`` and so too many to send to every task."""
    rows = df.count()
    least, most = rows * math.exp(-idf_high), rows * math.exp(-idf_low)
    band = stage(term_frequencies(df, text_col).filter((F.col("df") >= max(2.0, least)) & (F.col("df") <= max(2.0, most))).select("term"))
    return np.sort(band.toPandas()["term"].to_numpy(dtype=np.int64)) if band.count() <= most_terms else band


def _ordered_hashes(mixed: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 32-bit hash, never 0, of each run of sorted values; runs begin at ``start``."""
    if not len(start):
        return np.zeros(0, np.uint32)
    rank = np.arange(len(mixed)) - np.repeat(start, np.diff(np.r_[start, len(mixed)]))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mix64(mixed + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), start)
    return np.maximum(mix64(sums) >> np.uint64(32), np.uint64(1)).astype(np.uint32)


def _sections(found: list[np.ndarray], subsets: int) -> tuple[list[str], list[list[str]]]:
    """For each document's distinct terms: the hash of all, and ``level:hashes`` of the first ``subsets`` of 2**level
    random subsets, eight hex digits each, for two levels. The leading bits of a scrambled term are its subset."""
    size = np.array([len(x) for x in found], np.int64)
    doc = np.repeat(np.arange(len(found)), size)
    mixed = mix64(np.concatenate([*found, np.zeros(0, np.int64)]).view(np.uint64))
    order = np.lexsort((mixed, doc))
    mixed, doc = mixed[order], doc[order]
    used = np.flatnonzero(size)
    whole = np.zeros(len(found), np.uint32)
    whole[used] = _ordered_hashes(mixed, np.r_[0, np.cumsum(size)][used])
    level = np.maximum(max(0, int(math.log2(subsets))), np.rint(np.log2(np.maximum(size, 1))).astype(np.int64))
    parts: list[list[str]] = [[] for _ in found]
    for more in (0, 1):
        cell = mixed >> (64 - level - more)[doc].astype(np.uint64)
        inside = cell < np.uint64(subsets)
        place = doc[inside] * subsets + cell[inside].astype(np.int64)
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
        out = np.zeros(len(found) * subsets, np.uint32)
        out[place[start]] = _ordered_hashes(mixed[inside], start)
        raw = out.astype(">u4").tobytes().hex()
        for i, part in enumerate(parts):
            part.append(f"{level[i] + more}:{raw[8 * subsets * i : 8 * subsets * (i + 1)]}")
    return [f"{x:08x}" for x in whole], parts


def fingerprints_of(every: list[np.ndarray], band: list[np.ndarray], subsets: int = 32, few: int = 8) -> list[str]:
    """The fingerprints of documents from the hashes of their distinct terms and of those in the band.

    ``w:hash`` of all band terms, and ``level:hashes`` of the subsets of two levels; with few band terms also
    those of all terms. Sections are joined by ``|``; those of all terms start with ``a``. A text without terms
    has the section ``e``. A document's ``every`` is read only if its band has fewer than twice ``few`` terms.
    """
    whole, parts = _sections(band, subsets)
    rare = [i for i, x in enumerate(band) if len(x) < 2 * few]
    alls = dict(zip(rare, _sections([every[i] for i in rare], subsets)[1]))
    out = []
    for i, x in enumerate(band):
        if not len(every[i]):
            out.append("e")
            continue
        made = [f"w:{whole[i]}"] if len(x) else []
        made += parts[i] if len(x) >= few else []
        out.append("|".join(made + [f"a{p}" for p in alls.get(i, ())]))
    return out


def fingerprint(text: str, band_hashes: BandHashes, subsets: int = 32, few: int = 8) -> str:
    """The fingerprint of one text. Equal texts have equal fingerprints."""
    return fingerprint_texts([text], band_hashes, subsets, few)[0]


def fingerprint_texts(texts: list[str], band_hashes: BandHashes, subsets: int = 32, few: int = 8) -> list[str]:
    """The fingerprints of texts (see ``fingerprints_of``)."""
    every, band, lists = [], [], [terms(text) for text in texts]
    band_hashes.learn(set().union(*lists))
    for words in lists:
        found = np.fromiter(map(band_hashes.__getitem__, words), np.int64, len(words))
        band.append(found[found != 0])
        every.append(hash_terms(list(words)) if len(band[-1]) < 2 * few else band[-1])
    return fingerprints_of(every, band, subsets, few)


def likeness(a: str, b: str) -> float:
    """The likeness of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    left, right = (dict(x.partition(":")[::2] for x in f.split("|")) for f in (a, b))
    for names in (lambda n: n[:1] != "a", lambda n: n[:1] == "a"):
        common = sorted(int(n.lstrip("a")) for n in left if n in right and n not in ("e", "w") and names(n))
        if common:
            name = ("a" if not names("0") else "") + str(common[0])
            x, y = left[name], right[name]
            pairs = [(x[i : i + 8], y[i : i + 8]) for i in range(0, len(x), 8)]
            used = [p == q for p, q in pairs if p != "00000000" or q != "00000000"]
            return sum(used) / len(used) if used else 0.0
    return 0.0


def add_fingerprints(df: DataFrame, lexicon: np.ndarray | DataFrame, columns: dict[str, str], subsets: int = 32, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add a fingerprint column for each text column (text column -> fingerprint column). No shuffle, but for a
    lexicon that is a table.

    Null and empty texts have the fingerprint ``e``. Very long texts are read whole. Extra columns pass
    through; one named like a fingerprint column is replaced.
    """
    if isinstance(lexicon, DataFrame):
        return _joined_fingerprints(df, lexicon, columns, subsets, drop)
    shared, name = df.sparkSession.sparkContext.broadcast(lexicon), xxhash.xxh3_128_hexdigest(lexicon.tobytes())

    def make():
        hashes = worker_hashes(name, shared.value)
        return lambda *lists: [pa.array(fingerprint_texts(texts, hashes, subsets), pa.string()) for texts in lists]

    return map_text(df, list(columns), [T.StructField(c, T.StringType()) for c in columns.values()], make, drop)


def _joined_fingerprints(df: DataFrame, lexicon: DataFrame, columns: dict[str, str], subsets: int, drop: tuple[str, ...]) -> DataFrame:
    """The same by joins: each row's terms meet the lexicon, and come back to the row."""
    key = unused(df, "row")
    out = stage(df.drop(*columns.values()).withColumn(key, F.monotonically_increasing_id()))
    for text_col, name in columns.items():

        def make():
            def run(ids, texts):
                lists = [list(terms(t or "")) for t in texts]
                found = [w for words in lists for w in words]
                return {"row": np.repeat(np.array(ids, np.int64), [len(x) for x in lists]), "term": hash_terms(found)} if found else None

            return run

        rows = rows_of_text(out.select(F.col(key).alias("row"), F.col(f"`{text_col}`").alias("t")), ["row", "t"], "row long, term long", make)
        known = join_on_key(rows, lexicon.select("term", F.lit(True).alias("band")), ["term"], "left")
        lists = known.groupBy("row").agg(F.collect_list("term").alias("every"), F.collect_list(F.when(F.col("band"), F.col("term"))).alias("band"))

        def run(batches):
            for batch in batches:
                made = fingerprints_of(*[[np.array(x, np.int64) for x in batch.column(c).to_pylist()] for c in ("every", "band")], subsets)
                yield pa.RecordBatch.from_pydict({key: batch.column("row"), name: pa.array(made, pa.string())})

        made = lists.mapInArrow(run, T.StructType([T.StructField(key, T.LongType()), T.StructField(name, T.StringType())]))
        out = out.join(made, key, "left").withColumn(name, F.coalesce(name, F.lit("e")))
    return out.drop(key, *drop)


def add_likeness(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add the likeness of two fingerprint columns for each new column name."""
    sides = [c for pair in pairs.values() for c in pair]

    def make():
        return lambda *lists: [pa.array([likeness(a, b) for a, b in zip(lists[2 * i], lists[2 * i + 1])], pa.float64()) for i in range(len(pairs))]

    return map_text(df, sides, [T.StructField(c, T.DoubleType()) for c in pairs], make)


def with_next(df: DataFrame, id_col: str, columns: list[str], ids: DataFrame | None = None, rows_per_range: int = 1000) -> DataFrame:
    """Add ``next_<column>``: the values of the row with the next smaller id; the last row's next is the first.

    Rows are dealt into ranges of the id, cut at quantiles, so no task orders all rows: of about ``rows_per_range``
    rows, or of up to 50 times as many where that still makes 4096 ranges. The first row of each range is also sent, as a guest, to the range that precedes it in the
    order; a window over each range gives the next row. Ties of the id are ordered by a hash of the
    columns. Null ids sort last. A single row is its own next. Ids are numbers. ``ids`` may give the same ids at less cost.
    """
    ids = (df if ids is None else ids).select(F.col(f"`{id_col}`").alias("id"))
    total = ids.count()
    if not total:
        return df.select("*", *[F.col(f"`{c}`").alias(f"next_{c}") for c in columns])
    cuts = max(1, min(4096, total // rows_per_range), total // (50 * rows_per_range))
    key = F.coalesce(F.col("id").cast("double"), F.lit(float("-inf")))
    shares = [i / cuts for i in range(1, cuts)]
    bounds = sorted({b for b in ids.agg(F.percentile_approx(key, shares, min(100 * cuts, 10_000_000))).first()[0] if b != float("-inf")}) if shares else []
    # flat columns of unused names: what a window reads from inside a struct would be exchanged twice
    key_, range_, first_, to_, place_, at_, guest_ = unused(df, "key", "range", "first", "to", "place", "at", "guest")
    ranged = df.withColumn(key_, F.coalesce(F.col(f"`{id_col}`").cast("double"), F.lit(float("-inf"))))
    ids = ids.withColumn(key_, key)
    if bounds:
        ranges = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol=key_, outputCol=range_)
        ranged, ids = ranges.transform(ranged), ranges.transform(ids)
    else:
        ranged, ids = (x.withColumn(range_, F.lit(0.0)) for x in (ranged, ids))
    firsts = sorted((r["range"], r["first"]) for r in ids.groupBy(F.col(range_).alias("range")).agg(F.max("id").alias("first")).collect())
    to = [r for r, _ in firsts[1:]] + [firsts[0][0]]
    guests = df.sparkSession.createDataFrame([(r, first, t) for (r, first), t in zip(firsts, to)], f"{range_} double, {first_} long, {to_} double")
    marked = ranged.join(F.broadcast(guests), range_)
    own = F.struct(F.col(range_).alias("at"), F.lit(0).alias("guest"))
    leads = F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(first_))
    places = F.when(leads, F.array(own, F.struct(F.col(to_).alias("at"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    dealt = marked.withColumn(place_, F.explode(places)).withColumns({at_: F.col(f"{place_}.at"), guest_: F.col(f"{place_}.guest")}).drop(key_, range_, first_, to_, place_)
    order = Window.partitionBy(at_).orderBy(guest_, F.desc_nulls_last(f"`{id_col}`"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    out = dealt.withColumns({f"next_{c}": F.lead(F.col(f"`{c}`")).over(order) for c in columns})
    return out.filter(F.col(guest_) == 0).drop(at_, guest_)
