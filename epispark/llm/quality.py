"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

1. Each token falls into one of ``buckets`` hash buckets, and each bucket has a fixed sparse random index
   vector. In one pass over all documents each bucket sums the index vectors of its neighbours in a
   window (random indexing); tasks sum first, so the exchange carries at most ``buckets`` rows a task.
2. A document is the mean of its tokens' unit word vectors. Besides words, tokens are marks of a
   word's shape (upper case, foreign symbols, digits, repeated).
3. A two-layer numpy network learns from a bounded sample of labelled rows (``sample`` rows, chosen by a
   hash of the id) and its probabilities are calibrated by a temperature fitted on a fifth of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.common import map_text, rows_of_text, session_defaults

#: Marks of a word's shape take the first buckets.
MARKS = 16
UPPER, SYMBOL, DIGIT, REPEATED, NO_LETTER, MIXED, LONG = range(7)
_CACHED = 400_000
_COMMON = frozenset(".,;:!?'\"()-")


class Codes(dict):
    """chunk -> bucket << 8 | marks, remembered for a bounded number of chunks."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, chunk: str) -> int:
        bare = chunk.strip(".,;:!?'\"()")
        letters = bare.isalpha()
        marks = 0
        if len(bare) > 1 and bare.isupper():
            marks |= 1 << UPPER
        if not letters:
            if any(not c.isalnum() and c not in _COMMON for c in chunk):
                marks |= 1 << SYMBOL
            if any(c.isdigit() for c in chunk):
                marks |= 1 << DIGIT
            if not any(c.isalpha() for c in chunk):
                marks |= 1 << NO_LETTER
        elif len(bare) > 1 and not bare.islower() and not bare.isupper() and not bare.istitle():
            marks |= 1 << MIXED
        if len(chunk) > 30:
            marks |= 1 << LONG
        bucket = MARKS + xxhash.xxh64_intdigest(chunk.lower().encode()) % (self.buckets - MARKS)
        code = bucket << 8 | marks
        if len(self) >= _CACHED:
            self.clear()
        self[chunk] = code
        return code


def tokens(text: str, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's words, and how many words carry each mark."""
    chunks = text.split()
    found = np.fromiter(map(codes.__getitem__, chunks), dtype=np.int64, count=len(chunks))
    words, marks = found >> 8, found & 255
    counts = np.array([np.count_nonzero(marks & (1 << m)) for m in range(8)] + [0] * (MARKS - 8), dtype=np.float64)
    counts[REPEATED] = np.count_nonzero(words[1:] == words[:-1]) if len(words) else 0
    return words, counts


def index_vectors(buckets: int, dims: int, nonzero: int = 4, seed: int = 7) -> np.ndarray:
    """Sparse ternary index vectors: ``nonzero`` entries of +1 or -1 a bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((buckets, dims), dtype=np.float32)
    for _ in range(nonzero):
        out[np.arange(buckets), rng.integers(0, dims, buckets)] += rng.choice(np.float32([-1, 1]), buckets)
    return out


def word_vectors(df: DataFrame, text_col: str = "text", buckets: int = 8192, dims: int = 32, window: int = 2) -> np.ndarray:
    """Random-indexing vectors from all rows: ``buckets`` x ``dims`` unit vectors, a fixed size."""
    names = [f"v{i}" for i in range(dims)]

    def make():
        index, codes = index_vectors(buckets, dims), Codes(buckets)
        total = np.zeros((buckets, dims))

        def run(texts):
            if texts is None:
                used = np.flatnonzero(np.abs(total).sum(axis=1))
                return {"bucket": used} | {n: total[used, i] for i, n in enumerate(names)} if len(used) else None
            for text in texts:
                words, counts = tokens(text or "", codes)
                if not len(words):
                    continue
                own = index[words]
                near = own.copy()
                for k in range(1, min(window, len(words) - 1) + 1):
                    near[k:] += own[:-k]
                    near[:-k] += own[k:]
                if len(words) > 4 * buckets:  # a very long text: by column, without sorting
                    for d in range(dims):
                        total[:, d] += np.bincount(words, weights=near[:, d], minlength=buckets)
                else:
                    order = np.argsort(words, kind="stable")
                    at = words[order]
                    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    total[at[first]] += np.add.reduceat(near[order], first, axis=0)
                marked = np.flatnonzero(counts)
                total[marked] += counts[marked, None] * (index[marked] + near.mean(axis=0))
            return None

        return run

    parts = rows_of_text(df, [text_col], "bucket long, " + ", ".join(f"{n} double" for n in names), make, finish=True)
    rows = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((buckets, dims))
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows[names].to_numpy(dtype=np.float64)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray, codes: Codes) -> np.ndarray:
    """Mean word vector, mean mark vector and log length of each text; zeros for empty texts."""
    dims = vectors.shape[1]
    out = np.zeros((len(texts), 2 * dims + 1), dtype=np.float32)
    for i, text in enumerate(texts):
        words, counts = tokens(text or "", codes)
        if len(words):
            out[i, :dims] = vectors[words].mean(axis=0)
            out[i, dims : 2 * dims] = (counts / len(words)) @ vectors[:MARKS]
            out[i, -1] = np.log1p(len(words)) / 10
    return out


@dataclass(frozen=True)
class Network:
    """A two-layer network with standardised inputs and a calibration temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _log_loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
    """Adam on the log loss; every fifth row is left out of training and sets the temperature."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z, target = ((x - mean) / scale)[~held], y[~held].astype(float)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            h = np.tanh(z[rows] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - target[rows]) / len(rows)
            back = np.outer(error, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * p[0], back.sum(axis=0), h.T @ error + decay * p[2], np.array([error.sum()])]
            step += 1
            for a, g, mm, vv in zip(p, grads, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    raw = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits, truth = raw.logits(x[held]), y[held]
    grid = np.geomspace(0.5, 8, 60)
    best = min(grid, key=lambda t: _log_loss(logits / t, truth)) if held.any() else 1.0
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), float(best))


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    network: Network | None
    share: float


def train_quality(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> QualityModel:
    """Word vectors from all of ``docs``; the network from at most ``sample`` rows of ``labelled`` (id, label).

    Rows of ``labelled`` with a null id or label are not used; of repeated ids one row counts,
    and of their texts the smallest. If only
    one label (or none) is there, every score is that label's share (0.5 without any).
    """
    session_defaults(docs.sparkSession)
    vectors = word_vectors(docs, text_col)
    wanted = (
        labelled.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y"))
        .filter("_id is not null and _y is not null")
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t")).join(F.broadcast(wanted), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min("_t").alias("_t"))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def make():
        codes = Codes(len(shared.value))

        def run(ids, texts, labels):
            x = pooled(texts, shared.value, codes)
            return {"id": pa.array([str(i) for i in ids]), "y": labels, "x": pa.array([r.tobytes() for r in x], pa.binary())}

        return run

    found = rows_of_text(rows, ["_id", "_t", "_y"], "id string, y int, x binary", make).toPandas().sort_values("id")
    shared.destroy()
    if found["y"].nunique() < 2:
        return QualityModel(vectors, None, float(found["y"].mean()) if len(found) else 0.5)
    x = np.frombuffer(b"".join(found["x"]), dtype=np.float32).reshape(len(found), -1).astype(np.float64)
    order = np.random.default_rng(5).permutation(len(found))
    return QualityModel(vectors, fit_network(x[order], found["y"].to_numpy()[order]), float(found["y"].mean()))


def score_quality(df: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``score``: the calibrated probability of label 1. No shuffle.

    Null and empty texts have the score of a document without words. Very long texts are read whole.
    Extra columns pass through; one named like ``score_col`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        codes = Codes(len(shared.value.vectors))

        def run(texts):
            net = shared.value.network
            if net is None:
                return [pa.array([shared.value.share] * len(texts), pa.float64())]
            return [pa.array(net.probability(pooled(texts, shared.value.vectors, codes)), pa.float64())]

        return run

    return map_text(df, [text_col], [T.StructField(score_col, T.DoubleType())], make, drop)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(parts))
