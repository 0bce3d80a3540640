"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives, any text is unlabelled. A linear numpy classifier over the
presence of word buckets is trained with the class-prior-corrected risk
``prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])``: where the corrected part would fall below
zero, the step goes against it, so that the model doesn't learn the positives by heart.

Features are chosen in Spark, from counts over all rows; the driver gets the chosen ones and, of the fitted
rows, which of them each row has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.common import map_text, rows_of_text, session_defaults, stage

BUCKETS = 1 << 20
#: Lengths of the word beginnings that count as features, for inflected and compound words.
BEGINNINGS = (4, 5, 6)
_CACHED = 400_000
_EDGE = ".,;:!?'\"()[]{}*_-&%$#"


class Buckets(dict):
    """chunk -> hash buckets of its word and of the word's beginnings, remembered for a bounded number of chunks."""

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        word = chunk.lower().strip(_EDGE)
        parts = [word] + [f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k]
        found = tuple(xxhash.xxh64_intdigest(p.encode()) % BUCKETS for p in parts)
        if len(self) >= _CACHED:
            self.clear()
        self[chunk] = found
        return found


@dataclass(frozen=True)
class ToxicModel:
    """Weights of the chosen buckets, sorted by bucket, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, found: np.ndarray) -> float:
        if not len(self.buckets) or not len(found):
            return self.bias
        at = np.minimum(np.searchsorted(self.buckets, found), len(self.buckets) - 1)
        return self.bias + float(self.weights[at[self.buckets[at] == found]].sum())


def word_buckets(text: str, cache: Buckets) -> np.ndarray:
    """The sorted distinct word buckets of a text."""
    found = set().union(*map(cache.__getitem__, set(text.split())))
    return np.sort(np.fromiter(found, dtype=np.int64, count=len(found)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def bucket_counts(rows: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(bucket, n): the number of rows with a bucket, over all rows of the one text column; tasks sum first.

    ``only`` (a boolean array over all buckets, a fixed size) says which buckets are counted.
    """
    shared = None if only is None else rows.sparkSession.sparkContext.broadcast(np.packbits(only))

    def make():
        cache, total = Buckets(), np.zeros(BUCKETS, dtype=np.int64)
        wanted = None if shared is None else np.unpackbits(shared.value).astype(bool)

        def run(texts):
            if texts is None:
                used = np.flatnonzero(total if wanted is None else total * wanted)
                return {"bucket": used, "n": total[used]} if len(used) else None
            for t in texts:
                total[word_buckets(t or "", cache)] += 1
            return None

        return run

    return rows_of_text(rows, rows.columns, "bucket long, n long", make, finish=True).groupBy("bucket").agg(F.sum("n").alias("n"))


def choose_features(positive: DataFrame, all_rows: DataFrame, n_pos: int, n_all: int, prior: float, most: int = 1000, least_docs: int = 3, least_ratio: float = 10.0, least_z: float = 3.0) -> np.ndarray:
    """From (bucket, n) of the positives and of all rows, the buckets that positives have clearly more often
    than negatives: in at least ``least_docs`` of them, ``least_ratio`` times as often (negatives being
    all rows less the prior's share of positives), and more often than all rows by ``least_z`` standard
    errors; the ``most`` significant ones, ties by bucket."""
    p, u = F.col("cp") / n_pos, F.col("cu") / n_all
    both = positive.filter(F.col("n") >= least_docs).select("bucket", F.col("n").alias("cp")).join(all_rows.select("bucket", F.col("n").alias("cu")), "bucket")
    z = (p - u) / F.sqrt((p + u) / n_pos + u / n_all + 1e-12)
    ranked = both.withColumn("z", z).filter((u <= p * (prior + (1 - prior) / least_ratio)) & (F.col("z") >= least_z))
    return np.sort(np.array([r["bucket"] for r in ranked.orderBy(F.desc("z"), "bucket").limit(most).collect()], dtype=np.int64))


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, steps: int = 800, rate: float = 0.05, decay: float = 1e-6) -> ToxicModel:
    """Full-batch Adam on the non-negative risk with the logistic loss; rows hold the chosen buckets that they have."""
    chosen = np.unique(np.concatenate(pos)).astype(np.int64)

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        row, found = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        held = np.isin(found, chosen)
        return row[held], np.searchsorted(chosen, found[held]), len(rows)

    sets = [sparse(pos), sparse(unl)]
    w, b = np.zeros(len(chosen)), np.zeros(1)
    state = [[np.zeros_like(a), np.zeros_like(a)] for a in (w, b)]
    for step in range(1, steps + 1):
        f = [np.bincount(r, weights=w[c], minlength=n) + b[0] for r, c, n in sets]
        # derivatives of the mean losses by f: l(f) = log(1 + exp(-f))
        p_plus, p_minus, u_minus = -_sigmoid(-f[0]) / len(f[0]), _sigmoid(f[0]) / len(f[0]), _sigmoid(f[1]) / len(f[1])
        corrected = np.logaddexp(0, f[1]).mean() - prior * np.logaddexp(0, f[0]).mean()
        on_p, on_u = (prior * (p_plus - p_minus), u_minus) if corrected >= 0 else (prior * p_minus, -u_minus)
        grad = decay * w
        for (r, c, _), on in zip(sets, (on_p, on_u)):
            grad = grad + np.bincount(c, weights=on[r], minlength=len(w))
        for a, g, (m, v) in zip((w, b), (grad, np.array([on_p.sum() + on_u.sum()])), state):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ToxicModel(chosen, w, float(b[0]))


def train_toxicity(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float | None = None,
    positives: int = 10_000,
    unlabelled: int = 20_000,
) -> ToxicModel:
    """Train on at most ``positives`` confirmed rows and ``unlabelled`` rows of any kind, chosen by id hash.

    ``labelled`` holds (id, label); only its positive rows serve as examples, the others only for the
    class prior where none is given. How often all rows have a feature is counted over the whole of ``docs``.
    Of repeated ids one row is fitted, the one with the smallest text. Null ids are not fitted. Without
    positives every score is near 0.
    """
    session_defaults(docs.sparkSession)
    known = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    if prior is None:
        prior = float(known.agg(F.avg("y")).first()[0] or 0.05)
    prior = min(max(prior, 1e-4), 0.9)
    by_hash = (F.xxhash64("id", F.lit("toxicity")), F.col("id"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    chosen = known.filter("y = 1").orderBy(*by_hash).limit(positives).select("id", F.lit(1).alias("p"))
    chosen = chosen.unionByName(texts.select("id").filter("id is not null").distinct().orderBy(*by_hash).limit(unlabelled).select("id", F.lit(0).alias("p")))
    fitted = stage(texts.join(F.broadcast(stage(chosen)), "id").groupBy("id", "p").agg(F.min("t").alias("t")))
    n_pos, n_all = fitted.filter("p = 1").count(), docs.count()
    if not n_pos:
        return ToxicModel(np.zeros(0, dtype=np.int64), np.zeros(0), -30.0)
    positive = stage(bucket_counts(fitted.filter("p = 1").select("t")).filter("n >= 3"))
    wanted = np.zeros(BUCKETS, dtype=bool)
    wanted[positive.select("bucket").toPandas()["bucket"].to_numpy(dtype=np.int64)] = True
    features = choose_features(positive, bucket_counts(texts.select("t"), wanted), n_pos, n_all, prior)

    def make():
        cache = Buckets()

        def run(ids, texts, flags):
            places = []
            for t in texts:
                places.append(np.intersect1d(word_buckets(t or "", cache), features, assume_unique=True).astype(np.int32).tobytes())
            return {"id": pa.array([str(i) for i in ids]), "p": flags, "x": pa.array(places, pa.binary())}

        return run

    rows = rows_of_text(fitted, ["id", "t", "p"], "id string, p int, x binary", make).toPandas().sort_values(["id", "p"])
    pos, unl = [[np.frombuffer(x, dtype=np.int32) for x in rows.loc[rows["p"] == p, "x"]] for p in (1, 0)]
    return fit_nnpu(pos, unl, prior)


def score_toxicity(df: DataFrame, model: ToxicModel, text_col: str = "text", score_col: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``score``: the modelled probability that a text is toxic. No shuffle.

    Null and empty texts have the score of a text without known words. Very long texts are read whole.
    Extra columns pass through; one named like ``score_col`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        cache = Buckets()

        def run(texts):
            model = shared.value
            return [pa.array(_sigmoid(np.array([model.logit(word_buckets(t, cache)) for t in texts])), pa.float64())]

        return run

    return map_text(df, [text_col], [T.StructField(score_col, T.DoubleType())], make, drop)
