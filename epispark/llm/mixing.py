"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Rows are first summed to cells (one per combination of the dimensions that occurs). Raking scales the
cells' token weights in turn to each dimension's target shares until the margins agree. A document's
probability of staying is proportional to its cell's weight per token, with the rate solved so that
the expected number of tokens is the wanted share of all; it stays if a hash of its id says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.common import join_on_key, session_defaults, stage, text_of, unpacked

MISSING = "(none)"
#: Cells that are raked in one task at most.
ONE_TASK = 200_000


def fit_topics(df: DataFrame, text_col: str = "text", topics: int = 12, features: int = 1024, seed: int = 5) -> PipelineModel | None:
    """Clusters of texts by their hashed, idf-weighted words: document counts and k-means, both of every row that
    has words. None where texts are too few or too alike to be told apart."""
    return fit_clusters(stage(with_counts(df.select(text_of(text_col).alias("text")), F.col("text"), features).drop("text")), topics, features, seed)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def with_counts(df: DataFrame, text: Column, features: int = 1024) -> DataFrame:
    """Add ``counts``, how often the text's words fall on each hashed feature, and ``n_words``, how many there are."""
    counted = HashingTF(numFeatures=features, inputCol="words", outputCol="counts").transform(df.withColumn("words", _words(text)))
    return counted.withColumn("n_words", F.size("words").cast("bigint")).drop("words")


def fit_clusters(counted: DataFrame, topics: int = 12, features: int = 1024, seed: int = 5) -> PipelineModel | None:
    """The model of ``fit_topics`` from all rows of ``with_counts``, which are staged: each step reads them.

    The weighted vectors are kept on the executors' disks while k-means goes over them, not in their memory.
    """
    filled = counted.filter("n_words > 0").select("counts")
    if filled.isEmpty():
        return None
    vectors = Pipeline(stages=[IDF(inputCol="counts", outputCol="weights"), Normalizer(inputCol="weights", outputCol="unit")]).fit(filled)
    units = vectors.transform(filled).select("unit").persist(StorageLevel.DISK_ONLY)
    differing = lambda rows: rows.select(F.xxhash64(vector_to_array("unit")).alias("h")).distinct().limit(topics).count()
    try:
        if differing(units.limit(1000)) < topics:  # else there are enough, whatever the other rows hold
            topics = differing(units)
        if topics < 2:
            return None
        clusters = KMeans(k=topics, maxIter=8, seed=seed, featuresCol="unit", predictionCol="topic").fit(units)
    finally:
        units.unpersist()
    return PipelineModel(stages=[HashingTF(numFeatures=features, inputCol="words", outputCol="counts"), *vectors.stages, clusters])


def with_topic(df: DataFrame, model: PipelineModel | None, text: Column) -> DataFrame:
    """Add ``topic``: the cluster of the text's words, or ``blank``. ``df`` has none of the model's columns."""
    return topic_of_counts(with_counts(df, text, model.stages[0].getNumFeatures() if model else 1), model)


def topic_of_counts(counted: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``with_topic`` from the columns of ``with_counts``, which it takes away."""
    if model is None:
        return counted.withColumn("topic", F.when(F.col("n_words") > 0, "topic 0").otherwise("blank")).drop("counts", "n_words")
    out = PipelineModel(stages=model.stages[1:]).transform(counted)
    topic = F.when(F.col("n_words") > 0, F.concat(F.lit("topic "), F.col("topic").cast("string"))).otherwise("blank")
    return out.withColumn("topic", topic).drop("counts", "n_words", "weights", "unit")


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(dimension, target): the shares that the dimension's classes have if every cell's tokens are taken to
    the power ``power``. Targets of all dimensions made so can be met together, whatever cells are missing."""
    shares = cells.filter("tokens > 0").groupBy(dimension).agg(F.sum(F.pow("tokens", F.lit(power))).alias("t"))
    total = shares.agg(F.sum("t").alias("total"))
    return shares.join(F.broadcast(total)).select(dimension, (F.col("t") / F.col("total")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 20_000, tolerance: float = 1e-7, at_once: int = 20) -> DataFrame:
    """Add ``weight``: the cells' tokens raked to the targets (dimension -> (dimension, target shares)).

    Weights sum to 1. Sweeps go on until no margin is off by more than ``tolerance`` of the whole. Targets that
    don't fit together (no weights have them) can't be met: that is an error after ``sweeps`` sweeps. A class that a
    target lacks is left out.

    The cells, one for each combination of classes that occurs, are few beside the rows. Up to ``ONE_TASK`` of them
    are swept in one task; of more, a sweep is a window over each dimension's classes, ``at_once`` sweeps a job.
    """
    dims = list(targets)
    grand = cells.agg(F.sum("tokens").alias("all"))
    fitted = cells.join(F.broadcast(grand)).withColumn("weight", F.col("tokens") / F.col("all")).drop("all")
    for i, d in enumerate(dims):
        fitted = fitted.join(targets[d].select(d, F.col("target").alias(f"target{i}")), d)
    fitted = stage(fitted)
    if fitted.isEmpty():
        return fitted.drop(*[f"target{i}" for i in range(len(dims))])
    extra = [f"target{i}" for i in range(len(dims))]
    if fitted.count() <= ONE_TASK:
        swept = stage(_sweep_in_task(fitted, dims, sweeps, tolerance))
        worst = swept.agg(F.max("off")).first()[0]
        if worst < tolerance:
            return swept.drop("off", *extra)
        raise ValueError(f"the targets can't be met together: a margin is off by {worst} of the whole after {sweeps} sweeps")
    margin = lambda d: F.sum("weight").over(Window.partitionBy(d))
    worst = None
    for _ in range(0, sweeps, at_once):
        for _ in range(at_once):
            for i, d in enumerate(dims):
                share = margin(d)
                fitted = fitted.withColumn("weight", F.when(share > 0, F.col("weight") * F.col(f"target{i}") / share).otherwise(0.0))
        fitted = stage(fitted)
        worst = fitted.select(*[F.abs(F.col(f"target{i}") - margin(d)).alias(f"off{i}") for i, d in enumerate(dims)]).agg(*[F.max(f"off{i}") for i in range(len(dims))]).first()
        if max(worst) < tolerance:
            return fitted.drop(*extra)
    raise ValueError(f"the targets can't be met together: a margin is off by {max(worst)} of the whole after {sweeps} sweeps")


def _sweep_in_task(fitted: DataFrame, dims: list[str], sweeps: int, tolerance: float) -> DataFrame:
    """Raked cells and ``off``, by how much the margins are off at most; all cells are one task's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = pd.concat(list(batches))
        weight = cells["weight"].to_numpy(float)
        places = [np.unique(cells[d], return_inverse=True)[1] for d in dims]
        targets = [np.zeros(p.max() + 1) for p in places]
        for i, (p, t) in enumerate(zip(places, targets)):
            t[p] = cells[f"target{i}"]
        off = np.inf
        for _ in range(sweeps):
            for p, t in zip(places, targets):
                share = np.bincount(p, weights=weight)
                weight = weight * np.divide(t, share, out=np.zeros_like(t), where=share > 0)[p]
            off = max(np.abs(np.bincount(p, weights=weight) - t).max() for p, t in zip(places, targets))
            if off < tolerance:
                break
        yield cells.assign(weight=weight, off=off)

    schema = T.StructType(fitted.schema.fields + [T.StructField("off", T.DoubleType())])
    return fitted.coalesce(1).mapInPandas(run, schema)


def inclusion(fitted: DataFrame, keep: float) -> DataFrame:
    """Add ``probability``: min(1, rate * weight per token), the rate such that a share ``keep`` of the tokens is expected.

    Cells reach 1 in the order of their ratio, so the rate follows from sums over the cells; the equation
    is solved by raising the rate, each time from the cells that are still below 1, until it stays: each step
    but the last takes in one more cell at least.
    """
    rated = fitted.withColumn("_ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    total = rated.agg(F.sum("tokens")).first()[0] or 0
    want, rate = keep * total, keep * total
    while True:
        capped = F.col("_ratio") * rate >= 1
        row = rated.agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if not row or row["full"] is None or not row["free"]:
            break
        new = max(rate, (want - row["full"]) / row["free"])
        if abs(new - rate) <= 1e-12 * max(rate, 1.0):
            break
        rate = new
    return rated.withColumn("probability", F.least(F.lit(1.0), F.col("_ratio") * rate)).drop("_ratio")


def unit_hash(column: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash, the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), column), 11) / float(1 << 53)


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: dict[str, Column] | None = None,
    tokens: Column | None = None,
    power: float = 0.7,
    targets: dict[str, DataFrame] | None = None,
    keep: float = 0.7,
    seed: int = 17,
) -> DataFrame:
    """Add mix_weight (the row's share of the raked tokens), mix_probability and mix_kept to every row.

    ``dimensions`` are the margins (by default source, lang and topic, a cluster of the text's words: see
    ``fit_topics``), ``targets`` their shares (by default those of the present cells to the power ``power``, which lifts
    small sources), ``keep`` the expected share of tokens that stays, ``tokens`` a row's token weight (by default
    its words, runs of other than ASCII white space).

    Nulls in a dimension form a class of their own; a null text counts as empty; rows without tokens have
    weight 0 and the probability of their cell; with a null id, the null's hash decides. Repeated rows have
    the same fate. Extra columns pass through, whatever their names; columns named like the new ones are
    replaced. A dimension with classes that have no tokens or no target loses them.
    """
    session_defaults(df.sparkSession)
    text = text_of(text_col)
    given = {f"d{i}": c for i, c in enumerate((dimensions or {"source": F.col("source"), "lang": F.col("lang")}).values())}
    named = dict(zip(dimensions or ("source", "lang"), given))
    counted = tokens is None and dimensions is None  # the topics' words are the tokens
    if tokens is None:
        tokens = F.lit(0) if counted else F.regexp_count(text, F.lit(r"\S+"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.select(row.alias("row"), *[F.coalesce(c.cast("string"), F.lit(MISSING)).alias(d) for d, c in given.items()], tokens.cast("bigint").alias("tokens"))
    if dimensions is None:
        named["topic"] = "topic"
        # words are counted once, for all that reads the rows
        keyed = with_counts(keyed, F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")))
        keyed = stage(keyed.withColumn("tokens", F.col("n_words")) if counted else keyed)
        keyed = topic_of_counts(keyed, fit_clusters(keyed))
    dims = list(named.values())
    cells = stage(keyed.groupBy(*dims).agg(F.sum("tokens").alias("tokens")))
    aims = {named[d]: t.select(F.col(d).alias(named[d]), "target") for d, t in (targets or {}).items()}
    for d in dims:
        if d not in aims:
            aims[d] = stage(tempered_targets(cells, d, power))
    mixed = inclusion(rake(cells.filter("tokens > 0"), aims), keep)
    placed = cells.join(mixed.select(*dims, "weight", "probability"), dims, "left")
    placed = placed.select(*dims, F.col("tokens").alias("cell"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("probability", F.when(F.col("tokens") > 0, 0.0).otherwise(F.lit(keep))).alias("mix_probability"))
    out = join_on_key(keyed, placed, dims)
    weight = F.when(F.col("cell") > 0, F.col("weight") * F.col("tokens") / F.col("cell")).otherwise(0.0)
    kept = unit_hash(F.col("row")[id_col], seed) < F.col("mix_probability")
    return unpacked(out.withColumns({"mix_weight": weight, "mix_kept": kept}), "mix_probability", "mix_weight", "mix_kept")
