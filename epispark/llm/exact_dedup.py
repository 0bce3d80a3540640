"""Exact dedup: a tree-merge of sorted digest runs, DataFrame functions only.

Every row gives an entry (digest, second hash, length, smallest identifier, count). Rows are dealt
into ``runs`` runs, whose equal entries are merged before and after they move. Then come rounds: groups of
``fan_in`` runs meet (an exchange by run), are sorted by digest, and a window over the sorted entries merges
neighbours that are equal, keeping the smallest identifier. An entry is equal to another only if the
digest, the second hash and the length all agree, which every round checks again. A run consists of
``slices`` by digest, merged side by side, so that also the last, single run has as many tasks. Only entries move,
never texts; a text that holds a third of all rows costs one entry per task, and one per run in the rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.llm.common import join_on_key, text_of

#: White space that is folded to one space (fixed by the contract).
WHITE_SPACE = r"[\x20\x09-\x0D]+"
ENTRY = ["_digest", "_check", "_length"]


def normalised(column: str = "text") -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(text_of(column), WHITE_SPACE, " ")


def merge_runs(entries: DataFrame, runs: int = 64, fan_in: int = 4, slices: int | None = None) -> DataFrame:
    """Merge entries (_id, digest, check, length) to one per text: keep_id and group_size.

    ``slices`` is by default four times spark.sql.shuffle.partitions.
    """
    slices = slices or 4 * int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.select(F.pmod(F.xxhash64("_id"), F.lit(runs)).cast("int").alias("_run"), *ENTRY, "_id")
    level = dealt.groupBy("_run", *ENTRY).agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    level = level.withColumn("_slice", F.pmod(F.hash("_digest"), F.lit(slices)))
    equal = Window.partitionBy("_run", "_slice", *ENTRY).orderBy(F.asc_nulls_last("keep_id"))
    every = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while runs > 1:
        runs = -(-runs // fan_in)
        met = level.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int")).repartition("_run", "_slice")
        merged = met.withColumns({"_place": F.row_number().over(equal), "group_size": F.sum("group_size").over(every)})
        level = merged.filter("_place = 1").drop("_place")
    return level.drop("_run", "_slice")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 4) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Nulls: a null text counts as empty; a row with a null id never beats another, and is kept only if
    its whole group has null ids (keep_id is then null). Ties: rows that repeat both id and text
    share one verdict and count each in group_size. Empty texts are equal to each other. An empty
    table gives no rows. Extra columns of ``df`` are not read, whatever their names.
    """
    text = normalised(text_col)
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_t")).select("_id", F.unhex(F.sha2("_t", 256)).alias("_digest"), F.xxhash64("_t").alias("_check"), F.length("_t").alias("_length"))
    merged = merge_runs(rows, runs, fan_in)
    return join_on_key(rows, merged, ENTRY).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
