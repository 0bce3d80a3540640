"""Shared pieces of the corpus operators: Arrow text maps, staged tables, bounded bit filters."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes handed to Python at once: documents can be long, so batches are small.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"
#: Rows that Python hands back at once, so that neither side holds a task's output whole.
OUT_ROWS = 16_384

_SHIPPED: set[str] = set()
_STAGED: dict[str, list[str]] = {}


def session_defaults(spark: SparkSession) -> None:
    """Small Arrow batches unless the caller has set others, this package for the workers (once a session), and a
    checkpoint folder.

    The folder is the one that ``spark.checkpoint.dir`` names. Only a local session, whose tasks share the driver's
    disk, may do without: it gets a temporary one. On a cluster that is an error.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        package = Path(__file__).resolve().parents[1]
        archive = f"{tempfile.mkdtemp()}/{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(archive)
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: its rows are written once, as Parquet, to the shared checkpoint folder.

    A table read back has the size that it has. (A checkpoint() would keep the sizes estimated for the plan,
    which in loops of joins multiply without end.) The files stay until ``release`` or until the folder is cleared.
    """
    spark = df.sparkSession
    session_defaults(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_tables(spark: SparkSession) -> int:
    """How many staged tables this session has."""
    return len(_STAGED.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, *kept: DataFrame, since: int = 0) -> None:
    """Delete this session's staged tables (after the first ``since``), but for those that ``kept`` read. No other
    DataFrame may still need them."""
    files = {f for df in kept for f in df.inputFiles()}
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    left = paths[:since]
    for path in paths[since:]:
        if any(path.rsplit("/", 1)[1] in f for f in files):
            left.append(path)
            continue
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _STAGED[spark.sparkContext.applicationId] = left


def discard(*staged: DataFrame) -> None:
    """Delete the staged tables that these DataFrames read. No other DataFrame may still need them."""
    for df in staged:
        spark, files = df.sparkSession, df.inputFiles()
        paths = _STAGED.get(spark.sparkContext.applicationId, [])
        for path in [p for p in paths if any(p.rsplit("/", 1)[1] in f for f in files)]:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            paths.remove(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    session_defaults(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> str | list[str]:
    """For each name one like it that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        k, made = 0, f"_{name}"
        while made.lower() in taken:
            k += 1
            made = f"_{name}{k}"
        taken.add(made.lower())
        out.append(made)
    return out if len(out) > 1 else out[0]


def unpacked(df: DataFrame, *new: str) -> DataFrame:
    """The columns that were packed in one, ``row``, so that an operator's own beside it clash with none; then those
    named. Of equal names the new one stays."""
    replaced = {c.lower() for c in new}
    return df.select(*[F.col("row")[f.name].alias(f.name) for f in df.schema["row"].dataType if f.name.lower() not in replaced], *new)


def text_of(column: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def give_back() -> None:
    """Return to the system what this process has freed; Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with output of ``OUT_ROWS`` rows a batch at most, and with the task's memory given back at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            for at in range(0, out.num_rows, OUT_ROWS):
                yield out.slice(at, OUT_ROWS)
        out = None
        give_back()

    return df.mapInArrow(whole, schema)


def map_text(
    df: DataFrame,
    text_columns: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., list[pa.Array]]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add columns that Python computes from text columns, batch by batch; leave out those in ``drop``.

    ``make()`` runs once in each task and returns a function that takes one list of strings per text
    column (null: empty) and returns one Arrow array per field. Other columns pass through; one that
    has the name of a new field is replaced by it.
    """
    names = {f.name for f in fields} | {*drop}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            texts = [[x or "" for x in batch.column(c).to_pylist()] for c in text_columns]
            made = function(*texts)
            columns = [batch.column(f.name) for f in kept] + made
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept + fields])

    return map_batches(df, run, schema)


def rows_of_text(
    df: DataFrame,
    columns: list[str],
    schema: str,
    make: Callable[[], Callable[..., dict[str, np.ndarray] | None]],
    finish: bool = False,
) -> DataFrame:
    """Turn batches of rows into other rows: ``make()(lists...)`` returns columns by name, or None.

    With ``finish`` the function is called once more with None at the end of the task, for what it
    has summed up there.
    """
    picked = df.select(*columns)
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def batch_of(out: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) for f in target], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            out = function(*[batch.column(c).to_pylist() for c in columns])
            if out is not None:
                yield batch_of(out)
        if finish and (out := function(*[None] * len(columns))) is not None:
            yield batch_of(out)

    return map_batches(picked, run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_filter(keys: DataFrame, column: str, log2_most: int = 27) -> np.ndarray:
    """A bitmap over 64-bit keys, as 64-bit words: about 16 bits a key, 2**log2_most bits (16 MB) at most.

    Whoever tests keys against it gets false positives, never false negatives.
    """
    log2_bits = min(log2_most, max(20, (16 * keys.count()).bit_length()))
    at = F.shiftrightunsigned(F.xxhash64(F.col(column)), 64 - log2_bits).alias("at")
    words = (
        keys.select(at)
        .select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(1 << (log2_bits - 6), dtype=np.int64)
    rows = words.toPandas()
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64)
    return out


def may_hold(bits: np.ndarray, value: int) -> bool:
    """Whether a ``bit_filter`` may have been made from this 64-bit key."""
    at = xxhash.xxh64_intdigest((value & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), seed=42) >> (64 - (len(bits).bit_length() + 5))
    return bool(int(bits[at >> 6]) >> (at & 63) & 1)


def join_on_key(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Give each row its group's columns; ``groups`` has one row per key.

    A key may hold a large share of ``rows``. ``groups`` is staged first, so that both sides of the
    join are freshly exchanged and adaptive execution can split a hot key's partition.
    """
    return rows.join(stage(groups), keys, how)
