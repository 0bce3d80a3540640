"""Readers and writers."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.operators.lineage import cut

RAW_EVENTS = T.StructType([T.StructField(c, T.StringType()) for c in ("DTOBITO", "CODMUNRES", "IDADE", "SEXO", "CAUSABAS")])


#: Bytes of a file's head from which its dialect is told.
HEAD = 1 << 16


def list_files(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files that paths, patterns and folders stand for, in any file system Spark knows; hidden ones are left out."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for p in [paths] if isinstance(paths, str) else paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        open_ = list(fs.globStatus(path) or [])
        while open_:
            found = open_.pop()
            if found.isDirectory():
                open_ += [x for x in fs.listStatus(found.getPath()) if x.getPath().getName()[0] not in "_."]
            else:
                out.append(found.getPath().toString())
    return sorted(set(out))


def read_heads(spark: SparkSession, files: list[str], size: int = HEAD) -> dict[str, bytes]:
    """The first ``size`` bytes of each file, unpacked where it is compressed, through the file system that Spark reads it by.

    No more of a file is read, however large it is.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def head(file: str) -> tuple[str, bytes]:
        path = jvm.org.apache.hadoop.fs.Path(file)
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            inner = codec.createInputStream(stream) if codec is not None else stream
            return file, bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(inner, size)))
        finally:
            stream.close()

    with ThreadPoolExecutor(8) as pool:
        return dict(pool.map(head, files))


def _dialects(spark: SparkSession, paths: str | list[str], encoding: str = "ISO-8859-1") -> list[dict]:
    out = []
    for path, head in read_heads(spark, list_files(spark, paths)).items():
        lines = [x for x in re.split(r"\r\n|\n|\r", head.decode(encoding, errors="replace")) if x]
        header, row = next(iter(lines), ""), next((x for x in lines if re.search("[0-9]", x)), "")
        out.append({
            "path": path, "header": header, "separator": ";" if header.count(";") > header.count(",") else ",",
            "date_format": "iso" if re.search("[0-9]{4}-[0-9]{2}-[0-9]{2}", row) else "ddmmyyyy", "sex_format": "text" if re.search("masc|fem|ignorado", row.lower()) else "numeric",
        })
    return out


def detect_dialects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, header, separator, date_format, sex_format) of each text file, from its first lines.

    They are told from the first ``HEAD`` bytes: the header is the first line, the row the first one that has a digit. Empty files have an empty header.
    """
    return spark.createDataFrame([tuple(x.values()) for x in _dialects(spark, paths)], "path string, header string, separator string, date_format string, sex_format string")


def _by_header(found: list[dict], separator: str | None = None) -> dict[tuple[str, tuple[str, ...]], list[str]]:
    """Files by separator and cleaned header, so that column order may differ between files; empty files have no rows and go."""
    by: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for x in found:
        if x["header"]:
            mark = separator or x["separator"]
            by.setdefault((mark, tuple(c.strip().strip('"').strip().upper() for c in x["header"].split(mark))), []).append(x["path"])
    return dict(sorted(by.items()))


def read_event_csv(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    """All event files as strings, each dialect with its separator, with source_file; only ``columns``.

    The driver sees the head of each file, once.
    """
    columns = columns or RAW_EVENTS.names
    out = None
    for (separator, names), files in _by_header(_dialects(spark, paths, encoding)).items():
        part = spark.read.csv(files, sep=separator, encoding=encoding, header=True, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), enforceSchema=True)
        picked = [F.col(f"`{c}`") if c in names else F.lit(None).cast("string").alias(c) for c in columns]
        part = part.select(*picked, F.col("_metadata.file_name").alias("source_file"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "source_file"]]))


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, in any file system Spark knows (missing years are skipped)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).globStatus(path):
            out.append(p)
    return out


def optional_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none: its features are then off."""
    return spark.read.parquet(path) if existing_paths(spark, [path]) else None


def year_from_name(column: str = "source_file", pattern: str = r"([0-9]{2})(?=[^0-9]*$)", base: int = 2000) -> Column:
    """The year from two digits in a file name."""
    return F.expr(f"try_cast(regexp_extract({column}, '{pattern}', 1) as int)") + base


def read_panel(spark: SparkSession, path: str, region_aliases: list[str], region: str = "region_code", date_aliases: list[str] | None = None) -> DataFrame:
    """A Parquet panel, its level-specific key renamed to ``region`` and its date column to ``date``, a DATE."""
    from epispark.functions.parse import resolve_columns

    df = resolve_columns(spark.read.parquet(path), {region: region_aliases, "date": date_aliases or []})
    return df.withColumn("date", F.to_date("date"))


def read_history(spark: SparkSession, csv_paths: list[str], parquet_paths: list[str], encoding: str = "ISO-8859-1", separator: str = ";") -> DataFrame:
    """CSV years and Parquet years as one table of strings; missing columns are null.

    Files are read by their own headers, so columns may stand in another order in each.
    """
    parts = []
    for (_, names), files in _by_header(_dialects(spark, csv_paths, encoding), separator).items() if csv_paths else ():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        parts.append(spark.read.csv(files, sep=separator, header=True, encoding=encoding, schema=schema, enforceSchema=True))
    if parquet_paths:
        table = spark.read.parquet(*parquet_paths)
        parts.append(table.select(*[F.col(c).cast("string") for c in table.columns]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_covariates(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_json_report(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def seed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small static table of the caller."""
    return spark.createDataFrame(rows, schema)


def write_panel(df: DataFrame, path: str, keys: tuple[str, ...] = ("region_code", "date"), mode: str = "overwrite") -> None:
    """Parquet, range-partitioned by the first key and sorted by all: later filters on the key skip files."""
    df.repartitionByRange(keys[0]).sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str, digits: int | None = 8, mode: str = "overwrite") -> None:
    """Nested JSON; doubles are rounded to ``digits``, also inside of structs and arrays."""

    def rounded(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.DoubleType):
            return F.round(value, digits)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: rounded(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*[rounded(value[f.name], f.dataType).alias(f.name) for f in kind]))
        return value

    if digits is not None:
        df = df.select(*[rounded(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
    df.write.mode(mode).json(path)


def write_sample(df: DataFrame, path: str, keys: list[str], rows: int = 1000, mode: str = "overwrite") -> None:
    df.orderBy(*keys).limit(rows).write.mode(mode).option("header", True).csv(path)


def merge_increment(existing: DataFrame, new: DataFrame, keys: list[str], sums: list[str], renames: dict[str, str] | None = None, source: str | None = None) -> DataFrame:
    """Union two datasets and sum again by the keys.

    ``renames`` bring the new one's drifted names in line. With a ``source`` column the merge is idempotent:
    what the existing one has of the new one's sources is replaced.
    """
    for old, name in (renames or {}).items():
        new = new.withColumnRenamed(old, name)
    if source is not None:
        existing = existing.join(new.select(source).distinct(), source, "left_anti")
        keys = [*keys, source]
    both = existing.unionByName(new, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def upsert(new: DataFrame, path: str, keys: list[str], sums: list[str], renames: dict[str, str] | None = None, partition: tuple[str, str] = ("source", "year")) -> DataFrame:
    """Bring the increment ``new`` into the dataset at ``path``; returns (partition..., n_rows, digest, changed), a row a partition of ``new``.

    The dataset is Parquet by ``partition``, say a source and a year, and holds the sums by ``keys`` in each. A partition that ``new`` has replaces the
    one there, so an increment applied twice counts once; all others stay as they are, file by file. A manifest beside the data has each partition's
    rows and digest: what has not changed is not written again. It is appended to after the data, so an attempt that died in between is made good by the next.
    """
    spark = new.sparkSession
    for old, name in (renames or {}).items():
        new = new.withColumnRenamed(old, name)
    by = list(dict.fromkeys([*keys, *partition]))
    summed = cut(new.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums]))
    of_row = lambda k: F.bit_xor(F.xxhash64(F.lit(k), *[F.col(c) for c in sorted([*by, *sums])]))  # noqa: E731  rows are distinct
    fresh = summed.groupBy(*partition).agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws(":", of_row(0), of_row(1)).alias("digest"))
    manifest = f"{path}/_manifest"
    same = lambda other: [fresh[c].eqNullSafe(other[c]) for c in partition]
    if existing_paths(spark, [manifest]):
        held = spark.read.parquet(manifest)
        last = held.withColumn("_k", F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc("version")))).filter("_k = 1")
        version = held.agg(F.max("version")).first()[0] + 1
        met = last.select(*partition, F.col("n_rows").alias("_n"), F.col("digest").alias("_d"))
        fresh = fresh.join(met, same(met), "left").select(*[fresh[c] for c in partition], "n_rows", "digest", (~(F.col("n_rows").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_d")))).alias("changed"))
    else:
        fresh, version = fresh.withColumn("changed", F.lit(True)), 1
    fresh = cut(fresh)
    changed = F.broadcast(fresh.filter("changed").select(*partition))  # a row a partition: as many as the dataset has folders
    touched = summed.join(changed, [summed[c].eqNullSafe(changed[c]) for c in partition], "left_semi")
    if not fresh.filter("changed").isEmpty():
        # a partition may be large: its rows are dealt by the first key too
        dealt = touched.repartitionByRange(*partition, keys[0]).sortWithinPartitions(*partition, *keys)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
        fresh.filter("changed").drop("changed").withColumn("version", F.lit(version)).write.mode("append").parquet(manifest)
    return fresh


def read_upserted(spark: SparkSession, path: str, keys: list[str], sums: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """The dataset of ``upsert``, summed over its partitions by ``keys``. ``kinds`` are the types of the partitioning columns (by default
    source string, year int), which folders' names don't tell."""
    kinds = kinds or {"source": "string", "year": "int"}
    schema = T.StructType([T.StructField(f.name, T._parse_datatype_string(kinds[f.name])) if f.name in kinds else f for f in spark.read.parquet(path).schema.fields])
    return spark.read.schema(schema).parquet(path).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
