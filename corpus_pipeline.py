"""From raw documents to tokens: quality, line dedup, near duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.llm.bpe import default_tokenizer, round_trip
from epispark.llm.common import documents, release, stage, staged_tables
from epispark.llm.line_dedup import dedup_lines
from epispark.llm.mixing import mix_sources
from epispark.llm.near_dedup import near_duplicates
from epispark.llm.quality import fold, score_quality, train_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go. It learns from the labels outside fold 0 of 5.

    Null texts count as empty, and all empty texts have one score. Equal texts share a fate. Without labels of
    both kinds every score is the labels' share (0.5 without any). An empty table stays empty.
    """
    learned = documents(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0).select("doc_id", "quality")
    model = train_quality(docs.select("doc_id", "text"), learned)
    return score_quality(docs.select(*COLUMNS), model).filter("score >= 0.3").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that (nearly) repeat one of an earlier document go; so do documents that lose all their lines.

    Of documents that begin a line the one with the smallest id keeps it; among lines of the same document the
    one with the smallest hash stays. Null and blank texts stay as they are, null ids lose no line to another row.
    An empty table stays empty.
    """
    out = dedup_lines(docs.select(*COLUMNS), drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays.

    Documents without an id come after all that have one, in the order of a hash of their columns: one of them
    stays if its group has no id, and of equal ones (empty ones too) one at most. Rows that repeat an id stay
    together. Empty texts are near nothing. An empty table stays empty.
    """
    late = F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*COLUMNS[1:]), 2))
    docs = docs.select(*COLUMNS, F.coalesce("doc_id", late).alias("_id"))
    groups = near_duplicates(docs, "_id").filter("component_id = _id").select("_id")
    kept = docs.join(groups.distinct(), "_id", "left_semi")
    return kept.filter("doc_id is not null").unionByName(kept.filter("doc_id is null").dropDuplicates(["_id"])).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by probabilities raked to tempered source, language and topic shares.

    Nulls in source or language are a class of their own, blank texts a topic; documents without words stay with the
    kept share's probability. A hash of the id decides, so rows that repeat an id share a fate, and so do all without.
    An empty table stays empty.
    """
    return mix_sources(docs.select(*COLUMNS)).filter("mix_kept").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays, as token ids, and the digest of what they decode to. Null texts count as empty and have no ids;
    every row is encoded whole, also repeated ones and ones without an id. An empty table stays empty."""
    coded = round_trip(docs.select("doc_id", "text", "lang", "source"), default_tokenizer(), drop=("text",))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_dedup), ("mixing sources to target weights", mixing), ("BPE encoding and decoding", encode)]

#: No SQL: stages learn a model, join by edit distance and rake in loops; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows staged for the next."""
    docs, before = documents(spark, sf_dir), staged_tables(spark)
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
            release(spark, docs, since=before)
    return docs
