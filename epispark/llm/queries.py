"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.llm.bpe import default_tokenizer, round_trip
from epispark.llm.centroids import cluster
from epispark.llm.common import documents, text_of
from epispark.llm.embeddings import near_embeddings
from epispark.llm.exact_dedup import exact_dedup
from epispark.llm.fingerprints import add_fingerprints, add_likeness, band_lexicon, with_next
from epispark.llm.line_dedup import dedup_lines
from epispark.llm.mixing import mix_sources
from epispark.llm.near_dedup import near_duplicates
from epispark.llm.phrases import mine_phrases
from epispark.llm.pii import BASE, find_pii
from epispark.llm.quality import fold, score_quality, train_quality
from epispark.llm.toxicity import score_toxicity, train_toxicity
from epispark.llm.urls import filter_urls


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = round_trip(docs, default_tokenizer(), drop=("text",))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "source", "lang", "mix_weight", "mix_probability", "mix_kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_dropped")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(documents(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", text_of("text").alias("text"))
    lexicon = band_lexicon(docs)
    paired = with_next(add_fingerprints(docs, lexicon, {"text": "fingerprint"}), "doc_id", ["text", "fingerprint"], ids=docs)
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("left(next_text, cast(floor(length(text) / 3) as int))"))
    rows = paired.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = add_fingerprints(rows.withColumn("edited_sha256", F.sha2("edited", 256)), lexicon, {"edited": "edited_fingerprint"}, drop=("edited",))
    rows = add_likeness(rows, {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "next_fingerprint")})
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, similarity=(9, 10))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text")).drop("text")

    def joined(rows: str) -> Column:
        return F.expr(f"array_join(transform({rows}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")

    counts = [F.expr(f"size(filter(spans, s -> s.rank = {i}))").cast("bigint").alias(f"n_{kind.name}") for i, kind in enumerate(BASE)]
    base = joined(f"filter(spans, s -> s.rank < {len(BASE)})")
    every = F.size("spans").cast("bigint").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined("spans").alias("spans"), every)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    learned = documents(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0).select("doc_id", "quality")
    scored = score_quality(docs, train_quality(docs, learned), drop=("text",))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    learned = documents(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1).select("doc_id", "toxic")
    scored = score_toxicity(docs, train_toxicity(docs, learned), drop=("text",))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(documents(spark, sf_dir).select("lang", "text"))


OP11_SQL = r"""
WITH pieces AS (
    SELECT lang, piece, row_number() OVER () AS p FROM (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
words AS (
    SELECT lang, p, generate_subscripts(w, 1) AS i, unnest(w) AS w
    FROM (SELECT lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)),
windows AS (
    SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
    FROM words WINDOW o AS (PARTITION BY p ORDER BY i)),
every AS (
    SELECT lang, [w1] AS w, count(*) AS f FROM windows GROUP BY ALL
    UNION ALL SELECT lang, [w1, w2], count(*) FROM windows WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM windows WHERE w3 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM windows WHERE w4 IS NOT NULL GROUP BY ALL),
f AS MATERIALIZED (SELECT lang, w, array_to_string(w, ' ') AS t, f FROM every WHERE f >= 30),
c AS MATERIALIZED (SELECT lang, w, f AS a FROM f WHERE len(w) > 1),
cuts AS (SELECT lang, w, a, unnest(range(1, len(w))) AS k FROM c),
scored AS (
    SELECT t.lang, t.w, t.a, t.k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * t.a // (x.f + y.f) AS BIGINT) AS score
    FROM cuts t JOIN f x ON x.lang = t.lang AND x.t = array_to_string(t.w[1:t.k], ' ') JOIN f y ON y.lang = t.lang AND y.t = array_to_string(t.w[t.k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
runs AS (SELECT lang, w, a, unnest(range(2, len(w))) AS m FROM c WHERE len(w) > 2),
inside AS (SELECT lang, w[i:i + m - 1] AS w, max(a) AS longer FROM (SELECT lang, w, a, m, unnest(range(1, len(w) - m + 2)) AS i FROM runs) GROUP BY ALL),
kept AS (
    SELECT b.lang, array_to_string(b.w, ' ') AS phrase, b.a, b.l, b.r, b.score
    FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.w = b.w WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a),
n AS (SELECT lang, count(*) AS n FROM words GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000
"""


def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(documents(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x for x in e if x IS NOT NULL AND isfinite(x)]) = len(e) AND list_inner_product(e, e) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(documents(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int) -> str:
    """The rounds written out; whole numbers as doubles are exact here."""
    near = "(SELECT vec_id, q, min(CAST(list_inner_product(q, q) - 2 * list_inner_product(q, p) + list_inner_product(p, p) AS BIGINT) * 8 + c) AS m FROM kept, c{i} GROUP BY vec_id, q)"
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS q FROM embeddings "
        "WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, q AS p FROM kept QUALIFY c < 8)",
    ]
    for i in range(rounds):
        parts += [
            f"a{i} AS MATERIALIZED (SELECT m % 8 AS c, q FROM {near.format(i=i)})",
            f"s{i} AS (SELECT c, j, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT c, generate_subscripts(q, 1) AS j, unnest(q) AS x FROM a{i}) GROUP BY c, j)",
            f"n{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS p FROM s{i} GROUP BY c)",
            f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.p, o.p) AS p FROM c{i} o LEFT JOIN n{i} n ON n.c = o.c)",
        ]
    parts.append(f"final AS MATERIALIZED (SELECT vec_id, m % 8 AS cluster, m // 8 AS distance FROM {near.format(i=rounds)})")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, CAST(cluster AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, "
        "CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string([CAST(x AS BIGINT) for x in p], ',')) AS centroid_sha256\n"
        f"FROM final JOIN c{rounds} ON c = cluster"
    )


OP13_SQL = _op13_sql(10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_fingerprints": op5_fingerprints,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_phrases": op11_phrases,
    "op12_embeddings": op12_embeddings,
    "op13_centroids": op13_centroids,
}

ORACLES: dict[str, str] = {"op6_exact_dedup": OP6_SQL, "op11_phrases": OP11_SQL, "op12_embeddings": OP12_SQL, "op13_centroids": OP13_SQL}
