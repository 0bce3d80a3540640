"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Parsing, rules and features are DataFrame expressions. The trees are Spark ML's and learn from
labelled URLs; at most ``sample`` of them, chosen by a hash of the URL. Where the caller has no labels, a URL that
has a rule is labelled by it, and any other by its host: block if one of the host's words is among ``terms``, else
allow. Labels by rules alone would follow from the suffix, and trees could only repeat it. The terms are no feature: trees
see what such hosts look like, and carry that over to hosts with other words. Suffix statistics (how often a host suffix occurs, and how often it is blocked
among the labelled) are counted over all rows; for a labelled URL the share blocked is counted in the other
folds only (its own label, or that of a repeat of it, is not in its features).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.llm.common import join_on_key, session_defaults, stage, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: Words by which hosts of common unwanted kinds (gambling, adult, pharmacy, tracking) name themselves.
TERMS = ("ads", "adult", "bet", "bets", "betting", "casino", "dating", "gambling", "pharmacy", "pills", "poker", "porn", "spam", "tracker", "viagra", "xxx")


def parse_url(url: str | Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or where ``://`` is missing."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls; among equally long ones the first by text."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):  # the last that fits wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, r.text).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def judge_rules(df: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add host, path, rule and verdict (null without a rule)."""
    host, path = parse_url(f"`{url_col}`")
    out = df.withColumns({"host": host, "path": path})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": rule, "verdict": verdict})


def weak_label(verdict: Column, host: Column, terms: tuple[str, ...] = TERMS) -> Column:
    """1 (block) or 0 by the rule's verdict; without one by the words of the host, or null if there are no ``terms``."""
    ruled = F.when(verdict == "block", 1).when(verdict == "allow", 0)
    if not terms:
        return ruled
    return ruled.otherwise(F.arrays_overlap(F.split(host, "[^a-z0-9]+"), F.array(*map(F.lit, terms))).cast("int"))


def suffix_of(host: Column) -> Column:
    """The last two labels of a host (all of it, if it has fewer)."""
    return F.regexp_extract(host, r"[^.]*\.?[^.]*$", 0)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that follow from the URL alone."""
    n = F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.length(url) - F.length(F.replace(url, c)))
    entropy = F.log(F.greatest(n, F.lit(1))) - F.aggregate(F.filter(counts, lambda x: x > 0), F.lit(0.0), lambda s, x: s + x * F.log(x)) / F.greatest(n, F.lit(1))
    return {
        "length": n,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "labels": F.size(F.split(host, r"\.")),
        "digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(n, F.lit(1)),
        "entropy": entropy,
        "params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        "query_length": F.length(query),
        "hyphens": F.length(F.regexp_replace(url, "[^-_]", "")),
        "host_hyphens": F.length(F.regexp_replace(host, "[^-]", "")),
        "host_digits": F.length(F.regexp_replace(host, "[^0-9]", "")),
        "fragment": url.contains("#"),
        "https": url.startswith("https://"),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$"),
    }


def add_suffix_statistics(df: DataFrame, folds: int = 5) -> DataFrame:
    """Add suffix_count, suffix_labelled and suffix_block (the smoothed share of block among the labelled) of the
    host's suffix, over all rows; for labelled rows, without those of their fold. Needs url, host and label."""
    df = df.withColumns({"suffix": suffix_of(F.col("host")), "fold": F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64("url"), F.lit(folds))).otherwise(-1)})
    parts = df.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    whole = Window.partitionBy("suffix")
    totals = parts.withColumns({f"all_{c}": F.sum(c).over(whole) for c in ("n", "labelled", "blocked")})
    known, blocked = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
    stats = totals.select("suffix", "fold", F.log1p("all_n").alias("suffix_count"), F.log1p(known).alias("suffix_labelled"), ((blocked + 1) / (known + 2)).alias("suffix_block"))
    return join_on_key(df, stats, ["suffix", "fold"])


def featured(judged: DataFrame) -> DataFrame:
    """Add ``features``, a vector. Needs url, host, path and label."""
    names = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    out = add_suffix_statistics(judged)
    return out.withColumn("features", array_to_vector(F.array(*[c.cast("double") for c in names.values()], "suffix_count", "suffix_labelled", "suffix_block")))


def train_url_model(rows: DataFrame, sample: int = 10_000, trees: int = 12, depth: int = 4, seed: int = 3) -> GBTClassificationModel | None:
    """Boosted trees from the rows (url, features, label) with a label (1: block); None if one label is missing."""
    picked = rows.filter("label is not null").select("features", F.col("label").cast("double").alias("label"), "url")
    picked = stage(picked.orderBy(F.xxhash64("url"), "url").limit(sample).drop("url").coalesce(2))
    if picked.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2, cacheNodeIds=True).fit(picked)


def block_score(rows: DataFrame, model: GBTClassificationModel | None) -> DataFrame:
    """Add block_score, the trees' probability of block from ``features``; 0 without a model."""
    if model is None:
        return rows.withColumn("block_score", F.lit(0.0))
    model = model.setFeaturesCol("features").setProbabilityCol("probability").setRawPredictionCol("").setPredictionCol("")
    return model.transform(rows).withColumn("block_score", vector_to_array("probability")[1])


def filter_urls(df: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, label_col: str | None = None, sample: int = 10_000, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """Add host, path, rule, verdict and block_score (the trees' probability).

    The verdict is the rule's, else block where the trees give at least one half. The trees learn
    from ``label_col`` (1: block, null: unlabelled), or from ``weak_label``, which ``terms`` serve. Without both
    labels the score is 0 and the verdict allow.

    Nulls: a null URL has an empty host and path, no rule, and the trees' verdict on an empty URL.
    Repeated URLs get the same verdict. Very long URLs are read whole. Extra columns pass through, whatever
    their names; columns named like the new ones are replaced. An empty table gives no rows.
    """
    session_defaults(df.sparkSession)
    host, path = parse_url(f"`{url_col}`")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    label = F.col("row")[label_col].cast("int") if label_col else weak_label(F.col("verdict"), F.col("host"), terms)
    ready = featured(rows.withColumn("label", label))
    scored = block_score(ready, train_url_model(ready, sample))
    scored = scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")))
    return unpacked(scored, "host", "path", "rule", "verdict", "block_score")
