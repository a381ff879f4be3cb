"""URL filters (operator 1): rules first, else logistic regression on hashed character n-grams.

The model is trained on a small table of labelled URLs (at most ``TRAIN_ROWS``, the first by a
hash), by full-batch gradient steps: each step is one aggregation over the staged features, and
only the gradient, a vector of fixed size, reaches the driver. Scoring is one expression over the
URL, without a shuffle.

DataFrame functions only.

Defined cases: a NULL URL, or one without ``://``, has an empty host and path, fits no rule and
gets the verdict of the bias; equal URLs get equal verdicts; without labelled URLs of both kinds
the method allows all or blocks all alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.llm.common import literal_array, stage

# (verdict, host and path); the longest rule that fits decides.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
         ("allow", "org/fr/"))

GRAM = 3
FEATURES = 4096
TRAIN_ROWS = 2048
STEPS = 25
RATE = 0.5
DECAY = 1e-4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, lower case, and the path behind it."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return (F.translate(host, UPPER, LOWER),
            F.coalesce(F.regexp_extract(url, pattern, 2), F.lit("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES):
    """The longest rule that fits, and its verdict; NULL where none does."""
    fits, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        here = (((host == name) | host.endswith("." + name)) & path.startswith(slash + start))
        fits = F.when(here, F.lit(rule)).otherwise(fits)
        verdict = F.when(here, F.lit(kind)).otherwise(verdict)
    return fits, verdict


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None,
               rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id",
               url_col: str = "url", steps: int = STEPS) -> DataFrame:
    """``id_col``, host, path, rule, verdict, block_score for each URL.

    ``labelled`` has url and blocked (boolean); without it the URLs that rules decide are labels.
    """
    if labelled is None:
        labelled = ruled(pages, rules, url_col)
    weights, bias = train(labelled, steps=steps)
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(id_col, host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.withColumn("_buckets", buckets(F.col("host"), F.col("path")))
    score = probability(F.col("_buckets"), literal_array(weights, "double"), bias)
    return scored.select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"),
        score.alias("block_score"))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
          url_col: str = "url") -> DataFrame:
    """URLs that a rule decides, with its verdict."""
    host, path = host_and_path(F.col(url_col))
    _, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    return (pages.select(F.col(url_col).alias("url"), host.alias("_host"), path.alias("_path"))
            .select("url", (verdict == "block").alias("blocked")).filter("blocked IS NOT NULL"))


def buckets(host: Column, path: Column) -> Column:
    """Hashed n-grams of host and path, each marked with its part and its ends."""
    def grams(part: Column, mark: str) -> Column:
        chars = F.split(F.concat(F.lit("^"), part, F.lit("$")), "(?!^)(?!$)")
        # Each character with those behind it; what is cut short at the end is NULL. Zipping whole
        # arrays, unlike looking characters up by place, stays linear in the length.
        joined = chars
        for k in range(1, GRAM):
            joined = F.zip_with(joined, F.slice(chars, k + 1, F.size(chars)),
                                lambda a, b: F.concat(a, b))
        return F.transform(F.filter(joined, F.isnotnull), lambda g: F.pmod(
            F.xxhash64(F.concat(F.lit(mark), g)), F.lit(FEATURES)).cast("int"))

    return F.concat(grams(host, "h"), grams(path, "p"))


def probability(places: Column, weights: Column, bias: float) -> Column:
    """Logistic function of the mean weight, scaled by the root of the number of n-grams."""
    total = F.aggregate(places, F.lit(0.0), lambda s, b: s + F.element_at(weights, b + 1))
    margin = total / F.sqrt(F.greatest(F.size(places), F.lit(1))) + bias
    return 1 / (1 + F.exp(-margin))


def train(labelled: DataFrame, url_col: str = "url",
          steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and bias from the labelled URLs."""
    host, path = host_and_path(F.col("_url"))
    sample = (labelled.filter(F.col("blocked").isNotNull())
              .select(F.col(url_col).alias("_url"), "blocked").distinct()
              .orderBy(F.xxhash64("_url"), "_url", "blocked").limit(TRAIN_ROWS))
    rows = (sample.select(host.alias("_host"), path.alias("_path"),
                          F.col("blocked").cast("double").alias("_y"))
            .select("_y", buckets(F.col("_host"), F.col("_path")).alias("_buckets")))
    rows = stage(rows, "url-features").df
    weights, bias = [0.0] * FEATURES, 0.0
    seen, seen_bias = [1e-8] * FEATURES, 1e-8
    for _ in range(steps):
        p = probability(F.col("_buckets"), literal_array(weights, "double"), bias)
        errors = rows.select("_buckets", (p - F.col("_y")).alias("_e"))
        # The bias is one more bucket.
        scaled = F.col("_e") / F.sqrt(F.greatest(F.size("_buckets"), F.lit(1)))
        found = (errors.select(F.explode(F.concat(
            F.transform("_buckets", lambda b: F.struct(b.alias("b"), scaled.alias("g"))),
            F.array(F.struct(F.lit(FEATURES).alias("b"), F.col("_e").alias("g"))))).alias("_x"))
            .groupBy("_x.b").agg(F.sum("_x.g").alias("g")).collect())
        for r in found:
            b, g = r["b"], r["g"]
            if b == FEATURES:
                seen_bias += g * g
                bias -= RATE * g / math.sqrt(seen_bias)
            else:
                g += DECAY * weights[b]
                seen[b] += g * g
                weights[b] -= RATE * g / math.sqrt(seen[b])
    return weights, bias
