"""Comparison of two runs' quotes, page by page."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio, in the order (a, b): it is not symmetric for long texts."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def containment(a: Column, b: Column) -> Column:
    """Shorter over longer length where one text holds the other, else null."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(F.contains(a, b) | F.contains(b, a), F.when(long == 0, 1.0).otherwise(short / long))


def pair_candidates(a: DataFrame, b: DataFrame, threshold: float | None = None) -> DataFrame:
    """(page, i, j, score) of matching quotes; a and b: (page, ix, quote), normalised.

    A quote that holds the other matches whatever the threshold; other pairs match by difflib's ratio, or not at all
    without a threshold. The ratio's Python runs only for pairs that need it.
    """
    left = a.select("page", F.col("ix").alias("i"), F.col("quote").alias("qa"))
    right = b.select("page", F.col("ix").alias("j"), F.col("quote").alias("qb"))
    pairs = left.join(right, "page").withColumn("score", containment(F.col("qa"), F.col("qb")))
    held = pairs.filter("score is not null").select("page", "i", "j", "score")
    if threshold is None:
        return held
    # 2 * shorter / (both) bounds the ratio
    could = 2 * F.least(F.length("qa"), F.length("qb")) / (F.length("qa") + F.length("qb")) >= threshold
    ratio = pairs.filter(F.col("score").isNull() & could).withColumn("score", sequence_ratio("qa", "qb")).filter(F.col("score") >= threshold)
    return held.unionByName(ratio.select("page", "i", "j", "score"))


def greedy_pairing(candidates: DataFrame) -> DataFrame:
    """(page, i, j, score): one-to-one pairs, the best score first, ties by i, then j."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "i", "j")))
    empty = F.array().cast("array<struct<less:double,i:bigint,j:bigint>>")
    free = lambda done, x: ~F.exists(done, lambda y: (y["i"] == x["i"]) | (y["j"] == x["j"]))
    chosen = F.aggregate("c", empty, lambda done, x: F.when(free(done, x), F.concat(done, F.array(x))).otherwise(done))
    typed = candidates.select("page", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "score")
    # a page's candidates are within one array: quotes of one page of two runs
    return typed.groupBy("page").agg(ordered.alias("c")).select("page", F.explode(chosen).alias("x")).select("page", "x.i", "x.j", (-F.col("x.less")).alias("score"))


def page_status(matched: Column, a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), "EMPTY").when(matched == 0, "NO_MATCH").when((matched == a) & (matched == b), "MATCH").otherwise("PARTIAL")


def dice_percent(matched: Column, a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), 100.0).when((a == 0) | (b == 0), 0.0).otherwise(200.0 * matched / (a + b))


def compare_pages(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page, n_a, n_b, matched, status, similarity) of every page of either run."""
    count = lambda df, name: df.groupBy("page").agg(F.count("*").alias(name))
    both = count(a, "n_a").join(count(b, "n_b"), "page", "full_outer").join(count(pairs, "matched"), "page", "left").na.fill(0, ["n_a", "n_b", "matched"])
    m, x, y = F.col("matched"), F.col("n_a"), F.col("n_b")
    return both.select("page", "n_a", "n_b", "matched", page_status(m, x, y).alias("status"), F.round(dice_percent(m, x, y), 6).alias("similarity"))


def overall_similarity(compared: DataFrame) -> DataFrame:
    sums = compared.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_a", "n_b", "matched")])
    return sums.withColumn("similarity", F.round(dice_percent(F.col("matched"), F.col("n_a"), F.col("n_b")), 6))
