"""Pointwise mutual information of pairs and the affinity of words to clusters."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Decimal places to which sums of affinities are rounded before they are compared, as their terms have no order.
PLACES = 6


def weighted_pmi(bigrams: DataFrame, unigrams: DataFrame, mass: DataFrame, group_col: str | None = None) -> DataFrame:
    """(prev, curr, cnt, wpmi): cnt * ln(cnt * n / (count of prev * count of curr))."""
    keys = [group_col] if group_col else []
    out = bigrams
    for side in ("prev", "curr"):
        out = out.join(unigrams.select(*keys, F.col("word").alias(side), F.col("cnt").cast("double").alias(f"u_{side}")), [*keys, side])
    out = out.join(F.broadcast(mass), keys) if keys else out.crossJoin(F.broadcast(mass))  # mass: one row (a group)
    count = F.col("cnt").cast("double")
    return out.select(*keys, "prev", "curr", "cnt", (count * F.log(count * F.col("n") / (F.col("u_prev") * F.col("u_curr")))).alias("wpmi"))


def affinities(pmi: DataFrame, members: DataFrame) -> DataFrame:
    """(word, cluster, score): for each word and each cluster that it shares a pair
    with, the sum of wpmi over the cluster's members, both directions."""
    words = pmi.where("prev <> curr")
    there = words.select(F.col("prev").alias("word"), F.col("curr").alias("member"), "wpmi")
    back = words.select(F.col("curr").alias("word"), F.col("prev").alias("member"), "wpmi")
    seen = there.unionByName(back).join(members.select(F.col("word").alias("member"), "cluster"), "member")
    return seen.groupBy("word", "cluster").agg(F.round(F.sum("wpmi"), PLACES).alias("score"))


def nearest_cluster(words: DataFrame, scores: DataFrame, n_clusters: int) -> DataFrame:
    """(word, cluster) of the highest score for each of words; equal scores: the lowest id.

    A cluster that a word shares no pair with scores zero. Of those only the one
    with the lowest id can win, so just that one is added as a candidate.
    """
    touched = scores.groupBy("word").agg(F.collect_set("cluster").alias("touched"))  # at most n_clusters ids
    every = F.sequence(F.lit(1), F.lit(n_clusters))
    free = F.array_min(F.array_except(every, F.coalesce("touched", F.array().cast("array<int>"))))
    zero = words.select("word").join(touched, "word", "left").select("word", free.alias("cluster"), F.lit(0.0).alias("score")).where("cluster IS NOT NULL")
    some = scores.join(words.select("word"), "word", "left_semi").select("word", "cluster", "score")
    # -0.0 and 0.0 are equal, as the scores are.
    best = F.max_by("cluster", F.struct(F.col("score") + F.lit(0.0), -F.col("cluster")))
    return some.unionByName(zero).groupBy("word").agg(best.alias("cluster"))
