"""Word clusters from adjacent words: seeds, then greedy assignment by affinity."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textclusters.operators import counts, pmi
from textclusters.sources import corpus

#: The cluster of the sentinels and of unknown words.
RESERVED = 0
#: Words that are placed in one task at a time.
BLOCK = 2000


def seed_clusters(vocab: DataFrame, n_clusters: int, group_col: str | None = None) -> DataFrame:
    """(word, cluster): the n_clusters words of the lowest ranks, each its own cluster."""
    keys = [group_col] if group_col else []
    return vocab.where(F.col("rank") <= n_clusters).select(*keys, "word", F.col("rank").cast("int").alias("cluster"))


def _place(n_clusters: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """(rank, cluster) of the words of one block of one group.

    Rows without other are a word's affinity to a cluster by the words before the block,
    or, without a cluster, say only that the word is there; rows with other are its pairs
    with words of the block, back being 0 for word to other and 1 for other to word.
    Words are placed by rank, each when all that it depends on is. Terms are added by
    earlier rank and direction, those from before the block first, which fixes the sums to
    the last bit, whatever the size of blocks.
    """

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["rank"].min())
        scores = np.zeros((int(rows["rank"].max()) - first + 1, n_clusters))
        base = rows[rows["other"].isna() & rows["cluster"].notna()]
        scores[base["rank"].to_numpy() - first, base["cluster"].to_numpy().astype(np.int64) - 1] = base["weight"].to_numpy()
        pairs = rows.dropna(subset=["other"]).sort_values(["rank", "other", "back"])
        rank, other, weight = pairs["rank"].to_numpy() - first, pairs["other"].to_numpy().astype(np.int64) - first, pairs["weight"].to_numpy()
        bounds = np.searchsorted(rank, np.arange(len(scores) + 1))
        cluster = np.zeros(len(scores), np.int64)
        for word, score in enumerate(scores):
            at = slice(bounds[word], bounds[word + 1])
            np.add.at(score, cluster[other[at]], weight[at])
            cluster[word] = int(np.argmax(score))
        return pd.DataFrame({"rank": np.arange(first, first + len(cluster)), "cluster": cluster + 1})

    return place


def _assigned(ranks: DataFrame, edges: DataFrame, group: str, n_clusters: int, block: int) -> DataFrame:
    """(group, rank, cluster) of all ranks(group, rank), from edges(group, rank, other, back, wpmi).

    Ranks go in blocks. A word depends on words of earlier ranks alone: what it gets from
    earlier blocks is a join with their clusters and a sum, for all words of the block at
    once, and what is left are the pairs within the block, at most block^2 twice, which one
    task a group places. Edges are stored by block and each is read once; the clusters of
    a block are stored before the next one, so that the lineage is cut.
    """
    spark = ranks.sparkSession
    kind = dict(ranks.dtypes)[group]
    number = F.floor((F.col("rank") - n_clusters - 1) / block).cast("int")
    folder = corpus.scratch(spark)
    edges.where(F.col("rank") > n_clusters).withColumn("block", number).write.partitionBy("block").parquet(f"{folder}/edges")
    schema = f"{group} {kind}, rank int, other int, back int, wpmi double, block int"
    by_block = spark.read.schema(schema).parquet(f"{folder}/edges")
    ranks.where(F.col("rank") <= n_clusters).select(group, F.col("rank").cast("int").alias("rank"), F.col("rank").cast("int").alias("cluster")).write.parquet(f"{folder}/placed")
    placed = lambda: spark.read.schema(f"{group} {kind}, rank int, cluster int").parquet(f"{folder}/placed")
    most = ranks.agg(F.max("rank")).first()[0] or 0
    place = _place(n_clusters)

    def of_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = place(rows)
        found.insert(0, "g", key[0])
        return found

    for at in range(-(-max(most - n_clusters, 0) // block)):
        start = n_clusters + at * block
        own = by_block.where(F.col("block") == at)
        known = own.where(F.col("other") <= start).join(placed().withColumnRenamed("rank", "other"), [group, "other"])
        # The terms of one word and cluster, added in order.
        terms = known.groupBy(group, "rank", "cluster").agg(F.array_sort(F.collect_list(F.struct("other", "back", "wpmi"))).alias("terms"))
        total = F.aggregate("terms", F.lit(0.0), lambda sum_, term: sum_ + term["wpmi"])
        none, no_weight = F.lit(None).cast("int"), F.lit(0.0)
        sums = terms.select(group, "rank", none.alias("other"), F.lit(0).alias("back"), "cluster", total.alias("weight"))
        inner = own.where(F.col("other") > start).select(group, "rank", "other", "back", none.alias("cluster"), F.col("wpmi").alias("weight"))
        there = ranks.where((F.col("rank") > start) & (F.col("rank") <= start + block)).select(group, "rank", none.alias("other"), F.lit(0).alias("back"), none.alias("cluster"), no_weight.alias("weight"))
        rows = sums.unionByName(inner).unionByName(there)
        rows.groupBy(group).applyInPandas(of_group, f"g {kind}, rank int, cluster int").withColumnRenamed("g", group).write.mode("append").parquet(f"{folder}/placed")
    return placed()


def brown_cluster(sentences: DataFrame, n_clusters: int = 256, min_freq: int = 3, max_vocab: int | None = 8000, group_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """(word, cluster[, group]) for the vocabulary and the sentinels.

    The n_clusters most frequent words seed one cluster each; each further word, by
    rank, joins the cluster to whose members so far it has the highest affinity (the
    lowest id among equals); the sentinels are in cluster 0. Words are placed in blocks of
    ranks: affinities to earlier blocks are joins and sums over all executors, and one task
    a group holds no more than the pairs within a block, whatever the vocabulary's size.
    """
    if not 1 <= n_clusters <= 65535:
        raise ValueError("n_clusters must be from 1 to 65535")
    group = group_col or "_group"
    rows = sentences if group_col else sentences.withColumn(group, F.lit(0))
    vocab, unigrams, bigrams, mass = counts.vocabulary_counts(rows, min_freq, max_vocab, group)
    weights = pmi.weighted_pmi(bigrams, unigrams, mass, group)
    ranks = vocab.select(group, "word", F.col("rank").cast("int").alias("rank"))
    ranked = weights.join(ranks.select(group, F.col("word").alias("prev"), F.col("rank").alias("a")), [group, "prev"]).join(ranks.select(group, F.col("word").alias("curr"), F.col("rank").alias("b")), [group, "curr"]).where("a <> b")
    edges = ranked.select(group, F.greatest("a", "b").alias("rank"), F.least("a", "b").alias("other"), (F.col("a") < F.col("b")).cast("int").alias("back"), "wpmi")
    found = ranks.join(_assigned(ranks, edges, group, n_clusters, block), [group, "rank"]).select(group, "word", "cluster")
    groups = rows.select(group).distinct()
    ends = groups.select(group, F.explode(F.array(F.lit(counts.BOS), F.lit(counts.EOS))).alias("word"), F.lit(RESERVED).alias("cluster"))
    both = found.unionByName(ends)
    return both.select("word", "cluster", group) if group_col else both.select("word", "cluster")


def with_sentinels(clusters: DataFrame) -> DataFrame:
    """A (word, cluster) map with both sentinels in the reserved cluster."""
    ends = clusters.sparkSession.range(1).select(F.explode(F.array(F.lit(counts.BOS), F.lit(counts.EOS))).alias("word"), F.lit(RESERVED).alias("cluster"))
    return clusters.select("word", "cluster").unionByName(ends)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """(cluster, n_words) of every cluster that has words."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("n_words"))


def cluster_mass(clusters: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(cluster, mass double): occurrences of the words of each cluster."""
    return clusters.join(unigrams, "word").groupBy("cluster").agg(F.sum("cnt").cast("double").alias("mass"))


def get_cluster(tokens: DataFrame, clusters: DataFrame, word_col: str = "word") -> DataFrame:
    """tokens with the cluster of word_col, 0 for unknown words.

    The map has at most max_vocab + 2 words; Spark broadcasts it below its threshold.
    """
    known = clusters.select(F.col("word").alias(word_col), "cluster")
    joined = tokens.join(known, word_col, "left")
    return joined.select(*tokens.columns, F.coalesce("cluster", F.lit(RESERVED)).alias("cluster"))
