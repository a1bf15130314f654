"""Counts of words and of adjacent words, and what is kept of them.

Sentences are rows with an array of words. Every function takes an optional
group column: counts, vocabularies and all that follows are then made for each
group on its own. Without one there is a single group.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textclusters.sources.corpus import kept

#: The words that stand for the beginning and the end of a sentence.
BOS, EOS = "BOS", "EOS"


def path_words(words: Column) -> Column:
    """The words of a path without sentinels and nulls; their neighbours become a pair."""
    return F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w.isNotNull() & ~w.isin(BOS, EOS))


def _keys(group_col: str | None) -> list[str]:
    return [group_col] if group_col else []


def unigram_counts(sentences: DataFrame, group_col: str | None = None) -> DataFrame:
    """(word, cnt): occurrences of each word; both sentinels count once a sentence."""
    keys = _keys(group_col)
    words = sentences.select(*keys, F.explode(path_words(F.col("words"))).alias("word"))
    counted = words.groupBy(*keys, "word").agg(F.count("*").alias("cnt"))
    return counted.unionByName(sentinel_counts(sentences, group_col))


def sentinel_counts(sentences: DataFrame, group_col: str | None = None) -> DataFrame:
    """(word, cnt) of both sentinels: the number of sentences."""
    keys = _keys(group_col)
    paths = sentences.groupBy(*keys).agg(F.count("*").alias("cnt"))
    return paths.select(*keys, F.explode(F.array(F.lit(BOS), F.lit(EOS))).alias("word"), "cnt")


def bigram_counts(sentences: DataFrame, group_col: str | None = None) -> DataFrame:
    """(prev, curr, cnt) of adjacent words, the sentinels at both ends included.

    A sentence without words counts once as (BOS, EOS). Pairs are zipped within the
    row and summed with partial aggregation: one shuffle, no sort.
    """
    keys = _keys(group_col)
    words = path_words(F.col("words"))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(BOS)), words).alias("prev"), F.concat(words, F.array(F.lit(EOS))).alias("curr"))
    return sentences.select(*keys, F.inline(pairs).alias("prev", "curr")).groupBy(*keys, "prev", "curr").agg(F.count("*").alias("cnt"))


def word_ranks(unigrams: DataFrame) -> DataFrame:
    """(word, cnt, rank long) of all rows of unigrams(word, cnt), from 1 by count, equal counts by word.

    Ranges of the order are dealt to tasks and sorted there; running sums over the sizes of
    the ranges, a row each, tell at which rank a range starts. No task sees all words.
    """
    order = [F.desc("cnt"), F.asc("word")]
    ranged = unigrams.select("word", "cnt").repartitionByRange(*order).sortWithinPartitions(*order)
    # Written, so that numbers and sizes are of the same ranges.
    ranged = kept(ranged.withColumns({"part": F.spark_partition_id(), "id": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return ranged.join(starts, "part").select("word", "cnt", (F.col("ahead") + F.col("id") - F.col("first") + 1).alias("rank"))


def vocabulary(unigrams: DataFrame, min_freq: int = 3, max_vocab: int | None = 8000, group_col: str | None = None) -> DataFrame:
    """(word, cnt, rank): the max_vocab most frequent words, all for None, of at least
    min_freq occurrences, ranked from 1 by count, equal counts by word."""
    words = unigrams.where((F.col("cnt") >= min_freq) & ~F.col("word").isin(BOS, EOS))
    order = [F.desc("cnt"), F.asc("word")]
    if group_col:
        # Spark keeps the best max_vocab of each task before it shuffles a group.
        ranked = words.withColumn("rank", F.row_number().over(Window.partitionBy(group_col).orderBy(*order)))
        return ranked if max_vocab is None else ranked.where(F.col("rank") <= max_vocab)
    if max_vocab is None:
        return word_ranks(words)
    words = words.orderBy(*order).limit(max_vocab)
    return words.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def known_words(vocab: DataFrame, group_col: str | None = None) -> DataFrame:
    """The words of the vocabulary and both sentinels, one row for each (and group)."""
    keys = _keys(group_col)
    groups = vocab.select(*keys).distinct() if keys else vocab.sparkSession.range(1).select()
    ends = groups.select(*keys, F.explode(F.array(F.lit(BOS), F.lit(EOS))).alias("word"))
    return vocab.select(*keys, "word").unionByName(ends)


def filtered_bigrams(bigrams: DataFrame, vocab: DataFrame, group_col: str | None = None) -> DataFrame:
    """The bigrams of which both words are in the vocabulary or sentinels.

    The vocabulary has at most max_vocab words (a group), so Spark broadcasts it
    where that is below its threshold and shuffles where it is not.
    """
    keys, known = _keys(group_col), known_words(vocab, group_col)
    out = bigrams
    for side in ("prev", "curr"):
        out = out.join(known.withColumnRenamed("word", side), [*keys, side], "left_semi")
    return out.select(*keys, "prev", "curr", "cnt")


def filtered_unigrams(unigrams: DataFrame, vocab: DataFrame, group_col: str | None = None) -> DataFrame:
    """The unigrams of the vocabulary and the sentinels."""
    keys = _keys(group_col)
    return unigrams.join(known_words(vocab, group_col), [*keys, "word"], "left_semi").select(*keys, "word", "cnt")


def bigram_mass(bigrams: DataFrame, group_col: str | None = None) -> DataFrame:
    """(n double): the sum of the counts."""
    return bigrams.groupBy(*_keys(group_col)).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast(T.DoubleType()).alias("n"))


class Counts(NamedTuple):
    """The vocabulary, and the counts of its words and pairs with their mass."""

    vocab: DataFrame
    unigrams: DataFrame
    bigrams: DataFrame
    mass: DataFrame


def vocabulary_counts(sentences: DataFrame, min_freq: int = 3, max_vocab: int | None = 8000, group_col: str | None = None) -> Counts:
    """All that weights and clusters are made from, the corpus read once for words and once for pairs.

    What is used more than once is written to the shared folder and read again: at most
    max_vocab words, and the pairs among them (a group).
    """
    vocab = kept(vocabulary(unigram_counts(sentences, group_col), min_freq, max_vocab, group_col))
    bigrams = kept(filtered_bigrams(bigram_counts(sentences, group_col), vocab, group_col))
    unigrams = vocab.drop("rank").unionByName(sentinel_counts(sentences, group_col))
    return Counts(vocab, unigrams, bigrams, bigram_mass(bigrams, group_col))
