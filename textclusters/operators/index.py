"""Articles by category, their headings, and the order of their sentences."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textclusters.functions import annotation as A


def articles(sentences: DataFrame, categories=A.CATEGORIES) -> DataFrame:
    """(article, category) of each article; an unknown category is null."""
    return sentences.select("article").distinct().withColumn("category", A.category_of(F.col("article"), categories))


def article_headings(sentences: DataFrame, texts: DataFrame, categories=A.CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """(headings, rejects): headings(article, category, heading) with the text, from
    texts(sid, text), of each article's first sentence; rejects(article, reason) for
    articles without one or without a category."""
    named = articles(sentences, categories).withColumn("sid", F.concat("article", F.lit("-1-1-01")))
    joined = named.join(texts.select("sid", F.col("text").alias("heading")), "sid", "left")
    reason = F.when(F.col("category").isNull(), "category").when(F.col("heading").isNull(), "heading")
    joined = joined.withColumn("reason", reason)
    return joined.where("reason IS NULL").select("article", "category", "heading"), joined.where("reason IS NOT NULL").select("article", "reason")


def sentence_order(sentences: DataFrame) -> DataFrame:
    """(article, sid, sent_no, place): an article's sentences by number, then name."""
    place = F.row_number().over(Window.partitionBy("article").orderBy("sent_no", "sid"))
    return sentences.select("article", "sid", "sent_no", place.alias("place"))


def category_index(headings: DataFrame) -> DataFrame:
    """headings sorted by category and article: a sort by ranges, no group in one task."""
    return headings.select("category", "article", "heading").orderBy("category", "article")


def category_sizes(headings: DataFrame) -> DataFrame:
    """(category, n_articles)."""
    return headings.groupBy("category").agg(F.count("*").alias("n_articles"))
