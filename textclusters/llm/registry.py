"""The registered queries of this subpackage; each runs over whole tables.

Each query applies its operator with production parameters and derives the
columns of its contract from what the operator returns.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textclusters.llm import bpe, chosenpath, decontaminate, licenses, linededup, lmscore, periods, pii, quality, search, simhash, substrings, urlfilter
from textclusters.llm.oracles import ORACLES
from textclusters.llm.shared import SPACE, documents

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that a document holds, within the error budget."""
    return decontaminate.contaminated(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: counts, hash of the base spans, all spans."""
    return pii.digest(pii.personal_data(documents(spark, sf_dir)))


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page.

    A page shows the document whose number ends its path; that one's labels are
    the page's: bad if of low quality or toxic.
    """
    pages = _table(spark, sf_dir, "pages")
    labels = _table(spark, sf_dir, "labels")
    number = F.regexp_extract(urlfilter.path_of(F.col("url")), r"([0-9]+)[^0-9]*$", 1).try_cast("long")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    of_page = pages.select("page_id", number.alias("doc_id")).join(labels, "doc_id").select("page_id", bad.alias("bad"))
    return urlfilter.judge(pages, of_page)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the removal of repeated strings of 100 bytes takes from every document."""
    return substrings.dedup_substrings(documents(spark, sf_dir)).drop("kept")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices and passages that every document holds."""
    return licenses.matches(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict for every document."""
    return quality.quality(documents(spark, sf_dir))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication takes from every document, and a hash of what it leaves."""
    done = linededup.dedup_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of the decoded bytes."""
    return bpe.digest_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probabilities of every document."""
    return lmscore.score(documents(spark, sf_dir), by_bits=True)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every item of the benchmark."""
    return search.search(search.build_index(documents(spark, sf_dir)), _table(spark, sf_dir, "benchmark"))


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in which one of ten, by the checksum of its doc_id, goes on periodically from some word."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")
    n = F.size("w").cast("long")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).otherwise(F.array().cast("array<string>")).alias("w"), g.alias("g"))
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    repeated = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), a), F.slice(repeated, F.lit(1), (n - a).cast("int"))), " ")
    return rows.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, its longest one, and hashes of all of them and of what is left without their repeats."""
    found = periods.periodic_runs(_with_planted_periods(documents(spark, sf_dir)))
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = found.withColumn("top", first).withColumn("length", F.col("top.length")).withColumn("period", -F.col("top.period"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        "length",
        "period",
        F.floor(1000 * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by the similarity of its two-word shingles."""
    return chosenpath.similar_sets(documents(spark, sf_dir))


__all__ = ["ORACLES", "QUERIES"]
QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_pii, op3_urlfilter, op4_simhash, op5_substrings, op6_licenses, op7_quality, op8_linededup, op9_bpe, op10_lmscore, op11_search, op12_periods, op13_minhash)}
