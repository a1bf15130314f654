"""Readers and writers of annotated corpora, opinion rows, paths and clusters."""

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Which files below a corpus folder are sentences.
SENTENCE_FILES = "KN*-[0-9]*"
#: Bytes of small files for a task, and rows of an output file, about.
TASK_BYTES, ROWS_PER_FILE = 64 << 20, 1_000_000
OPINION_SCHEMA = "sid string, sent string, holder string, expr string, type string, target string"


def read_corpus(spark: SparkSession, path: str, files: str = SENTENCE_FILES, folder_names: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(sid, value): one row for each sentence file; the id is the file's name, or, with
    folder_names, what follows sid= in the name of its folder.

    Many small files are read by few tasks: Spark counts each file as some megabytes when
    it packs them, so the sizes are listed first, without the contents, and tasks are
    joined until each has about task_bytes.
    """
    listed = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=files).load(path)
    size = listed.agg(F.sum("length")).first()[0] or 0
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=files)
    parts = F.split("_metadata.file_path", "/")
    sid = F.url_decode(F.regexp_replace(F.element_at(parts, -2), "^sid=", "")) if folder_names else F.element_at(parts, -1)
    return raw.select(sid.alias("sid"), "value").coalesce(max(1, -(-size // task_bytes)))


def write_corpus(raw: DataFrame, path: str) -> None:
    """raw(sid, value) as one compressed text file a row, each in a folder sid=<id>; read_corpus(folder_names=True) reads them."""
    raw.select("sid", F.regexp_replace("value", r"\n\z", "").alias("value")).write.mode("overwrite").partitionBy("sid").text(path, compression="gzip")


def read_opinions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Opinion rows of tab-separated files, with file and line for their order.

    Files of any size are read in splits. The lines of a split are numbered as they are
    read; the numbers of all splits are small, and running sums over a file's splits tell
    where each starts.
    """
    raw = spark.read.text(paths, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\r\z", "").alias("row"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    splits = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    placed = raw.join(splits, ["file", "split"]).select("file", (F.col("ahead") + F.col("id") - F.col("first")).alias("line"), "row")
    part = F.split("row", "\t")
    names = [x.split()[0] for x in OPINION_SCHEMA.split(", ")]
    return placed.where("row <> ''").select("file", "line", *(F.get(part, F.lit(i)).alias(name) for i, name in enumerate(names)))


def read_gold_paths(spark: SparkSession, path: str) -> DataFrame:
    """(sid, reading, words) of Parquet rows (sid, reading, nodes array<struct<surface>>)."""
    return spark.read.parquet(path).select("sid", "reading", F.transform("nodes", lambda n: n["surface"]).alias("words"))


def write_clusters(clusters: DataFrame, path: str) -> None:
    clusters.write.mode("overwrite").parquet(path)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_opinions(opinions: DataFrame, path: str) -> None:
    opinions.write.mode("overwrite").parquet(path)


def read_stored_opinions(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Located opinions, or None where no store is named or none is there: no sentence has any then."""
    if not path:
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_opinion_rows(rows: DataFrame, path: str) -> None:
    """Opinion rows as tab-separated text files, as read_opinions() reads them; no field may hold a tab or a line end."""
    names = [x.split()[0] for x in OPINION_SCHEMA.split(", ")]
    rows.select(F.array_join(F.array(*names), "\t", "").alias("value")).write.mode("overwrite").text(path)


def write_gold_paths(paths: DataFrame, path: str) -> None:
    """(sid, reading, words) as Parquet rows (sid, reading, nodes array<struct<surface>>)."""
    paths.select("sid", "reading", F.transform("words", lambda w: F.struct(w.alias("surface"))).alias("nodes")).write.mode("overwrite").parquet(path)


class OpinionStore:
    """Located opinions in a table that is bucketed by sentence, so that joins and windows by
    sentence do not shuffle it.

    put() replaces whole sentences: it adds a generation, with a row without idx for every
    sentence that is annotated anew, and of each sentence the last generation counts. No
    bucket is written again until compact().
    """

    SCHEMA = "sid string, idx int, holder string, expr string, start int, end int, type string, target string, generation int"

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64) -> None:
        self.spark, self.name, self.buckets = spark, name, buckets

    def _append(self, rows: DataFrame) -> None:
        # As many tasks as buckets, by the same hash: one file a bucket.
        rows.repartition(self.buckets, "sid").write.mode("append").bucketBy(self.buckets, "sid").sortBy("sid").saveAsTable(self.name)

    def put(self, opinions: DataFrame, sids: DataFrame | None = None) -> None:
        """The opinions of the sentences sids(sid), of those in opinions by default, in place of any before."""
        last = self.spark.table(self.name).agg(F.max("generation")).first()[0] if self.spark.catalog.tableExists(self.name) else None
        marks = (opinions if sids is None else sids).select("sid").distinct()
        empty = self.spark.createDataFrame([], self.SCHEMA)
        rows = opinions.unionByName(marks, allowMissingColumns=True).withColumn("generation", F.lit(0 if last is None else last + 1))
        self._append(empty.unionByName(rows))

    def read(self) -> DataFrame:
        """Every sentence's opinions of its last generation."""
        newest = F.max("generation").over(Window.partitionBy("sid"))
        rows = self.spark.table(self.name).withColumn("newest", newest).where("generation = newest AND idx IS NOT NULL")
        return rows.drop("generation", "newest")

    def compact(self) -> "OpinionStore":
        """A new store of the same opinions in one generation; this one stays for who reads it."""
        fresh = OpinionStore(self.spark, f"{self.name}_{uuid.uuid4().hex[:8]}", self.buckets)
        fresh.put(self.read())
        return fresh

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def write_by_article(sentences: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """sentences(article, sent_no, sid, ...) in files of about rows_per_file rows, ranges of
    articles, with a manifest(article, file, rows) for lookups.

    An article is in one file; only one of more than four times the rows is cut into several.
    The sentences are stored first, as they are counted, sampled and written.
    """
    sentences = kept(sentences)
    files = max(1, -(-sentences.count() // rows_per_file))
    ranged = sentences.repartitionByRange(files, "article").sortWithinPartitions("article", "sent_no", "sid")
    ranged.write.mode("overwrite").option("maxRecordsPerFile", 4 * rows_per_file).parquet(path)
    held = sentences.sparkSession.read.parquet(path).groupBy("article", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    # A name with an underscore is not read as rows.
    held.repartitionByRange("article").sortWithinPartitions("article").write.mode("overwrite").parquet(f"{path}/_manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_manifest")


def read_article(spark: SparkSession, path: str, article: str) -> DataFrame:
    """The sentences of one article; no other files than its own are opened."""
    files = [f"{path}/{r.file}" for r in read_manifest(spark, path).where(F.col("article") == article).select("file").collect()]
    return spark.read.parquet(*files or [path]).where(F.col("article") == article)


def write_by_category(df: DataFrame, path: str) -> None:
    """One folder a category; rows of an article lie together in its files."""
    df.repartition("category", "article").sortWithinPartitions("article").write.mode("overwrite").partitionBy("category").parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path below the folder that spark.checkpoint.dir names; where none is set, a
    temporary one is taken if all tasks run on this machine, and a cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet below the shared folder and read again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
