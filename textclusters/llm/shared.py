"""Small helpers that the corpus operators share."""

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a batch that are worked on at a time, and bytes of their texts, one long text aside.
PART_ROWS, PART_BYTES = 1000, 4 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def lower_ascii(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, _UPPER, _LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints that the cluster names in spark.checkpoint.dir.

    Where none is set, a temporary one is taken if all tasks run on this machine
    (tests, a laptop); a cluster must name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, by: str | None = None, buckets: int = 1) -> DataFrame:
    """The same rows, written as a Parquet table in the shared folder and read again; in buckets of a column, if
    one is named, so that joins and groups by it need no shuffle of the table."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    database = f"scratch_{zlib.crc32(folder.encode()):08x}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{folder}/tables'")
    name = f"{database}.t{uuid.uuid4().hex}"
    writer = df.write.format("parquet")
    (writer.bucketBy(buckets, by) if by else writer).saveAsTable(name)
    table = spark.table(name)
    _TABLES[table] = name
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what stored() wrote, once all that was made from it has been written."""
    for table in tables:
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(table)}")


def parts(batch: pa.RecordBatch, rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch by parts of bounded rows and bytes; a text that is longer is a part of its own."""
    n = batch.num_rows
    own = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False) if "text" in batch.schema.names else np.zeros(n, np.int64)
    upto, at = np.concatenate([[0], np.cumsum(own, dtype=np.int64)]), 0
    while at < n:
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, upto[at] + size, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply an Arrow batch function to the parts of every batch of df, without a shuffle.

    make() runs once in each task, so that tables built there are reused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield from map(work, parts(batch))

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of df, with all their columns, whose texts a batch function keeps; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in parts(batch):
                yield part.filter(pa.array(keep(texts_of(part)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def narrow(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of docs, its other columns left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ordered(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned numbers: what np.argsort gives, but by sorting numbers that carry their places, which is faster."""
    if not len(keys):
        return np.empty(0, np.int64)
    places = np.uint64(len(keys).bit_length())
    drop = np.uint64(max(0, int(keys.max()).bit_length() + int(places) - 64))
    both = (keys >> drop << places) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & ((np.uint64(1) << places) - np.uint64(1))).astype(np.int64)
    if drop:
        # Few numbers are alike but for the bits that were dropped.
        both >>= places
        got = keys[order]
        for top in np.unique(both[1:][(both[1:] == both[:-1]) & (got[1:] != got[:-1])]):
            at = slice(*(np.searchsorted(both, top, side) for side in ("left", "right")))
            order[at] = order[at][np.argsort(keys[order[at]], kind="stable")]
    return order
