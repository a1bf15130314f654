"""Removal of repeated strings of WIDTH bytes across the corpus.

The plan is that of distributed suffix sorting by a difference cover: a sample of
positions is named, positions that share a name are compared by longer prefixes,
the remaining positions are resolved from the sample, and of neighbours with a
common prefix of WIDTH bytes all but the earliest are removed. Two things differ
from the textbook, because suffixes to the number of bytes, several times over,
do not fit the disks (see the README):

* The cover is chosen by content. The sample of a string of WIDTH bytes is its
  least GRAM-gram by hash, the leftmost of equals, so that equal strings have
  their sample at the same place, whatever their positions' residues. Strings
  whose samples nobody shares are done with: that is most of the corpus.
* Names are hashes, not ranks. Neighbours with equal prefixes are wanted, not
  their order, so naming is an aggregation and needs no global sort.

Strings that follow each other and share their sample make a block. The stages:

1. name the samples; keep those that occur at two places or more;
2. name whole blocks; every later copy of a block is removed as one;
3. for blocks that differ although their samples agree, name the inner prefix
   that all strings of a small cell of the block have in common, keep the cells
   whose name is shared, and name each of their strings.

Each stage is an aggregation with partial sums and a join that Spark can split, so
a passage that a third of all documents share is a hot key of joins only.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textclusters.llm.shared import discard, narrow, parts, stored

#: Bytes of a string; bytes of a sample; the number of samples that a string has to choose from.
WIDTH, GRAM = 100, 32
CHOICE = WIDTH - GRAM + 1
#: Places of a cell: strings of a block that are first compared as one.
CELL = 9
#: Bytes that are worked on at a time.
_PIECE = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _ODD[4]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _grams(data: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of the size bytes, a power of two, from each place: names of two halves make that of the whole."""
    name = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD[seed])[data]
    base, k = int(_ODD[seed + 1]), 1
    while k < size:
        name = name[:-k] * np.uint64(pow(base, k, 1 << 64)) + name[k:]
        k *= 2
    return name


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of width."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in lists of about _PIECE bytes; long texts are cut so
    that every string of WIDTH bytes is in one piece."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - WIDTH + 1, 0), _PIECE):
            part = text[at : at + _PIECE + WIDTH - 1]
            held.append((i, at, part))
            size += len(part)
            if size >= _PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _joined(held: list[tuple[int, int, bytes]]):
    """The bytes in a row; for each of them, its piece; where pieces start; of each piece, text and offset."""
    data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
    sizes = np.array([len(x[2]) for x in held])
    start = np.cumsum(sizes) - sizes
    return data, np.repeat(np.arange(len(held)), sizes), start, np.array([x[0] for x in held]), np.array([x[1] for x in held])


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, sample's hash, block's hash, packed place) of all blocks.

    packed: the sample's place, then the first and the last string of the block
    relative to it, from -(CHOICE - 1) to 0, as two numbers of seven bits.
    """
    for held in _pieces(texts):
        data, piece, start, text, offset = _joined(held)
        hashed = _mix(_grams(data, GRAM, 0))
        key = (hashed & ~_LOW) | np.arange(len(hashed), dtype=np.uint64)
        sample = (_least(key, CHOICE) & _LOW).astype(np.int64)
        ok = piece[: len(sample)] == piece[WIDTH - 1 :]
        edge = np.r_[True, (sample[1:] != sample[:-1]) | (ok[1:] != ok[:-1]) | (piece[1 : len(sample)] != piece[: len(sample) - 1])]
        first = np.flatnonzero(edge)
        last = np.r_[first[1:], len(sample)] - 1
        first, last = first[ok[first]], last[ok[first]]
        at = sample[first]
        low, high = first - at, last - at
        half = _grams(data, 64, 2)
        name = half[first] * _ODD[0] + half[first + (WIDTH - 64 + last - first) // 2] * _ODD[1] + half[last + WIDTH - 64] * _ODD[2]
        name = _mix(name + low.view(np.uint64) * _ODD[3] + high.view(np.uint64))
        place = at - start[piece[first]] + offset[piece[first]]
        yield text[piece[first]], hashed[at].view(np.int64), name.view(np.int64), (place << 14) | (low + CHOICE - 1) << 7 | (high + CHOICE - 1)


def cells(text: bytes, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell's hash, first string, number of strings, hashes of all strings) of the blocks of one text.

    Cells are counted from the sample, so that equal strings are in like cells.
    The cell's hash is that of the bytes that all strings of a whole cell share.
    """
    place, low, high = packed >> 14, (packed >> 7) & 127, packed & 127
    count = high // CELL - low // CELL + 1
    block = np.repeat(np.arange(len(packed)), count)
    cell = low[block] // CELL + np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    base = place[block] - (CHOICE - 1)
    first, last = np.maximum(low[block], cell * CELL), np.minimum(high[block], cell * CELL + CELL - 1)
    inner_from, inner_to = base + np.minimum(cell * CELL + CELL - 1, CHOICE - 1), base + cell * CELL + WIDTH
    # Only the bytes around the blocks are hashed.
    start = max(0, int(base.min()))
    half = _grams(np.frombuffer(text, np.uint8)[start : int(place.max()) + WIDTH], 64, 2)
    name = _mix(half[inner_from - start] * _ODD[0] + half[inner_to - 64 - start] * _ODD[1] + cell.astype(np.uint64))
    size = last - first + 1
    string = np.repeat(base + first - start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    names = _mix(half[string] * _ODD[2] + half[string + WIDTH - 64] * _ODD[3])
    return name.view(np.int64), base + first, size, names.view(np.int64)


def without(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """The text less the spans, the number of bytes removed and that of maximal runs removed."""
    steps = np.zeros(len(text) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    gone = np.cumsum(steps[:-1]) > 0
    runs = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(np.count_nonzero(gone)), runs


_KEY = ["doc_id", "version"]


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [(x or "").encode("utf-8", "replace") for x in batch.column("text").to_pylist()]


def _all_blocks(docs: DataFrame, names_only: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in parts(batch):
                ids, versions = part.column("doc_id").to_numpy(), part.column("version").to_numpy()
                for text, sample, block, packed in blocks(_raw(part)):
                    if names_only:
                        yield pa.RecordBatch.from_arrays([pa.array(sample)], names=["sample"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sample, block, ids[text], versions[text], packed)], names=["sample", "block", *_KEY, "packed"])

    return docs.mapInArrow(run, "sample long" if names_only else "sample long, block long, doc_id long, version long, packed long")


def _cells_of(docs: DataFrame, contested: DataFrame) -> DataFrame:
    """(cell, doc_id, version, start, names) of the contested blocks of each document."""
    listed = contested.groupBy(*_KEY).agg(F.collect_list("packed").alias("blocks"))  # one document's

    def run(batches):
        for batch in batches:
            for part in parts(batch, 100):
                listed, keys = part.column("blocks"), [part.column(k).to_numpy() for k in _KEY]
                name, start, size, names = zip(*(cells(text, listed[i].values.to_numpy()) for i, text in enumerate(_raw(part))), strict=True)
                owner = np.repeat(np.arange(part.num_rows), list(map(len, name)))
                ends = np.cumsum(np.concatenate([[0], *size])).astype(np.int32)
                columns = [np.concatenate(name), *(k[owner] for k in keys), np.concatenate(start).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(names)))], names=["cell", *_KEY, "start", "names"])

    return docs.join(listed, _KEY).select(*_KEY, "text", "blocks").mapInArrow(run, "cell long, doc_id long, version long, start int, names array<long>")


def _later(rows: DataFrame, names: list[str], place: str) -> tuple[DataFrame, DataFrame]:
    """(firsts, later): of the rows that share names, the first by document and place, and all others.

    The firsts are finished before they are joined, so that Spark can split a very common name's rows.
    """
    order = F.struct(*_KEY, place)
    firsts = stored(rows.groupBy(*names).agg(F.min(order).alias("first"), F.count("*").alias("n")))
    later = rows.join(firsts.where("n > 1").drop("n"), names).where(order > F.col("first")).drop("first")
    return firsts, later


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, version, spans array<struct<start, end>>): the bytes to remove of docs(doc_id, version, text)."""
    # Counted on their own: joined to a finished table, a very common sample's rows are split.
    shared = stored(_all_blocks(docs, True).groupBy("sample").agg(F.count("*").alias("n")).where("n > 1").select("sample"))
    found = stored(_all_blocks(docs, False).join(shared, "sample", "left_semi"))
    discard(shared)
    firsts, later = _later(found, ["sample", "block"], "packed")
    low, high = F.shiftright("packed", 7).bitwiseAND(F.lit(127)), F.col("packed").bitwiseAND(F.lit(127))
    base = F.shiftright("packed", 14) - (CHOICE - 1)
    copied = stored(later.select(*_KEY, (base + low).alias("start"), (base + high + WIDTH).alias("end")))
    discard(found)
    several = firsts.groupBy("sample").agg(F.count("*").alias("n")).where("n > 1").select("sample")
    contested = firsts.join(several, "sample", "left_semi").select("first.*")
    each = stored(_cells_of(docs, contested))
    discard(firsts)
    alike = each.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    strings = each.join(alike, "cell", "left_semi").select("cell", *_KEY, "start", F.posexplode("names").alias("k", "name")).select("cell", "name", *_KEY, (F.col("start") + F.col("k")).alias("at"))
    strings = stored(strings)
    discard(each)
    # Neighbouring strings of one document that are all later copies are one span.
    firsts, single = _later(strings, ["cell", "name"], "at")
    single = single.select(*_KEY, F.col("at").cast("long").alias("start"), (F.col("at") + WIDTH).cast("long").alias("end"))
    spans = stored(copied.unionByName(single).groupBy(*_KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans")))  # one document's
    discard(copied, strings, firsts)
    return spans


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of docs(doc_id, text).

    Every byte goes that lies in a string of WIDTH bytes of its text which starts
    earlier too: in a document of smaller doc_id, or before in the same one.
    Strings do not cross documents and are judged on the input. A null text is
    empty. A row without doc_id has no place in the order: it stays whole and is
    no one's earlier copy. Rows that repeat a doc_id count as one document for
    each different text, ordered by a hash of the text, and rows that repeat both
    are treated alike. Other columns are ignored.
    """
    docs = narrow(docs).fillna("", "text")
    named = docs.where("doc_id IS NOT NULL")
    repeats = not named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    # The hash is carried only where it is needed to tell documents apart.
    docs = docs.withColumn("version", F.xxhash64("text") if repeats else F.lit(0).cast("long"))
    named = docs.where("doc_id IS NOT NULL")
    listed = repeated_spans(named.dropDuplicates(_KEY) if repeats else named)

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            out = []
            for text, spans in zip(_raw(batch), batch.column("spans"), strict=True):
                flat = spans.values.flatten() if spans.is_valid else None
                starts, ends = (x.to_numpy() for x in flat) if flat else (np.empty(0, np.int64),) * 2
                out.append((len(text), *without(text, starts, ends)))
            n, kept, gone, runs = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = docs.join(listed, _KEY, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
