"""Dependency edges of chunks and the grid in which they are drawn."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textclusters.functions import linebatches, packed

#: The classes of cells and the symbols of the grid.
CLASSES = ("joins", "first", "crosses", "passes", "through", "blank")
JOINS, FIRST, CROSSES, PASSES, THROUGH, BLANK = "┫", "┓", "╋", "━", "┃", "　"
#: Cells that are drawn at a time, those of one chunk aside.
_CELLS = 1 << 19


def edges(chunks: DataFrame) -> DataFrame:
    """(sid, child, parent, dep_type); the root's parent is -1."""
    return chunks.select("sid", F.col("chunk_id").alias("child"), "parent", "dep_type")


def _children_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sentence, parent = packed.flat(batch.column("parent"))
    parent, child = parent.to_numpy(zero_copy_only=False), packed.flat(batch.column("child"))[1].to_numpy(zero_copy_only=False)
    order = np.lexsort((child, parent, sentence))
    sentence, parent, child = sentence[order], parent[order], child[order]
    new = np.ones(len(order), bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (parent[1:] != parent[:-1])
    starts = np.flatnonzero(new)
    columns = [batch.column("sid").take(pa.array(sentence[starts])), pa.array(parent[starts]), packed.listed(pa.array(child), starts), pa.array(child[starts])]
    yield pa.RecordBatch.from_arrays(columns, names=["sid", "parent", "children", "min_child"])


def children(chunks: DataFrame) -> DataFrame:
    """(sid, parent, children array<int>, min_child) of each chunk that has children."""
    rows = edges(chunks).where("parent >= 0 AND child IS NOT NULL").select("sid", "parent", "child")
    return packed.by_key(rows, "sid", _children_of, "sid string, parent int, children array<int>, min_child int")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(sid, n_chunks) of each sentence that has chunks."""
    return chunks.groupBy("sid").agg((F.max("chunk_id") + 1).alias("n_chunks"))


def _numbered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, present, parent, first, which) of sentences(chunk_id, parent) laid end to end by number: whether a
    number has a line, that line's parent, -1 for none, the number's first child, -1 for none, and the place of the
    line's row. Numbers that no row has, those of lines that could not be parsed, are filled in."""
    sentence, number = packed.flat(batch.column("chunk_id"))
    number = number.to_numpy(zero_copy_only=False).astype(np.int64)
    parent = batch.column("parent").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.zeros(batch.num_rows, np.int64)
    np.maximum.at(lengths, sentence, number + 1)
    base = (np.cumsum(lengths) - lengths)[sentence]
    place = base + number
    present, told = np.zeros(lengths.sum(), bool), np.full(lengths.sum(), -1, np.int64)
    # Of rows that repeat a number the one of the greatest parent counts.
    order = np.argsort(parent, kind="stable")
    which = np.zeros(len(told), np.int64)
    present[place[order]], told[place[order]], which[place[order]] = True, parent[order], order
    met = (parent >= 0) & (parent < lengths[sentence])
    first = np.full(len(told), len(told) + len(number), np.int64)
    np.minimum.at(first, (base + parent)[met], number[met])
    return lengths, present, told, np.where(first < len(told) + len(number), first, -1), which


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sid, i, cells, j, class, row of the chunk's type) of the drawn rows of sentences, _CELLS or so at a time: of rows the
    sentence, the chunk and how many cells it has, of the cells the later chunk and the number of the class."""
    lengths, present, parent, first, which = _numbered(batch)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    number, owner, n = np.arange(len(parent)) - start, np.repeat(np.arange(len(lengths)), lengths), np.repeat(lengths, lengths)
    drawn = np.flatnonzero(present & (number < n - 1))
    upto = np.cumsum((n - 1 - number)[drawn])
    at = 0
    while at < len(drawn):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _CELLS, "right")))
        mine = drawn[at:end]
        cells = (n - 1 - number)[mine]
        row = np.repeat(mine, cells)
        j = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells) + number[row] + 1
        child = first[start[row] + j]
        here, later, earlier = parent[row] == j, parent[row] > j, (child >= 0) & (child < number[row])
        kind = np.where(here, np.where(earlier, 0, 1), np.where(later, np.where(earlier, 2, 3), np.where(earlier, 4, 5)))
        yield batch.column("sid").take(pa.array(owner[mine])), number[mine], cells, j, kind, which[mine]
        at = end


def _symbols(types: pa.Array, row: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of the symbol of each cell: the letter of the row's type where its line ends, marks else."""
    marks = pa.array([JOINS, FIRST, CROSSES, PASSES, THROUGH, BLANK])
    distinct = types.dictionary_encode()
    letters, number = pc.fill_null(distinct.dictionary.cast(pa.string()), ""), pc.fill_null(distinct.indices, len(distinct.dictionary)).to_numpy(zero_copy_only=False)
    data, offsets = linebatches.bytes_of(pa.concat_arrays([marks, letters, pa.array([""])]))
    plain = pc.fill_null(pc.equal(types, "D"), False).to_numpy(zero_copy_only=False)
    symbol = np.where((kind < 2) & ~plain[row], len(marks) + number[row], kind)
    return data, offsets[symbol], offsets[symbol + 1]


def _draw(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    types = batch.column("dep_type").flatten()
    for sid, i, cells, _, kind, which in _rows_of(batch):
        data, start, end = _symbols(types.take(pa.array(which)), np.repeat(np.arange(len(i)), cells), kind)
        drawn, offsets = linebatches.bytes_of(linebatches.strings(data, start, end))
        ends = np.append(0, np.cumsum(cells))
        texts = pa.StringArray.from_buffers(len(i), pa.py_buffer(offsets[ends].astype(np.int32)), pa.py_buffer(drawn))
        yield pa.RecordBatch.from_arrays([sid, pa.array(i.astype(np.int32)), texts], names=["sid", "i", "drawing"])


def _cells(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    types = batch.column("dep_type").flatten()
    for sid, i, cells, j, kind, which in _rows_of(batch):
        row = np.repeat(np.arange(len(i)), cells)
        mine = types.take(pa.array(which))
        data, start, end = _symbols(mine, row, kind)
        unknown = mine.is_null().to_numpy(zero_copy_only=False)[row] & (kind < 2)
        columns = [sid.take(pa.array(row)), pa.array(i[row].astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(CLASSES).take(pa.array(kind)), linebatches.strings(data, start, end, unknown)]
        yield pa.RecordBatch.from_arrays(columns, names=["sid", "i", "j", "class", "cell"])


def _told(chunks: DataFrame, *columns: str) -> DataFrame:
    return chunks.where("chunk_id >= 0").select("sid", "chunk_id", F.coalesce("parent", F.lit(-1)).alias("parent"), *columns)


def dependency_grid(chunks: DataFrame) -> DataFrame:
    """(sid, i, j, class, cell) for each chunk i and each later chunk j of its sentence.

    A chunk whose parent is beyond the last chunk, or unknown, never joins; the
    line of an unknown parent or of the root does not pass either. A row of the grid is made
    at a time, so that what is held grows with a sentence and not with its square.
    """
    return packed.by_key(_told(chunks, "dep_type"), "sid", _cells, "sid string, i int, j int, class string, cell string")


def grid_rows(chunks: DataFrame) -> DataFrame:
    """(sid, i, drawing): the cells of a chunk joined in order."""
    return packed.by_key(_told(chunks, "dep_type"), "sid", _draw, "sid string, i int, drawing string")


def _passed(points: np.ndarray, low: np.ndarray, high: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each query how many of points[low:high] are less than below.

    Places are sorted by their value, bit by bit from the highest: at each bit those
    without it go ahead of those with it, both in their order, and running counts tell where
    the ends of each query's stretch go. One pass over points and queries for each bit.
    """
    low, high, found = low.copy(), high.copy(), np.zeros(len(low), np.int64)
    high = np.maximum(high, low)
    for bit in range(int(max(points.max(initial=0), below.max(initial=0))).bit_length() - 1, -1, -1):
        zero = points >> bit & 1 == 0
        before = np.r_[0, np.cumsum(zero)]
        zeros, wanted = before[-1], below >> bit & 1 == 1
        lo, hi = before[low], before[high]
        # Points without the bit are less where the limit has it; else only they can be.
        found += np.where(wanted, hi - lo, 0)
        low, high = np.where(wanted, zeros + low - lo, lo), np.where(wanted, zeros + high - hi, hi)
        points = np.concatenate([points[zero], points[~zero]])
    return found


def _class_counts(lengths: np.ndarray, present: np.ndarray, parent: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sentences, classes) cells of sentences laid end to end, their chunks with parent and first
    child, -1 for none; chunks that are not present draw no row."""
    ends = np.cumsum(lengths)
    start = np.repeat(ends - lengths, lengths)
    place, end = np.arange(len(parent)), np.repeat(ends, lengths)
    # A chunk without children is never passed: its first child is taken to lie behind all.
    child = np.where(first >= 0, start + first, len(parent))
    mine = place[present]
    at, stop = start[mine] + parent[mine], end[mine]
    met = (parent[mine] > mine - start[mine]) & (at < stop)
    # Where the line ends: at the parent, behind the sentence for a parent beyond it, at once for an earlier one or none.
    upto = np.where(parent[mine] > mine - start[mine], np.minimum(at, stop), mine + 1)
    rest = np.where(met, at + 1, upto)
    early = lambda lo, hi: _passed(child, lo, hi, mine)
    joins = met & (child[np.minimum(at, len(parent) - 1)] < mine)
    crosses, through = early(mine + 1, upto), early(rest, stop)
    each = {"joins": joins, "first": met & ~joins, "crosses": crosses, "passes": upto - mine - 1 - crosses, "through": through, "blank": stop - rest - through}
    owner = np.repeat(np.arange(len(lengths)), lengths)[mine]
    return np.stack([np.bincount(owner, each[name], len(lengths)) for name in CLASSES], axis=1).astype(np.int64)


def _count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lengths, present, parent, first, _ = _numbered(batch)
    found = _class_counts(lengths, present, parent, first)
    row, kind = np.nonzero(found)
    yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(row)), pa.array(CLASSES).take(pa.array(kind)), pa.array(found[row, kind])], names=["sid", "class", "n_cells"])


def grid_classes(chunks: DataFrame) -> DataFrame:
    """(sid, class, n_cells) of each sentence, counted without drawing.

    Whether a line joins its parent is a look-up; how many of the chunks before the parent,
    and behind it, have a child before the line's own chunk is a count of points below a
    limit in a stretch. A sentence of n chunks takes n log n steps and n numbers.
    """
    return packed.by_key(_told(chunks), "sid", _count, "sid string, class string, n_cells long")
