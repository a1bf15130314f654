"""Periodic runs of words, found in tiles by period octave and stitched by document and period.

A run is a stretch of words with smallest period q that no neighbour extends. Let E_q
be the places whose word is that q further on: a run of at least four periods is a
stretch of E_q of three periods or more. Octave k has the periods from s = 2^k to 2s - 1
and a boundary at every s-th word, so such a stretch holds the 2s words from some
boundary on. There the Z-function at q, the length to which the text from the boundary
equals the text q words on, reaches 2s: names of all windows of 2s words, doubled from
octave to octave, tell for which boundaries and periods it does, and comparing words
gives its value forwards and backwards. Of two such periods at one boundary neither is
the smallest (Fine and Wilf), so one period a boundary is followed at most, and all
octaves together cost n log n.

A tile is what the boundaries of one octave, or of all the short ones, need in a
stretch of the document. A document of one tile is solved where it is read. Longer ones
are exploded into overlapping tiles, which are dealt out and solved on their own; their
fragments meet by document and period, and those that touch are one stretch of E_q.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textclusters.llm.shared import map_batches, stored, texts_of

#: Periods that a run must hold, and words.
PERIODS, LEAST = 4, 6
#: Characters of a text that is one tile; the longest octave whose tiles serve all shorter ones, and their boundaries' words.
ONE_TILE, SHORT_OCTAVE, CORE = 32_768, 8, 4096
RUN = "array<struct<start:long,length:long,period:long>>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _prime_factors(n: int) -> set[int]:
    found, r = set(), 2
    while r * r <= n:
        while n % r == 0:
            found.add(r)
            n //= r
        r += 1
    return found | ({n} if n > 1 else set())


def _is_power(root: np.ndarray) -> bool:
    """Whether the words repeat a shorter root."""
    n = len(root)
    return any(np.array_equal(root[n // r :], root[: n - n // r]) for r in _prime_factors(n))


def fragments(ids: np.ndarray, low: int, high: int, first: int, last: int) -> list[tuple[int, int, int]]:
    """(lo, hi, q): stretches of E_q, with q their smallest period, as far as ids goes.

    Octaves low to high, boundaries from first on and before last. Every stretch of at
    least 3q places is met by a fragment at each boundary that has 2^(k+1) of them ahead.
    """
    n, found = len(ids), []
    names = _mixed(ids.astype(np.uint64) + np.uint64(1))
    for k in range(high + 1):
        s = 1 << k
        if len(names) <= s:
            break
        # names[i]: of the 2s words from i on.
        names = _mixed(names[:-s] * _ODD + _mixed(names[s:]))
        count = -(-(min(last, len(names) - s) - first) // s)
        if k < low or count <= 0:
            continue
        later = names[first + s : first + s + count * s]
        later = np.append(later, np.zeros(count * s - len(later), np.uint64)).reshape(count, s)
        same = later == names[first : first + count * s : s, None]
        single = np.flatnonzero(np.count_nonzero(same, axis=1) == 1)
        if not len(single):
            continue
        at, period = first + single * s, s + same[single].argmax(1)
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        starts = np.flatnonzero(np.r_[True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + s)])
        for i, j in zip(starts, np.r_[starts[1:], len(at)], strict=True):
            q = int(period[i])
            x, y = max(int(at[i]) - s, 0), min(int(at[j - 1]) + 3 * s, n - q)
            unlike = np.flatnonzero(ids[x:y] != ids[x + q : y + q])
            los, his = np.r_[0, unlike + 1], np.r_[unlike, y - x]
            for lo, hi in zip(los, his, strict=True):
                if hi - lo >= 2 * s and not _is_power(ids[x + lo : x + lo + q]):
                    found.append((x + int(lo), x + int(hi), q))
    return found


def _as_runs(stretches: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of stretches of E_q that are runs, by start and period."""
    runs = ((lo, hi - lo + q, q) for lo, hi, q in stretches if hi - lo + q >= max(LEAST, PERIODS * q))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, but of each run only the first period, joined by a blank."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    inside = np.cumsum(steps)
    return b" ".join(w for w, x in zip(words, inside, strict=False) if not x)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _octave(n: int) -> int:
    """The last octave of which a run fits into n words; -1 for none."""
    return (n // PERIODS).bit_length() - 1


def _listed(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    return pa.array([[dict(zip(("start", "length", "period"), run, strict=True)) for run in own] for own in runs], kind)


def _output(batch: pa.RecordBatch, words: list[list[bytes]], runs: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    texts = pa.array([collapsed(w, r).decode("utf-8", "surrogatepass") for w, r in zip(words, runs, strict=True)], pa.string())
    columns = [batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), _listed(runs), texts]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def _solve_whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The runs of whole documents, laid end to end with a word of its own after each."""
    words = [_words(x) for x in texts_of(batch)]
    known: dict[bytes, int] = {}
    ends = np.cumsum([0, *(len(w) + 1 for w in words)])
    ids = np.empty(ends[-1], np.int64)
    for i, own in enumerate(words):
        ids[ends[i] : ends[i + 1] - 1] = [known.setdefault(w, len(known)) for w in own]
    ids[ends[1:] - 1] = -2 - np.arange(len(words))
    runs: list[set[tuple[int, int, int]]] = [set() for _ in words]
    for lo, hi, q in fragments(ids, 0, _octave(max(map(len, words))), 0, len(ids)):
        owner = int(np.searchsorted(ends, lo, "right")) - 1
        runs[owner].add((lo - int(ends[owner]), hi - int(ends[owner]), q))
    return _output(batch, words, [_as_runs(own) for own in runs])


def _tiles(n: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(low, high, start, first, core, end) of the tiles of n words.

    Tiles of octave k have boundaries in 16 * 2^k words (CORE, for all up to SHORT_OCTAVE),
    2^k words before the first and 5 * 2^k after the last.
    """
    for k in range(SHORT_OCTAVE, max(SHORT_OCTAVE, _octave(n)) + 1):
        core, s = CORE if k == SHORT_OCTAVE else 16 << k, 1 << k
        for begin in range(0, n, core):
            start = max(begin - s, 0)
            yield 0 if k == SHORT_OCTAVE else k, k, start, begin - start, core, min(begin + core + 5 * s, n)


_TILE = pa.schema([("key", pa.string()), *((name, pa.int64()) for name in ("deal", "low", "high", "start", "first", "core")), ("text", pa.string())])


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, doc_id, text in zip(*(batch.column(name).to_pylist() for name in ("key", "doc_id", "text")), strict=True):
            words = _words(text)
            for low, high, start, first, core, end in _tiles(len(words)):
                own = b" ".join(words[start:end]).decode("utf-8", "surrogatepass")
                # By doc_id too, as copies of one text would meet in one task.
                deal = xxhash.xxh64_intdigest(f"{key} {doc_id} {high} {start}") >> 1
                yield pa.RecordBatch.from_pylist([{"key": key, "deal": deal, "low": low, "high": high, "start": start, "first": first, "core": core, "text": own}], _TILE)


def tiles(long: DataFrame) -> DataFrame:
    """(key, deal, low, high, start, first, core, text) of long(key, doc_id, text): a row for each tile."""
    return long.select("key", "doc_id", "text").mapInArrow(_explode, "key string, deal long, low long, high long, start long, first long, core long, text string")


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            known: dict[bytes, int] = {}
            ids = np.array([known.setdefault(w, len(known)) for w in _words(row["text"])], np.int64)
            for lo, hi, q in fragments(ids, row["low"], row["high"], row["first"], row["first"] + row["core"]):
                rows.append((row["key"], q, lo + row["start"], hi + row["start"]))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["key", "q", "lo", "hi"])


def stitched(pieces: DataFrame) -> DataFrame:
    """(key, runs) of fragments(key, q, lo, hi): those of one document and period that
    overlap or touch are one; of each document the runs, by start and period."""
    own = Window.partitionBy("key", "q").orderBy("lo", "hi")
    before = F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1))
    # Copies of a document make the same fragments; of one document and period there are as many as it has boundaries, at most.
    marked = pieces.distinct().withColumn("fresh", F.coalesce(F.col("lo") > before, F.lit(True)).cast("int"))
    islands = marked.withColumn("island", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "q", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    length = F.col("hi") - F.col("lo") + F.col("q")
    runs = islands.select("key", F.struct(F.col("lo").alias("start"), F.col("q").alias("period"), length.alias("length")).alias("run")).where((F.col("run.length") >= LEAST) & (F.col("run.length") >= PERIODS * F.col("run.period")))
    # The runs of one document.
    return runs.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("run")), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs(doc_id, text).

    runs: array of (start, length, period), word numbers from 0, by start and period: all
    maximal stretches with that smallest period, of at least PERIODS periods and LEAST
    words. collapsed: the words, of each run only those of its first period, joined by a
    blank. A null text has no words, no runs and an empty text. Rows that repeat a doc_id
    or lack one each get a row; other columns are ignored; no rows give none. Texts of
    up to ONE_TILE characters are not shuffled; the runs are the same in either way.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = f"doc_id long, n_words long, runs {RUN}, collapsed string"
    short = map_batches(docs.where(F.length("text") <= ONE_TILE), lambda: _solve_whole, schema)
    long = docs.where(F.length("text") > ONE_TILE).withColumn("key", F.sha2("text", 256))
    dealt = tiles(long).repartition("deal")
    runs = stored(stitched(dealt.mapInArrow(_solve_tiles, "key string, q long, lo long, hi long")))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [[(r["start"], r["length"], r["period"]) for r in x or ()] for x in batch.column("runs").to_pylist()]
            return _output(batch, [_words(x) for x in texts_of(batch)], own)

        return work

    return short.unionByName(map_batches(long.join(runs, "key", "left").select("doc_id", "text", "runs"), make, schema))
