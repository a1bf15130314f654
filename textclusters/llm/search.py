"""Ranked lexical search over an inverted index in shards, by Block-Max MaxScore.

The index is a table. A shard holds the documents that one task has read next to each
other, SHARD_BYTES of text at most; nothing is shuffled to make it. In a shard a term has
one row: its documents by number and how often each holds it, in blocks of BLOCK
postings that are packed one by one, with the last document, the greatest frequency and
the shortest document of each block. From these an upper bound of a block's scores
follows under any statistics, so the index does not depend on those of the corpus.

A search reads the rows of the terms that are asked for. In every shard the lists of a
query are put in order of their upper bounds: as many of the lesser lists as cannot lift a
document above the worst of the best k so far are not essential. Candidates come from
essential lists only. For the others, first the sum of what is open rejects candidates,
then the maximum of the block that a candidate would be in; only blocks of candidates
that are left are unpacked. The shards' best k meet by query.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textclusters.llm.shared import lower_ascii, narrow, parts, stored

#: Bytes of text in a shard, one longer document aside; postings in a block; bytes of queries that are searched for at a time.
SHARD_BYTES, BLOCK, QUERY_BYTES = 10 << 20, 128, 4 << 20
#: Documents of a shard that are ranked at first; each later stretch is twice as long.
_STRETCH = 1024
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What parts terms becomes a blank, A-Z become a-z.
_SEEN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_LISTS = ("last", "most", "shortest", "ends")
SCHEMA = "shard long, term string, n_docs long, last array<int>, most array<long>, shortest array<long>, ends array<long>, data binary, doc_ids array<long>, lengths array<long>"
_FIELDS = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n_docs", pa.int64()), ("last", pa.list_(pa.int32())), *((name, pa.list_(pa.int64())) for name in ("most", "shortest", "ends")), ("data", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
K1, LENGTH_SHARE, UNIT = 12, 25, 1_000_000_000


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where the bytes of each value end): seven bits a byte, the last below 128."""
    size = np.ones(len(values), np.uint8)
    for bits in range(7, 63, 7):
        size += values >= 1 << bits
    ends = np.cumsum(size, dtype=np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for place in range(int(size.max(initial=0))):
        has = size > place
        more = np.where(size[has] > place + 1, 128, 0)
        out[(ends - size)[has] + place] = (values[has] >> 7 * place & 127) | more
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    """The values that packed() made the bytes of."""
    starts = np.flatnonzero(np.r_[True, data[:-1] < 128])
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a unit of weight scores in documents of measure m that hold the term tf times."""
    return UNIT * tf // (1000 * tf + K1 * m)


def measure(n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """The length measure of documents of n terms: 100 for one of average length."""
    return 100 - LENGTH_SHARE + LENGTH_SHARE * n * total_docs // max(total_terms, 1)


class _Shard:
    """Documents gathered for one shard, and their terms as numbers."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.doc_ids: list[int | None] = []
        self.size = 0

    def add(self, part: pa.RecordBatch) -> None:
        known, numbers = self.known, []
        for text in part.column("text").to_pylist():
            own = text.encode("utf-8", "surrogatepass").translate(_SEEN).split() if text else []
            numbers += [known.setdefault(w, len(known)) for w in own]
            self.lengths.append(len(own))
        self.size += part.nbytes
        self.terms.append(np.array(numbers, np.int32))
        self.doc_ids += part.column("doc_id").to_pylist()

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The row of the documents, then those of the terms."""
        # Documents are numbered by doc_id, those without one last.
        order = sorted(range(len(self.doc_ids)), key=lambda i: (self.doc_ids[i] is None, self.doc_ids[i]))
        lengths = np.array(self.lengths, np.int64)
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        # In place, as workers of all cores share an executor's memory.
        key = np.concatenate(self.terms, dtype=np.int64)
        self.terms.clear()
        key *= len(order)
        key += np.repeat(number, lengths)
        key.sort()
        lengths = lengths[order]
        head = {"shard": shard, "term": "", "n_docs": int(np.count_nonzero(lengths)), "doc_ids": [self.doc_ids[i] for i in order], "lengths": lengths}
        yield pa.RecordBatch.from_pylist([head], _FIELDS)
        if not len(key):
            return
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        tf = np.diff(heads, append=len(key)).astype(np.int32)
        key = key[heads]
        term, doc = (x.astype(np.int32) for x in np.divmod(key, len(order)))
        del key, heads
        n_docs = np.bincount(term, minlength=len(self.known))
        first = np.cumsum(n_docs) - n_docs
        begins = (np.arange(len(term)) - first[term]) % BLOCK == 0
        block = np.flatnonzero(begins)
        block_end = np.r_[block[1:], len(term)]
        values = np.empty((len(term), 2), np.int32)
        values[:, 0] = np.where(begins, doc, np.diff(doc, prepend=np.int32(0)))
        values[:, 1] = tf
        data, ends = packed(values.ravel())
        upto = np.r_[0, ends[2 * block_end - 1]]
        of_term = np.searchsorted(block, np.r_[first, len(term)])
        del values, ends, begins, term
        start = upto[of_term]
        listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(of_term, pa.int32()), pa.array(values, kind))
        n = len(self.known)
        columns = [
            pa.array(np.full(n, shard)),
            pa.array([w.decode("utf-8", "surrogatepass") for w in self.known], pa.string()),
            pa.array(n_docs),
            listed(doc[block_end - 1], pa.int32()),
            listed(np.maximum.reduceat(tf, block), pa.int64()),
            listed(np.minimum.reduceat(lengths[doc], block), pa.int64()),
            listed(upto[1:] - np.repeat(start[:-1], np.diff(of_term)), pa.int64()),
            pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(data)]),
            pa.nulls(n, pa.list_(pa.int64())),
            pa.nulls(n, pa.list_(pa.int64())),
        ]
        whole = pa.RecordBatch.from_arrays(columns, schema=_FIELDS)
        yield from (whole.slice(i, 10_000) for i in range(0, n, 10_000))


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all rows of docs(doc_id, text): SCHEMA's columns, for each shard a row of its
    documents (its term is empty) and one for each term; a null text has no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for part in parts(batch):
                if shard.size and shard.size + part.nbytes > SHARD_BYTES:
                    yield from shard.rows(made)
                    made, shard = made + 1, _Shard()
                shard.add(part)
        if shard.doc_ids:
            yield from shard.rows(made)

    # Written once: what a shard holds follows from how the rows were read.
    return stored(narrow(docs).mapInArrow(run, SCHEMA))


class _List:
    """One term's postings in a shard, unpacked block by block when needed."""

    def __init__(self, row: dict, m_of: Callable[[np.ndarray], np.ndarray]) -> None:
        self.last, most, shortest, self.ends = (np.array(row[name], np.int64) for name in _LISTS)
        self.data, self.weight = np.frombuffer(row["data"], np.uint8), row["w"]
        self.bounds = impact(most, m_of(shortest))
        self.bound = int(self.bounds.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, frequencies) of block j."""
        if j not in self.open:
            values = unpacked(self.data[self.ends[j - 1] if j else 0 : self.ends[j]])
            self.open[j] = np.cumsum(values[::2]), values[1::2]
        return self.open[j]

    def blocks(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of some blocks, in order."""
        found = [self.block(int(j)) for j in at]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def best(lists: list[tuple[int, _List]], m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores), best first and equal scores by number, of the weighted lists of a query."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].bound)
    bounds = np.cumsum([w * x.bound for w, x in lists])
    docs, scores, worst = np.empty(0, np.int64), np.empty(0, np.int64), 0
    start, stretch = 0, _STRETCH
    while start < len(m):
        end = min(start + stretch, len(m))
        essential = int(np.searchsorted(bounds, worst, "right"))
        if essential == len(lists):
            break
        got = np.zeros(end - start, np.int64)
        for w, x in lists[essential:]:
            lo, hi = np.searchsorted(x.last, [start, end])
            if lo < len(x.last):
                doc, tf = x.blocks(np.arange(lo, min(hi + 1, len(x.last))))
                lo, hi = np.searchsorted(doc, [start, end])
                got[doc[lo:hi] - start] += w * impact(tf[lo:hi], m[doc[lo:hi]])
        seen = np.flatnonzero(got)
        for i in range(essential - 1, -1, -1):
            w, x = lists[i]
            seen = seen[got[seen] + bounds[i] > worst]
            at = np.searchsorted(x.last, seen + start)
            most = np.append(w * x.bounds, 0)[at] + (bounds[i - 1] if i else 0)
            open_ = got[seen] + most > worst
            seen, at = seen[open_], at[open_]
            needed = np.unique(at[at < len(x.last)])
            if len(needed):
                doc, tf = x.blocks(needed)
                there = np.minimum(np.searchsorted(doc, seen + start), len(doc) - 1)
                there, own = there[hit := doc[there] == seen + start], seen[hit]
                got[own] += w * impact(tf[there], m[doc[there]])
        docs, scores = np.append(docs, seen + start), np.append(scores, got[seen])
        order = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[order], scores[order]
        worst = int(scores[-1]) if len(scores) == k else 0
        start, stretch = end, 2 * stretch
    return docs[scores > 0], scores[scores > 0]


def _ranker(sent: Broadcast, k: int) -> Callable[[pa.Table], pa.Table]:
    """Ranks a shard's documents for every query of the broadcast list of (query, terms with their numbers)."""

    def rank(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["term"] == "")
        m_of = lambda n: measure(n, head["total_docs"], head["total_terms"])
        m = m_of(np.array(head["lengths"], np.int64))
        lists = {r["term"]: _List(r, m_of) for r in rows if r["term"]}
        out: dict[str, list] = {"query": [], "doc_id": [], "score": []}
        for query, terms in sent.value:
            own = [(lists[t].weight * times, lists[t]) for t, times in terms.items() if t in lists and lists[t].weight]
            docs, scores = best(own, m, k)
            out["query"] += [query] * len(docs)
            out["doc_id"] += [head["doc_ids"][d] for d in docs]
            out["score"] += scores.tolist()
        return pa.table({name: pa.array(x, pa.int64()) for name, x in out.items()})

    return rank


def _query_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, dict[str, int]]]]:
    """(item_id, terms with their numbers) of all items that have terms, in blocks of bounded size."""
    terms = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0))
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), terms.alias("terms")).where(F.size("terms") > 0).toLocalIterator():
        own: dict[str, int] = {}
        for term in row.terms:
            own[term] = own.get(term, 0) + 1
        block.append((row.item_id, own))
        size += sum(map(len, row.terms))
        if size > QUERY_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank int, doc_id, score): of each row of items(item_id, text) the k documents of
    the index with the highest scores above 0, equal scores by doc_id.

    With N documents that have terms, L terms in them, and df documents that hold a term, the
    term's weight is floor(1000 * ln((2 * N + 2) / (2 * df + 1))), and it scores, for each time
    that the item holds it, weight times impact() of its frequency and of measure() of the
    document's length. Items without terms, or with a null text, have no rows; rows that
    repeat an item_id are ranked one by one; documents that repeat a doc_id, or lack one,
    are ranked each, those without one after their equals. Items go to the shards in
    blocks of QUERY_BYTES.
    """
    spark = index.sparkSession
    heads = index.where("term = ''")
    totals = heads.agg(F.sum("n_docs").alias("total_docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("total_terms"))
    heads = heads.crossJoin(F.broadcast(totals)).withColumn("w", F.lit(0).cast("long"))  # totals: one row
    found = None
    for block in _query_blocks(items):
        words = sorted({t for _, terms in block for t in terms})
        wanted = spark.createDataFrame([(w,) for w in words], "term string")
        # The terms of a block of bounded size.
        lists = stored(index.join(F.broadcast(wanted), "term", "left_semi"))
        df = lists.groupBy("term").agg(F.sum("n_docs").alias("df")).crossJoin(F.broadcast(totals))
        weights = df.select("term", F.floor(1000 * F.log((2 * F.col("total_docs") + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
        weighted = lists.join(weights, "term").select(*index.columns, F.lit(None).cast("long").alias("total_docs"), F.lit(None).cast("long").alias("total_terms"), "w")
        # A shard's rows are bounded by its text.
        shards = weighted.unionByName(heads).groupBy("shard")
        sent = spark.sparkContext.broadcast([(i, terms) for i, (_, terms) in enumerate(block)])
        ranked = shards.applyInArrow(_ranker(sent, k), "query long, doc_id long, score long")
        # Spark keeps the best k of each task before queries meet.
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = ranked.withColumn("rank", place).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "query long, item_id long")
        ranked = stored(ranked.join(ids, "query").select("item_id", "rank", "doc_id", "score"))
        sent.destroy()
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found
