"""Documents of a given shingle similarity, by wide SimHash fingerprints and anchors.

Two documents whose sets of word shingles have a Jaccard similarity of 0.8 differ in
some 15 % of the bits of their fingerprints: 39 of 256, far more than the covering of
three bits in simhash is built for. (There, a block of 31 bits with the Hamming code
finds such a pair with probability 0.08 for 17 rows; as many blocks of 24 bits find it
with 0.28.) So the fingerprint has 256 bits here, and the anchors are the values of
many blocks of it: the covering code of a block is the whole space, its radius and the
threshold are zero, and each fingerprint goes to one anchor for each block. The bits of
a block follow from the number of fingerprints, so that an anchor has few members by
chance, and the number of blocks from the wanted recall at the given similarity.

At an anchor every member is compared with the least one, by all bits. Pairs within
NEAR bits are links if their shingles, compared exactly, are as similar as asked for;
then those beyond, up to FAR bits, that the former have not joined. Groups of any size
give one pair for each member and block, never all pairs.

What blocks of bits do not find by chance, members of crowded anchors that are not the
least one, and pairs of more than FAR bits have an exact way: two sets of the similarity
share one of the shingles that come first in each, under any common order. A set of n
shingles has n - ceil(similarity * n) + 1 such ones, and in an order by rising frequency
they are rare. Only sets of different components meet there, and a pair goes on to the
comparison of all shingles if those that it shares among the first can still make it
similar enough. So no link is left out.
"""

import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textclusters.llm.components import connected_components
from textclusters.llm.shared import discard, map_batches, parts, stored, texts_of

#: Words in a shingle; Jaccard similarity from which documents link; share of such pairs that meet at an anchor at least.
WORDS, SIMILARITY, RECALL = 5, 0.8, 0.95
#: Rows of a bucket of sets, about, and texts of a bucket.
BUCKET_ROWS, BUCKET_TEXTS = 8192, 2048
#: 64-bit words of a fingerprint; bits, of 256, within which links stand by themselves (an estimate of 0.91), and beyond which they are not looked at (0.68).
LONGS, NEAR, FAR = 4, 24, 52
#: Bits of a block at least, and beyond those that number all fingerprints; bits of a shingle's slot, whose count tells how rare it is; of the number of a filter's words, at least and at most.
_LEAST, _SPARE, _SLOT_BITS, _FILTER_BITS = 24, 3, 16, (16, 21)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_NAMES = [f"f{k}" for k in range(LONGS)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _ODD[4]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each distinct shingle of each text, text), in the order of texts.

    A-Z are lower-cased. A text of fewer words has one shingle, all of them; one
    without words has one as well, which it shares with all such texts.
    """
    known: dict[bytes, int] = {}
    numbers, counts = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        numbers += [known.setdefault(w, len(known)) for w in words]
        counts.append(len(words))
    of_word = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in known), np.uint64, len(known))
    flat = np.concatenate([of_word[np.array(numbers, np.int64)], np.zeros(width, np.uint64)])
    count = np.array(counts, np.int64)
    first = np.cumsum(count) - count
    each = np.maximum(count - width + 1, 1)
    owner = np.repeat(np.arange(len(texts)), each)
    at = np.repeat(first, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        there = np.repeat(count > k, each)
        total = (total + np.where(there, flat[at + k] + np.uint64(k + 1), np.uint64(0))) * _ODD[k % 4]
    hashed = _mix(total)
    # Equal shingles of one text become one.
    _, one = np.unique(hashed + owner.astype(np.uint64) * _ODD[0], return_index=True)
    one.sort()
    return hashed[one], owner[one]


def wide_fingerprints(texts: list[str], width: int = WORDS) -> np.ndarray:
    """Fingerprints of LONGS words each: a bit is set if over half of the text's distinct shingles have it."""
    hashes, owner = shingle_hashes(texts, width)
    return _fingerprints(hashes, np.searchsorted(owner, np.arange(len(texts) + 1)))


def _fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.empty((len(bounds) - 1, LONGS), np.uint64)
    for k in range(LONGS):
        own = _mix(hashes ^ _ODD[k])
        for i in range(len(out)):
            part = own[bounds[i] : bounds[i + 1]]
            # Columns of bits, counted in pieces so that a very long text needs little memory.
            ones = sum(np.unpackbits(part[j : j + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32) for j in range(0, len(part), 65536))
            out[i, k] = np.packbits(2 * ones > len(part), bitorder="little").view(np.uint64)[0]
    return out


def least_common(n: int, similarity: float) -> int:
    """Shingles that a set of n has in common with any set of the similarity, at least."""
    return math.ceil(similarity * n - 1e-9)


def first_shingles(hashes: np.ndarray, bounds: np.ndarray, ranks: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that come first in each set, where those of each set end): one of them is shared by any two sets
    of the similarity. The order is by the rank of a shingle's slot, then by the rest of its hash."""
    rest = np.uint64(64 - _SLOT_BITS)
    keys = ranks[(hashes >> rest).astype(np.int64)] << rest | hashes & np.uint64((1 << 64 - _SLOT_BITS) - 1)
    own = [np.sort(keys[a:b])[: b - a - least_common(b - a, similarity) + 1] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.concatenate(own), np.cumsum([0, *map(len, own)])


def _slot_ranks(docs: DataFrame, width: int) -> np.ndarray:
    """The rank of each slot of shingles, by how many shingles of docs(text) it has; as many numbers for any corpus."""

    def run(batches):
        counts = np.zeros(1 << _SLOT_BITS, np.int64)
        for part in (part for whole in batches for part in parts(whole)):
            hashes, _ = shingle_hashes(texts_of(part), width)
            counts += np.bincount((hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["slot", "n"])

    counts = np.zeros(1 << _SLOT_BITS, np.int64)
    for row in docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.slot] = row.n
    ranks = np.empty(len(counts), np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    return ranks


def blocks_for(n: int, similarity: float, recall: float) -> list[list[int]]:
    """The masks of blocks: for each, the bits of all LONGS words that belong to it."""
    size = max(_LEAST, math.ceil(math.log2(n + 1)) + _SPARE)
    agree = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** size
    count = math.ceil(math.log(1 - recall) / math.log(1 - agree))
    rng = random.Random(size)
    masks = []
    for _ in range(count):
        words = [0] * LONGS
        for bit in rng.sample(range(64 * LONGS), min(size, 64 * LONGS)):
            words[bit // 64] |= 1 << bit % 64
        masks.append([w - (w >> 63 << 64) for w in words])
    return masks


def _candidates(each: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(a, b, d): nodes of each(node, f0, ...) that meet at an anchor, and the bits in which they differ, FAR at most."""
    masks = blocks_for(each.count(), similarity, recall)
    anchors = F.explode(F.array(*(F.xxhash64(F.lit(k), *(F.col(f).bitwiseAND(F.lit(m)) for f, m in zip(_NAMES, mask, strict=True))) for k, mask in enumerate(masks))))
    placed = each.select("node", anchors.alias("anchor"))
    # One shuffle; the rows of an anchor are read in order and not held. A group of copies has an anchor in each
    # block, so that its rows are dealt to as many tasks.
    order = Window.partitionBy("anchor").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    met = placed.select(F.first("node").over(order).alias("a"), F.col("node").alias("b"))
    met = stored(met.where("a <> b").distinct())
    side = lambda name: each.select(F.col("node").alias(name), *(F.col(f).alias(name + f) for f in _NAMES))
    differing = sum((F.bit_count(F.col("a" + f).bitwiseXOR(F.col("b" + f))) for f in _NAMES), F.lit(0))
    found = stored(met.join(side("a"), "a").join(side("b"), "b").select("a", "b", differing.alias("d")).where(F.col("d") <= FAR))
    discard(met)
    return found


def _filter(keys: DataFrame, key: str) -> tuple[DataFrame, Column, Column]:
    """(words, a column that joins them to rows with a key, a column that tells if the key may be one of keys(key)).

    A filter of bounded size: words of 64 bits, one for four keys or so. It goes to all tasks, so that only the few rows
    that pass it need be shuffled.
    """
    least, most = _FILTER_BITS
    size = min(most, max(least, (keys.count() // 4).bit_length()))
    word, bit = F.col(key).bitwiseAND((1 << size) - 1), F.expr(f"shiftleft(1L, cast(pmod(shiftright({key}, {most}), 64) AS int))")
    words = keys.groupBy(word.alias("_filter_word")).agg(F.bit_or(bit).alias("_filter_bits"))
    return F.broadcast(words), word == F.col("_filter_word"), F.coalesce(F.col("_filter_bits").bitwiseAND(bit) != 0, F.lit(False))


def _passing(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is one of keys(key), and few others; no shuffle of df."""
    words, on, passes = _filter(keys, key)
    return df.join(words, on).where(passes).select(*df.columns)


def _without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df, null keys among them, whose key is none of keys(key); only those that may be one are shuffled."""
    words, on, passes = _filter(keys, key)
    marked, columns = df.join(words, on, "left"), [F.col(f"`{c}`") for c in df.columns]
    return marked.where(~passes).select(*columns).unionByName(marked.where(passes).select(*columns).join(keys, key, "left_anti").select(*columns))


def _of_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is one of the distinct keys(key); they are filtered before they are shuffled."""
    # Not a semi join: Spark would put it below the filter.
    return _passing(df, keys, key).join(keys, key).select(*df.columns)


def _texts(docs: DataFrame, each: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) of the nodes of pairs(a, b), in buckets of nodes, so that joins do not shuffle texts again."""
    wanted = stored(each.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "version"))
    passed = _passing(docs.select("version", "text"), wanted, "version").dropDuplicates(["version"])
    buckets = max(1, wanted.count() // BUCKET_TEXTS)
    out = stored(passed.join(wanted, "version").select("node", "text").repartition(buckets, "node"), "node", buckets)
    discard(wanted)
    return out


def _verified(texts: DataFrame, pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs(a, b) whose texts have the similarity, shingle by shingle."""
    both = pairs.select("a", "b").join(texts.withColumnRenamed("node", "a"), "a").join(texts.withColumnsRenamed({"node": "b", "text": "other"}), "b").select("a", "b", "text", "other")

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, 100)):
            keep = []
            for pair in zip(texts_of(batch), texts_of(batch, "other"), strict=True):
                hashes, owner = shingle_hashes(list(pair), width)
                n = len(hashes)
                common = n - len(np.unique(hashes))
                keep.append(common >= similarity * (n - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(both.mapInArrow(run, "a long, b long"))


def _meeting(each: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of each(node, n, shingles) of different components of roots(node, root) that share some
    of their first shingles, and so many, and so early, that they can have the similarity; all pairs that have it are
    among them."""
    rooted = each.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), "shingles")
    # Two sets share at least this of both together. So fewer shingles are enough on the side of the smaller one: a
    # group of copies, each with edits of its own, has only the rare shingles of its edits there.
    few = F.col("n") - F.ceil(2 * similarity / (1 + similarity) * F.col("n") - 1e-9) + 1
    placed = rooted.select("node", "n", "root", few.alias("few"), F.posexplode("shingles").alias("at", "shingle")).select("shingle", "node", "n", "root", "at", (F.col("at") < F.col("few")).alias("early"))
    # Most shingles are in one component only; one that is not may have many members, so its row is finished first.
    several = placed.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max("early").alias("early"))
    several = stored(several.where("least < most AND early").select("shingle"))
    full = stored(_of_keys(placed, several, "shingle"))
    side = lambda name: full.select("shingle", *(F.col(c).alias(name + c) for c in ("node", "n", "root", "at", "early")))
    smaller = (F.col("an") < F.col("bn")) | (F.col("an") == F.col("bn")) & (F.col("anode") < F.col("bnode"))
    alike = F.col("an") >= similarity * F.col("bn") - 1e-9
    pairs = side("a").where("aearly").join(side("b"), "shingle").where(smaller & (F.col("aroot") != F.col("broot")) & alike)
    # All sets are in one order: what two share beyond these shingles comes after the last of them in both.
    shared = pairs.groupBy(F.col("anode").alias("a"), F.col("bnode").alias("b")).agg(F.count("*").alias("shared"), *(F.max(c).alias(c) for c in ("an", "bn", "aat", "bat")))
    after = F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat")) - 1
    enough = F.col("shared") + after >= similarity / (1 + similarity) * (F.col("an") + F.col("bn")) - 1e-9
    pairs = stored(shared.where(enough).select("a", "b"))
    discard(several, full)
    return pairs


def _left_out(each: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): those of _meeting() that can have the similarity by all that they share of their first shingles."""
    pairs = _meeting(each, roots, similarity)
    own = lambda name: each.select(F.col("node").alias(name), F.col("n").alias(name + "n"), F.col("shingles").alias(name + "s"))
    # What is shared lies among the first of both, or after the first of one.
    others = F.greatest(F.col("an") - F.size("as"), F.col("bn") - F.size("bs"))
    enough = F.size(F.array_intersect("as", "bs")) + others >= similarity / (1 + similarity) * (F.col("an") + F.col("bn")) - 1e-9
    out = stored(pairs.join(own("a"), "a").join(own("b"), "b").where(enough).select("a", "b"))
    discard(pairs)
    return out


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, width: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, component_id) for every row of docs(doc_id, text): the smallest doc_id
    that can be reached over links of documents whose sets of width-word shingles have
    at least the similarity. All links count: the recall is that of the fingerprints'
    blocks, and what they leave out is found by the rarest shingles of each set.

    Texts with equal sets are one. Null texts and texts without a word are alike;
    a text of fewer words than width is one shingle. A row without doc_id keeps its
    component and does not name it; rows that repeat a doc_id each get a row; other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("version", F.xxhash64("text"))

    ranks = _slot_ranks(docs, width)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, owner = shingle_hashes(texts_of(batch), width)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            shingles, ends = first_shingles(hashes, bounds, ranks, similarity)
            columns = [np.add.reduceat(_mix(hashes ^ _ODD[LONGS]), bounds[:-1]).view(np.int64), np.diff(bounds), *_fingerprints(hashes, bounds).view(np.int64).T]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(shingles.view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), *map(pa.array, columns), listed], names=names)

        return work

    names = ["doc_id", "version", "node", "n", *_NAMES, "shingles"]
    rows = stored(map_batches(docs, make, ", ".join(f"{c} {'array<long>' if c == 'shingles' else 'long'}" for c in names)))
    # A node is a set: all but doc_id and version is the same in each of its rows.
    # It is joined by node again and again, and so lies in buckets.
    buckets = max(1, rows.count() // BUCKET_ROWS)
    each = stored(rows.repartition(buckets, "node").groupBy("node").agg(*(F.min(c).alias(c) for c in ("n", *_NAMES)), F.min("doc_id").alias("first"), F.min("version").alias("version"), F.first("shingles").alias("shingles")), "node", buckets)
    found = _candidates(each, similarity, recall)
    texts = _texts(docs, each, found)
    sure = _verified(texts, found.where(F.col("d") <= NEAR), similarity, width)
    roots = connected_components(sure)
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias("r" + name))
    apart = found.where(F.col("d") > NEAR).join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    more = _verified(texts, apart, similarity, width)
    roots = connected_components(sure.unionByName(more))
    left = _left_out(each, roots, similarity)
    others = _texts(docs, each, left)
    rest = _verified(others, left, similarity, width)
    if not rest.isEmpty():
        roots = connected_components(sure.unionByName(more).unionByName(rest))
    discard(found, texts, sure, more, left, others, rest)
    rooted = each.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    out = stored(rows.join(named, "node").select("doc_id", "component_id"))
    discard(rows, each)
    return out


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY, width: int = WORDS, recall: float = RECALL) -> DataFrame:
    """The rows of docs, with all their columns, less those that similar_documents()
    links to a smaller doc_id: one document of each component stays.

    Rows without doc_id stay. Where doc_ids repeat, rows that repeat both doc_id and
    text become one, and of rows with one doc_id and other texts all go if one does.
    """
    gone = stored(similar_documents(docs, similarity, width, recall).where("doc_id <> component_id").select("doc_id").distinct())
    kept = _without_keys(docs, gone, "doc_id")
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id IS NULL"))
