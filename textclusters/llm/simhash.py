"""Near-duplicate documents by SimHash fingerprints and anchor-point covering.

A 64-bit fingerprint is cut into two halves, and each half is seen through 31 of
its bits. The anchors of a half are the 2^26 words of the perfect Hamming code of
length 31: every 31-bit value lies within one bit (the covering radius) of
exactly one anchor, its home. Two fingerprints that differ in at most three bits
differ in at most one bit in one of the halves. There, the home of either lies
within radius + 1 = 2 bits of the other. So each fingerprint is replicated, in
both halves, to every anchor within two bits (one or sixteen of them), and all
comparisons are made at anchors, between those at home there and the replicas.
This finds every pair within three bits; the comparison is exact.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textclusters.llm.components import connected_components, spanning_links
from textclusters.llm.shared import cut, map_batches, texts_of

#: Bits by which linked fingerprints may differ; the covering above is built for it.
DISTANCE = 3
#: Members at an anchor beyond which its comparisons are dealt out in tiles.
TILE = 1024


def fingerprint(text: str, words_in_shingle: int = 3) -> int:
    """Majority of the bits of the hashed word shingles, repeats included.

    A bit is set if more than half of the hashes have it. Fewer words than a
    shingle: the whole sequence is the one shingle; no words: zero.
    """
    return _of_words(text.encode("utf-8", "surrogatepass").lower().split(), words_in_shingle)


def _of_words(words: list[bytes], n: int) -> int:
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, max(1, len(words) - n + 1))
    # Columns of bits, counted in pieces so that a very long text needs little memory.
    ones = sum(np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(hashes), 65536))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, widths: tuple[int, ...] = (3,)) -> DataFrame:
    """(doc_id, fp, fp1, ...) longs for every row of docs, one fingerprint for each
    number of words in a shingle; a null text counts as empty."""
    names = ["fp", *(f"fp{k}" for k in range(1, len(widths)))]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [x.encode("utf-8", "surrogatepass").lower().split() for x in texts_of(batch)]
            columns = [pa.array(np.array([_of_words(x, n) for x in words], np.uint64).view(np.int64)) for n in widths]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])

        return work

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(narrow, make, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


def _syndrome(part: Column) -> Column:
    """XOR of the places (1 to 31) of the set bits: 0 for a word of the code."""
    masks = [sum(1 << (place - 1) for place in range(1, 32) if place >> b & 1) for b in range(5)]
    return sum(((F.bit_count(part.bitwiseAND(F.lit(m))) % 2) * (1 << b) for b, m in enumerate(masks)), F.lit(0))


def _flip(part: Column, place: Column) -> Column:
    return part.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int")))


def at_anchors(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(homes, replicas) of fps(fp), each (anchor long, fp); the half is in the anchor's bit 31."""
    seen = fps.select(
        "fp",
        F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(F.lit(0x7FFFFFFF)).alias("part")), F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(0x7FFFFFFF)).alias("part")))).alias("x"),
    ).select("fp", "x.half", "x.part")
    seen = seen.withColumn("s", _syndrome(F.col("part")).cast("int"))
    mark = F.col("half") * F.lit(1 << 31)
    homes = seen.select((F.when(F.col("s") == 0, F.col("part")).otherwise(_flip(F.col("part"), F.col("s"))) + mark).alias("anchor"), "fp")

    def other(i: Column) -> Column:
        j = i.bitwiseXOR(F.col("s"))
        return F.when(j == 0, _flip(F.col("part"), i)).when(j > i, _flip(_flip(F.col("part"), i), j))

    near = F.when(F.col("s") == 0, F.array("part")).otherwise(F.filter(F.transform(F.sequence(F.lit(1), F.lit(31)), other), lambda x: x.isNotNull()))
    return homes, seen.select("fp", F.explode(near).alias("part"), "half").select((F.col("part") + mark).alias("anchor"), "fp")


def _tile(table: pa.Table) -> pa.Table:
    """Compare the homes of a tile with its replicas; return a spanning forest of the links.

    The forest has fewer links than the tile has members, however many pairs are near.
    """
    fp, home = table.column("fp").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
    mine, theirs = fp[home], fp[~home]
    found = []
    for i in range(0, len(mine), 256):
        near = np.bitwise_count((mine[i : i + 256, None] ^ theirs[None, :]).view(np.uint64)) <= DISTANCE
        r, c = np.nonzero(near)
        found.append(spanning_links(mine[i : i + 256][r], theirs[c]))
    a, b = (np.concatenate([x[k] for x in found] or [np.empty(0, np.int64)]) for k in (0, 1))
    node, root = spanning_links(a, b)
    return pa.table({"a": pa.array(node, pa.int64()), "b": pa.array(root, pa.int64())})


def links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints within three bits, enough to
    join all that are joined: anchors with few members give each near pair,
    crowded ones a spanning forest for each tile of members.

    A crowded anchor's homes and replicas are dealt into tiles by hash, and every
    tile of homes meets every tile of replicas in a group of bounded size.
    """
    homes, replicas = at_anchors(fps)
    crowd = replicas.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("anchor", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    crowd = cut(crowd)
    mine = homes.join(crowd, "anchor", "left_anti").withColumnRenamed("fp", "b")
    others = replicas.join(crowd, "anchor", "left_anti").withColumnRenamed("fp", "a")
    pairs = others.join(mine, "anchor").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    if crowd.isEmpty():
        return pairs

    def dealt(rows: DataFrame, home: bool) -> DataFrame:
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        rows = rows.join(crowd, "anchor").withColumn("own", own).withColumn("every", every)
        return rows.select("anchor", F.col("own" if home else "every").alias("h"), F.col("every" if home else "own").alias("r"), "fp", F.lit(home).alias("home"))

    tiled = dealt(homes, True).unionByName(dealt(replicas, False))
    return pairs.unionByName(tiled.groupBy("anchor", "h", "r").applyInArrow(_tile, "a long, b long"))


def _node(name: str, k: int) -> Column:
    """A fingerprint as a node; those of other widths are kept apart by a hash."""
    return F.col(name) if k == 0 else F.xxhash64(F.lit(k), F.col(name))


def near_duplicates(docs: DataFrame, widths: tuple[int, ...] = (3,)) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text).

    Documents link if, for one of the numbers of words in a shingle, their
    fingerprints differ in at most three bits; component_id is the smallest doc_id
    that can be reached; fp is of the first width. Equal fingerprints are first made
    one, so a group of copies of any size costs one comparison. Null texts and texts
    without a word have fingerprint zero and link like any other; a row without
    doc_id keeps its component and does not name it; rows that repeat a doc_id each
    get a row; other columns are ignored.
    """
    names = ["fp", *(f"fp{k}" for k in range(1, len(widths)))]
    rows = cut(fingerprints(docs, widths))
    each = cut(rows.groupBy(*names).agg(F.min("doc_id").alias("first")))
    graph = None
    for k, name in enumerate(names):
        found = links(each.select(F.col(name).alias("fp")).distinct() if len(names) > 1 else each.select("fp"))
        found = found.select(_node("a", k).alias("a"), _node("b", k).alias("b"))
        if k:
            # A document joins its fingerprints of all widths.
            found = found.unionByName(each.select(F.col("fp").alias("a"), _node(name, k).alias("b")))
        graph = found if graph is None else graph.unionByName(found)
    roots = connected_components(graph)
    of_fp = each.groupBy("fp").agg(F.min("first").alias("first")) if len(names) > 1 else each
    rooted = of_fp.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, widths: tuple[int, ...] = (3,)) -> DataFrame:
    """The rows of docs, with all their columns, less those that near_duplicates()
    links to a smaller doc_id: one document of each component stays.

    Rows without doc_id stay. Where doc_ids repeat, rows that repeat both doc_id and
    text become one, and of rows with one doc_id and other texts all go if one does.
    """
    found = near_duplicates(docs, widths)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if ids.isEmpty():
        return kept
    nameless = kept.where("doc_id IS NULL")
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(nameless)
