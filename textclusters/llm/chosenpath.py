"""Documents of similar shingle sets, by a chosen-path set similarity join over minwise tokens.

A document is its set of distinct word shingles; equal sets are made one first. From a
set come COORDINATES minwise tokens: two sets agree in each with a probability of their
Jaccard similarity. A tree starts with all sets in its root. A node chooses by its own
name one coordinate, and a second one now and then, 1 / SIMILARITY on average, and sends
each of its sets to the child named by the token there: a pair of the wanted similarity
meets in one child on average, and lesser pairs are parted. Nodes of few sets are leaves
and are not branched; independent trees are grown until the chance that a pair shares a
leaf of none is small (survival(), trees_for()).

What shares a leaf is compared exhaustively, in two passes. First the members of a leaf by
their sketches, a byte of each token: what comes near links, as a spanning forest, so
that no group gives all its pairs. A node that is no leaf at DEPTH holds sets that agree
in so many tokens that they are joined as they are. This joins all sets that could be
linked, and more. Then the whole shingle sets are compared within what was joined. A
joined group of few sets is one block. In a large one, LEADERS sets are compared with the
others first, each with those whose sketches are nearest to its own, which links most of
the group; who is then left outside its largest component is compared with the whole
group, in blocks of a tile of the ones and a tile of the others. Confirmed links leave a
block as a spanning forest too.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textclusters.llm.components import connected_components, spanning_links
from textclusters.llm.shared import discard, map_batches, stored, texts_of
from textclusters.llm.similar import shingle_hashes

#: Words in a shingle; Jaccard similarity from which documents link, in percent.
WORDS, PERCENT = 2, 80
#: Minwise tokens of a set; standard deviations below the wanted similarity from which sketches count as near (one pair in 300,000 falls short).
COORDINATES, DEVIATIONS = 128, 4.5
#: Levels of a tree, and the share of pairs of the wanted similarity, alone in the corpus, that share a leaf even at that depth.
DEPTH, RECALL = 3, 0.9999
#: Sets in a leaf; sets in a block, and their shingles together, at most, one larger set aside; sets of a large group that are compared with its others.
LEAF, BLOCK, WEIGHT, LEADERS = 1024, 256, 4_000_000, 16
#: Shingles whose tokens are made at a time; shared shingles that are multiplied at a time.
_PIECE, _COLUMNS = 1 << 12, 4096
Keep = Callable[[DataFrame], DataFrame]
_SEED = np.random.default_rng(42)
_FACTORS = _SEED.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _SEED.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def survival(depth: int, similarity: float) -> float:
    """The chance that a pair of the similarity shares a node at the depth of one tree."""
    second, chance = 1 / similarity - 1, 1.0
    for _ in range(depth):
        meet = similarity * chance
        chance = (1 - second) * meet + second * (1 - (1 - meet) ** 2)
    return chance


def trees_for(recall: float, depth: int, similarity: float) -> int:
    """Trees in which such a pair shares a node at the depth at least once, with the recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth, similarity)))


def minwise(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, COORDINATES) tokens of sets that begin at the places starts of hashes; none is empty."""
    out = np.full((len(starts), COORDINATES), np.iinfo(np.uint32).max, np.uint32)
    low = hashes.astype(np.uint32)
    for at in range(0, len(low), _PIECE):
        end = min(at + _PIECE, len(low))
        first, last = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, end, "left")
        tokens = low[at:end] * _FACTORS[:, None] + _SHIFTS[:, None]
        least = np.minimum.reduceat(tokens, np.maximum(starts[first:last], at) - at, axis=1)
        out[first:last] = np.minimum(out[first:last], least.T)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _roots(trees: int, similarity: float) -> list[tuple[int, int]]:
    """(tree, coordinate) of the children of all roots."""
    rng = np.random.default_rng(trees)
    chosen = []
    for tree in range(trees):
        many = 1 + int(rng.random() < 1 / similarity - 1)
        chosen += [(tree, int(c)) for c in rng.choice(COORDINATES, many, replace=False)]
    return chosen


def signatures(docs: DataFrame, width: int, chosen: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, version, n, key, sketch, nodes) of docs(doc_id, text, version): the size of the
    shingle set, a hash of it, a byte of each token, the nodes below the roots. A set
    without shingles has none of the last three."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        trees = np.array([t for t, _ in chosen], np.uint64)
        coordinates = np.array([c for _, c in chosen])

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            empty = np.array([not x.encode("utf-8", "surrogatepass").split() for x in texts], bool)
            hashes, owner = shingle_hashes(texts, width)
            starts = np.searchsorted(owner, np.arange(len(texts)))
            size = np.diff(np.append(starts, len(hashes)))
            own = _mixed(hashes)
            key = _mixed(np.add.reduceat(own, starts) ^ _mixed(np.bitwise_xor.reduceat(own, starts) + size.astype(np.uint64)))
            tokens = minwise(hashes, starts)
            at = tokens[:, coordinates].astype(np.uint64)
            nodes = _mixed(_mixed(at + np.uint64(1)) + _mixed(trees * np.uint64(COORDINATES) + coordinates.astype(np.uint64)))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(chosen), pa.int32()), pa.array(nodes.ravel().view(np.int64)))
            some = pa.array(~empty)
            none = lambda column, kind: pc.if_else(some, column, pa.scalar(None, kind))
            sketch = pa.array([x.tobytes() for x in (tokens ^ (tokens >> np.uint32(16))).astype(np.uint8)], pa.binary())
            columns = [batch.column("doc_id"), batch.column("version"), pa.array(np.where(empty, 0, size), pa.int64())]
            columns += [none(pa.array(key.view(np.int64)), pa.int64()), none(sketch, pa.binary()), none(listed, listed.type)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "n", "key", "sketch", "nodes"])

        return work

    return map_batches(docs, make, "doc_id long, version long, n long, key long, sketch binary, nodes array<long>")


def _by_group(df: DataFrame, group: str, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """work over rows of df that hold whole groups, many groups at a time; all groups must be of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(group).to_numpy()
            last = int(np.searchsorted(names, names[-1]))
            # Batches are sorted: what comes before the last group is whole, with what was held.
            if last or (held and held[-1].column(group)[-1].as_py() != names[-1]):
                yield work(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield work(pa.Table.from_batches(held))

    return df.repartition(group).sortWithinPartitions(group).mapInArrow(run, schema)


def _bounds(names: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.append(True, names[1:] != names[:-1])), len(names))


def _forest(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A spanning forest of the links, with fewer rows than there are sets."""
    a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in spanning_links(a, b)], names=["a", "b"])


def _near(least: float) -> Callable[[pa.Table], pa.RecordBatch]:
    """Spanning forests of the leaves' members whose sketches agree in a share of least or more."""

    def work(table: pa.Table) -> pa.RecordBatch:
        names, keys = table.column("node").to_numpy(), table.column("key").to_numpy()
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        bounds, found = _bounds(names), []
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            own, x = sketches[start:end], keys[start:end]
            for i in range(0, end - start, 64):
                agree = np.count_nonzero(own[i : i + 64, None] == own[None, :], axis=2)
                a, b = np.nonzero(agree >= least * COORDINATES)
                apart = a + i < b
                found.append((x[a[apart] + i], x[b[apart]]))
        return _forest(found)

    return work


def common_counts(hashes: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """(sets, sets) sizes of the intersections; each set's hashes are distinct."""
    _, number, count = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    there = shared[number]
    row, at = owner[there], column[number[there]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((sets, sets), np.float64)
    total = int(shared.sum())
    for k in range(0, total, _COLUMNS):
        lo, hi = np.searchsorted(at, [k, k + _COLUMNS])
        marks = np.zeros((sets, min(_COLUMNS, total - k)), np.float32)
        marks[row[lo:hi], at[lo:hi] - k] = 1
        out += marks @ marks.T
    return out.astype(np.int64)


def _confirmed(percent: int, width: int) -> Callable[[pa.Table], pa.RecordBatch]:
    """Spanning forests of the links between whole sets, block by block."""

    def work(table: pa.Table) -> pa.RecordBatch:
        names, keys = table.column("block").to_numpy(), table.column("key").to_numpy()
        bounds, found = _bounds(names), []
        texts = table.column("text")
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            hashes, owner = shingle_hashes([x or "" for x in texts.slice(start, end - start).to_pylist()], width)
            size = np.bincount(owner, minlength=end - start)
            common = common_counts(hashes, owner, end - start)
            a, b = np.nonzero(np.triu(100 * common >= percent * (size[:, None] + size[None, :] - common), 1))
            x = keys[start:end]
            found.append((x[a], x[b]))
        return _forest(found)

    return work


def _children(similarity: float) -> Column:
    """The children of a node(node, sketch), by the coordinates that its name chooses."""
    draw = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 20))
    first = (draw(1) % COORDINATES).cast("int")
    second = ((first + 1 + draw(2) % (COORDINATES - 1)) % COORDINATES).cast("int")
    child = lambda c: F.xxhash64("node", c, F.substring("sketch", c + 1, F.lit(1)))
    return F.when(draw(3) < int((1 / similarity - 1) * (1 << 20)), F.array(child(first), child(second))).otherwise(F.array(child(first)))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def _candidates(each: DataFrame, similarity: float, keep: Keep) -> DataFrame:
    """(a, b): links of each(key, sketch, nodes) that join all sets that may be similar."""
    least = similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / COORDINATES)
    placed, leaves, joined = each.select(F.explode("nodes").alias("node"), "key"), [], []
    for depth in range(1, DEPTH + 1):
        sizes = placed.groupBy("node").agg(F.count("*").alias("members"), F.min("key").alias("first")).where("members > 1")
        level = keep(placed.join(sizes, "node"))
        leaves.append(level.where(F.col("members") <= LEAF).select("node", "key"))
        crowded = level.where(F.col("members") > LEAF)
        if crowded.isEmpty():
            break
        if depth == DEPTH:
            joined.append(crowded.select(F.col("key").alias("a"), F.col("first").alias("b")))
            break
        placed = crowded.select("node", "key").join(each.select("key", "sketch"), "key").select(F.explode(_children(similarity)).alias("node"), "key")
    near = _by_group(_union(leaves).join(each.select("key", "sketch"), "key"), "node", _near(least), "a long, b long")
    return _union([near, *joined])


def _tiles(members: DataFrame, group: str) -> DataFrame:
    """members(group, key, n) with tile and tiles: so many of a group that two tiles make a block."""
    sizes = members.groupBy(group).agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    tiles = F.greatest(F.ceil(F.col("members") * 2 / BLOCK), F.ceil(F.col("shingles") * 2 / WEIGHT), F.lit(1)).cast("int")
    sized = members.join(sizes.select(group, tiles.alias("tiles")), group)
    return sized.withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))


def _nearest(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(root, key, n, leader): the leader whose sketch is nearest to a set's own, if near; of itself, the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            keys, leaders = batch.column("key").to_pylist(), batch.column("leaders").to_pylist()
            found: list[int | None] = []
            for key, sketch, listed in zip(keys, own, leaders, strict=True):
                told = [(np.count_nonzero(sketch == np.frombuffer(x["sketch"], np.uint8)), x["key"]) for x in listed if x["key"] != key]
                agree, leader = max(told, default=(0, None))
                found.append(leader if agree >= least * COORDINATES else None)
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("key"), batch.column("n"), pa.array(found, pa.int64())], names=["root", "key", "n", "leader"])

    return run


def _led(large: DataFrame, each: DataFrame, similarity: float) -> DataFrame:
    """(block, key): the leaders of each large group, each with tiles of the sets that are nearest to it."""
    place = F.row_number().over(Window.partitionBy("root").orderBy("key"))
    sketched = large.join(each.select("key", "sketch"), "key")
    # Keys are hashes, so the first ones are a draw; Spark keeps the first of each task before it shuffles a group.
    leaders = sketched.withColumn("place", place).where(F.col("place") <= LEADERS).groupBy("root").agg(F.collect_list(F.struct("key", "sketch")).alias("leaders"))
    least = similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / COORDINATES)
    nearest = sketched.join(leaders, "root").select("root", "key", "n", "sketch", "leaders").mapInArrow(_nearest(least), "root long, key long, n long, leader long")
    tiled = _tiles(nearest.where("leader IS NOT NULL").select("leader", "key", "n"), "leader").withColumn("block", F.xxhash64("leader", "tile"))
    return tiled.select("block", "key").unionByName(tiled.select("block", F.col("leader").alias("key"))).distinct()


def _outside(large: DataFrame, links: DataFrame) -> DataFrame:
    """(block, key): who is outside the largest component of a large group, against the whole group."""
    found = large.join(connected_components(links).withColumnsRenamed({"node": "key", "root": "part"}), "key", "left").withColumn("part", F.coalesce("part", "key"))
    largest = found.groupBy("root", "part").agg(F.count("*").alias("members")).groupBy("root").agg(F.max_by("part", F.struct("members", "part")).alias("most"))
    outside = _tiles(found.join(largest, "root").where("part <> most").select("root", "key", "n"), "root")
    whole = _tiles(large, "root")
    counts = lambda df, name: df.select("root", F.col("tiles").alias(name)).distinct()
    rows = whole.join(counts(outside, "others"), "root").select("root", "key", F.col("tile").alias("i"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j"))
    met = outside.join(counts(whole, "others"), "root").select("root", "key", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("i"), F.col("tile").alias("j"))
    return rows.unionByName(met).select(F.xxhash64("root", "i", "j").alias("block"), "key").distinct()


def similar_sets(docs: DataFrame, percent: int = PERCENT, width: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Documents link if 100 * intersection >= percent * union of their sets of distinct
    width-word shingles (A-Z lower-cased; the whole sequence, if it has fewer words), which is
    confirmed on the whole sets. component_id is the smallest doc_id that can be reached;
    kept: it is the row's own. Null texts and texts without words have an empty set and
    link with nothing. A row without doc_id keeps its component and does not name it, and
    is kept where nothing else names it; rows that repeat a doc_id each get a row; other
    columns are ignored; no rows give none. Every pair that is not confirmed is not
    linked; of the pairs to be linked, each alone in the corpus is met with the recall
    at the full depth and nearly always above it.
    """
    similarity = percent / 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("version", F.xxhash64("text"))
    rows = stored(signatures(docs, width, _roots(trees_for(recall, DEPTH, similarity), similarity)))
    first = ("sketch", "nodes", "n")
    each = stored(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("named"), F.min("version").alias("version"), *(F.first(c).alias(c) for c in first)))
    made: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(stored(df))
        return made[-1]

    roots = connected_components(_candidates(each, similarity, keep))
    members = keep(roots.withColumnRenamed("node", "key").unionByName(roots.select(F.col("root").alias("key"), "root").distinct()).join(each.select("key", "n"), "key"))
    sizes = members.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    fits = (F.col("members") <= BLOCK) & (F.col("shingles") <= WEIGHT)
    sized = keep(members.join(sizes, "root"))
    large = sized.where(~fits).select("root", "key", "n")
    some = keep(docs.join(members.join(each.select("key", "version"), "key").select("version").distinct(), "version", "left_semi").dropDuplicates(["version"]).select("version", "text"))

    def compared(blocks: DataFrame) -> DataFrame:
        named = blocks.join(each.select("key", "version"), "key").join(some, "version").select("block", "key", "text")
        return keep(_by_group(named, "block", _confirmed(percent, width), "a long, b long"))

    links = compared(sized.where(fits).select(F.col("root").alias("block"), "key"))
    if not large.isEmpty():
        led = compared(_led(large, each, similarity))
        links = _union([links, led, compared(_outside(large, led))])
    roots = connected_components(links)
    discard(*made)
    rooted = each.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "named", F.coalesce("root", "key").alias("root"))
    component = rooted.join(rooted.groupBy("root").agg(F.min("named").alias("component_id")), "root").select("key", "component_id")
    out = rows.join(component, "key", "left")
    # A set without shingles stands for itself.
    of_row = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), of_row.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
