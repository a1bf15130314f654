"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters with an error budget of k edits is cut into k + 1
pieces. If a passage is within k edits of the item, at least one piece occurs in
it unchanged. One Aho-Corasick pass over a document finds all exact hits of all
pieces; each hit names a window in which the item would have to lie, and Myers'
bit-parallel algorithm gives the least edit distance of the item to any passage
of the window. Nothing within the budget is missed, and nothing else is found.

Case is folded and runs of white space count as one blank, on both sides. A short
item, which chance could bring within the budget, is looked for without edits and
between word borders.
"""

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textclusters.llm.shared import keep_rows, map_batches, narrow, texts_of

#: Edits allowed for each character of an item; characters below which an item is short.
ERROR_RATE, SHORT = 0.08, 24
#: Bytes of test items that go to the executors at a time: the bound of what is broadcast.
BLOCK_BYTES = 4 << 20
SCHEMA = "doc_id long, item_id long, distance int, start int, end int"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def places(text: str) -> list[int]:
    """For each character of normal(text), where it stands in text; then the end of the last."""
    at, gap, end = [], -1, 0
    for i, c in enumerate(text):
        for x in c.lower():
            if x.isspace():
                gap = i if gap < 0 else gap
                continue
            if gap >= 0 and at:
                at.append(gap)
            gap, end = -1, i + 1
            at.append(i)
    return [*at, end]


class Item:
    """A normalised test item with its budget, its pieces and its bit masks."""

    def __init__(self, text: str, ids: list[int], rate: float, short: int):
        self.text, self.ids, self.whole = text, ids, len(text) < short
        self.budget = 0 if self.whole else int(rate * len(text))
        self.full, self.top = (1 << len(text)) - 1, 1 << (len(text) - 1)
        self.masks = self._masks(text)
        self.back = self._masks(text[::-1])

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            masks[c] |= 1 << i
        return dict(masks)

    def pieces(self) -> Iterator[tuple[int, str]]:
        n, parts = len(self.text), self.budget + 1
        for j in range(parts):
            start = j * n // parts
            yield start, self.text[start : (j + 1) * n // parts]

    def ends(self, window: str, masks: dict[str, int]) -> Iterator[tuple[int, int]]:
        """(distance, end) for each end in window of a passage within the budget."""
        up, down, score = self.full, 0, len(self.text)
        for at, c in enumerate(window):
            eq = masks.get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            plus, minus = down | ~(diagonal | up) & self.full, up & diagonal
            if plus & self.top:
                score += 1
            elif minus & self.top:
                score -= 1
            plus = plus << 1 & self.full
            up, down = (minus << 1 | ~(diagonal | plus)) & self.full, plus & diagonal
            if score <= self.budget:
                yield score, at + 1

    def best(self, window: str) -> tuple[int, int, int] | None:
        """(distance, start, end) of the nearest passage in window; the first of equals, and of those the shortest."""
        found = min(self.ends(window, self.masks), default=None)
        if not found:
            return None
        distance, end = found
        head = window[max(0, end - len(self.text) - self.budget) : end][::-1]
        size = min(size for d, size in self.ends(head, self.back) if d == distance)
        return distance, end - size, end


def _in_word(text: str, start: int, end: int) -> bool:
    """Whether a passage begins or ends within a word: letters or digits on both sides of an end of it."""
    return any(text[i - 1 : i].isalnum() and text[i : i + 1].isalnum() for i in (start, end))


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[str, list[int]]], rate: float, short: int = SHORT):
        self.items = [Item(text, ids, rate, short) for text, ids in items]
        hits: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, item in enumerate(self.items):
            for start, piece in item.pieces():
                hits[piece].append((k, start))
        self.automaton = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.automaton.add_word(piece, (len(piece), where))
        if hits:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[Item, int, int, int]]:
        """(item, distance, start, end) of the nearest passage for each item found in a normalised text."""
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (size, where) in self.automaton.iter(text) if self.items else ():
            for k, offset in where:
                starts[k].add(last + 1 - size - offset)
        for k, at in starts.items():
            item, best = self.items[k], None
            n = len(item.text)
            exact = min((s for s in at if s >= 0 and text.startswith(item.text, s) and not (item.whole and _in_word(text, s, s + n))), default=None)
            if exact is not None:
                yield item, 0, exact, exact + n
            if exact is not None or item.whole:
                continue
            reach, low, high = item.budget, None, 0
            for s in [*sorted(at), None]:
                if low is not None and (s is None or s - reach > high):
                    if (got := item.best(text[low:high])) and (best is None or got[0] < best[0]):
                        best = got[0], got[1] + low, got[2] + low
                    low = None
                if s is not None:
                    low = max(0, s - reach) if low is None else low
                    high = s + len(item.text) + reach
            if best:
                yield item, *best


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, list[int]]]]:
    """The items, equal texts once with all their ids, in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    held: dict[str, list[int]] = {}
    size = 0
    for row in items.toLocalIterator():
        text = normal(row.text)
        if not text:
            continue
        size += 64 if text in held else 64 + 4 * len(text)
        held.setdefault(text, []).append(row.item_id)
        if size >= block_bytes:
            yield sorted(held.items())
            held, size = {}, 0
    if held:
        yield sorted(held.items())


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, short: int = SHORT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """SCHEMA's columns: for each row of docs(doc_id, text) and each item of
    benchmark(item_id, text) that it holds, the nearest passage, as code points
    of the text with the end exclusive.

    The items are the stated query set; they go to the executors in blocks of
    bounded size, and each block meets all documents, without a shuffle. An item
    has a budget of error_rate edits a character; one of fewer than short characters
    has none and must stand between word borders. Items without id, text or a
    character besides white space are not looked for; a null text holds nothing. Rows that repeat a doc_id, or lack one, each give
    their own rows; other columns are ignored.
    """
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for block in blocks(benchmark, block_bytes):
        found = found.unionByName(_against(narrow(docs), block, error_rate, short))
    return found


def _against(docs: DataFrame, block: list[tuple[str, list[int]]], rate: float, short: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        matcher = Matcher(sent.value, rate, short)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                if found := list(matcher.find(normal(text))):
                    at = places(text)
                    for item, distance, start, end in found:
                        rows += [(doc, i, distance, at[start], at[end - 1] + 1 if end > start else at[start]) for i in item.ids]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "end"])

        return work

    return map_batches(docs, make, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, short: int = SHORT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of benchmark; no shuffle."""
    for block in blocks(benchmark, block_bytes):
        docs = _without(docs, block, error_rate, short)
    return docs


def _without(docs: DataFrame, block: list[tuple[str, list[int]]], rate: float, short: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        matcher = Matcher(sent.value, rate, short)
        return lambda texts: [next(matcher.find(normal(x)), None) is None for x in texts]

    return keep_rows(docs, make)
