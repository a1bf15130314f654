"""Byte-level BPE by tree reduction: halves are encoded, neighbours are joined.

The ids of two neighbouring pieces of a text do not simply add up: the split
pattern and the merges may cross the cut. A join re-encodes a window around the
cut and grows it until the tokens outside are final:

* Between pieces of ordinary text the window grows to places where a character
  that is no white space is followed by white space (or an end of the text). No
  match of the pattern contains such a place: a blank can only open a match, other
  white space only matches white space. What lies left of it matches the same way
  with or without what follows (each alternative is greedy and would stop there
  anyway, and the one that looks ahead looks past white space only); matching has
  no look-behind, so the right side matches as a text of its own; and merges never
  leave a match.
* A passage without such a place for long (a run of white space, then a run of
  other characters) is read match by match, and a match of any length is cut too.
  Inside a match the window grows by tokens until both pairs of tokens at its edges
  are stable, that is, until the two tokens' bytes encode to these two tokens. A row
  of tokens of which each two neighbours are stable is the encoding of its bytes, as
  each merge across any border would have come before what was merged beside it.

So every join works on a window, whatever the size of its sides, and joining is
associative. Decoding maps ids to bytes, and the bytes concatenate up the same tree.
"""

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from textclusters.llm.shared import map_batches, narrow, texts_of

#: Characters below which a piece is encoded at once; leaves to a passage that counts as unbroken.
LEAF, UNBROKEN = 2048, 4
#: Unicode's White_Space, which is what \s means in the split pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_GAP = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> tuple[tiktoken.Encoding, dict[bytes, int], tuple[bytes, ...]]:
    """The encoder of a rank file, its ranks and the bytes of each id; loaded once a worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks, tuple(pieces)


def merged(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match: the pair of the least rank is merged, the leftmost of equals, while there is one."""
    end = list(range(1, len(data) + 1))
    before = list(range(-1, len(data) - 1))
    alive = [True] * len(data)
    heap = []

    def offer(at: int) -> None:
        if end[at] < len(data) and (rank := ranks.get(data[at : end[end[at]]])) is not None:
            heapq.heappush(heap, (rank, at, end[end[at]]))

    for at in range(len(data)):
        offer(at)
    while heap:
        _, at, stop = heapq.heappop(heap)
        if not alive[at] or end[at] == len(data) or end[end[at]] != stop:
            continue
        alive[end[at]], end[at] = False, stop
        if stop < len(data):
            before[stop] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    return [ranks[data[at : end[at]]] for at in range(len(data)) if alive[at]]


class TreeEncoder:
    """Encodes and decodes whole texts by recursion over halves."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        self.encoding, self.ranks, self.pieces = vocabulary(path, pattern)
        self.sizes = np.array([len(x) for x in self.pieces])
        self.matches = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.leaf, self.stable = max(1, leaf), {}

    def _leaf(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def _halves(self, start: int, end: int, leaf, join) -> list[np.ndarray]:
        """Ids, in arrays of bounded size, of what lies from start to end; cuts lie whole leaves from its start."""
        if end - start <= self.leaf:
            return [leaf(start, end)]
        middle = start + self.leaf * (-(-(end - start) // self.leaf) // 2)
        return join(self._halves(start, middle, leaf, join), self._halves(middle, end, leaf, join), start, middle, end)

    def _drop_tail(self, parts: list[np.ndarray], n: int) -> None:
        """Take the ids of the last n bytes off."""
        while n > 0:
            sizes = np.cumsum(self.sizes[parts[-1][::-1]])
            if len(sizes) and sizes[-1] > n:
                parts[-1] = parts[-1][: -int(np.searchsorted(sizes, n)) - 1]
                return
            n -= int(sizes[-1]) if len(sizes) else 0
            parts.pop()

    def _ordinary(self, text: str) -> list[np.ndarray]:
        """Ids of a text whose stable places are at most UNBROKEN leaves apart."""

        def join(left, right, start, middle, end):
            a = middle
            while a > start and not (a < end and text[a] in WHITE and text[a - 1] not in WHITE):
                a -= 1
            if a == middle:
                return left + right
            gap = _GAP.search(text, middle + 1, end)
            b = gap.start() if gap else end
            self._drop_tail(left, len(text[a:middle].encode("utf-8", "replace")))
            right.reverse()
            right = [x[::-1] for x in right]
            self._drop_tail(right, len(text[middle:b].encode("utf-8", "replace")))
            return [*left, self._leaf(text[a:b]), *(x[::-1] for x in reversed(right))]

        return self._halves(0, len(text), lambda a, b: self._leaf(text[a:b]), join)

    def _is_stable(self, a: int, b: int) -> bool:
        if (a, b) not in self.stable:
            self.stable[a, b] = merged(self.pieces[a] + self.pieces[b], self.ranks) == [a, b]
        return self.stable[a, b]

    def _match(self, text: str) -> list[np.ndarray]:
        """Ids of a text that is one match of the pattern."""

        def join(left, right, start, middle, end):
            i = j = 4
            while True:
                own, their = _taken(left, i, True), _taken(right, j, False)
                window = merged(self.decode(own[-i:] + their[:j]), self.ranks)
                ok_left = len(own) <= i or self._is_stable(own[-i - 1], window[0])
                ok_right = len(their) <= j or self._is_stable(window[-1], their[j])
                if ok_left and ok_right:
                    break
                i, j = i if ok_left else 2 * i, j if ok_right else 2 * j
            _cut(left, min(i, len(own)), True)
            _cut(right, min(j, len(their)), False)
            return [*left, np.array(window, np.uint32), *right]

        return self._halves(0, len(text), lambda a, b: self._leaf(text[a:b]), join)

    def _passage(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a passage without a stable place inside: short matches together, white
        space (which looks ahead) match by match, long matches by halves."""
        at = upto = 0
        for match in self.matches.finditer(text):
            start, end = match.span()
            alone = end - start > self.leaf or text[start] in WHITE and text[end - 1] in WHITE
            if alone or end - at > self.leaf:
                yield self._leaf(text[at:upto])
                at = start
            if alone:
                yield from self._match(text[start:end])
                at = end
            upto = end
        yield self._leaf(text[at:upto])

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self._leaf(text)
        parts, at, last = [], 0, 0
        for place in (*(gap.start() for gap in _GAP.finditer(text)), len(text)):
            if place - last > UNBROKEN * self.leaf:
                parts += self._ordinary(text[at:last])
                parts += self._passage(text[last:place])
                at = place
            last = place
        return np.concatenate(parts + self._ordinary(text[at:]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def _taken(parts: list[np.ndarray], n: int, tail: bool) -> list[int]:
    """The last n + 1 ids, or the first, or as many as there are."""
    found: list[int] = []
    for part in reversed(parts) if tail else parts:
        found = part[-n - 1 :].tolist() + found if tail else found + part[: n + 1].tolist()
        if len(found) > n:
            break
    return found[-n - 1 :] if tail else found[: n + 1]


def _cut(parts: list[np.ndarray], n: int, tail: bool) -> None:
    """Take n ids off the end, or off the start."""
    while n:
        k = -1 if tail else 0
        if len(parts[k]) > n:
            parts[k] = parts[k][:-n] if tail else parts[k][n:]
            return
        n -= len(parts.pop(k))


def encode_documents(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded binary) for every row of docs(doc_id, text).

    A null or empty text has no ids. Rows that repeat a doc_id and rows without
    one each get their row; other columns are ignored. No shuffle; a very long
    text is one row's work, in time proportional to its length, at a depth
    logarithmic in it.
    """

    def make():
        encoder = TreeEncoder(path, pattern, leaf)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [encoder.encode(x) for x in texts_of(batch)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32)
            decoded = [encoder.decode(x.tolist()) for x in ids]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

        return work

    return map_batches(narrow(docs), make, "doc_id long, n_tokens long, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what encode_documents returns,
    made in the tasks that encode, so that ids and bytes do not travel."""

    def make():
        encoder = TreeEncoder(path, pattern, leaf)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, of_ids, of_bytes = [], [], []
            for text in texts_of(batch):
                ids = encoder.encode(text)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(encoder.decode(ids.tolist())).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return map_batches(narrow(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
