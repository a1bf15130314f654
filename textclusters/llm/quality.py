"""Quality rules on whole documents, with repetition measured by suffix arrays.

The words of a batch of documents make one sequence in which equal words of
different documents count as different, so that no repeat spans two documents.
Its suffix array comes from prefix doubling over numpy arrays: ranks by the first
word, by two, by four, ..., where only suffixes that still tie are sorted again.
The longest common prefix of neighbours in the array, read off the ranks of each
round, bounds the longest repeat that starts at each word; the union of those of
at least min_repeat words is what maximal repeated substrings cover.
"""

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textclusters.llm.shared import keep_rows, map_batches, narrow, texts_of

#: Words below which a document fails, and the share of words in repeated three-word windows beyond which it does.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Repeats count from this many words on; limits on what they cover and on the longest. Five words are what
#: published rules start from; a fifth of the words leaves nearly all documents alone that are labelled good.
MIN_REPEAT, MAX_COVERED_PERCENT, MAX_LONGEST = 5, 20, 100
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def suffix_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until no two tie.

    A rank is the number of suffixes that come before; the last array's order is
    the suffix array. Each has a last entry of -1 for the empty suffix.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    heads = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.repeat(heads, np.diff(np.r_[heads, n]))
    levels, k, open_ = [rank], 1, np.arange(n)
    while len(open_):
        count = np.bincount(rank[open_], minlength=n)
        open_ = open_[count[rank[open_]] > 1]
        if not len(open_):
            break
        after = rank[np.minimum(open_ + k, n)]
        by = np.argsort(rank[open_] * np.int64(n + 1) + after + 1, kind="stable")
        open_, after = open_[by], after[by]
        old = rank[open_]
        first = np.r_[True, old[1:] != old[:-1]]
        fresh = first | np.r_[True, after[1:] != after[:-1]]
        place = np.arange(len(open_))
        start = np.maximum.accumulate(np.where(first, place, 0))
        head = np.maximum.accumulate(np.where(fresh, place, 0))
        rank = rank.copy()
        rank[open_] = old + head - start
        levels.append(rank)
        k *= 2
    return levels


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest string from there that occurs elsewhere too."""
    n = len(ids)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    levels = suffix_ranks(ids)
    order = np.argsort(levels[-1][:n], kind="stable")
    a, b = order[:-1], order[1:]
    tied = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b, length = a[tied], b[tied], np.zeros(len(tied), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + length, n)] == levels[k][np.minimum(b + length, n)]
        same &= b + length < n
        same &= a + length < n
        length[same] += 1 << k
    np.maximum.at(best, a, length)
    np.maximum.at(best, b, length)
    return best


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans cover."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


def _window_words(ids: np.ndarray, size: int = 3) -> np.ndarray:
    """Which places lie in a window of three symbols that occurs more than once."""
    m = len(ids) - size + 1
    if m < 2:
        return np.zeros(len(ids), bool)
    key = ids[:m]
    for k in range(1, size):
        key = np.unique(key * (ids.max() + 1) + ids[k : k + m], return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(key)[key] > 1)
    return _covered(twice, np.full(len(twice), size), len(ids))


def measures(texts: list[str], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The measures of SCHEMA for each text, without the verdicts."""
    ids, counts, dup, base = [], [], [], 0
    for text in texts:
        raw = text.encode("utf-8", "replace")
        own: dict[bytes, int] = {}
        words = raw.split()
        ids.append([own.setdefault(w, base + len(own)) for w in words])
        counts.append(len(words))
        base += len(own)
        lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
        dup.append(len(lines) - len(set(lines)))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(counts))
    ends = np.cumsum([0, *counts])
    total = lambda marks: np.diff(np.r_[0, np.cumsum(marks)][ends])
    best = longest_repeats(flat)
    long = np.flatnonzero(best >= min_repeat)
    owner = np.repeat(np.arange(len(texts)), counts)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner, best)
    return {
        "n_words": np.array(counts, np.int64),
        "word_chars": np.array([len(t) - sum(map(t.count, _SPACES)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, _SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": total(_window_words(flat)),
        "covered_words": total(_covered(long, best[long], len(flat))),
        "longest_repeat": longest,
    }


def verdicts(texts: list[str], min_repeat: int, max_covered_percent: int, max_longest: int) -> dict[str, np.ndarray]:
    """The measures of each text with base_failed and kept."""
    got = measures(texts, min_repeat)
    failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
    kept = ~failed & (100 * got["covered_words"] <= max_covered_percent * got["n_words"]) & (got["longest_repeat"] <= max_longest)
    return got | {"base_failed": failed, "kept": kept}


def quality(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST) -> DataFrame:
    """SCHEMA's columns for every row of docs(doc_id, text).

    base_failed: fewer than 50 words, or over half of the words in three-word
    windows that the text has twice or more. kept: not base_failed, and repeats
    of at least min_repeat words cover at most max_covered_percent of the words,
    and none is longer than max_longest words. A null text has no words and
    fails. Limits are exclusive: what equals a limit is kept. Rows that repeat a
    doc_id and rows without one each get their row; other columns are ignored. No
    shuffle; a suffix array is made over documents of about 4 MB together, or over
    one longer text, at some 100 bytes a word.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = verdicts(texts_of(batch), min_repeat, max_covered_percent, max_longest)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[name]) for name in columns[1:])], names=columns)

        return work

    columns = [column.split()[0] for column in SCHEMA.split(", ")]
    return map_batches(narrow(docs), make, SCHEMA)


def keep_good(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of docs, with all their columns, that quality() keeps; no shuffle.

    Rows with a null text go; rows that repeat a doc_id, or lack one, are each judged.
    """
    return keep_rows(docs, lambda: lambda texts: verdicts(texts, min_repeat, max_covered_percent, max_longest)["kept"].tolist())
