"""Periodic runs, against looking at every period of every text."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.test_corpus_operators import ODD_ROWS, ODD_SCHEMA, split
from textclusters.llm import periods, registry


def plain_runs(words):
    """All runs, period by period."""
    n, found, seen = len(words), [], set()
    for q in range(1, n // 4 + 1):
        lo = None
        for i in range(n - q + 1):
            if i < n - q and words[i] == words[i + q]:
                lo = i if lo is None else lo
            elif lo is not None:
                length = i - lo + q
                # With a smaller period the whole stretch would have been found before.
                if length >= max(6, 4 * q) and not any(s <= lo and lo + length <= s + m and q % p == 0 for s, m, p in seen):
                    found.append((lo, length, q))
                    seen.add((lo, length, q))
                lo = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randint(0, 200))]
    if kind == 1:
        return ["a"] * rng.randint(0, 300)
    words = []
    while len(words) < rng.choice([20, 200, 500]):
        root = [rng.choice("abcdef") for _ in range(rng.randint(1, rng.choice([3, 8, 60])))]
        words += (root * rng.randint(1, 9))[: rng.randint(1, 400)]
        words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
    return words


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return [some_words(rng) for _ in range(150)]


def test_whole_texts(texts):
    for words in texts:
        ids = np.array([ord(w) for w in words], np.int64)
        got = periods._as_runs(set(periods.fragments(ids, 0, periods._octave(len(words)), 0, len(words))))
        assert got == plain_runs(words), words


def test_query_steps_do_not_depend_on_tiles(spark, texts, monkeypatch):
    rows = [(i, rng_space(i).join(words)) for i, words in enumerate(texts)]
    rows += [(1000 + i, t) for i, t in rows[:20]]
    want = {i: (len(split(t)), plain_runs(split(t)), plain_collapse(split(t), plain_runs(split(t)))) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def got():
        return {r.doc_id: (r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs).collect()}

    assert got() == want
    for octave, core in ((0, 4), (2, 16), (3, 64)):
        monkeypatch.setattr(periods, "ONE_TILE", 10)
        monkeypatch.setattr(periods, "SHORT_OCTAVE", octave)
        monkeypatch.setattr(periods, "CORE", core)
        assert got() == want


def rng_space(i):
    return [" ", "\n", " \t", "\r\n "][i % 4]


def test_query_by_loops(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 150)))) for i in range(120)] + [(500, None), (501, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.op12_periods(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in rows:
        words = split(text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            planted += 1
        runs = plain_runs(words)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        told = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
        row = got[i]
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (len(runs), *told)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
    assert planted > 5 and len(got) == len(rows)


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(odd).collect()), key=str)
    same = (3, 3, [], "a b c")
    assert got == sorted([(1, 0, [], ""), (2, 0, [], ""), (None, 3, [], "a b c"), same, same, (4, 40_000, [(0, 40_000, 1)], "long")], key=str)
    assert periods.periodic_runs(odd.limit(0)).count() == 0
