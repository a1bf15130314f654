"""Ranked search, against scoring every document for every query."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_corpus_operators import ODD_ROWS, ODD_SCHEMA, lower
from textclusters.llm import search


def terms(text):
    return re.findall(search.TERM, lower(text or ""))


def plain_ranking(docs, items, k):
    """{item: [(rank, doc_id, score)]} by the formula, document by document."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    total, docs_in = sum(sum(c.values()) for _, c in held), sum(1 for _, c in held if c)
    df = Counter(t for _, c in held for t in c)
    out = {}
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * docs_in) // max(total, 1)
            score = 0
            for t, times in asked.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * docs_in + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, i))
        out[item] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(40_000)] + ["Ä", "é-x", "A_b"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 30, 200])))) for i in range(900)]
    docs += [(1000 + i, t) for i, t in docs[:60]] + [(5000, None), (5001, "?!")]
    items = [(i, ", ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(60)] + [(90, None), (91, "..."), (92, "nowhere"), (93, "w1 " * 400)]
    return docs, items


def found(spark, docs, items, k):
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = search.search(search.build_index(rows), spark.createDataFrame(items, "item_id long, text string"), k)
    ranked: dict = {}
    for r in sorted(got.collect(), key=lambda r: (r.item_id, r.rank)):
        ranked.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return ranked


@pytest.mark.parametrize("sizes", [{}, {"SHARD_BYTES": 20_000, "BLOCK": 2, "_STRETCH": 4}, {"BLOCK": 7, "_STRETCH": 1, "QUERY_BYTES": 100}])
def test_ranking_equals_scoring_all(spark, corpus, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(search, name, value)
    for k in (1, 20):
        want = {item: rows for item, rows in plain_ranking(*corpus, k).items() if rows}
        assert found(spark, *corpus, k) == want


def test_packing():
    rng = np.random.default_rng(1)
    values = np.r_[0, 1, 127, 128, 16383, 16384, 2**40, rng.integers(0, 2**20, 500)]
    data, ends = search.packed(values)
    assert (search.unpacked(data) == values).all() and ends[-1] == len(data)
    assert (search.unpacked(data[ends[2] : ends[5]]) == values[3:6]).all()


def test_blocks_that_cannot_win_stay_packed():
    m = np.full(100_000, 100)
    rows = []
    for docs, w in ((np.arange(0, 100_000, 2), 10), (np.array([1, 50_000, 99_999]), 10_000)):
        last = np.r_[docs[search.BLOCK - 1 :: search.BLOCK], docs[-1:]][: -(-len(docs) // search.BLOCK)]
        parts = [docs[i : i + search.BLOCK] for i in range(0, len(docs), search.BLOCK)]
        data = [search.packed(np.stack([np.diff(p, prepend=0), np.ones(len(p), np.int64)], axis=1).ravel())[0] for p in parts]
        n = len(parts)
        rows.append({"last": last, "most": [1] * n, "shortest": [100] * n, "ends": np.cumsum([len(x) for x in data]), "data": b"".join(x.tobytes() for x in data), "w": w})
    lists = [search._List(r, lambda n: n) for r in rows]
    docs, scores = search.best([(x.weight, x) for x in lists], m, 2)
    assert docs.tolist() == [50_000, 1] and scores[0] > scores[1]
    # The common term is essential in the first stretch only; later one of its blocks is unpacked, for document 50,000.
    assert len(lists[0].open) < 12


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)
    items = spark.createDataFrame([(7, "b c", 1), (7, "long", 2), (None, "A", 3), (8, None, 4)], "item_id long, text string, rank int")
    got = sorted((r.item_id or 0, r.rank, r.doc_id or 0) for r in search.search(search.build_index(odd), items).collect())
    assert got == [(0, 1, 3), (0, 2, 3), (0, 3, 0), (7, 1, 3), (7, 1, 4), (7, 2, 3), (7, 3, 0)]
    assert search.search(search.build_index(odd.limit(0)), items).count() == 0
    assert search.search(search.build_index(odd), items.limit(0)).count() == 0


def test_making_a_shard_takes_few_bytes_for_a_term():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"t{k}" for k in rng.integers(0, 20_000, 200)) for _ in range(1000)]
    shard = search._Shard()
    shard.add(pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts}))
    tracemalloc.start()
    try:
        assert sum(x.num_rows for x in shard.rows(0)) == 1 + len(shard.known)
        assert tracemalloc.get_traced_memory()[1] < 140 * 200_000
    finally:
        tracemalloc.stop()
