"""Near-duplicates by shingle similarity, against comparing all pairs."""

import random

import numpy as np
import pytest

from tests.llm.test_corpus_operators import ODD_ROWS, ODD_SCHEMA, roots
from textclusters.llm import similar


def shingles(text, width=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_shingle_hashes_are_those_of_the_distinct_shingles():
    rng = random.Random(1)
    texts = ["", "One", "one", "a b c d", "a b c d e", "x " * 50, *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(50))]
    hashes, owner = similar.shingle_hashes(texts, 5)
    own = [set(hashes[owner == i].tolist()) for i in range(len(texts))]
    for i, a in enumerate(texts):
        assert np.count_nonzero(owner == i) == len(shingles(a))
        for j, b in enumerate(texts):
            assert len(own[i] & own[j]) == len(shingles(a) & shingles(b)), (a, b)


def test_fingerprints_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    whole = similar.wide_fingerprints(texts)
    assert all((similar.wide_fingerprints([t])[0] == whole[i]).all() for i, t in enumerate(texts))


def test_blocks_reach_the_recall():
    for n in (1, 1000, 10**9):
        masks = similar.blocks_for(n, 0.8, 0.95)
        sizes = {sum((w & (1 << 64) - 1).bit_count() for w in mask) for mask in masks}
        (size,) = sizes
        agree = (1 - np.arccos(1.6 / 1.8) / np.pi) ** size
        assert 2**size > 4 * n and 1 - (1 - agree) ** len(masks) >= 0.95


@pytest.fixture(scope="module")
def planted():
    """Groups of copies with few edits, copies with many, and texts of their own."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs = []
    for _ in range(12):
        base = fresh(rng.randint(150, 400))
        docs.append(base)
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for k in rng.sample(range(len(copy)), rng.choice([1, 2])):
                copy[k] = "edited"
            docs.append(copy)
        far = list(base)
        for k in range(0, len(far), 7):
            far[k] = fresh(1)[0]
        docs.append(far)
    docs += [fresh(200) for _ in range(60)]
    rng.shuffle(docs)
    return [(i, " ".join(x)) for i, x in enumerate(docs)]


def test_groups_equal_all_pairs(spark, planted):
    rows = spark.createDataFrame(planted, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar.similar_documents(rows).collect()}
    root = roots((a, b) for a, x in planted for b, y in planted if a < b and jaccard(x, y) >= 0.8)
    assert got == {i: root.get(i, i) for i, _ in planted}


def test_links_beyond_the_near_bits_are_verified(spark, planted, monkeypatch):
    monkeypatch.setattr(similar, "NEAR", -1)
    monkeypatch.setattr(similar, "FAR", 120)
    rows = spark.createDataFrame(planted, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_documents(rows, recall=0.9999).collect()}
    root = roots((a, b) for a, x in planted for b, y in planted if a < b and jaccard(x, y) >= 0.8)
    assert got == {i: root.get(i, i) for i, _ in planted}


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in similar.similar_documents(odd).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 3), (3, 3), (3, 3), (4, 4)], key=str)
    kept = similar.drop_similar(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, None], key=str)
    assert similar.similar_documents(odd.limit(0)).count() == 0 and similar.drop_similar(odd.limit(0)).count() == 0


def test_no_link_is_left_out_among_documents_with_much_in_common(spark):
    """Pairs at the threshold that all share most of their words: blocks of bits lose some, and least members hide others."""
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common, docs = fresh(300), []
    for _ in range(120):
        own = fresh(100)
        copy = list(own)
        at = rng.randrange(60)
        copy[at : at + 40] = fresh(40)
        docs += [common + own, common + copy]
    rng.shuffle(docs)
    docs = [(i, " ".join(x)) for i, x in enumerate(docs)]
    sets = [shingles(x) for _, x in docs]
    root = roots((a, b) for a in range(len(docs)) for b in range(a + 1, len(docs)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sum(i != r for i, r in root.items()) == 120
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: root.get(i, i) for i, _ in docs}


def test_two_similar_sets_share_one_of_their_first_shingles():
    rng = np.random.default_rng(5)
    ranks = rng.permutation(1 << 16).astype(np.uint64)
    for n in (1, 2, 4, 5, 9, 10, 50, 333):
        least = similar.least_common(n, 0.8)
        assert least - 1 < 0.8 * n <= least
        a = rng.integers(1, 1 << 63, n).astype(np.uint64)
        b = a[rng.permutation(n)[:least]]
        first, ends = similar.first_shingles(np.concatenate([a, b]), np.array([0, n, n + least]), ranks, 0.8)
        assert set(first[: ends[1]].tolist()) & set(first[ends[1] :].tolist())


def test_edited_copies_that_do_not_link_are_not_paired(spark):
    """A group of copies with an edit each, too short to link: a square of pairs before, none now."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(34)]
    docs = [(i, " ".join([*base[:15], f"e{i}", *base[16:]])) for i in range(100)]
    docs += [(100 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(34))) for i in range(20)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    ranks = similar._slot_ranks(rows, 5)
    hashes, owner = similar.shingle_hashes([t for _, t in docs], 5)
    bounds = np.searchsorted(owner, np.arange(len(docs) + 1))
    first, ends = similar.first_shingles(hashes, bounds, ranks, 0.8)
    each = spark.createDataFrame([(i, int(bounds[i + 1] - bounds[i]), first[ends[i] : ends[i + 1]].view(np.int64).tolist()) for i, _ in docs], "node long, n long, shingles array<long>")
    none = spark.createDataFrame([], "node long, root long")
    assert similar._meeting(each, none, 0.8).count() == 0 and similar._left_out(each, none, 0.8).count() == 0
    assert all(r.doc_id == r.component_id for r in similar.similar_documents(rows).collect())


def test_pairs_that_share_a_shingle_too_late_are_not_paired(spark):
    """What comes after the one shingle that they share, in one of them, is too little."""
    pair = lambda at: [(1, 100, list(range(1, 22))), (2, 100, [*range(100, 100 + at), 1, *range(200, 220 - at)])]
    none = spark.createDataFrame([], "node long, root long")
    met = lambda at: similar._meeting(spark.createDataFrame(pair(at), "node long, n long, shingles array<long>"), none, 0.8).collect()
    # 89 of 100 must be shared.
    assert [(r.a, r.b) for r in met(11)] == [(1, 2)] and met(12) == []


def test_texts_are_filtered_before_they_are_joined(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)] + [(50, "text 3")], "version long, text string").selectExpr("(version % 50) * 1234567890123 - 7 AS version", "text")
    docs = docs.where("text <> 'text 3' OR version = 3 * 1234567890123 - 7")
    each = spark.createDataFrame([(100 + k, k * 1234567890123 - 7) for k in range(50)], "node long, version long")
    pairs = spark.createDataFrame([(103, 104), (104, 149)], "a long, b long")
    assert sorted(tuple(r) for r in similar._texts(docs, each, pairs).collect()) == [(103, "text 3"), (104, "text 4"), (149, "text 49")]


def test_few_rows_are_shuffled_to_find_those_of_few_keys(spark):
    """All rows that were exploded from shingles were shuffled for this join before."""
    rows = spark.range(100_000).selectExpr("xxhash64(id) AS shingle", "id AS node")
    keys = rows.where("node % 1000 = 7").select("shingle")
    assert 100 <= similar._passing(rows, keys, "shingle").count() < 300
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = similar._of_keys(rows, keys, "shingle")
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert sorted(r.node for r in found.collect()) == list(range(7, 100_000, 1000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # The filter lies below the join that needs a shuffle.
    assert plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")


def test_joins_do_not_shuffle_texts_again(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "version long, text string")
    each = spark.createDataFrame([(100 + k, k) for k in range(50)], "node long, version long")
    pairs = spark.createDataFrame([(103, 104), (104, 149)], "a long, b long")
    texts = similar._texts(docs, each, pairs)
    plan = pairs.join(texts.hint("merge").withColumnRenamed("node", "a"), "a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan


def test_documents_that_stay_are_not_shuffled(spark):
    """All documents were shuffled to leave out a few, where these were too many to be broadcast."""
    docs = spark.createDataFrame([(k if k % 50 else None, f"t{k}") for k in range(2000)], "doc_id long, text string")
    gone = spark.createDataFrame([(k,) for k in range(3, 2000, 100)], "doc_id long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = similar._without_keys(docs, gone, "doc_id")
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        got = sorted(r.text for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert kept.columns == docs.columns and got == sorted(f"t{k}" for k in range(2000) if k % 50 == 0 or k % 100 != 3)
    # The anti join has a filter below it.
    assert plan.index("LeftAnti") < plan.rindex("BroadcastHashJoin")
