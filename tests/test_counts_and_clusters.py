"""Counts, vocabulary, affinities and clusters on small hand-made sentences."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textclusters.operators import brown, counts, pmi


def paths(spark, *rows):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "sid long, words array<string>")


def pairs(df):
    return {(r.prev, r.curr): r.cnt for r in df.collect()}


def test_empty_path_counts_once(spark):
    rows = paths(spark, [])
    assert pairs(counts.bigram_counts(rows)) == {("BOS", "EOS"): 1}
    assert {r.word: r.cnt for r in counts.unigram_counts(rows).collect()} == {"BOS": 1, "EOS": 1}


def test_sentinel_inside_is_skipped(spark):
    assert pairs(counts.bigram_counts(paths(spark, ["a", "EOS", "b"]))) == {("BOS", "a"): 1, ("a", "b"): 1, ("b", "EOS"): 1}


def test_null_words_are_an_empty_path(spark):
    rows = spark.createDataFrame([(None,), (["a", None],)], "words array<string>")
    assert pairs(counts.bigram_counts(rows)) == {("BOS", "EOS"): 1, ("BOS", "a"): 1, ("a", "EOS"): 1}


def test_vocabulary_ties_by_word(spark):
    vocab = counts.vocabulary(counts.unigram_counts(paths(spark, ["b", "a", "c", "c"])), 1, 2)
    assert [(r.word, r.rank) for r in vocab.orderBy("rank").collect()] == [("c", 1), ("a", 2)]


def test_frequency_cut_drops_pairs(spark):
    rows = paths(spark, ["a", "a", "a", "b"])
    vocab = counts.vocabulary(counts.unigram_counts(rows), 3, 10)
    kept = counts.filtered_bigrams(counts.bigram_counts(rows), vocab)
    assert pairs(kept) == {("BOS", "a"): 1, ("a", "a"): 2}
    assert counts.bigram_mass(kept).first().n == 3.0


def test_empty_table(spark):
    rows = spark.createDataFrame([], "words array<string>")
    assert counts.bigram_counts(rows).count() == 0
    assert brown.brown_cluster(rows, 2, 1).count() == 0


def test_few_words_are_their_own_clusters(spark):
    got = {r.word: r.cluster for r in brown.brown_cluster(paths(spark, ["a", "b"]), 5, 1).collect()}
    assert got == {"a": 1, "b": 2, "BOS": 0, "EOS": 0}


@pytest.mark.parametrize("n", [0, 65536])
def test_cluster_ids_have_16_bits(spark, n):
    with pytest.raises(ValueError):
        brown.brown_cluster(paths(spark, ["a"]), n)


def greedy(rows, n_clusters, min_freq, max_vocab):
    """The assignment by loops over all clusters and members."""
    uni, bi = Counter(), Counter()
    for words in rows:
        prev = "BOS"
        for w in words:
            uni[w] += 1
            bi[prev, w] += 1
            prev = w
        bi[prev, "EOS"] += 1
    vocab = sorted((w for w in uni if uni[w] >= min_freq), key=lambda w: (-uni[w], w))[:max_vocab]
    known = {*vocab, "BOS", "EOS"}
    bi = {k: c for k, c in bi.items() if k[0] in known and k[1] in known}
    total = float(sum(bi.values()))
    members = [[w] for w in vocab[:n_clusters]]
    for w in vocab[n_clusters:]:
        scores = []
        for group in members:
            score = 0.0
            for m in group:
                for pair in ((w, m), (m, w)):
                    if c := bi.get(pair, 0):
                        score += c * math.log(c * total / (float(uni[w]) * uni[m]))
            scores.append(score)
        members[scores.index(max(scores))].append(w)
    return {w: i + 1 for i, group in enumerate(members) for w in group} | {"BOS": 0, "EOS": 0}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_loops_in_any_order_of_rows(spark, seed):
    rng = random.Random(seed)
    rows = [[rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 6))] for _ in range(30)]
    want = greedy(rows, 4, 1, 10)
    for part in (1, 3):
        got = brown.brown_cluster(paths(spark, *rng.sample(rows, len(rows))).repartition(part), 4, 1, 10)
        assert {r.word: r.cluster for r in got.collect()} == want


def test_groups_are_clustered_on_their_own(spark):
    rows = spark.createDataFrame([("x", ["a", "b"]), ("y", ["b", "b", "c"])], "grp string, words array<string>")
    got = {(r.grp, r.word): r.cluster for r in brown.brown_cluster(rows, 2, 1, group_col="grp").collect()}
    assert got == {("x", "a"): 1, ("x", "b"): 2, ("y", "b"): 1, ("y", "c"): 2, **{(g, s): 0 for g in "xy" for s in ("BOS", "EOS")}}


def test_zero_of_an_untouched_cluster_beats_a_negative(spark):
    words = spark.createDataFrame([("w",), ("free",)], "word string")
    scores = spark.createDataFrame([("w", 1, -2.0)], "word string, cluster int, score double")
    got = {r.word: r.cluster for r in pmi.nearest_cluster(words, scores, 3).collect()}
    assert got == {"w": 2, "free": 1}


def test_lookup_of_unknown_words(spark):
    clusters = spark.createDataFrame([("a", 3)], "word string, cluster int")
    tokens = spark.createDataFrame([("a", "x"), ("q", "y"), (None, "z")], "word string, note string")
    assert {r.note: r.cluster for r in brown.get_cluster(tokens, clusters).collect()} == {"x": 3, "y": 0, "z": 0}


def test_sizes_and_mass(spark):
    clusters = brown.with_sentinels(spark.createDataFrame([("a", 1), ("b", 1)], "word string, cluster int"))
    unigrams = spark.createDataFrame([("a", 2), ("b", 5), ("BOS", 1), ("EOS", 1)], "word string, cnt long")
    assert {r.cluster: r.n_words for r in brown.cluster_sizes(clusters).collect()} == {0: 2, 1: 2}
    assert {r.cluster: r.mass for r in brown.cluster_mass(clusters, unigrams).collect()} == {0: 2.0, 1: 7.0}


def test_weighted_pmi(spark):
    rows = paths(spark, ["a", "b"], ["a", "b"])
    bigrams, unigrams = counts.bigram_counts(rows), counts.unigram_counts(rows)
    got = pmi.weighted_pmi(bigrams, unigrams, counts.bigram_mass(bigrams)).where(F.col("prev") == "a").first()
    assert got.wpmi == pytest.approx(2 * math.log(2 * 6 / 4))
