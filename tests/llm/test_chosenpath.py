"""The chosen-path join, against comparing all pairs."""

import random

import numpy as np
import pytest

from tests.llm.test_corpus_operators import ODD_ROWS, ODD_SCHEMA, lower, roots, split
from textclusters.llm import chosenpath


def shingles(text):
    words = split(lower(text or ""))
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {tuple(words)} if words else set()


def components(docs):
    """(n_shingles, component_id, kept) of each document, by all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(linked)
    return {i: (len(s), root.get(i, i), root.get(i, i) == i) for i, s in sets.items()}


@pytest.fixture(scope="module")
def planted():
    """Copies with few and with more edits, a crowd around one text, short texts, exact copies."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]

    def edited(base, share):
        return [w if rng.random() > share else fresh(1)[0] for w in base]

    texts = []
    for _ in range(25):
        base = fresh(rng.randint(20, 300))
        texts += [base, base, edited(base, 0.02), edited(base, 0.05), edited(edited(base, 0.04), 0.04)]
    crowd = fresh(150)
    texts += [crowd, *(edited(crowd, rng.choice([0.01, 0.03, 0.05, 0.06])) for _ in range(150))]
    texts += [fresh(n) for n in range(6) for _ in range(4)] + [["a"], ["A"], ["a", "b"], ["a", "b", "a", "b"], [], []]
    rng.shuffle(texts)
    return [(i, " ".join(x)) for i, x in enumerate(texts)]


def found(rows):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in chosenpath.similar_sets(rows).collect()}


def test_components_equal_all_pairs(spark, planted):
    assert found(spark.createDataFrame(planted, "doc_id long, text string").repartition(3)) == components(planted)


@pytest.mark.parametrize("depth", [1, 4])
def test_crowded_nodes_are_branched_and_large_groups_led(spark, planted, monkeypatch, depth):
    monkeypatch.setattr(chosenpath, "LEAF", 8)
    monkeypatch.setattr(chosenpath, "BLOCK", 8)
    monkeypatch.setattr(chosenpath, "LEADERS", 3)
    monkeypatch.setattr(chosenpath, "DEPTH", depth)
    assert found(spark.createDataFrame(planted, "doc_id long, text string")) == components(planted)


def test_heavy_blocks_are_parted(spark, planted, monkeypatch):
    monkeypatch.setattr(chosenpath, "WEIGHT", 2000)
    assert found(spark.createDataFrame(planted, "doc_id long, text string")) == components(planted)


def test_minwise_tokens_estimate_the_similarity_and_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    hashes, starts = np.concatenate([common, own[:100], common, own[100:]]), np.array([0, 900])
    tokens = chosenpath.minwise(hashes, starts)
    assert abs((tokens[0] == tokens[1]).mean() - 0.8) < 0.15
    monkeypatch.setattr(chosenpath, "_PIECE", 7)
    assert (chosenpath.minwise(hashes, starts) == tokens).all()


def test_intersections():
    rng = random.Random(2)
    sets = [set(rng.sample(range(60), rng.randint(0, 40))) for _ in range(12)]
    hashes = np.array([x for s in sets for x in s], np.uint64)
    owner = np.array([i for i, s in enumerate(sets) for _ in s])
    got = chosenpath.common_counts(hashes, owner, len(sets))
    assert all(got[i, j] == len(a & b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_trees_reach_the_recall():
    rng = np.random.default_rng(3)
    met = np.ones(20_000)
    for _ in range(5):
        # Children of the pair's nodes, drawn one by one.
        draws = rng.binomial(met.astype(int), 0.25) + met.astype(int)
        met = rng.binomial(draws, 0.8)
    assert abs((met > 0).mean() - chosenpath.survival(5, 0.8)) < 0.02
    assert 1 - (1 - chosenpath.survival(chosenpath.DEPTH, 0.8)) ** chosenpath.trees_for(0.995, chosenpath.DEPTH, 0.8) >= 0.995


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in chosenpath.similar_sets(odd).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (4, 1, 4, True)], key=str)
    assert chosenpath.similar_sets(odd.limit(0)).count() == 0
