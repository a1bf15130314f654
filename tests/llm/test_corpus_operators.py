"""Operators that compare documents, against plain versions of themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from textclusters.llm import components, linededup, lmscore, simhash, substrings, urlfilter
from textclusters.llm.registry import op3_urlfilter  # noqa: F401

ODD_ROWS = [(1, None, "x", 5), (2, "", "x", 5), (None, "a b c", None, None), (3, "a b c", "x", 5), (3, "a b c", "x", 5), (4, "long " * 40_000, "x", 5)]
ODD_SCHEMA = "doc_id long, text string, version string, first int"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def roots(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(70)] + [(300, 300 + i) for i in range(1, 40)]
    rows = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = {r.node: r.root for r in components.connected_components(rows).collect()}
    assert got == {x: r for x, r in roots(pairs).items() if x != r}
    assert components.connected_components(rows.limit(0)).count() == 0


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def plain_fingerprint(text):
    words = split(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ("", "One two", "a", "One two three four one two three", "x " * 500, "Ä É\xa0b\u3000C ÀB\x1cD İx ß", " \t\n"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("tile", [2, 1024])
def test_links_equal_all_pairs(spark, tile):
    rng = random.Random(4)
    near = [rng.getrandbits(64) for _ in range(6)]
    fps = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for x in near for _ in range(12)} | {rng.getrandbits(64) for _ in range(40)} | {0}
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    rows = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = roots((r.a, r.b) for r in simhash.links(rows, tile).collect())
    want = roots((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert got == want


def test_near_duplicates_odd_rows(odd, empty):
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 3), (3, 3), (3, 3), (4, 4)], key=str)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, None], key=str)


def plain_line_dedup(docs, min_lines=2, min_words=10):
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines = text.split("\n")
        own = [k for k, x in enumerate(lines) if x.strip(" \t\n\r\v\f")]
        gone = set()
        for k in range(len(own)):
            run = tuple(lines[j] for j in own[k : k + min_lines])
            if len(run) == min_lines:
                if run in seen:
                    gone |= set(range(k, k + min_lines))
                seen.add(run)
            one = lines[own[k]]
            if one in seen and len(one.split()) >= min_words:
                gone.add(k)
            seen.add(one)
        out[i] = (len(own), len(gone), sum(k - 1 not in gone for k in gone), "\n".join(x for j, x in enumerate(lines) if j not in {own[k] for k in gone}))
    return out


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_dedup_equals_loops(spark, min_lines):
    rng = random.Random(min_lines)
    long = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(12)) for _ in range(3)]
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "d e", "", " ", *long]) for _ in range(rng.randint(0, 12)))) for i in range(30)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.text) for r in linededup.dedup_lines(rows, min_lines).collect()}
    assert got == plain_line_dedup(docs, min_lines, 0 if min_lines == 1 else 10)


def test_a_long_run_is_one_interval(spark):
    run = [f"line {k}" for k in range(64)]
    docs = [(1, "\n".join(["a", *run, "b"])), (2, "\n".join(["c", "d", *run])), (3, "\n".join([*run[10:43], "e"]))]
    rows = spark.createDataFrame([(i, 0, t) for i, t in docs], "doc_id long, version long, text string")
    found = {(r.doc_id, r.seq, r.size) for r in linededup.later_copies(rows, 2, 10).collect()}
    assert (2, 2, 64) in found and (3, 0, 32) in found and max(size for i, _, size in found if i == 3) == 32 and not any(i == 1 for i, _, _ in found)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.text) for r in linededup.dedup_lines(rows.drop("version")).collect()}
    assert got == plain_line_dedup(docs)


def test_line_dedup_odd_rows(spark, odd, empty):
    got = linededup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_removed", "n_runs"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((r[0], r[1]) for r in ODD_ROWS), key=str)
    assert linededup.dedup_lines(empty).count() == 0
    same = spark.createDataFrame([(5, "x\ny", "k"), (5, "x\ny", "l"), (6, "x\ny", "m")], "doc_id long, text string, seq string")
    assert sorted((r.doc_id, r.seq, r.text) for r in linededup.dedup_lines(same).collect()) == [(5, "k", "x\ny"), (5, "l", "x\ny"), (6, "m", "")]
    assert sorted(r.seq for r in linededup.drop_repeated_lines(same).collect()) == ["k", "l"]


def plain_substrings(docs):
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            piece = data[p : p + 100]
            if piece in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("piece", [1 << 20, 150])
def test_substrings_equal_loops(spark, monkeypatch, piece):
    monkeypatch.setattr(substrings, "_PIECE", piece)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(20, 90)))
    pool = [word() + word() for _ in range(8)]
    docs = [(i, "".join(rng.choice([*pool, word(), "ab" * 90, "x"]) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    docs += [(40, "z" * 350), (41, docs[3][1]), (42, docs[3][1] + "y"), (43, "q" * 99), (44, "q" * 100), (45, "q" * 101)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup_substrings(rows).collect()}
    assert got == plain_substrings(docs)


def test_substrings_odd_rows(spark, odd, empty):
    assert substrings.dedup_substrings(empty).count() == 0
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in substrings.dedup_substrings(odd).collect()}
    assert got == {(1, 0): 0, (2, 0): 0, (None, 5): 0, (3, 5): 0, (4, 200_000): 199_995}
    text = "".join(chr(33 + i % 90) for i in range(7 * 30)) + "end"
    same = spark.createDataFrame([(5, text), (5, text), (6, text), (None, text)], "doc_id long, text string")
    plain = {i: n for i, (_, n, _, _) in plain_substrings([(5, text), (6, text)]).items()}
    assert sorted(((r.doc_id, r.n_removed) for r in substrings.dedup_substrings(same).collect()), key=str) == sorted([(5, plain[5]), (5, plain[5]), (6, plain[6]), (None, 0)], key=str)


def plain_scores(docs):
    tokens = lambda t: [w.encode() for w in split(lower(t or ""))] + [b"\n"]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    below = sum(count.values()) + 0.5 * (len(count) + 1)
    return {i: (held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), sum(count.values()), sum(math.log10((count[w] + 0.5) / below) for w in tokens(t))) for i, t in docs}


def test_scores_have_the_base_and_beat_it_on_held_out_texts(spark):
    rng = random.Random(3)
    sides = [[f"{s}{k}" for k in range(30)] for s in "xy"]
    docs = [(i, " ".join(rng.choice(sides[i % 2]) for _ in range(60))) for i in range(400)] + [(400, None), (401, "never seen"), (402, "É\xa0Ä x1 X1 \x1cé"), (403, "É é Ä")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lmscore.score(rows).collect()}
    for i, (held, n, known, train, base) in plain_scores(docs).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train) and r.base_score == pytest.approx(base)
    out = [r for r in got.values() if r.held_out and r.n_tokens > 50]
    assert len(out) > 40 and sum(r.score for r in out) > 0.93 * sum(r.base_score for r in out)


def plain_spelling(docs):
    """log10 of the probability of a word's bytes and its end, by dictionaries; of no bytes for the end of a text."""
    pairs = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for w in split(lower(t or "")):
                raw = b" " + w.encode() + b" "
                pairs.update(zip(raw, raw[1:], strict=False))
    after, own = Counter(), Counter()
    for (a, b), n in pairs.items():
        after[a] += n
        own[b] += n
    share = lambda b: (own[b] + 1) / (sum(own.values()) + 256)
    one = lambda a, b: math.log10((pairs[a, b] + 8 * share(b)) / (after[a] + 8))

    def spelled(word):
        raw = b" " + (word.encode() if word != "\n" else b"") + b" "
        return sum(one(a, b) for a, b in zip(raw, raw[1:], strict=False))

    return spelled


def plain_model(docs, block=1 << 15, twice=4):
    """The model by loops over dictionaries, for one chunk."""
    spelled = plain_spelling(docs)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    docs = sorted((i, t or "") for i, t in docs)
    grams = lambda own: [[tuple(own[max(0, p - k) : p + 1]) if p >= k else ("<",) * (k - p) + tuple(own[: p + 1]) for k in range(3)] for p in range(len(own))]
    texts = [grams([*split(lower(t)), "\n"]) for _, t in docs]
    count = Counter(g for (i, _), own in zip(docs, texts, strict=True) if not held(i) for at in own for g in at)
    total = sum(n for g, n in count.items() if len(g) == 1)
    events, share = [[] for _ in range(sum(map(len, texts)))], [0.0] * len(docs)
    at = 0
    often = lambda n: min(15, int(math.log2(n + 1)))
    for d, ((i, _), own) in enumerate(zip(docs, texts, strict=True)):
        less = Counter(g for x in own for g in x) if not held(i) else Counter()
        left = lambda g, less=less: count[g] - less[g]
        levels = []
        for p, x in enumerate(own):
            n = [left(g) for g in x]
            of = [total - len(own) * (not held(i)), left(own[p - 1][0]), left(own[p - 1][1])] if p else [total - len(own) * (not held(i)), *[left(("\n",))] * 2]
            past = ([0, 0, 0] + levels)[::-1]
            slots = [("one", x[1][0]), ("two", x[2][:2]), ("past", *past[:3], often(of[2])), ("often", often(of[2]), often(of[1]))]
            level = 3 if n[2] else 2 if n[1] else 1 if n[0] else 0
            for k in (0, 1, 2):
                if of[2 - k]:
                    yes = n[2 - k] > 0
                    events[at].append((d, k, yes, slots, (past[0], often(of[2 if k == 0 else 1])), past[0], not held(i)))
                    if yes:
                        break
            share[d] += math.log10(n[level - 1] / of[level - 1]) if level else spelled(x[0][0])
            levels.append(level)
            at += 1
    seen, weights, cells = Counter(), {}, Counter()
    blocks = [events[i : i + block] for i in range(0, len(events), block)]
    sums = {}
    for number, own in [*enumerate(blocks[:twice]), *enumerate(blocks)]:
        sums[number] = Counter()
        for kind in range(3):
            moved, met, learned = {}, Counter(), []
            for d, k, yes, slots, gate, last, teaches in (e for x in own for e in x):
                if k != kind:
                    continue
                odds = [math.log((seen[kind, s, True] + 0.4) / (seen[kind, s, False] + 0.4)) for s in slots]
                w = weights.setdefault((kind, gate), [0.4] * 4)
                x = max(-15, min(15, sum(a * b for a, b in zip(w, odds, strict=True))))
                p = 1 / (1 + math.exp(-x))
                cell = max(0, min(32, round(2 * x) + 16))
                centre = 1 / (1 + math.exp(-(cell - 16) / 2))
                to = cells[kind, last, cell, True] + 20 * centre
                no = cells[kind, last, cell, False] + 20 * (1 - centre)
                sums[number][d] += math.log10(0.5 * (p if yes else 1 - p) + 0.5 * (to if yes else no) / (to + no))
                if teaches:
                    moved[gate] = [a + (yes - p) * o for a, o in zip(moved.get(gate, [0] * 4), odds, strict=True)]
                    met[gate] += 1
                    learned.append((slots, last, cell, yes))
            for gate, step in moved.items():
                weights[kind, gate] = [w + 0.02 * m / math.sqrt(met[gate]) for w, m in zip(weights[kind, gate], step, strict=True)]
            for slots, last, cell, yes in learned:
                cells[kind, last, cell, yes] += 1
                for s in slots:
                    seen[kind, s, yes] += 1
    return {i: share[d] + sum(x[d] for x in sums.values()) for d, (i, _) in enumerate(docs)}


def some_documents(n, rng):
    words = ["a", "B", "é", "d1", "ee", "f", "Gg", *(f"w{k}" for k in range(40))]
    docs = [(i, " ".join(rng.choice(words[: 2 + i % 40]) for _ in range(rng.randint(0, 30)))) for i in range(n)]
    return docs + [(n, None), (n + 1, "never met"), (n + 2, "solo"), (n + 3, docs[3][1]), (n + 4, docs[8][1] + " f")]


def test_scores_equal_the_model_by_loops(spark):
    docs = some_documents(80, random.Random(5))
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lmscore.score(rows, bucket_entries=50).collect()}
    assert got == {i: pytest.approx(x, rel=1e-9, abs=1e-9) for i, x in plain_model(docs).items()}


def chunk_of(docs, key_bits=62):
    raw = [(t or "").encode() for _, t in docs]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    table = pa.table({"doc_ids": [[i for i, _ in docs]], "held_out": [held], "sizes": [list(map(len, raw))], "texts": [zstandard.compress(b"".join(raw))]})
    chunk = lmscore.Chunk(table, key_bits)
    sums = np.bincount(chunk.place, np.tile(chunk.learned, 3), len(chunk.keys)).astype(np.int64)
    counts = sums[chunk.place].reshape(3, -1)
    return chunk, counts, int(np.count_nonzero(chunk.learned))


def test_blocks_are_predicted_by_those_before(monkeypatch):
    monkeypatch.setattr(lmscore, "BLOCK", 64)
    monkeypatch.setattr(lmscore, "TWICE", 2)
    docs = some_documents(60, random.Random(7))
    chunk, counts, total = chunk_of(docs)
    got = dict(zip(chunk.ids, lmscore.log10_scores(chunk, counts, total, chunk.pair_counts()), strict=True))
    assert got == {i: pytest.approx(x, rel=1e-9, abs=1e-9) for i, x in plain_model(docs, 64, 2).items()}


def test_scores_of_all_continuations_add_up_to_at_most_one():
    docs = [(i, w) for i, w in enumerate(["a", "b", "a c", "c", "", "b a b"] * 20)]
    free = (i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 5 == 1)
    words = ["a", "b", "c", "zzz"]
    for start in ("", "a ", "b a ", "zzz "):
        asked = {next(free): start + w for w in ["", *words]}
        chunk, counts, total = chunk_of(docs + list(asked.items()))
        got = dict(zip(chunk.ids, lmscore.log10_scores(chunk, counts, total, chunk.pair_counts()), strict=True))
        # What follows start, its end included, against the text up to there.
        assert 0 < sum(10 ** got[i] for i in asked) <= 1 + 1e-9, start


def test_random_letters_cost_more_than_words(spark):
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("st", "br", "l", "m") for b in ("a", "e", "ou") for c in ("n", "rt", "ld")]
    noise = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7)))
    docs = [(i, " ".join(rng.choice(words) if i % 10 else noise() for _ in range(200))) for i in range(300)]
    got = {r.doc_id: r for r in lmscore.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for held in (False, True):
        bits = [[r.bits_per_byte for i, r in got.items() if r.held_out == held and bool(i % 10) == prose] for prose in (True, False)]
        assert max(bits[0]) < 2 < min(bits[1]), held


def test_documents_that_occur_twice_are_told_apart(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(80))) for i in range(150)]
    docs += [(150 + i, docs[i][1]) for i in range(0, 30)]
    got = {r.doc_id: r.score for r in lmscore.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    taught = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    twice = [got[i] for i in range(30) if taught(150 + i)]
    assert len(twice) > 15 and min(twice) > max(got[i] for i in range(30, 150))


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(50))) for i in range(200)]
    one, many = (spark.createDataFrame(rows, "doc_id long, text string").repartition(n) for rows, n in ((docs, 1), (docs[::-1], 8)))
    a, b = ({r.doc_id: tuple(r) for r in lmscore.score(x, chunk_chars=4000, bucket_entries=500).collect()} for x in (one, many))
    assert a == b and len(a) == 200


def test_packed_numbers_come_back():
    for x in (np.array([5], np.uint32), np.array([0, 1, 2**32 - 1], np.uint32), np.array([7, 2**63], np.uint64)):
        assert lmscore._unpack(lmscore._pack(x), x.dtype.type).tolist() == x.tolist()


def test_scores_odd_rows(odd, empty):
    got = lmscore.score(odd).collect()
    assert len(got) == len(ODD_ROWS) and all(math.isfinite(r.score) for r in got)
    assert {r.bits_per_byte for r in got if r.doc_id in (1, 2)} == {None}
    assert lmscore.score(empty).count() == 0


def test_url_parts(spark):
    urls = [("HTTP://A.Example.COM/en/1?x#y", "a.example.com", "/en/1"), ("x://h", "h", ""), ("x://h?q/", "h", ""), ("no scheme", "", ""), (None, "", ""), ("a://b://c/d", "b:", "//c/d"), ("s://ÄB/é\n/x", "Äb", "/é\n/x"), ("", "", "")]
    pages = spark.createDataFrame([(i, u, 1) for i, (u, _, _) in enumerate(urls)], "page_id long, url string, host int")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path) for r in urlfilter.judge(pages, labels).collect()}
    assert got == {i: (h, p) for i, (_, h, p) in enumerate(urls)}


def test_url_rules(spark):
    want = {"s://com/": "com/", "s://x.com/y": "com/", "s://x.com": None, "s://example.com/en/1": "example.com/en/", "s://m.example.com/en/": "example.com/en/", "s://www.example.com/en/1": "www.example.com/en/", "s://a.www.example.com/en/1": "www.example.com/en/", "s://notexample.com/en/1": "com/", "s://a.net/es/": "net/es/", "s://a.net/es": None, "s://net/fr/?q": "net/fr/", "s://acom/": None}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(want)], "page_id long, url string")
    got = urlfilter.judge(pages, spark.createDataFrame([], "page_id long, bad int")).orderBy("page_id").collect()
    assert [r.rule for r in got] == list(want.values())
    assert {r.rule: r.verdict for r in got if r.rule} == {r: v for v, r in urlfilter.RULES}


def test_url_ids_of_letters_and_digits_share_a_template(spark):
    """Hex ids and numbered slugs of bad hosts: pages without a label are blocked by those with one."""
    rng = random.Random(4)
    ids = ["".join(rng.choice("0123456789abcdef") for _ in range(12)) for _ in range(60)]
    slugs = [f"{''.join(rng.choice('abcdefgh') for _ in range(6))}-{i}" for i in range(60)]
    few = ["1a2b", "3c4d", "5e6f", "7a8b", "9c0d", "1e2f", "2a1b", "4c3d"]
    urls = [f"s://hex.org/p/{x}" for x in ids] + [f"s://slug.org/p/{x}" for x in slugs] + [f"s://few.org/p/{x}" for x in few] + [f"s://good.org/p/{i}" for i in range(400)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 128)) for i in range(0, len(urls), 2)], "page_id long, bad int")
    got = {r.page_id: r for r in urlfilter.judge(pages, labels).collect()}
    assert {got[i].verdict for i in range(128)} == {"block"} and {got[i].verdict for i in range(128, len(urls))} == {"allow"}
    assert {got[i].template for i in range(120)} == {"/p/*"} and got[200].template == "/p/{n}"


def test_url_branches_are_merged_with_each_other(spark):
    """Of one skeleton: two bad branches of few labels each support each other, and the good ones do not hide them."""
    urls = [f"s://h.org/{side}/{i}" for side in ("good", "fine", "bad", "worse") for i in range(40)] + ["s://h.org/bad/x7", "s://h.org/odd/1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0) for i in range(80)] + [(i, 1) for i in (80, 81, 82, 120, 121, 122)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, labels).collect()}
    assert {got[i] for i in range(80)} == {"allow"} and {got[i] for i in range(80, 160)} == {"block"} and got[161] == "allow"


def test_url_rows_that_repeat_or_lack_labels(spark):
    pages = spark.createDataFrame([(1, "s://h.org/a/1", "x"), (1, "s://h.org/a/1", "x"), (2, "s://h.org/a/2", "x"), (None, "s://h.org/a/3", "x")], "page_id long, url string, template string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (9, 0)] + [(k, 0) for k in range(20, 40)], "page_id long, bad int")
    rows = urlfilter.judge(pages, labels).collect()
    assert sorted((r.page_id or 0) for r in rows) == [0, 1, 1, 2] and {r.verdict for r in rows} == {"block"}
    none = urlfilter.judge(pages, labels.limit(0)).collect()
    assert {r.verdict for r in none} == {"allow"}


def test_url_templates(spark):
    urls = [f"s://h.org/good/{i}" for i in range(30)] + [f"s://h.org/bad/{i}.html" for i in range(30)] + [f"s://h.org/tag/name{chr(97 + i)}" for i in range(26)] + ["s://other.org/" + "a/" * 500]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(30 <= i < 60)) for i in range(0, 60, 2)] + [(None, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in urlfilter.judge(pages, labels).collect()}
    assert {got[i].verdict for i in range(30)} == {"allow"} and {got[i].verdict for i in range(30, 60)} == {"block"}
    assert got[0].template == "/good/{n}" and got[30].template == "/bad/{n}.html" and {got[i].template for i in range(60, 86)} == {"/tag/*"}
    assert got[86].template == "/" + "/".join(["a"] * 500)
    assert urlfilter.judge(pages.limit(0), labels).count() == 0
