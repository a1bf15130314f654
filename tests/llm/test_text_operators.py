"""Operators that look at one text at a time, against plain versions of themselves."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from textclusters.llm import bpe, decontaminate, licenses, pii, quality
from textclusters.llm.registry import VOCABULARY

PATH, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
ODD_ROWS = [(1, None, "x", 5), (2, "", "x", 5), (None, "a b c", None, None), (3, "a b c", "x", 5), (3, "a b c", "x", 5), (4, "long " * 40_000, "x", 5)]
ODD_SCHEMA = "doc_id long, text string, version string, row int"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def base_items(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def test_pii_base_equals_the_patterns():
    rng, automaton = random.Random(7), pii.anchors()
    parts = ["01259", "..@@", "+ -()", "ab", "a@b.c", "192.168", "4111 1111 1111 1111", "é", "\n"]
    for _ in range(5000):
        text = "".join(rng.choice(rng.choice(parts)) if rng.random() < 0.7 else rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert [x for x in pii.find(text, automaton) if x[1] < 4] == base_items(text), text


def test_pii_added_kinds():
    automaton = pii.anchors()
    told = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.find(t, automaton)]
    assert told('token = "c6b354b929dc"') == [("secret", "c6b354b929dc")]
    assert ("account", "DE89370400440532013000") in told("IBAN: DE89370400440532013000")
    assert not [x for x in told("IBAN: DE88370400440532013000") if x[0] == "account"]
    assert ("url", "https://me:pw@host.org/x") in told("see https://me:pw@host.org/x now")
    assert told("a token of thanks; the account was long") == []


def test_pii_iban_ends_before_what_follows():
    automaton = pii.anchors()
    accounts = lambda t: [t[s:e] for s, k, e in pii.find(t, automaton) if pii.KINDS[k] == "account"]
    iban = "DE89370400440532013000"
    for after in (" BIC COBADEFFXXX", " Please pay", " 12 EUR", " A", ".", "", " AND " + "MORE " * 20, " iban NO9386011117947"):
        assert accounts(f"IBAN: {iban}{after}")[0] == iban, after
        assert accounts(f"IBAN: DE89 3704 0044 0532 0130 00{after}")[0] == "DE89 3704 0044 0532 0130 00", after
    assert accounts(f"IBAN: {iban} iban NO9386011117947") == [iban, "NO9386011117947"]
    assert accounts("iban NO9386011117947 X") == ["NO9386011117947"]
    assert accounts("IBAN: DE88370400440532013000 BIC COBADEFFXXX") == [] and accounts(f"IBAN: {iban}X") == []


def test_pii_schemes_of_any_length():
    automaton, long = pii.anchors(), "a" * 5000 + "+b"
    told = lambda t: [t[s:e] for s, k, e in pii.find(t, automaton) if pii.KINDS[k] == "url"]
    assert told(f"9.{long}://me:pw@host.org/x y") == [f"{long}://me:pw@host.org/x"]
    assert told("a://b://me@h.org") == ["b://me@h.org"] and told("://me@h.org 1://me@h.org") == []


def test_pii_extra_columns_follow(odd):
    assert pii.digest(pii.personal_data(odd)).columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_url", "n_account", "n_secret", "n_items"]


def test_pii_odd_rows(odd, empty):
    got = pii.digest(pii.personal_data(odd)).collect()
    assert len(got) == len(ODD_ROWS) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in got)
    assert pii.digest(pii.personal_data(empty)).count() == 0


def test_bpe_joins_equal_the_library():
    rng, small = random.Random(3), bpe.TreeEncoder(PATH, PATTERN, leaf=1)
    parts = ["ab", "the", "  ", " ", "\n", "\r\n", "\t", "'s", "'ll", "12", "é", "日本", "\u3000", "\xa0", "!?", "\x1c", "😀", "A"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = small.encode(text)
        assert ids.tolist() == small.encoding.encode_ordinary(text)
        assert small.decode(ids.tolist()) == text.encode()


@pytest.mark.parametrize("leaf", [1, 2, 5])
def test_bpe_joins_in_unbroken_passages_equal_the_library(leaf):
    rng, small = random.Random(leaf), bpe.TreeEncoder(PATH, PATTERN, leaf)
    parts = ["ab", "the", " ", "\n", "\r\n", "'s", "'", "12", "é", "日本", "\xa0", "!?", "\x1c", "😀", "a" * 9, "==", " " * 13, "\n" * 7]
    for _ in range(1500):
        pool = rng.sample(parts, rng.randint(1, 5))
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        assert small.encode(text).tolist() == small.encoding.encode_ordinary(text), text


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000, "abcdefgh" * 625_000, "ab1=" * 250_000, "x\t" * 200_000])
def test_bpe_of_very_long_unbroken_texts(text):
    """The library breaks off at long white space; the ids are those of an independent merge of each match."""
    encoder = bpe.TreeEncoder(PATH, PATTERN)
    ids = encoder.encode(text)
    assert encoder.decode(ids.tolist()) == text.encode()
    if len(set(text)) == 1:
        assert ids.tolist() == bpe.merged(text[:100_000].encode(), encoder.ranks) * 50
    else:
        assert ids.tolist() == encoder.encoding.encode_ordinary(text)


def test_every_token_is_what_its_bytes_encode_to():
    """The join inside a match rests on it."""
    _, ranks, _ = bpe.vocabulary(PATH, PATTERN)
    assert all(bpe.merged(token, ranks) == [rank] for token, rank in ranks.items())


def test_bpe_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_tokens): r for r in bpe.encode_documents(odd, PATH, PATTERN).collect()}
    assert got[1, 0].ids == [] and bytes(got[2, 0].decoded) == b"" and bytes(got[None, 3].decoded) == b"a b c"
    assert next(bytes(r.decoded) for k, r in got.items() if k[0] == 4) == ODD_ROWS[-1][1].encode()
    assert bpe.digest_documents(odd, PATH, PATTERN).count() == len(ODD_ROWS) and bpe.encode_documents(empty, PATH, PATTERN).count() == 0


def longest_by_loops(words):
    n = len(words)
    return [max([0, *(next((k for k in range(n) if max(i, j) + k >= n or words[i + k] != words[j + k]), n) for j in range(n) if j != i)]) for i in range(n)]


def test_suffix_array_repeats_equal_loops():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.randint(0, 3) for _ in range(rng.randint(0, 40))]
        assert quality.longest_repeats(np.array(words, np.int64)).tolist() == longest_by_loops(words)


def test_quality_measures_equal_loops():
    rng = random.Random(6)
    texts = ["", " \n", *(rng.choice(" \n").join(rng.choice(["a", "b#", "c", "é", "d\te"]) for _ in range(rng.randint(0, 60))) for _ in range(60))]
    got = quality.measures(texts, min_repeat=4)
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        twice = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        best = longest_by_loops(words)
        covered = {k + d for k, n in enumerate(best) if n >= 4 for d in range(n)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice), len(covered), max(best, default=0))
        assert tuple(got[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")) == want


def plain_verdict(text):
    """Base rules, then the repeats of five words and more by comparing all places."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = Counter(tuple(words[k : k + 3]) for k in range(n - 2))
    repeated = {k + d for k in range(n - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    base = n < 50 or 100 * len(repeated) > 50 * n
    best = longest_by_loops(words)
    covered = {k + d for k, size in enumerate(best) if size >= 5 for d in range(size)}
    return base, not base and 100 * len(covered) <= 20 * n and max(best, default=0) <= 100


def test_quality_verdicts_come_from_the_suffix_array():
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    long, mid, short = fresh(101), fresh(12), fresh(5)
    texts = [" ".join(x) for x in (
        fresh(60), fresh(49), fresh(50), [*fresh(60), *mid, *fresh(20), *mid], [*fresh(120), *mid, *fresh(20), *mid],
        [*long, *fresh(900), *long], [*long[:100], *fresh(900), *long[:100]], [*short, *fresh(40), *short], [*short, *fresh(39), *short], ["a"] * 200,
        [*fresh(80), *mid, *fresh(1), *mid, *fresh(1)],
    )]
    want = [plain_verdict(t) for t in texts]
    got = quality.verdicts(texts, quality.MIN_REPEAT, quality.MAX_COVERED_PERCENT, quality.MAX_LONGEST)
    assert [(bool(a), bool(b)) for a, b in zip(got["base_failed"], got["kept"], strict=True)] == want
    assert sum(not base and not kept for base, kept in want) >= 3


def test_quality_of_a_batch_of_long_texts(spark):
    """Parts are bounded by bytes."""
    docs = spark.createDataFrame([(i, f"w{i} " * 400_000) for i in range(6)], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.n_words, r.longest_repeat) for r in quality.quality(docs).collect()} == {(i, 400_000, 399_999) for i in range(6)}


def test_quality_odd_rows(odd, empty):
    got = quality.quality(odd).collect()
    assert len(got) == len(ODD_ROWS) and not any(r.kept for r in got) and {r.n_words for r in got} == {0, 3, 40_000}
    assert quality.quality(odd).columns[-4:] == ["base_failed", "kept", "covered_words", "longest_repeat"]
    assert quality.keep_good(odd).count() == 0 and quality.quality(empty).count() == 0
    assert quality.keep_good(odd).columns == odd.columns


def edit_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_equals_the_table_of_distances():
    rng = random.Random(2)
    for _ in range(300):
        item = decontaminate.normal("".join(rng.choice("abc d") for _ in range(rng.randint(24, 40))))
        text = list(item)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(text))
            text[k : k + rng.randint(0, 1)] = rng.choice(["x", ""])
        text = decontaminate.normal("q" * rng.randint(0, 5) + "".join(text) + "zz")
        matcher = decontaminate.Matcher([(item, [1])], 0.1, short=0)
        found, want = list(matcher.find(text)), edit_distance(item, text)
        assert bool(found) == (want <= matcher.items[0].budget)
        if found:
            _, distance, start, end = found[0]
            assert distance == want == edit_distance(item, text[start:end])


def test_decontamination_rows(spark, odd, empty):
    item = "The quick brown fox jumps over the lazy dog"
    bench = spark.createDataFrame([(1, item, 0), (2, item.upper(), 0), (3, None, 0), (None, item, 0), (4, "too short", 0)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(7, "é the  quick\nbrown fox jumps over teh lazy dog!"), (8, "the quick brown cat")], "doc_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    assert [(r[0], r[1], r[2]) for r in got] == [(7, 1, 2), (7, 2, 2)] and got[0][3:] == (2, 46)
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [8]
    # Blocks of one item each give the same rows.
    assert sorted(tuple(r) for r in decontaminate.contaminated(docs, bench, block_bytes=1).collect()) == got
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd, bench).count() == len(ODD_ROWS)


def test_short_items_are_found_without_edits_between_word_borders(spark):
    bench = spark.createDataFrame([(1, "Paris"), (2, "42"), (3, "  "), (4, "the capital of France")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "in paris, 420 and x42"), (2, "parisian; 42"), (3, "The  capital\nof FRANCE!"), (4, "the capitol of France")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r.start, r.end) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1, 0, 3, 8), (2, 2, 0, 10, 12), (3, 4, 0, 0, 22)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [4]


def test_places_of_normal_text():
    text = "  Ab  c\n\tD "
    at = decontaminate.places(text)
    assert decontaminate.normal(text) == "ab c d" and at == [2, 3, 4, 6, 7, 9, 10]


def dice(a, b):
    grams = lambda w: set(zip(w, w[1:], strict=False))
    return round(2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b))), 6)


def plain_matches(text, templates=licenses.TEMPLATES, limit=licenses.LIMIT):
    """Every window of every template compared; of those that overlap the nearest, longest, first by name."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    ours, best = words(text), []
    for name, notice in dict.fromkeys(templates):
        theirs = words(notice)
        n = min(len(theirs), len(ours))
        if n > 1 and len(theirs) > 1:
            score, minus = max((dice(ours[i : i + n], theirs), -i) for i in range(len(ours) - n + 1))
            best += [(score, n, name, -minus)] if score >= limit else []
    beats = lambda y, x: x[3] < y[3] + y[1] and y[3] < x[3] + x[1] and (-y[0], -y[1], y[2]) < (-x[0], -x[1], x[2])
    return sorted({x for x in best if not any(beats(y, x) for y in best)})


def wrapped(text, width=7):
    words = text.split()
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_licenses(spark, odd, empty):
    rng = random.Random(11)
    filler = lambda n: " ".join(rng.choice(["license", "the", "of", "software", "under", "this", "copyright", "x1"]) for _ in range(n))
    passages = dict(licenses.PASSAGES)
    gpl = next(t for k, t in licenses.NOTICES if k == "gpl-3.0")
    texts = [
        "some words\nLicensed under the Apache License, version 2.0!",
        "Released under\nthe MIT License.",
        "Released under the license of nobody at all",
        filler(40) + "\n" + wrapped(passages["mit"]).replace("granted", "given") + "\n" + filler(30),
        filler(5) + " " + wrapped(passages["bsd-3-clause"], 9) + " " + filler(9),
        f"{filler(8)} {wrapped(gpl, 5)} {filler(8)} SPDX-License-Identifier: Apache-2.0 {filler(3)}",
        "// " + wrapped(passages["apache-2.0"]).replace("\n", "\n// "),
        passages["mit"][: len(passages["mit"]) * 7 // 10],
        "mit",
        filler(300),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {}
    for r in licenses.matches(docs).collect():
        got.setdefault(r.doc_id, []).append((r.dice, r.n_words, r.license_id, r.start_word))
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, t in enumerate(texts) if (x := plain_matches(t))}
    names = {i: {x[2] for x in own} for i, own in got.items()}
    assert names[0] == {"apache-2.0"} and names[1] == {"mit"} and names[3] == {"mit"} and names[4] == {"bsd-3-clause"} and names[5] == {"gpl-3.0", "apache-2.0"} and names[6] == {"apache-2.0"} and 8 not in names
    assert licenses.matches(odd).count() == 0 and licenses.matches(empty).count() == 0
    assert licenses.matches(docs, templates=()).count() == 0 and licenses.matches(docs, templates=[("one", "word")]).count() == 0


def test_licenses_of_repeated_rows_and_clashing_columns(spark):
    row = (5, "Released under the MIT License.", 1, "x")
    docs = spark.createDataFrame([row, row, (None, row[1], 1, "x"), (6, "word " * 30_000 + row[1], 1, "x")], "doc_id long, text string, row int, words string")
    assert sorted(((r.doc_id, r.license_id, r.start_word) for r in licenses.matches(docs).collect()), key=str) == sorted([(5, "mit", 0), (5, "mit", 0), (None, "mit", 0), (6, "mit", 30_000)], key=str)
