"""Long sentences, many spans, large vocabularies and files in splits, against plain loops."""

import random
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.test_counts_and_clusters import greedy, paths
from textclusters.functions import annotation
from textclusters.operators import annotated, brown, counts, dependency, opinions
from textclusters.plans import registry
from textclusters.sources import corpus


@pytest.fixture
def table(spark):
    name = f"t_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_running_sums(spark):
    rng = random.Random(1)
    arrays = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 31, 32, 33, 64, 1000, 40_000)]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    for r in rows.select("i", annotation.running_sums("a").alias("s")).collect():
        want, total = [], 0
        for x in arrays[r.i]:
            want.append(total)
            total += x
        assert r.s == want


def long_file(n):
    """A sentence of n chunks, of which some have no morphemes and some have several."""
    rng, lines, want, offset, chunk = random.Random(2), ["# x"], [], 0, -1
    for _ in range(n):
        lines.append("* -1D")
        chunk += 1
        for _ in range(rng.choice([0, 1, 1, 3])):
            surface = "s" * rng.randint(1, 5)
            want.append((len(lines), chunk, offset, offset + len(surface) - 1))
            lines.append(f"{surface} r l n 1 * 0 * 0 *")
            offset += len(surface)
    return "\n".join([*lines, "EOS", ""]), want


def test_a_sentence_of_very_many_lines_takes_linear_time(spark):
    took = []
    for n in (20_000, 200_000):
        text, want = long_file(n)
        raw = spark.createDataFrame([("A-1-1-01", text)], "sid string, value string")
        began = time.time()
        got = annotated.parse_annotated(raw).morphemes.select("ln", "chunk_id", "off_start", "off_end").collect()
        took.append(time.time() - began)
        assert sorted(map(tuple, got)) == want
    assert took[1] < 40 * max(took[0], 0.5)
    one_chunk = "* -1D\n" + "a r l n 1 * 0 * 0 *\n" * 100_000
    last = annotated.parse_annotated(spark.createDataFrame([("A-1-1-01", one_chunk)], "sid string, value string")).morphemes.orderBy(F.desc("ln")).first()
    assert (last.ln, last.chunk_id, last.off_start) == (100_000, 0, 99_999)


def test_files_are_parsed_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b\nc", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("chunks", "case_links", "grid_rows"):
        plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 2, name


def test_rejects_are_counted_in_the_pass_that_makes_the_chunks(spark):
    bad = "* 1D <C用;【a;ガ;9:x(y):0タグ>\na a a n 1 * 0 * 0 *\n* nothing\n* -1D <NE:LOCATION:b>\nEOS\n"
    raw = spark.createDataFrame([(f"A-1-{i}-01", bad) for i in range(5)], "sid string, value string").repartition(3)
    watch = Observation()
    assert annotated.parse_annotated(raw, watch=watch).chunks.count() == 5
    assert annotated.check_rejects(watch, limit=10) == {"lines": 15, "chunk": 5, "link": 5, "entity": 0}
    with pytest.raises(annotated.TooManyRejects, match="10 of 15 chunk lines can't be parsed, 9 may: 5 for their chunk, 5 for their link"):
        annotated.check_rejects(watch, limit=9)


@pytest.mark.parametrize("block", [1, 3, 100])
def test_clusters_do_not_depend_on_blocks(spark, block):
    rng = random.Random(block)
    rows = [[rng.choice("abcdefghijklmnopqr") for _ in range(rng.randint(0, 9))] for _ in range(40)]
    got = brown.brown_cluster(paths(spark, *rows), 3, 1, 15, block=block)
    assert {r.word: r.cluster for r in got.collect()} == greedy(rows, 3, 1, 15)


def test_groups_of_different_sizes_in_blocks(spark):
    rng = random.Random(9)
    rows = [("x", [rng.choice("abcdefgh") for _ in range(6)]) for _ in range(20)] + [("y", ["a", "b"]), ("y", ["c", "b"])]
    got = {(r.grp, r.word): r.cluster for r in brown.brown_cluster(spark.createDataFrame(rows, "grp string, words array<string>"), 2, 1, group_col="grp", block=2).collect()}
    assert got == {(g, w): c for g in "xy" for w, c in greedy([ws for h, ws in rows if h == g], 2, 1, 8000).items()}


def test_no_vocabulary(spark):
    assert {r.word: r.cluster for r in brown.brown_cluster(paths(spark, ["a"], []), 2, 5).collect()} == {"BOS": 0, "EOS": 0}


def test_ranks_of_all_words(spark):
    rng = random.Random(3)
    words = {f"w{i}": rng.randint(1, 40) for i in range(3000)}
    rows = spark.createDataFrame(list(words.items()), "word string, cnt long").repartition(5)
    want = [(w, i + 1) for i, (w, _) in enumerate(sorted(words.items(), key=lambda x: (-x[1], x[0])))]
    ranked = counts.word_ranks(rows)
    assert sorted(((r.word, r["rank"]) for r in ranked.collect()), key=lambda x: x[1]) == want
    assert counts.word_ranks(rows.limit(0)).count() == 0
    assert counts.vocabulary(rows, 2, None).count() == sum(n > 1 for n in words.values())


def plain_overlaps(words, spans):
    found = {}
    for ln, a, b in words:
        met = [i for i, s, e in spans if e >= a and s <= b]
        if met:
            found[ln] = min(met)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_equal_comparing_all(spark, seed):
    rng = random.Random(seed)
    words, at = [], 0
    for ln in range(rng.choice([1, 5, 60])):
        size = rng.choice([1, 1, 2, 7, 40])
        words.append((ln, at, at + size - 1))
        at += size
    spans = []
    for i in range(rng.choice([0, 3, 30])):
        start = rng.randrange(at)
        spans.append((i, start, min(at + 3, start + rng.choice([0, 1, 5, 30, 200]))))
    morphemes = spark.createDataFrame([("s", *w) for w in words] + [("t", *w) for w in words], "sid string, ln int, off_start int, off_end int")
    given = spark.createDataFrame([("s", *x) for x in spans] + [("u", 0, 0, 9)], "sid string, idx int, start int, end int")
    got = {(r.sid, r.ln): r.idx for r in opinions.overlaps(morphemes, given).collect()}
    assert got == {("s", ln): i for ln, i in plain_overlaps(words, spans).items()}


def test_many_spans_of_one_long_sentence(spark):
    words = spark.range(100_000).select(F.lit("s").alias("sid"), F.col("id").cast("int").alias("ln"), (F.col("id") * 3).cast("int").alias("off_start"), (F.col("id") * 3 + 2).cast("int").alias("off_end"))
    spans = spark.range(10_000).select(F.lit("s").alias("sid"), F.col("id").cast("int").alias("idx"), (F.col("id") * 29 + 1).cast("int").alias("start"), (F.col("id") * 29 + 60).cast("int").alias("end"))
    got = {r.ln: r.idx for r in opinions.overlaps(words, spans).collect()}
    # A place is in the spans that start in the 59 places before it; the first of them counts.
    want = {ln: max(-(-(3 * ln - 60) // 29), 0) for ln in range(100_000) if -(-(3 * ln - 60) // 29) <= min((3 * ln + 1) // 29, 9999)}
    assert got == want


def random_chunks(rng, sid, n):
    rows = [(sid, i, rng.choice([-1, i - 1, i + 1, i + rng.randint(1, 5), n - 1, n + 3, rng.randrange(n)]), rng.choice("DPA")) for i in range(n)]
    return [r for r in rows if rng.random() < 0.9 or r[1] == n - 1]


def test_counted_classes_equal_the_drawn_ones(spark):
    rng = random.Random(4)
    rows = [r for k in range(40) for r in random_chunks(rng, f"s{k}", rng.choice([1, 2, 3, 8, 30, 90]))]
    chunks = spark.createDataFrame(rows, "sid string, chunk_id int, parent int, dep_type string").repartition(3)
    want = Counter((r.sid, r["class"]) for r in dependency.dependency_grid(chunks).collect())
    assert {(r.sid, r["class"]): r.n_cells for r in dependency.grid_classes(chunks).collect()} == dict(want)
    assert dependency.grid_classes(chunks.limit(0)).count() == 0


def test_a_grid_of_many_chunks_is_counted(spark):
    n = 50_000
    chunks = spark.range(n).select(F.lit("s").alias("sid"), F.col("id").cast("int").alias("chunk_id"), F.when(F.col("id") == n - 1, -1).otherwise(F.col("id") + 1).cast("int").alias("parent"), F.lit("D").alias("dep_type"))
    got = {r["class"]: r.n_cells for r in dependency.grid_classes(chunks).collect()}
    # Each is the only child of the next one.
    assert got == {"first": n - 1, "through": 0, "blank": n * (n - 1) // 2 - (n - 1)} or got == {"first": n - 1, "blank": n * (n - 1) // 2 - (n - 1)}


def test_lines_of_files_in_splits(spark, tmp_path):
    want = {}
    for name, n in (("a", 5000), ("b", 3)):
        lines = [f"s{i}\tsent\th\te{i}\tt\tx" if i % 7 else "" for i in range(n)]
        (tmp_path / f"{name}.tsv").write_text("\r\n".join(lines) + ("\n" if n > 3 else ""))
        want |= {(name, i): f"e{i}" for i in range(n) if i % 7}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        read = corpus.read_opinions(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = {(r.file.rsplit("/", 1)[1][0], r.line): (r.expr, r.target) for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: (e, "x") for k, e in want.items()}


OPINION = "sid string, idx int, holder string, expr string, start int, end int, type string, target string"


def test_store_replaces_sentences_and_is_not_shuffled(spark, table):
    rows = lambda sid, n, kind: [(sid, i, "h", "e", 0, 1, kind, "x") for i in range(n)]
    store = corpus.OpinionStore(spark, table, buckets=8)
    store.put(spark.createDataFrame(rows("a", 2, "old") + rows("b", 1, "old") + rows("c", 3, "old"), OPINION))
    store.put(spark.createDataFrame(rows("b", 2, "new"), OPINION))
    store.put(spark.createDataFrame([], OPINION), spark.createDataFrame([("c",)], "sid string"))
    now = lambda s: sorted((r.sid, r.idx, r.type) for r in s.read().collect())
    want = [("a", 0, "old"), ("a", 1, "old"), ("b", 0, "new"), ("b", 1, "new")]
    assert now(store) == want
    sentences = spark.createDataFrame([("a",), ("b",), ("d",)], "sid string")
    joined = opinions.sentences_with_opinions(sentences, store.read())
    assert {r.sid: r.n_opinions for r in joined.collect()} == {"a": 2, "b": 2, "d": 0}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = sentences.join(store.read(), "sid", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    small = store.compact()
    assert now(small) == want and spark.table(small.name).select("generation").distinct().count() == 1
    small.drop()


def test_articles_are_read_from_their_own_file(spark, tmp_path):
    rows = [(f"A{i:03}", j, f"A{i:03}-{j}") for i in range(60) for j in range(20)] + [("HOT", j, f"HOT-{j:05}") for j in range(3000)]
    path = str(tmp_path / "articles")
    corpus.write_by_article(spark.createDataFrame(rows, "article string, sent_no int, sid string").repartition(4), path, rows_per_file=300)
    files = Counter(r.article for r in corpus.read_manifest(spark, path).collect())
    assert files["HOT"] == 3 and all(n == 1 for a, n in files.items() if a != "HOT")
    one = corpus.read_article(spark, path, "A007")
    assert [r.sent_no for r in one.collect()] == list(range(20)) and len(one.inputFiles()) == 1
    assert corpus.read_article(spark, path, "HOT").count() == 3000 and corpus.read_article(spark, path, "none").count() == 0
    assert spark.read.parquet(path).count() == len(rows)


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    for a in range(20):
        folder = tmp_path / f"KN{a}_Kyoto_1"
        folder.mkdir()
        for s in range(30):
            (folder / f"KN{a}_Kyoto_1-1-{s}-01").write_text(f"# {a} {s}\nEOS\n")
        (folder / "fileinfos").write_text("no sentence")
    read = corpus.read_corpus(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() == 1 and corpus.read_corpus(spark, str(tmp_path), task_bytes=2000).rdd.getNumPartitions() > 1
    assert {r.sid: r.value for r in read.collect()} == {f"KN{a}_Kyoto_1-1-{s}-01": f"# {a} {s}\nEOS\n" for a in range(20) for s in range(30)}
