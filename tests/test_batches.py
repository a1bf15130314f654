"""Annotated text that is made and parsed in batches, against the patterns and plain loops."""

import random
import re

import pytest

from textclusters.functions import annotation as A
from textclusters.operators import annotated, dependency, opinions
from textclusters.plans import registry
from textclusters.sources import adapters, corpus

#: Queries whose plan must not number or cut lines in lambdas, which are interpreted.
LINEAR = ["chunks", "case_links", "morphemes", "morpheme_display", "rejects", "chunk_text", "children", "grid_rows", "grid_cells", "line_grid_cells"]
#: Queries in which words are shuffled once, packed.
SHUFFLED_ONCE = ["phrase_labels", "phrase_overlap", "marked_morphemes", "opinion_overlap", "chunk_opinions"]


@pytest.mark.parametrize("name", LINEAR)
def test_lines_are_not_cut_and_summed_in_lambdas(spark, tmp_path, name):
    spark.createDataFrame([(1, "a b\nc", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan and "filter(" not in plan


def odd_line(rng):
    parts = ["<C用;【", "】;", "ガ", "メモ", ";0;", "(同一文)", "(", ")", ":0タグ", ">", "<NE:", "LOCATION:", "LO", "京都", ":", ";", "<a", "】", "<係:ノ格>"]
    good = ["<C用;【京都】;ガ;0;0;9.999:KN1(同一文):0タグ>", "<NE:LOCATION:京都>", "<NE:DATE:a:b>", "<文頭>"]
    head = rng.choice(["* 1D ", "+ -1P ", "*", "+ ", "* D", "+ 5-A", "* --3I", "* 99999999999D", "* -D ", "+ 007D<", "* 1X ", "*1D "])
    body = "".join(rng.choice(good) if rng.random() < 0.4 else rng.choice(parts) for _ in range(rng.randint(0, 7)))
    return head + body


def as_int(text):
    return int(text) if re.fullmatch(r"-?[0-9]+", text) and -(2**31) <= int(text) < 2**31 else None


def by_patterns(line):
    """Why a line is rejected, or what it tells."""
    head, links, link, named, entity = (re.compile(p.removeprefix("(?d)")) for p in (A.CHUNK, A.LINKS, A.LINK, A.ENTITIES, A.ENTITY))
    cases, entities = [link.search(x) for x in links.findall(line)], [entity.search(x) for x in named.findall(line)]
    if not (start := head.search(line)):
        return "chunk"
    if None in cases:
        return "link"
    if None in entities:
        return "entity"
    return line[0], as_int(start[1]), start[2], [x.groups() for x in cases], [x.groups() for x in entities]


def test_lines_with_odd_marks_are_told_as_the_patterns_tell_them(spark):
    rng, files, chunks, rejects = random.Random(7), [], {}, {}
    for k in range(400):
        lines, number = [], -1
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                lines.append(rng.choice(["a b c", "", " x", "# y", "EOS", "京都 き", "EOS x", "<C用;【a】;b;c(d)> z"]))
                continue
            lines.append(odd_line(rng))
            number += 1
            told = by_patterns(lines[-1])
            (rejects if isinstance(told, str) else chunks)[f"s{k}", number] = told if not isinstance(told, str) else (len(lines) - 1, lines[-1], told)
        files.append((f"s{k}", "\n".join(lines) + rng.choice(["", "\n"])))
    parsed = annotated.parse_annotated(spark.createDataFrame(files, "sid string, value string"))
    got = {(r.sid, r.chunk_id): (r.kind, r.parent, r.dep_type, [tuple(x) for x in r.cases], [tuple(x) for x in r.entities]) for r in parsed.chunks.collect()}
    assert got == chunks and len(got) > 100
    assert sorted((r.sid, r.ln, r.line, r.reason) for r in parsed.rejects.collect()) == sorted((sid, *x) for (sid, _), x in rejects.items())


def test_a_sentence_in_many_batches_is_one(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", "c", None]), i, rng.choice([-1, None, 1, 5, 9, 40]), rng.choice(["D", "P", None])) for i in range(60) for _ in range(rng.choice([0, 1, 2]))]
    chunks = spark.createDataFrame(rows, "sid string, chunk_id int, parent int, dep_type string").repartition(3)
    want = {}
    for sid, i, parent, _ in rows:
        if parent is not None and parent >= 0:
            want.setdefault((sid, parent), []).append(i)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        got = {(r.sid, r.parent): (r.children, r.min_child) for r in dependency.children(chunks).collect()}
        plan = dependency.children(chunks)._jdf.queryExecution().optimizedPlan().toString()
        cells = dependency.dependency_grid(chunks).groupBy("sid", "class").count().collect()
        counted = dependency.grid_classes(chunks).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {k: (sorted(v), min(v)) for k, v in want.items()}
    assert sorted(map(str, ((r[0], r[1], r[2]) for r in cells))) == sorted(map(str, (tuple(r) for r in counted)))
    # Sentences are packed before they are shuffled.
    assert plan.count("MapInArrow") == 2 and "Aggregate" not in plan


OPINION = "sid string, idx int, holder string, expr string, start int, end int, type string, target string"


@pytest.mark.parametrize("seed", range(3))
def test_spans_of_repeated_and_odd_rows(spark, seed):
    rng, words, spans = random.Random(seed), [], []
    for sid in ("a", "b", "c", "d", None):
        for _ in range(rng.choice([1, 1, 2])):
            at = 0
            for ln in range(rng.randint(1, 40)):
                size = rng.choice([0, 1, 2, 9])
                words.append((sid, ln, ln // 5, f"w{ln}", at, at + size - 1))
                at += size
        for idx in rng.sample(range(99), rng.choice([0, 3, 20])):
            start = rng.randrange(60)
            spans.append((sid, idx, rng.choice(["[著者]", "h", None]), "e", start, start + rng.choice([-1, 0, 3, 30]), rng.choice(["T", None]), "x"))
    morphemes = spark.createDataFrame(words, "sid string, ln int, chunk_id int, surface string, off_start int, off_end int").repartition(3)
    given = spark.createDataFrame(spans, OPINION).repartition(2)
    least = {}
    for sid, ln, _, _, a, b in words:
        met = [s[1] for s in spans if sid is not None and s[0] == sid and a <= b and s[4] <= s[5] and s[5] >= a and s[4] <= b]
        if met:
            least[sid, ln] = min([*met, least.get((sid, ln), 99)])
    first = {}
    for (sid, ln), idx in least.items():
        first[sid, idx] = min(ln, first.get((sid, idx), ln))
    told = {(sid, ln): (idx, f"{kind or ''}[x]" + ("" if holder == "[著者]" else f":{holder}")) for sid, idx, holder, _, _, _, kind, _ in spans if holder and (ln := first.get((sid, idx))) is not None}
    labels = {}
    for sid, ln, chunk, *_ in words:
        labels.setdefault((sid, chunk), []).extend([(ln, *told[sid, ln])] if (sid, ln) in told else [])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = {(r.sid, r.ln): r.idx for r in opinions.overlaps(morphemes, given).collect()}
        chunks = {(r.sid, r.chunk_id): (r.labels, r.with_sentiment) for r in opinions.label_chunks(morphemes, given).collect()}
        marked = opinions.marked_morphemes(morphemes, given)
        marks = sorted(map(str, map(tuple, marked.select("sid", "ln", "chunk_id", "surface", "off_start", "off_end", "idx", "in_opinion").collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == least
    assert chunks == {k: (", ".join(x[2] for x in sorted(v)), bool(v)) for k, v in labels.items()}
    assert marks == sorted(str((*w, least.get(w[:2]), w[:2] in least)) for w in words)


@pytest.mark.parametrize("name", SHUFFLED_ONCE)
def test_words_and_spans_meet_in_one_shuffle(spark, tmp_path, name):
    spark.createDataFrame([(1, "a b\nc", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("Union")[0]
    # Above the union of words and spans there is no join and no other shuffle.
    assert top.count("RepartitionByExpression") == 1 and "Join" not in top and "Aggregate" not in top


def test_expressions_are_found_without_copies_of_their_sentence(spark):
    rows = spark.createDataFrame([("s", "😀良い天気、良い", "a\\nb\\nc", "良い\\n天気\\nx\\ny", "T", "g\\n\\n")], "sid string, sent string, holder string, expr string, type string, target string")
    good, bad = opinions.locate_opinions(rows)
    assert sorted((r.idx, r.expr, r.start, r.end, r.type, r.target) for r in good.collect()) == [(0, "良い", 1, 2, "T", "g"), (1, "天気", 3, 4, None, None)]
    assert [(r.idx, r.expr, r.reason) for r in bad.collect()] == [(2, "x", "not found")]
    assert "Generate" not in good._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_not_shuffled_to_find_passages(spark):
    docs = spark.createDataFrame([(1, "a cat sat\non the mat", "en", "web"), (1, "the cat\nsat", "de", "src"), (None, "cat", "en", "x"), (3, "dog cats", "fr", None)], "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([(4, "cat sat\non the"), (2, "cat"), (2, "cat"), (6, "cat  sat"), (8, " \n"), (None, "cat")], "item_id long, text string")
    rows = adapters.opinion_rows(docs, bench)
    assert sorted((r.sid, r.expr, r.holder) for r in rows.collect()) == [("1", "cat", "[著者]"), ("1", r"cat\ncatsatonthe", r"[著者]\n[著者]"), ("3", "cat", "[著者]")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_sentences_are_made_once_to_be_written_by_article(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"A{i % 9}", i, f"A{i % 9}-{i}") for i in range(300)], "article string, sent_no int, sid string")
    corpus.write_by_article(rows.mapInArrow(seen, rows.schema), str(tmp_path / "a"), rows_per_file=50)
    assert made.value == 300 and spark.read.parquet(str(tmp_path / "a")).count() == 300


def test_pages_are_put_in_order_by_one_shuffle(spark):
    rng = random.Random(3)
    chunks = spark.createDataFrame([(f"s{k:02}", i, "*+"[i % 2], i - 1) for k in rng.sample(range(40), 40) for i in range(k % 5 + 1)], "sid string, chunk_id int, kind string, parent int").repartition(3)
    words = [(f"s{k:02}", i, 10 * i + j, f"w{j}\n") for k in range(40) for i in range(-1, k % 5 + 2) for j in range((k + i) % 3)]
    pages = annotated.output_order(chunks, spark.createDataFrame(words, "sid string, chunk_id int, ln int, surface string").repartition(4))
    held = {}
    for sid, i, *word in words:
        held.setdefault((sid, i), []).append(tuple(word))
    want = [(f"s{k:02}", i, ln, "*+"[i % 2], i - 1, w) for k in range(40) for i in range(k % 5 + 1) for ln, w in held.get((f"s{k:02}", i), [(None, None)])]
    assert list(map(tuple, pages.collect())) == want
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


def test_small_files_are_compressed(spark, tmp_path):
    path = str(tmp_path / "c")
    corpus.write_corpus(spark.createDataFrame([("a", "x\ny\n"), ("c", "z")], "sid string, value string"), path)
    assert sorted((r.sid, r.value) for r in corpus.read_corpus(spark, path, "part-*", folder_names=True).collect()) == [("a", "x\ny\n"), ("c", "z\n")]
    assert len(list((tmp_path / "c").rglob("part-*.gz"))) == 2


def test_files_of_an_article_are_put_together_without_a_shuffle_of_their_text(spark):
    rng = random.Random(5)
    rows = [(f"D{k}_1-1-{n}-0{m}", f"{k} {n} {m} {x}\n") for k in range(6) for x in range(1 + k % 2) for n, m in rng.sample([(n, m) for n in (1, 2, 10) for m in (1, 2)], 6)]
    raw = spark.createDataFrame(rows, "sid string, value string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        files = annotated.article_files(raw)
        got = {r.article: r.value for r in files.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 6 and "Exchange" not in files._jdf.queryExecution().executedPlan().toString()
    assert got == {f"D{k}_1": "".join(f"{k} {n} {m} {x}\n" for n in (1, 2, 10) for m in (1, 2) for x in range(1 + k % 2)) for k in range(6)}
