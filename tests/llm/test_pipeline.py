"""The pipeline's rows against a plain version of all its stages, which shares no code with them."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_corpus_operators import plain_line_dedup, roots
from tests.llm.test_similar import jaccard
from tests.llm.test_text_operators import edit_distance, plain_verdict
from textclusters.llm.registry import VOCABULARY


def holds(text, item):
    fold = lambda t: " ".join(t.lower().split())
    return edit_distance(fold(item), fold(text)) <= int(0.08 * len(fold(item)))


def plain(docs, bench):
    docs = [(i, t) for i, t in docs if plain_verdict(t or "")[1]]
    lines = plain_line_dedup(docs)
    docs = [(i, text) for i, (n, gone, _, text) in lines.items() if gone == 0 or gone < n]
    root = roots((a, b) for a, x in docs for b, y in docs if a < b and jaccard(x, y) >= 0.8)
    docs = [(i, t) for i, t in docs if root.get(i, i) == i]
    docs = [(i, t) for i, t in docs if not any(holds(t, item) for _, item in bench)]
    with open(public_tokenizers.path(VOCABULARY), "rb") as rows:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rows)}
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {i: (encoding.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [a + b + c for a in "bcdfghklmÀß" for b in ("a", "e", "io", "un", "ert", "ing") for c in ("", "r", "s", "Ton")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    edited = lambda t, k: " ".join("edited" if j in k else w for j, w in enumerate(t.split(" ")))
    bench = [(k, line(30)) for k in range(4)]
    shared = [line(12) for _ in range(4)]
    docs = [(i, "\n".join(line(rng.randint(30, 60)) for _ in range(rng.randint(2, 5)))) for i in range(40)]
    docs += [(60 + i, docs[i][1]) for i in range(3)]
    docs += [(70 + i, docs[10 + i][1].replace("\n", " ") + " " + rng.choice(words)) for i in range(4)]
    docs += [(75 + i, edited(docs[20 + i][1].replace("\n", " "), {20})) for i in range(4)]
    docs += [(80 + i, line(60) + "\n" + bench[i][1].upper().replace("I", "J", 2) + " " + line(60)) for i in range(4)]
    docs += [(90 + i, rng.choice(shared) + "\n" + line(70)) for i in range(10)]
    docs += [(150, docs[0][1].split("\n")[0] + " " + line(60) + " " + docs[0][1].split("\n")[0]), (151, line(49)), (152, line(90))]
    docs += [(200, None), (201, ""), (202, "same words " * 100)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, bench


def test_run_equals_the_plain_version(spark, tables):
    folder, docs, bench = tables
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    want = plain(docs, bench)
    assert got == want and 40 < len(want) < len(docs) - 15
    # Each stage takes some: long repeats, copies with edits, test items with edits.
    assert not {150, 60, 70, 75, 80, 200, 201, 202} & want.keys() and {0, 10, 20, 152} <= want.keys()


def test_stages_keep_the_columns(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_stages_take_repeated_rows_and_nulls_in_every_column(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    nulls = spark.createDataFrame([(None, tables[1][5][1], None, None, None), (None, None, None, None, None), (5, tables[1][5][1], None, None, None)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.unionByName(nulls).unionByName(docs), folder).count() > 0
