"""Tables of sentences, chunks and morphemes from annotated text.

A sentence file is one row, and all that is numbered along its lines is numbered
within a batch of rows, by linebatches: nothing is shuffled or sorted. Where rows are made by
a generator it is an outer one, since for inner ones the optimiser puts a filter on what is
exploded below it, and with the filter all of the parsing a second time.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textclusters.functions import annotation as A
from textclusters.functions import linebatches, packed
from textclusters.sources.corpus import kept


def _lines(value: Column) -> Column:
    return F.split(F.regexp_replace(value, r"\n\z", ""), "\n")


def lines(raw: DataFrame) -> DataFrame:
    """(sid, ln, line, kind) of raw(sid, value), one row for each sentence file."""
    each = raw.select("sid", F.posexplode_outer(_lines(F.col("value"))).alias("ln", "line")).where("ln IS NOT NULL")
    return each.withColumn("kind", A.line_kind(F.col("line")))


@dataclass
class Parsed:
    sentences: DataFrame
    chunks: DataFrame
    morphemes: DataFrame
    rejects: DataFrame


def _surface(line: Column) -> Column:
    return F.get(F.split(line, " "), F.lit(0))


def _surfaces(some_lines: Column) -> Column:
    """The surfaces of the morphemes among lines, joined."""
    return F.array_join(F.transform(F.filter(some_lines, lambda x: A.line_kind(x) == "morpheme"), _surface), "")


#: What linebatches.chunk_batches gives.
_CHUNK_ROWS = (
    "sid string, chunk_id int, ln int, kind string, parent int, dep_type string, "
    "cases array<struct<word:string,marker:string,position:string>>, entities array<struct<type:string,word:string>>, text string, line string"
)


def _chunk_rows(raw: DataFrame) -> DataFrame:
    """(sid, chunk_id, ln, kind, parent, dep_type, cases, entities, text, line, reason), a row for each chunk line.

    Lines with marks that do not stand once and in order, few if any, are given as line and
    told by the patterns; the others by their bytes.
    """
    rows = raw.select("sid", "value").mapInArrow(linebatches.chunk_batches, _CHUNK_ROWS)
    # Generated, so that no filter on what the patterns find runs them a second time.
    general = F.when(F.col("line").isNotNull(), F.struct(A.links_of(F.col("line")).alias("links"), A.named_of(F.col("line")).alias("named")))
    found = rows.select("*", F.explode_outer(F.array(general)).alias("found"))
    links, named = F.col("found.links"), F.col("found.named")
    told = {"cases": F.coalesce("cases", A.case_links(links)), "entities": F.coalesce("entities", A.entities(named))}
    return found.withColumns(told | {"reason": F.when(F.col("line").isNotNull(), A.malformed(F.col("line"), links, named))})


def numbered(files: DataFrame) -> DataFrame:
    """files with article, sent_no and sub_no, as their sid tells them."""
    number = lambda at: F.get(F.reverse(F.split("sid", "-")), F.lit(at)).try_cast("int")
    return files.withColumns({"article": F.regexp_extract("sid", r"^(.*)-1-[^-]*-[^-]*$", 1), "sent_no": number(1), "sub_no": number(0)})


def sentence_table(raw: DataFrame) -> DataFrame:
    """(sid, article, sent_no, sub_no, header, text) of raw(sid, value), from the row of each file alone."""
    rows = raw.select("sid", "value").mapInArrow(linebatches.sentence_batches, "sid string, header string, text string")
    return numbered(rows).select("sid", "article", "sent_no", "sub_no", "header", "text")


def _article_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, article = [], None

    def made() -> pa.RecordBatch:
        value = "".join(x[2] for x in sorted(held, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2])))
        return pa.RecordBatch.from_arrays([pa.array([article], pa.string()), pa.array([value], pa.string())], names=["article", "value"])

    for batch in batches:
        starts = packed.runs(batch.column("article"))
        names, rest = batch.column("article").take(pa.array(starts)).to_pylist(), [batch.column(c).to_pylist() for c in ("sent_no", "sub_no", "value")]
        for name, low, high in zip(names, starts, [*starts[1:], batch.num_rows], strict=True):
            if held and name != article:
                yield made()
                held = []
            article = name
            held += zip(*(x[low:high] for x in rest), strict=True)
    if held:
        yield made()


def article_files(raw: DataFrame) -> DataFrame:
    """(article, value): the sentence files of each article put together by number, of raw(sid, value) whose rows of an
    article lie side by side; nothing is shuffled, and one article is held at a time."""
    rows = numbered(raw.where("value IS NOT NULL")).select("article", "sent_no", "sub_no", "value")
    return rows.mapInArrow(_article_batches, "article string, value string")


class TooManyRejects(ValueError):
    """More chunk lines than allowed could not be parsed."""


def check_rejects(watch: Observation, limit: int = 0) -> dict[str, int]:
    """What an action on watched chunks has counted: lines, and rejects for each of REASONS.

    Raises TooManyRejects if there are more rejects than limit. Waits for the action.
    """
    counted = dict(watch.get)
    found = {reason: counted[reason] for reason in A.REASONS if counted[reason]}
    if sum(found.values()) > limit:
        raise TooManyRejects(f"{sum(found.values())} of {counted['lines']} chunk lines can't be parsed, {limit} may: " + ", ".join(f"{n} for their {reason}" for reason, n in found.items()))
    return counted


def parse_annotated(raw: DataFrame, strict: bool = False, watch: Observation | None = None) -> Parsed:
    """The tables of raw(sid, value).

    A chunk line that can't be parsed goes to rejects(sid, ln, line, reason) and the
    rest is kept; strict raises an error for it instead. With watch, the first action on
    chunks also counts lines and rejects by reason, in the same pass, and check_rejects()
    then tells or fails. chunks have the text of their morphemes. A null value has no
    lines and no sentence.
    """
    parts = _chunk_rows(raw)
    seen = parts
    if strict:
        seen = parts.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("malformed "), "reason", F.lit(" in "), "sid", F.lit(": "), "line"))))
    if watch is not None:
        seen = seen.observe(watch, F.count("*").alias("lines"), *(F.count_if(F.col("reason") == r).alias(r) for r in A.REASONS))
    chunks = seen.where("reason IS NULL").select("sid", "chunk_id", "kind", "parent", "dep_type", "cases", "entities", "text")
    fields = ", ".join(f"{name} string" for name in A.FIELDS)
    morphemes = raw.select("sid", "value").mapInArrow(linebatches.morpheme_batches(A.FIELDS), f"sid string, chunk_id int, ln int, {fields}, off_start int, off_end int")
    rejects = parts.where("reason IS NOT NULL").select("sid", "ln", "line", "reason")
    return Parsed(sentence_table(raw), chunks, morphemes, rejects)


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """(sid, chunk_id, text, label): the surfaces of a chunk joined, and its labels."""
    return chunks.select("sid", "chunk_id", "text", A.chunk_label(F.col("cases"), F.col("entities")).alias("label"))


def block_texts(raw: DataFrame) -> DataFrame:
    """(sid, block, text): the surfaces up to each end mark; a file may hold several."""
    cut = F.split(F.concat(F.lit("\n"), F.regexp_replace("value", r"\n\z", "")), r"\nEOS(?=\n|\z)")
    ended = F.slice(cut, F.lit(1), F.size(cut) - 1)
    # Each part starts with the line end that was put or left before its first line.
    texts = F.transform(ended, lambda part: _surfaces(F.filter(F.split(part, "\n"), lambda x: x != "")))
    return raw.where("value IS NOT NULL").select("sid", F.posexplode_outer(texts).alias("block", "text")).where("block IS NOT NULL")


def plain_texts(raw: DataFrame) -> DataFrame:
    """(sid, text): all surfaces of a file, without lines that start with #, *, + or E;
    files of such lines only are left out."""
    kept = F.filter(_lines(F.col("value")), lambda x: ~x.rlike(r"^[#*+E]"))
    return raw.select("sid", kept.alias("kept")).where(F.size("kept") > 0).select("sid", F.array_join(F.transform("kept", _surface), "").alias("text"))


def morpheme_display(morphemes: DataFrame) -> DataFrame:
    """(sid, ln, surface, reading, lemma, pos, conj): the columns as tables show them."""
    return morphemes.select("sid", "ln", "surface", "reading", "lemma", A.shown(F.col("pos1"), F.col("pos2")).alias("pos"), A.shown(F.col("conj_type"), F.col("conj_form")).alias("conj"))


def _pages(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(sid, chunk_id, ln, kind, parent, surface): each chunk with its morphemes, or alone, in order."""
    sentence, is_chunk = packed.flat(batch.column("is_chunk"))
    is_chunk = is_chunk.to_numpy(zero_copy_only=False).astype(bool)
    number, ln = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("chunk_id", "ln"))
    key = (sentence << 33) + number + 1
    chunk, morpheme = np.flatnonzero(is_chunk), np.flatnonzero(~is_chunk)
    morpheme = morpheme[np.argsort(key[morpheme], kind="stable")]
    low, high = (np.searchsorted(key[morpheme], key[chunk], side) for side in ("left", "right"))
    times = np.maximum(high - low, 1)
    row, none = np.repeat(chunk, times), np.repeat(high == low, times)
    at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(len(row))
    at = np.append(morpheme, 0)[np.where(none, len(morpheme), at)]
    order = np.lexsort((np.where(none, -1, ln[at] if len(ln) else at), key[row]))
    row, at, none = row[order], at[order], none[order]
    column = lambda name, which: batch.column(name).flatten().take(which)
    places = pa.array(at, mask=none)
    told = [pa.array(number[row].astype(np.int32)), pa.array((ln[at] if len(ln) else at).astype(np.int32), mask=none), column("kind", pa.array(row)), column("parent", pa.array(row)), column("surface", places)]
    yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(sentence[row])), *told], names=["sid", "chunk_id", "ln", "kind", "parent", "surface"])


def output_order(chunks: DataFrame, morphemes: DataFrame, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """(sid, chunk_id, ln, kind, parent, surface) as pages show them: sentences by name, in
    each the chunks by number and their morphemes by line. A chunk without morphemes has a row of its own.

    The rows of a sentence are packed and stored by keep; ranges of sentences are shuffled once, and sorted as they are unpacked."""
    null = lambda kind: F.lit(None).cast(kind)
    told = chunks.select("sid", F.lit(True).alias("is_chunk"), "chunk_id", F.lit(0).alias("ln"), "kind", "parent", null("string").alias("surface"))
    words = morphemes.where("sid IS NOT NULL").select("sid", F.lit(False).alias("is_chunk"), "chunk_id", "ln", null("string").alias("kind"), null("int").alias("parent"), "surface")
    schema = "sid string, chunk_id int, ln int, kind string, parent int, surface string"
    return packed.by_key(told.unionByName(words), "sid", _pages, schema, ("chunk_id", "ln"), keep)
