"""Opinion rows located in their sentences and attached to morphemes and chunks."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from textclusters.functions import annotation as A
from textclusters.functions import packed

_FIELDS = ("holder", "expr", "type", "target")
#: Greater than any idx; columns of entries that rise along a sentence.
_NONE, _RISING = 1 << 40, ("low", "high", "number")
#: Characters of fields whose values are held at a time, those of one row aside.
_FIELD_CHARS = 1 << 22


def filled(value: Column) -> Column:
    """Whether a field counts as given: not missing, empty or a single zero."""
    return F.coalesce(~value.isin("", "0"), F.lit(False))


def _parted(value: str) -> list[str]:
    """The values of a field, as annotation.fields_of()."""
    parts = value.split(A.PARTING)
    while parts and not parts[-1]:
        parts.pop()
    return parts


def _values(order: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(order, sid, at, fields, start): the values of rows(order, sid, sent, fields), a row for each holder, with the
    place of the expression in the sentence, -1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, at, start, fields = [], [], [], [[] for _ in _FIELDS]
            done = 0

            def made() -> pa.RecordBatch:
                keys = [batch.column(c).take(pa.array(of, pa.int64())) for c in (*order, "sid")]  # noqa: B023
                told = [pa.array(at, pa.int32()), *(pa.array(x, pa.string()) for x in fields), pa.array(start, pa.int32())]  # noqa: B023
                return pa.RecordBatch.from_arrays([*keys, *told], names=[*order, "sid", "at", *_FIELDS, "start"])

            columns = [batch.column(c) for c in ("sent", *_FIELDS)]
            for k in range(batch.num_rows):
                sent, *values = (c[k].as_py() for c in columns)
                parts = [_parted(v) for v in values]
                n = len(parts[0])
                of += [k] * n
                at += range(n)
                for mine, told in zip(fields, parts, strict=True):
                    mine += told[:n] + [None] * (n - len(told))
                start += [None if x is None or sent is None else sent.find(x) for x in fields[1][len(fields[1]) - n :]]
                done += sum(map(len, values))
                if done > _FIELD_CHARS:
                    yield made()
                    of, at, start, fields, done = [], [], [], [[] for _ in _FIELDS], 0
            yield made()

    return run


def locate_opinions(rows: DataFrame, order: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(opinions, rejects) of rows(sid, sent, holder, expr, type, target).

    Rows with an empty field are skipped. Fields hold several values; their number
    is that of the holders, and shorter fields give null beyond their end. An
    expression is at its first occurrence, start and end counted from 0, both
    inclusive. idx numbers the opinions of a sentence from 0 in the order of the
    columns named by order, then of the values. opinions(sid, idx, holder, expr,
    start, end, type, target); rejects(sid, idx, expr, reason): an expression that
    is missing, empty or not in the sentence.
    """
    given = rows
    for name in _FIELDS:
        given = given.where(filled(F.col(name)))
    # Located within the rows, so that sentences are neither copied nor shuffled with each of their values.
    rows = given.select(*order, *(F.col(c).cast("string").alias(c) for c in ("sid", "sent", *_FIELDS)))
    kinds = [StructField(c, rows.schema[c].dataType) for c in (*order, "sid")]
    each = rows.mapInArrow(_values(order), StructType([*kinds, StructField("at", IntegerType()), *(StructField(c, StringType()) for c in _FIELDS), StructField("start", IntegerType())]))
    reason = F.when(F.col("expr").isNull(), "missing").when(F.col("expr") == "", "empty").when(F.col("start") < 0, "not found")
    # A sentence's opinions are one window.
    number = F.row_number().over(Window.partitionBy("sid").orderBy(*order, "at", "holder", "expr", "type", "target")) - 1
    each = each.withColumn("idx", number.cast("int")).withColumn("reason", reason)
    good = each.where("reason IS NULL").select("sid", "idx", "holder", "expr", "start", (F.col("start") + F.length("expr") - 1).alias("end"), "type", "target")
    return good, each.where("reason IS NOT NULL").select("sid", "idx", "expr", "reason")


def _least_over(n: int, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each of n places the least value of the stretches low[k] to high[k], less the last, that hold it.

    A stretch is two of a power of two, which may overlap; those of a power are halved into the next lower one.
    """
    some = np.flatnonzero(low < high)
    low, high, value = low[some], high[some], value[some]
    power = np.frexp((high - low).astype(float))[1] - 1
    least = np.full(n, _NONE)
    for k in range(int(power.max(initial=0)), -1, -1):
        own = power == k
        np.minimum.at(least, low[own], value[own])
        np.minimum.at(least, high[own] - (1 << k), value[own])
        if k:
            half = 1 << k - 1
            halved = least.copy()
            np.minimum(halved[half:], least[:-half], out=halved[half:])
            least = halved
    return least


def _least_of(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each stretch low[k] to high[k], less the last, the least of values in it."""
    out = np.full(len(low), _NONE)
    power = np.where(low < high, np.frexp(np.maximum(high - low, 1).astype(float))[1] - 1, -1)
    least = values
    for k in range(int(power.max(initial=-1)) + 1):
        own = np.flatnonzero(power == k)
        out[own] = np.minimum(least[low[own]], least[high[own] - (1 << k)])
        if 1 << k < len(least):
            least = np.minimum(least[: -(1 << k)], least[1 << k :])
    return out


def _key(sentence: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits in the order of sentences, then by themselves."""
    return (sentence << 33) + number.astype(np.int64) + (1 << 31)


@dataclass
class _Met:
    """Words and spans of a batch of sentences, and of each word the lowest span that overlaps it, or _NONE.

    word and span are places of entries, and sentence tells whose each entry is."""

    sentence: np.ndarray
    number: np.ndarray
    word: np.ndarray
    span: np.ndarray
    least: np.ndarray


def _meet(batch: pa.RecordBatch) -> _Met:
    sentence, is_span = packed.flat(batch.column("is_span"))
    is_span = is_span.to_numpy(zero_copy_only=False).astype(bool)
    low, high, number = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("low", "high", "number"))
    word, span = np.flatnonzero(~is_span), np.flatnonzero(is_span)
    full = span[low[span] <= high[span]]
    # Spans that hold a word's start, then words that hold a span's start.
    starts = _key(sentence[word], low[word])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    least = np.empty(len(word), np.int64)
    least[order] = _least_over(len(word), np.searchsorted(starts, _key(sentence[full], low[full])), np.searchsorted(starts, _key(sentence[full], high[full]), "right"), number[full])
    starts = _key(sentence[full], low[full])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    inner = _least_of(number[full][order], np.searchsorted(starts, _key(sentence[word], low[word])), np.searchsorted(starts, _key(sentence[word], high[word]), "right"))
    least = np.where(low[word] <= high[word], np.minimum(least, inner), _NONE)
    # Rows that repeat a word have the lowest span of all.
    key = _key(sentence[word], number[word])
    if len(key) > 1 and not (key[1:] > key[:-1]).all():
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
        least[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return _Met(sentence, number, word, span, least)


def _entries(morphemes: DataFrame, opinions: DataFrame, words: list[Column] | None = None, spans: list[Column] | None = None) -> DataFrame:
    """(sid, is_span, low, high, number, ...): morphemes and spans in rows of one form; spans of no sentence overlap nothing."""
    place = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    known = lambda low, high: F.col(low).isNotNull() & F.col(high).isNotNull()
    # What has no place is empty.
    form = lambda is_span, low, high, number, more: ["sid", F.lit(is_span).alias("is_span"), place(low).alias("low"), F.when(known(low, high), place(high)).otherwise(place(low) - 1).alias("high"), F.coalesce(F.col(number).cast("int"), F.lit(-1)).alias("number"), *more]
    return morphemes.select(*form(False, "off_start", "off_end", "ln", words or [])).unionByName(opinions.where("sid IS NOT NULL AND idx IS NOT NULL").select(*form(True, "start", "end", "idx", spans or [])))


def _overlapping(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    met = _meet(batch)
    _, one = np.unique(_key(met.sentence[met.word], met.number[met.word]), return_index=True)
    found = one[met.least[one] < _NONE]
    word = met.word[found]
    yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(met.sentence[word])), pa.array(met.number[word].astype(np.int32)), pa.array(met.least[found].astype(np.int32))], names=["sid", "ln", "idx"])


def overlaps(morphemes: DataFrame, opinions: DataFrame) -> DataFrame:
    """(sid, ln, idx): the lowest opinion whose span overlaps the morpheme's offsets.

    Two stretches overlap if one holds the start of the other. Morphemes and spans of a sentence
    are packed and shuffled once, and all sentences of a batch are met at once: places are
    sorted, a stretch of places is two of a power of two, and the least idx goes down from the greater
    powers to the lower ones. n morphemes and m spans take (n + m) log(n + m) steps, never n * m.
    Nothing overlaps an empty span or morpheme.
    """
    rows = _entries(morphemes.where("sid IS NOT NULL AND off_start <= off_end"), opinions.where("start <= end"))
    return packed.by_key(rows, "sid", _overlapping, "sid string, ln int, idx int", _RISING)


def _marked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    met = _meet(batch)
    word = met.word
    own = {name: batch.column(name).flatten().take(pa.array(word)) for name in ("number", "low", "high", "gaps", *batch.schema.names[6:])}
    gaps = own.pop("gaps").to_numpy(zero_copy_only=False)
    for k, name in enumerate(("number", "low", "high")):
        if gaps.any():
            own[name] = pc.if_else(pa.array(gaps >> k & 1 == 0), own[name], pa.scalar(None, own[name].type))
    found = (met.least < _NONE) & (gaps == 0)
    idx = pa.array(np.where(found, met.least, 0).astype(np.int32), mask=~found)
    yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(met.sentence[word])), *own.values(), idx], names=["sid", *own, "idx"])


def marked_morphemes(morphemes: DataFrame, opinions: DataFrame | None) -> DataFrame:
    """morphemes with idx and in_opinion; without a store of opinions none is inside.

    All columns of morphemes are shuffled, so what is not needed is to be left out before."""
    if opinions is None:
        return morphemes.withColumn("idx", F.lit(None).cast("int")).withColumn("in_opinion", F.lit(False))
    places = ("ln", "off_start", "off_end")
    rest = [c for c in morphemes.columns if c not in ("sid", *places)]
    # The three places are shuffled once, with a bit for each that is null.
    gaps = sum((F.col(c).isNull().cast("int") * (1 << k) for k, c in enumerate(places)), F.lit(0)).cast("byte")
    filled = morphemes.select("*", gaps.alias("_gaps")).withColumns({c: F.coalesce(c, F.lit(0)) for c in places})
    kinds = {c: morphemes.schema[c].dataType for c in rest}
    rows = _entries(filled, opinions, [F.col("_gaps").alias("gaps"), *(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(rest))], [F.lit(0).cast("byte").alias("gaps"), *(F.lit(None).cast(kinds[c]).alias(f"_{k}") for k, c in enumerate(rest))])
    schema = StructType([StructField("sid", morphemes.schema["sid"].dataType), *(StructField(c, IntegerType()) for c in ("number", "low", "high")), *(StructField(f"_{k}", kinds[c]) for k, c in enumerate(rest)), StructField("idx", IntegerType())])
    marked = packed.by_key(rows, "sid", _marked, schema, _RISING)
    told = {"sid": "sid", "ln": "number", "off_start": "low", "off_end": "high"} | {c: f"_{k}" for k, c in enumerate(rest)}
    return marked.select(*(F.col(told[c]).cast(morphemes.schema[c].dataType).alias(c) for c in morphemes.columns), "idx", F.col("idx").isNotNull().alias("in_opinion"))


def opinion_label(kind: Column, target: Column, holder: Column) -> Column:
    """type[target], with the holder unless that is the author."""
    told = F.concat(F.coalesce(kind, F.lit("")), F.lit("["), F.coalesce(target, F.lit("")), F.lit("]"))
    return F.when(holder == A.AUTHOR, told).otherwise(F.concat(told, F.lit(":"), holder))


def _labelled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    met = _meet(batch)
    chunk = batch.column("chunk_id").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    labels = batch.column("label").flatten()
    sentence, number = met.sentence, met.number
    # The first morpheme that a span is the lowest for.
    inside = np.flatnonzero(met.least < _NONE)
    owner, line, idx = sentence[met.word[inside]], number[met.word[inside]], met.least[inside]
    order = np.lexsort((line, idx, owner))
    keys, first = np.unique(_key(owner[order], idx[order]), return_index=True)
    line = line[order][first]
    told = met.span[labels.take(pa.array(met.span)).is_valid().to_numpy(zero_copy_only=False)]
    mine = _key(sentence[told], number[told])
    at = np.searchsorted(keys, mine)
    has = at < len(keys)
    has[has] = keys[at[has]] == mine[has]
    told, at = told[has], line[at[has]]
    # All rows of that morpheme have the label.
    words = _key(sentence[met.word], number[met.word])
    order = np.argsort(words, kind="stable")
    words = words[order]
    low, high = (np.searchsorted(words, _key(sentence[told], at), side) for side in ("left", "right"))
    times = high - low
    rows = met.word[order[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]]
    told, at = np.repeat(told, times), np.repeat(at, times)
    chunks, one = np.unique(_key(sentence[met.word], chunk[met.word]), return_index=True)
    of = np.searchsorted(chunks, _key(sentence[rows], chunk[rows]))
    order = np.lexsort((number[told], at, of))
    held = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[order], np.arange(len(chunks) + 1)).astype(np.int32)), labels.take(pa.array(told[order])))
    one = met.word[one]
    columns = [batch.column("sid").take(pa.array(sentence[one])), pa.array(chunk[one].astype(np.int32)), pc.binary_join(held, ", "), pc.greater(pc.list_value_length(held), 0)]
    yield pa.RecordBatch.from_arrays(columns, names=["sid", "chunk_id", "labels", "with_sentiment"])


def label_chunks(morphemes: DataFrame, opinions: DataFrame) -> DataFrame:
    """(sid, chunk_id, labels, with_sentiment) of every chunk that has morphemes.

    A span is labelled once, at the first morpheme that it is the lowest for; a
    span hidden by lower ones is not. Labels follow the order of the morphemes. One shuffle, as overlaps().
    """
    label = opinion_label(F.col("type"), F.col("target"), F.col("holder"))
    rows = _entries(morphemes, opinions, [F.col("chunk_id").cast("int").alias("chunk_id"), F.lit(None).cast("string").alias("label")], [F.lit(0).alias("chunk_id"), label.alias("label")])
    return packed.by_key(rows, "sid", _labelled, "sid string, chunk_id int, labels string, with_sentiment boolean", (*_RISING, "chunk_id"))


def sentences_with_opinions(sentences: DataFrame, opinions: DataFrame | None) -> DataFrame:
    """sentences with the number of their opinions; those without any stay."""
    if opinions is None:
        return sentences.withColumn("n_opinions", F.lit(0).cast("long"))
    counted = opinions.groupBy("sid").agg(F.count("*").alias("n"))
    return sentences.join(counted, "sid", "left").select(*sentences.columns, F.coalesce("n", F.lit(0)).cast("long").alias("n_opinions"))
