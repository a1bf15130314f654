"""Annotated text made and parsed in Arrow batches, by arithmetic on the bytes of all their lines.

What is numbered along the lines of a file is a running sum over a batch less its value
where the file starts, and a field is a stretch of bytes: a batch takes a fixed number of
passes, and no line is looked at alone.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text or annotated text that are worked on at a time, one long value aside, and words of annotated text made at a time, one long line aside.
TEXT_BYTES, VALUE_BYTES, WORDS = 1 << 20, 4 << 20, 1 << 16
#: Bytes of the format.
_LF, _BLANK, _HASH, _STAR, _PLUS, _MINUS, _OPEN, _CLOSE, _COLON, _SEMI, _LESS, _MORE = b"\n #*+-():;<>"
_LINK, _NAMED, _LEFT, _RIGHT = (np.frombuffer(x.encode(), np.uint8) for x in ("<C用;", "<NE:", "【", "】"))
#: More bytes and places than any look-ahead needs.
_SPARE = 16


def bounded(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch by parts of so many bytes of a column at most; a longer value is a part of its own."""
    own = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.concatenate([[0], np.cumsum(own, dtype=np.int64)]), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text starts, and the end); nulls are empty."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(texts, "")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, null: np.ndarray | None = None) -> pa.StringArray:
    """The stretches of data as texts; those of null are null."""
    size = end - start if null is None else np.where(null, 0, end - start)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    own = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    valid = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little"))
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(own), valid)


def _next(places: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The number of the first of some sorted places from start on."""
    return np.searchsorted(places, start)


def _places(data: np.ndarray, *wanted: int) -> list[np.ndarray]:
    """Where each of some bytes stands, and behind them places beyond all data; found in one pass."""
    known = np.zeros(256, bool)
    known[list(wanted)] = True
    at = np.flatnonzero(known[data])
    byte, beyond = data[at], np.full(_SPARE, len(data) + _SPARE)
    return [np.concatenate([at[byte == one], beyond]) for one in wanted]


def _spells(padded: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether wanted stands at places of padded data."""
    out = np.ones(len(at), bool)
    for k, byte in enumerate(wanted):
        out &= padded[at + k] == byte
    return out


# Annotated text from documents.


def _chosen(choices: list[str], which: np.ndarray) -> pa.Array:
    return pa.array(choices).take(pa.array(which))


def _where(mask: np.ndarray, values: pa.Array) -> pa.Array:
    """values, one for each place of the mask, and empty texts elsewhere."""
    return pa.concat_arrays([values, pa.array([""])]).take(pa.array(np.where(mask, np.cumsum(mask) - 1, len(values))))


def _joined(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """(document, line, place in the line, word) of each word of a batch(text)."""
    data, offsets = bytes_of(batch.column("text"))
    gap = (data == _BLANK) | (data == _LF)
    full = offsets[:-1] < offsets[1:]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[offsets[:-1][full]] = after[offsets[1:][full] - 1] = True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    ends = np.flatnonzero(data == _LF)
    line = np.searchsorted(ends, start) - np.searchsorted(ends, offsets[:-1])[doc]
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
    count = np.arange(len(start))
    place = count - np.maximum.accumulate(np.where(new, count, 0)) if len(start) else count
    return doc, line, place, strings(data, start, end)


def _unmarked(words: pa.StringArray) -> pa.StringArray:
    """Words, those that read as a mark of the format with a leading underscore."""
    if not len(words):
        return words
    data, offsets = bytes_of(words)
    first = data[offsets[:-1]]
    mark = (first == _HASH) | (first == _STAR) | (first == _PLUS) | pc.equal(words, "EOS").to_numpy(zero_copy_only=False).astype(bool)
    return pc.if_else(pa.array(mark), _joined("_", words), words) if mark.any() else words


def word_batches(per_chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(sid, ln, chunk_id, surface, off_start, off_end) of batches(sid, text): all words of a text, so many a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in bounded(whole, "text", TEXT_BYTES):
                doc, _, _, words = _words(part)
                size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(size)])
                first = np.searchsorted(doc, np.arange(part.num_rows))
                ln, start = np.arange(len(doc)) - first[doc], upto[:-1] - upto[first][doc]
                numbers = [pa.array(x.astype(np.int32)) for x in (ln, ln // per_chunk, start, start + size - 1)]
                yield pa.RecordBatch.from_arrays([part.column("sid").take(pa.array(doc)), *numbers[:2], words, *numbers[2:]], names=["sid", "ln", "chunk_id", "surface", "off_start", "off_end"])

    return run


def _annotated(batch: pa.RecordBatch, piece: int | None, broken: bool) -> Iterator[pa.RecordBatch]:
    doc, line, place, words = _words(batch)
    words = _unmarked(words)
    part = place // piece if piece else np.zeros_like(place)
    place = place - part * (piece or 0)
    first = np.flatnonzero(place == 0)
    n = np.diff(np.append(first, len(place)))
    sub = part[first] + 1
    of = pa.array(doc[first])
    names = _joined("D", batch.column("doc_id").take(of), "_", batch.column("lang").take(of), "_1-1-", pa.array(line[first] + 1).cast(pa.string()), _chosen(["-0", "-"], (sub > 9).astype(int)), pa.array(sub).cast(pa.string()))
    at = 0
    while at < len(first):
        # Whole pieces of WORDS words or so.
        end = max(at + 1, int(np.searchsorted(first, first[at] + WORDS)))
        stop = first[end] if end < len(first) else len(place)
        yield _pieces(names.slice(at, end - at), n[at:end], place[first[at] : stop], words.slice(first[at], stop - first[at]), broken)
        at = end


def _pieces(names: pa.StringArray, n: np.ndarray, i: np.ndarray, word: pa.StringArray, broken: bool) -> pa.RecordBatch:
    """The annotated text of pieces of n words, laid end to end; i is each word's place in its piece."""
    told = pc.fill_null(names, "")
    owner, of_n = np.repeat(np.arange(len(n)), n), np.repeat(n, n)
    length = pc.utf8_length(word).to_numpy(zero_copy_only=False).astype(np.int64)
    plain = ~pc.match_substring_regex(word, "[<>【】();:]").to_numpy(zero_copy_only=False)
    data, offsets = bytes_of(word)
    first = data[offsets[:-1]]
    last = i == of_n - 1
    parent = np.where(last, -1, np.minimum(i + 1 + length % 3, of_n - 1))
    linked = np.zeros(len(i), bool)
    linked[1:] = (i[1:] > 0) & plain[:-1]
    before = np.flatnonzero(linked) - 1
    by = length[before]
    number = pa.array(i[linked]).cast(pa.string())
    marker = (by % 5 == 0).astype(int) + 2 * (by % 11 == 0) * broken
    link = _joined(
        *("<C用;【", word.take(pa.array(before)), _chosen(["】;ガ;0;", "】;メモ;0;", ";ガ;0;", ";メモ;0;"], marker), number, ";9.999:"),
        *(told.take(pa.array(owner[linked])), _chosen(["(同一文):", "(1文前):"], (by % 3 == 0).astype(int)), number, "タグ>"),
    )
    named = (first >= ord("A")) & (first <= ord("Z")) & plain
    entity = _joined("<NE:LOCATION:", word.filter(pa.array(named)), ">")
    ends = (length % 4 == 0).astype(int) + 2 * ((i == 5) & (of_n > 6) | last)
    tails = [f" 名詞 6 {second} 1 * 0 * 0\n{end}" for end in ("", "EOS\n") for second in ("普通名詞", "*")]
    lines = _joined(
        *(_where(i == 0, _joined("# S-ID:", told, "\n")), _chosen(["* ", "+ "], i % 2), pa.array(parent).cast(pa.string()), _chosen(["D ", "P "], (length % 7 == 0).astype(int))),
        *(_where(linked, link), _where(named, entity), "\n", word, " ", word, " ", word, _chosen(tails, ends)),
    )
    data, offsets = bytes_of(lines)
    # The lines of a piece lie side by side.
    starts = np.append(offsets[:-1][i == 0], len(data)).astype(np.int32)
    values = pa.StringArray.from_buffers(len(n), pa.py_buffer(starts), pa.py_buffer(data))
    return pa.RecordBatch.from_arrays([names, pc.if_else(names.is_valid(), values, pa.scalar(None, pa.string())) if names.null_count else values], names=["sid", "value"])


def annotate(piece: int | None, broken: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(sid, value) of batches(doc_id, lang, text): the annotated text that adapters.annotated() describes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in bounded(whole, "text", TEXT_BYTES):
                yield from _annotated(part, piece, broken)

    return run


# Annotated text, parsed.


class Lines:
    """The lines of files(sid, value): of each its file, number, kind, stretch of bytes and chunk.

    A chunk's number is -1 for lines before the first chunk line. Files without value have no lines.
    """

    def __init__(self, files: pa.RecordBatch) -> None:
        files = files.filter(files.column("value").is_valid())
        self.sid = files.column("sid")
        data, offsets = bytes_of(files.column("value"))
        self.data, self.padded = data, np.concatenate([data, np.zeros(_SPARE, np.uint8)])
        # A line end that ends the file starts no line.
        stop = offsets[1:] - ((offsets[1:] > offsets[:-1]) & (self.padded[offsets[1:] - 1] == _LF))
        ends = np.flatnonzero(data == _LF)
        ends = ends[ends < stop[np.searchsorted(offsets, ends, "right") - 1]]
        held = np.searchsorted(ends, offsets)
        self.n = np.diff(held) + 1
        self.first = np.cumsum(self.n) - self.n
        self.file = np.repeat(np.arange(len(self.n)), self.n)
        self.number = np.arange(len(self.file)) - self.first[self.file]
        opens = self.number == 0
        self.start = np.empty(len(self.file), np.int64)
        self.start[opens], self.start[~opens] = offsets[:-1], ends + 1
        closes = np.ones(len(self.file), bool)
        closes[:-1] = opens[1:]
        self.end = np.empty_like(self.start)
        self.end[closes], self.end[~closes] = stop, ends
        size = self.end - self.start
        lead = np.where(size > 0, self.padded[self.start], 0)
        self.header = lead == _HASH
        self.chunk = (lead == _STAR) | (lead == _PLUS)
        self.morpheme = ~self.header & ~self.chunk & ~((size == 3) & _spells(self.padded, self.start, b"EOS"))
        seen = np.cumsum(self.chunk)
        self.chunk_id = seen - (seen - self.chunk)[self.first][self.file] - 1 if len(seen) else seen

    def fields(self, which: np.ndarray) -> Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of some lines (start, end, missing) of the field at a place, parted by blanks."""
        (blanks,), start, end = _places(self.data, _BLANK), self.start[which], self.end[which]
        at = _next(blanks, start)

        def field(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            last = len(blanks) - 1
            begin = start if k == 0 else blanks[np.minimum(at + k - 1, last)] + 1
            return begin, np.minimum(blanks[np.minimum(at + k, last)], end), begin > end

        return field

    def surfaces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lines of morphemes, where their surfaces start, where they end)."""
        which = np.flatnonzero(self.morpheme)
        start, end, _ = self.fields(which)(0)
        return which, start, end


def _texts(lines: Lines, start: np.ndarray, stop: np.ndarray) -> pa.StringArray:
    """The surfaces of the morphemes among the lines from start up to stop, joined."""
    which, begin, end = lines.surfaces()
    data, offsets = bytes_of(strings(lines.data, begin, end))
    return strings(data, offsets[np.searchsorted(which, start)], offsets[np.searchsorted(which, stop)])


def sentence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, header, text) of files(sid, value): the first header line, and all surfaces joined."""
    for whole in batches:
        for part in bounded(whole, "value", VALUE_BYTES):
            lines = Lines(part)
            text = _texts(lines, lines.first, lines.first + lines.n)
            headers = np.flatnonzero(lines.header)
            at = np.append(headers, len(lines.file))[np.searchsorted(headers, lines.first)]
            none = at >= lines.first + lines.n
            at = np.where(none, lines.first, at)
            yield pa.RecordBatch.from_arrays([lines.sid, strings(lines.data, lines.start[at], lines.end[at], none), text], names=["sid", "header", "text"])


def morpheme_batches(places: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(sid, chunk_id, ln, fields, off_start, off_end) of files(sid, value): places are those of the fields of a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in bounded(whole, "value", VALUE_BYTES):
                lines = Lines(part)
                which = np.flatnonzero(lines.morpheme)
                field = lines.fields(which)
                told = {name: strings(lines.data, *field(k)) for name, k in places.items()}
                size = pc.utf8_length(strings(lines.data, *field(0)[:2])).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(size)])
                file = lines.file[which]
                start = upto[:-1] - upto[np.searchsorted(which, lines.first)][file]
                numbers = {"chunk_id": lines.chunk_id[which], "ln": lines.number[which]}
                offsets = {"off_start": start, "off_end": start + size - 1}
                whole_row = {"sid": lines.sid.take(pa.array(file))} | {k: pa.array(v.astype(np.int32)) for k, v in numbers.items()} | told | {k: pa.array(v.astype(np.int32)) for k, v in offsets.items()}
                yield pa.RecordBatch.from_arrays(list(whole_row.values()), names=list(whole_row))

    return run


def _heads(lines: Lines, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parent, whether it is no int, place of the type, whether the line starts as chunk lines must)."""
    padded, at, stop = lines.padded, lines.start[which] + 2, lines.end[which]
    good = (at <= stop) & (padded[at - 1] == _BLANK)
    value, digits, odd = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    minus = good & (at < stop) & (padded[np.minimum(at, len(padded) - 1)] == _MINUS)
    at = at + minus
    going = np.flatnonzero(good & (at < stop))
    while len(going):
        byte = padded[at[going]].astype(np.int64)
        digit = (byte >= 48) & (byte <= 57)
        odd[going[byte == _MINUS]] = True
        value[going[digit]] = np.minimum(value[going[digit]] * 10 + byte[digit] - 48, 1 << 40)
        digits[going[digit]] += 1
        going = going[digit | (byte == _MINUS)]
        at[going] += 1
        going = going[at[going] < stop[going]]
    kind = padded[np.minimum(at, len(padded) - 1)]
    good &= (at < stop) & np.isin(kind, list(b"ADIP"))
    value = np.where(minus, -value, value)
    return value, odd | (digits == 0) | (value > 2**31 - 1) | (value < -(2**31)), at, good


def _tags(lines: Lines, less: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, line, whether it is a link, whether it is a named entity) of tags of chunk lines that are one or the other."""
    padded = lines.padded
    start, follows = less[:-_SPARE], less[1 : len(less) - _SPARE + 1]
    link, named = _spells(padded, start, _LINK), _spells(padded, start, _NAMED)
    some = np.flatnonzero(link | named)
    line = np.searchsorted(lines.start, start[some], "right") - 1
    in_chunk = lines.chunk[line]
    some, line = some[in_chunk], line[in_chunk]
    start, follows, link, named = start[some], follows[some], link[some], named[some]
    end = more[_next(more, start)]
    # Where another tag starts within one, or none ends it, it has no end here.
    return start, np.where((end < lines.end[line]) & (follows > end), end, -1), line, link, named


def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, chunk_id, ln, kind, parent, dep_type, cases, entities, text, line) of files(sid, value), a row for each chunk line.

    Where all links and named entities of a line have their marks once and in order, cases and
    entities are what the patterns of functions.annotation find, and line is null. Any other
    line, malformed ones too, is left to the patterns: line is the line, cases and entities are null.
    """
    for whole in batches:
        for part in bounded(whole, "value", VALUE_BYTES):
            lines = Lines(part)
            data, padded = lines.data, lines.padded
            which = np.flatnonzero(lines.chunk)
            parent, no_parent, kind, good = _heads(lines, which)
            less, more, semi, left, right, colon = _places(data, _LESS, _MORE, _SEMI, _OPEN, _CLOSE, _COLON)
            start, end, line, link, named = _tags(lines, less, more)
            plain = np.zeros(len(lines.file), bool)
            plain[which] = good
            plain[line[end < 0]] = False

            own, stop, at = start[link], end[link], line[link]
            begin = own + len(_LINK) + len(_LEFT)
            first = _next(semi, begin)
            one, two = semi[first], semi[first + 1]
            opens = left[_next(left, two + 1)]
            closes = right[_next(right, opens + 1)]
            fine = (begin < stop) & (closes < stop) & _spells(padded, own + len(_LINK), _LEFT) & (two > one + 1) & (opens > two + 1) & (closes > opens + 1) & (one - len(_RIGHT) >= begin)
            fine &= _spells(padded, np.where(fine, one - len(_RIGHT), 0), _RIGHT)
            plain[at[~fine]] = False

            mine, until, here = start[named], end[named], line[named]
            letters = mine + len(_NAMED)
            parts_at = colon[_next(colon, letters + 4)]
            whole_type = np.all([padded[np.minimum(letters + k, len(data))] < 128 for k in range(4)], axis=0) if len(mine) else np.zeros(0, bool)
            right_ = (parts_at + 1 < until) & whole_type
            plain[here[~right_]] = False

            chunk = plain[which]
            keep, keep_named = plain[at], plain[here]
            cases = _listed(which, at[keep], {"word": strings(data, begin[keep], one[keep] - len(_RIGHT)), "marker": strings(data, one[keep] + 1, two[keep]), "position": strings(data, opens[keep] + 1, closes[keep])}, ~chunk)
            letters, parts_at, until = letters[keep_named], parts_at[keep_named], until[keep_named]
            entities = _listed(which, here[keep_named], {"type": strings(data, letters, letters + 4), "word": strings(data, parts_at + 1, until)}, ~chunk)

            # A chunk's lines end before the next chunk line, or with the file.
            behind = np.minimum(np.append(which, len(lines.file))[1:], (lines.first + lines.n)[lines.file[which]])
            text = _texts(lines, which, behind)
            lead = lines.start[which]
            columns = {
                "sid": lines.sid.take(pa.array(lines.file[which])),
                "chunk_id": pa.array(lines.chunk_id[which].astype(np.int32)),
                "ln": pa.array(lines.number[which].astype(np.int32)),
                "kind": strings(data, lead, lead + 1),
                "parent": pa.array(np.where(no_parent, 0, parent).astype(np.int32), mask=no_parent),
                "dep_type": strings(padded, kind, kind + 1, ~good),
                "cases": cases,
                "entities": entities,
                "text": text,
                "line": strings(data, lead, lines.end[which], chunk),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _listed(which: np.ndarray, owner: np.ndarray, fields: dict[str, pa.Array], null: np.ndarray) -> pa.ListArray:
    """For each of some lines the structs of their owners in a list; null for lines that are null."""
    held = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    ends = np.append(np.searchsorted(owner, which), len(owner)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), held, mask=pa.array(null)) if len(which) else pa.array([], pa.list_(held.type))
