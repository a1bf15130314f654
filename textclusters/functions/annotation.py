"""Columns parsed from the lines of an annotated sentence.

Patterns are matched with UNIX lines: only a line feed ends what a dot matches.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns, marks and names of the annotation format.
CHUNK = r"(?d)^[+*] ([-0-9]*)([ADIP])"
LINKS, LINK = r"(?d)<(C用;.+?)>", r"(?d)C用;【(.*?)】;(.+?);.+?\((.+?)\)"
ENTITIES, ENTITY = r"(?d)<NE:(.+?)>", r"(?d)^(....).*?:(.+?)$"
MEMO, SAME_SENTENCE, AUTHOR = "メモ", "同一文", "[著者]"
CATEGORIES = ("Keitai", "Kyoto", "Gourmet", "Sports")
#: Fixed value: what parts the values of a field, a backslash and an n.
PARTING = "\\n"
#: Entries of a block of running sums at least.
_BLOCK = 32
#: The places of the fields of a morpheme line.
FIELDS = {"surface": 0, "reading": 1, "lemma": 2, "pos1": 3, "pos2": 5, "conj_type": 7, "conj_form": 9}


def line_kind(line: Column) -> Column:
    """header, chunk, end or morpheme, tested in this order."""
    return F.when(line.startswith("#"), "header").when(line.rlike(r"^[+*]"), "chunk").when(line == "EOS", "end").otherwise("morpheme")


def links_of(line: Column) -> Column:
    """array<string>: all case and anaphora links of a chunk line, as they stand there."""
    return F.regexp_extract_all(line, F.lit(LINKS), F.lit(1))


def named_of(line: Column) -> Column:
    """array<string>: all named entities of a chunk line, as they stand there."""
    return F.regexp_extract_all(line, F.lit(ENTITIES), F.lit(1))


def case_links(links: Column) -> Column:
    """array<struct<word, marker, position>> of links_of()."""
    return F.transform(links, lambda x: F.struct(*(F.regexp_extract(x, LINK, i + 1).alias(name) for i, name in enumerate(("word", "marker", "position")))))


def entities(named: Column) -> Column:
    """array<struct<type, word>> of named_of(); the type is its first four characters."""
    return F.transform(named, lambda x: F.struct(F.regexp_extract(x, ENTITY, 1).alias("type"), F.regexp_extract(x, ENTITY, 2).alias("word")))


#: Why a chunk line may not be parsed.
REASONS = ("chunk", "link", "entity")


def malformed(line: Column, links: Column, named: Column) -> Column:
    """Why a chunk line can't be parsed, or null."""
    bad = lambda found, one: F.exists(found, lambda x: ~x.rlike(one))
    return F.when(~line.rlike(CHUNK), "chunk").when(bad(links, LINK), "link").when(bad(named, ENTITY), "entity")


def link_label(link: Column) -> Column:
    """How a link is shown: memo:word, word:marker within the sentence, else all three."""
    word, marker, position = link["word"], link["marker"], link["position"]
    return F.when(marker == MEMO, F.concat(marker, F.lit(":"), word)).when(position == SAME_SENTENCE, F.concat(word, F.lit(":"), marker)).otherwise(F.concat(word, F.lit(":"), marker, F.lit(":"), position))


def chunk_label(cases: Column, named: Column) -> Column:
    """Labels of links, then of entities, in order; null-free and comma-separated."""
    return F.array_join(F.concat(F.transform(cases, link_label), F.transform(named, lambda e: F.concat(e["type"], F.lit(":"), e["word"]))), ", ")


def shown(first: Column, second: Column) -> Column:
    """Two fields with a blank between; a star is shown as nothing."""
    blank = lambda c: F.when(c == "*", "").otherwise(c)
    return F.concat(blank(first), F.lit(" "), blank(second))


def fields_of(value: Column) -> Column:
    """The values of a field that holds several, parted by a backslash and an n.

    Trailing empty values do not count, as in the annotation tools.
    """
    parts = F.split(value, r"\\n")
    last = F.coalesce(F.array_max(F.filter(F.transform(parts, lambda x, i: F.when(x != "", i + 1)), lambda n: n.isNotNull())), F.lit(0))
    return F.slice(parts, F.lit(1), last)


def category_of(article: Column, categories=CATEGORIES) -> Column:
    """The first category whose name is in the article's, or null."""
    found = F.lit(None).cast("string")
    for name in reversed(categories):
        found = F.when(article.contains(name), name).otherwise(found)
    return found


def running_sums(values: str) -> Column:
    """For each entry of an array column of ints the sum of those before it.

    Two levels: blocks of entries, each summed from where the one before ended. Arrays
    are appended to by copying, so n entries in blocks of the cube root of n cost n^(4/3)
    copies instead of n^2. values must be a column's name, not an expression, which
    would be made anew for each block.
    """
    n = F.size(values)
    size = F.greatest(F.lit(_BLOCK), F.ceil(F.cbrt(n)).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / size).cast("int")), lambda b: F.slice(values, b * size + 1, size))
    last = lambda sums: F.element_at(sums, -1)
    summed = lambda block, start: F.aggregate(block, F.array(start), lambda sums, x: F.concat(sums, F.array(last(sums) + x)))
    # Each block's sums end with that of all its entries, where the next block starts.
    each = F.aggregate(blocks, F.array(F.array(F.lit(0))), lambda sums, block: F.concat(sums, F.array(summed(block, last(last(sums))))))
    return F.flatten(F.transform(F.slice(each, F.lit(2), F.size(blocks)), lambda sums: F.slice(sums, F.lit(1), F.size(sums) - 1)))
