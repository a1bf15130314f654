"""Licence notices in texts, by Dice's coefficient over word bigrams.

A text is normalised to its words: A-Z lower-cased, everything but letters and
digits turned into blanks, line ends too. A template of w words is compared with
the windows of w words of a text, or with the whole of a shorter text. Sizes prune
what is compared: bigram sets that share a coefficient of t have sizes within a
factor of (2 - t) / t, so a shorter text needs that share of the template's bigrams,
and any unit that reaches t shares at least t / (2 - t) of them. Of the others plus
one, the template's anchors, it has at least one; so only windows that hold an
anchor are compared, and texts without any are done with. Nothing within the limit
is missed. All of it is DataFrame operations within the row of a document.
"""

import math

import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textclusters.llm.shared import lower_ascii

#: Coefficient from which a unit counts as the template.
LIMIT = 0.8
#: Identifiers of licences, as tags name them.
IDENTIFIERS = (
    "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0",
    "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT",
    "MPL-2.0", "Unlicense", "Zlib",
)
#: One-line notices by which texts are placed under a licence.
NOTICES = (
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "Released under CC0 1.0 Universal."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Released under the ISC License."),
    ("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mpl-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
    ("unlicense", "Released into the public domain under the Unlicense."),
    ("zlib", "Released under the zlib License."),
)
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation, either version {2} of "
    "the License, or (at your option) any later version."
)
#: Headers of files and the passages of licence texts that name what is granted.
PASSAGES = (
    ("agpl-3.0", _GNU.format("This program", "GNU Affero General Public License", "3")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", _FORMS),
    ("bsd-2-clause", " ".join([_FORMS, "1.", _CLAUSES[0], "2.", _CLAUSES[1]])),
    ("bsd-3-clause", " ".join([_FORMS, "1.", _CLAUSES[0], "2.", _CLAUSES[1], "3.", _CLAUSES[2]])),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", _GNU.format("This program", "GNU General Public License", "2")),
    ("gpl-3.0", _GNU.format("This program", "GNU General Public License", "3")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1", _GNU.format("This library", "GNU Lesser General Public License", "2.1")),
    ("lgpl-3.0", _GNU.format("This program", "GNU Lesser General Public License", "3")),
    ("mit", _GRANT),
    ("mit", " ".join([_GRANT, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _WARRANTY])),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)
TEMPLATES = (*NOTICES, *PASSAGES, *((name.lower(), f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS))


def words_of(text: Column) -> Column:
    """The normalised words: runs of letters and digits."""
    return F.filter(F.split(lower_ascii(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Hashes of the pairs of neighbouring words, in order."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) < 2, F.array().cast("array<bigint>")).otherwise(pairs)


def _known(templates, limit: float) -> list[tuple]:
    """(license_id, w, theirs, least, anchors) of each template, hashes as bigrams_of makes them.

    The anchors are its longest bigrams, as long words are rare.
    """
    out = []
    for name, notice in dict.fromkeys(templates):
        words = [w.encode() for w in regex.findall(r"[\p{L}\p{N}]+", "".join(c.lower() if c.isascii() else c for c in notice))]
        pairs = dict.fromkeys(zip(words, words[1:], strict=False))
        least = math.ceil(len(pairs) * limit / (2 - limit) - 1e-9)
        hashed = {pair: xxhash.xxh64_intdigest(pair[1], xxhash.xxh64_intdigest(pair[0], 42)) for pair in pairs}
        signed = {pair: h - (h >> 63 << 64) for pair, h in hashed.items()}
        longest = sorted(pairs, key=lambda x: -len(x[0] + x[1]))[: len(pairs) - least + 1]
        if pairs:
            out.append((name, len(words), list(signed.values()), least, [signed[x] for x in longest]))
    return out


def matches(docs: DataFrame, templates=TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """(doc_id, license_id, start_word int, n_words int, dice double): each template's
    nearest window in a document, the first of equals, if it reaches the limit and no
    other template's overlaps it that is nearer, or as near and longer, or else first
    by name.

    start_word counts the normalised words from 0. dice is rounded to six places. A
    null text has no window, nor has one of fewer than two words; templates of fewer
    than two words, and equal templates of one licence beyond the first, find nothing
    of their own; without templates there are no rows. Rows that repeat a doc_id, or
    lack one, each give their own rows; other columns are ignored. Templates are a
    parameter, a short list that goes to all tasks. A very long text costs time in
    proportion to its length, and to a template's size for each anchor in it.
    """
    known = _known(templates, limit)
    anchors = F.lit(sorted({x for template in known for x in template[-1]}) or [None]).cast("array<bigint>")
    listed = docs.sparkSession.createDataFrame(known, "license_id string, w int, theirs array<long>, least int, anchors array<long>").withColumn("anchor", F.explode("anchors"))
    # A row's own number tells apart rows that repeat a doc_id; being one of a kind, it also keeps Spark from
    # moving the filter below the columns that it tests, which would split a text anew for each of its words.
    own = F.monotonically_increasing_id()
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text").cast("string")).alias("words"), own.alias("row"))
    grams = words.select("doc_id", "row", bigrams_of(F.col("words")).alias("grams"))
    met = grams.withColumn("hits", F.array_intersect("grams", anchors)).where(F.size("hits") > 0).withColumn("anchor", F.explode("hits"))
    met = met.join(F.broadcast(listed), "anchor").where(F.col("anchor") == F.get(F.array_intersect("hits", "anchors"), F.lit(0)))
    met = met.where(F.size("grams") >= F.col("least"))
    # Places count bigrams: a window of w words has w - 1 of them, a shorter text all it has.
    size = F.least(F.col("w") - 1, F.size("grams"))
    places = F.filter(F.transform("grams", lambda x, i: F.when(F.array_contains("anchors", x), i)), lambda i: i.isNotNull())
    around = F.transform(places, lambda i: F.sequence(F.greatest(i - size + 1, F.lit(0)), F.least(i, F.size("grams") - size)))

    def compared(start: Column) -> Column:
        ours = F.array_distinct(F.slice("grams", start + 1, size))
        dice = F.round(2.0 * F.size(F.array_intersect(ours, F.col("theirs"))) / (F.size(ours) + F.size("theirs")), 6)
        return F.struct(dice.alias("dice"), (-start).alias("minus"))

    near = met.withColumn("best", F.array_max(F.transform(F.array_distinct(F.flatten(around)), compared))).where(F.col("best.dice") >= limit)
    near = near.select("row", "doc_id", F.struct("best.dice", (size + 1).alias("n"), "license_id", (-F.col("best.minus")).alias("start")).alias("x"))
    # At most one entry a template.
    found = near.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_set("x").alias("all"))

    def beaten(x: Column, y: Column) -> Column:
        meet = (x["start"] < y["start"] + y["n"]) & (y["start"] < x["start"] + x["n"])
        better = (y["dice"] > x["dice"]) | (y["dice"] == x["dice"]) & ((y["n"] > x["n"]) | (y["n"] == x["n"]) & (y["license_id"] < x["license_id"]))
        return meet & better

    left = F.filter("all", lambda x: ~F.exists("all", lambda y: beaten(x, y)))
    return found.select("doc_id", F.explode(left).alias("x")).select("doc_id", "x.license_id", F.col("x.start").alias("start_word"), F.col("x.n").alias("n_words"), "x.dice")
