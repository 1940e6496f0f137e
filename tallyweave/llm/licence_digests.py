"""Licence scan by canonical digests: whole texts are looked up among known licences.

A text is brought to a canonical form: copyright lines go, letters are lower-cased, everything that is not
a letter or digit becomes one space, and equivalent spellings become one. Texts of equal canonical form have
equal SHA-256 digests, and the digests are joined with those of the known licences. Both whole documents and
their single lines count as texts, so that a notice inside a longer document is found as well.

Only DataFrame functions are used. The known digests are broadcast while they are few (their number is
counted); nothing else moves but the digests that match.

Null texts count as empty; a text that is empty in canonical form matches nothing. Repeated rows each
match; a line that occurs more than once in a document counts that often. Rows with a null doc_id keep it.
Where known licences share a canonical form, all their ids match. Other columns are dropped; they may have any
names. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.sources.scratch import materialize

#: Known digests that are sent to every task at most; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 200_000
#: Different first words of known licences by which texts are told apart first.
OPENINGS = 1_000

#: Fixed equivalent spellings, on canonical words.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licensed", "sublicensed"),
    ("organisation", "organization"), ("favour", "favor"), ("judgement", "judgment"), ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"), ("non commercial", "noncommercial"), ("centre", "center"),
    ("http", "https"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
    ("v2 0", "version 2 0"), ("v3", "version 3"), ("analyse", "analyze"), ("per cent", "percent"),
)

#: Fixed texts of known licences and notices.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
)


def without_notices(text: Column) -> Column:
    """The text without its copyright lines."""
    text = F.coalesce(text, F.lit(""))
    copyright_line = r"(?im)^\W*(copyright|\(c\)|©)(?=.*(\d{4}|\(c\)|©|\ball rights reserved\b)).*$"
    small = F.lower(text)
    marked = small.contains("copyright") | small.contains("(c)") | small.contains("©")
    return F.when(marked, F.regexp_replace(text, copyright_line, "")).otherwise(text)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    text = without_notices(text)
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for said, meant in SPELLINGS:
        out = F.replace(out, F.lit(f" {said} "), F.lit(f" {meant} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def openings(wanted: DataFrame) -> list[str] | None:
    """The first words that a text can have if its canonical form is one of ``form``; None if they are many.

    A spelling that is replaced at the start of a text opens it with a word of its own.
    """
    first = [r[0] for r in wanted.select(F.substring_index("form", " ", 1)).distinct().limit(OPENINGS + 1).collect()]
    if len(first) > OPENINGS:
        return None
    words = set(first)
    for _ in SPELLINGS:
        words |= {said.split()[0] for said, meant in SPELLINGS if meant.split()[0] in words}
    return sorted(words)


def licence_hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, unit ('document' or 'line'), licence_id, hits for every match of a whole text.

    ``known`` has licence_id and text.
    """
    wanted = materialize(known.select("licence_id", canonical(F.col("text")).alias("form")).where("form != ''").distinct())
    small, first = wanted.count() <= BROADCAST_ROWS, openings(wanted)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", F.lit("line").alias("unit"), F.explode(F.split(text, "\n")).alias("text"))
    texts = lines.union(docs.select("doc_id", F.lit("document").alias("unit"), text.alias("text")))
    if first is not None:  # no other text can match, so no other needs a canonical form
        texts = texts.where(F.regexp_extract(F.lower(without_notices(F.col("text"))), r"[\p{L}\p{N}]+", 0).isin(first))
    digests = wanted.select("licence_id", F.sha2(F.col("form").cast("binary"), 256).alias("digest"))
    return (
        texts.select("doc_id", "unit", digest(F.col("text")).alias("digest"))
        .join(F.broadcast(digests) if small else digests, "digest")
        .groupBy("doc_id", "unit", "licence_id").agg(F.count("*").alias("hits")))
