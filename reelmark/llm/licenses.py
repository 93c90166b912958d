"""License notices by an exact set-similarity join of text blocks with templates; DataFrame functions only.

A block is a window of consecutive words, across line ends; a template is a license notice; both are sets of words. A
block meets a template if it holds at least the threshold's share of the template's words. A template's blocks are as
long as that share lets a text be that has all its words, so words scattered over a long text meet nothing.

1. The document counts of the template words, over all documents, give one global order, rare words first. No
   other word can be shared, so what follows sees these words alone.
2. Texts are cut into segments of words that overlap by the longest block, so that a row is bounded whatever the text.
   A template of n words of which need must be met is indexed under its n - need + 1 first words: a block that meets it
   holds one of them, so a segment meets a template by the first of these words that it holds (prefix filter).
3. A segment that holds fewer than need of a template's words falls away (length filter), and so does one that from the
   place of the shared word on, in both orders, cannot reach need any more (positional filter).
4. Of the segments left, the windows that begin with a template's word are verified one by one.

Phrases that must stand word for word are looked for besides, in the document's words.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (phrase, label): words that stand consecutively.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: (label, notice). The wording of public licenses, whole texts of the short ones and the headers that the
#: long ones ask for.
NOTICES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this
program. If not, see <https://www.gnu.org/licenses/>."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
by any means."""),
)

#: (label, sentence). The sentences that stand for a license where its text is not given.
TEMPLATES = (
    *NOTICES,
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
)


def words(text: Column) -> Column:
    """A text's words, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def phrase_places(own: Column, text: Column, phrases=PHRASES) -> Column:
    """(start, label) of every place in the words `own` of `text` where a phrase stands. Words count from 0."""
    lower = F.lower(text)

    def places(phrase: str, label: str) -> Column:
        p = phrase.split()
        last = F.size(own) - len(p)
        # Most documents lack one of the words and are not walked.
        maybe = last >= 0
        for w in p:
            maybe = maybe & F.contains(lower, F.lit(w))
        starts = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get(own, i + len(p) - 1) == p[-1]) & (F.array_join(F.slice(own, i + 1, len(p)), " ") == " ".join(p)))
        found = F.transform(starts, lambda i: F.struct(i.cast("bigint").alias("start"), F.lit(label).alias("label")))
        return F.when(maybe, found).otherwise(F.expr("cast(array() as array<struct<start:bigint,label:string>>)"))

    return F.concat(*(places(*x) for x in phrases))


class Template(NamedTuple):
    """A notice as the join takes it: its distinct words, rare ones first, and how long its blocks are."""

    label: str
    notice: str
    words: list[str]
    need: int
    width: int

    @property
    def prefix(self) -> list[str]:
        return self.words[: len(self.words) - self.need + 1]


def _parsed(spark: SparkSession, templates, threshold: tuple[int, int]) -> list[Template]:
    """The templates that have words, these in any order."""
    share, of = threshold
    notices = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(templates)], "k int, t string")
    own = {r["k"]: r["w"] for r in notices.select("k", words(F.col("t")).alias("w")).collect() if r["w"]} if templates else {}
    return [Template(*templates[k], sorted(set(ws)), -(-share * len(set(ws)) // of), -(-of * len(ws) // share)) for k, ws in own.items()]


def _read(docs: DataFrame, parsed: list[Template], phrases=()) -> DataFrame:
    """(doc_id, n_words, places, held, text) of every row, written: the template words that the text holds, and the text where it
    holds enough of some template's. The one pass that cuts all texts into words."""
    vocabulary = sorted({w for t in parsed for w in t.words})
    own = docs.select("doc_id", "text", words(F.col("text")).alias("_w"))
    places = phrase_places(F.col("_w"), F.coalesce("text", F.lit("")), phrases) if phrases else F.lit(None).cast("array<struct<start:bigint,label:string>>")
    own = own.select("doc_id", "text", F.size("_w").cast("bigint").alias("n_words"), places.alias("places"), F.array_intersect("_w", _strings(vocabulary)).alias("held"))
    enough = reduce(or_, (F.size(F.array_intersect("held", _strings(t.words))) >= t.need for t in parsed), F.lit(False))
    return written(own.withColumn("text", F.when(enough, F.col("text"))), "licenses")


def _ordered(read: DataFrame, parsed: list[Template]) -> tuple[list[Template], list[str]]:
    """The templates with their words in the global order, and that order: rarest first, by the documents that hold a word, then
    by the word. One row per template word reaches the driver."""
    counts = {r["w"]: r["count"] for r in read.select(F.explode("held").alias("w")).groupBy("w").count().collect()}
    order = sorted({w for t in parsed for w in t.words}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    return [t._replace(words=sorted(t.words, key=rank.__getitem__)) for t in parsed], order


def license_blocks(docs: DataFrame, *, templates=TEMPLATES, threshold: tuple[int, int] = (9, 10), id_col: str = "doc_id", text_col: str = "text", segment_words: int = 512) -> DataFrame:
    """(doc_id, start, label, template, shared, containment, block): every window of words that begins with a word of a
    template and holds at least the threshold's share of its distinct words. start counts words from 0; a block is
    the window's words, fewer at the text's end.

    Null and empty texts have no block; templates without words meet nothing. Repeated rows each give their matches; rows
    with a null id do too. Extra columns are ignored. A text is cut into words whole, however long, and met by segments of
    segment_words words.
    """
    spark = docs.sparkSession
    docs = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    parsed = _parsed(spark, templates, threshold)
    return _blocks(_read(docs, parsed), parsed, segment_words)


def _blocks(read: DataFrame, parsed: list[Template], segment_words: int = 512) -> DataFrame:
    spark = read.sparkSession
    ready, order = _ordered(read, parsed)
    index = [(w, i, t.label, t.notice, t.words, t.prefix, len(t.words), t.need, t.width) for t in ready for i, w in enumerate(t.prefix)]
    # A row per template word at most.
    indexed = F.broadcast(spark.createDataFrame(index, "word string, i int, label string, template string, own array<string>, prefix array<string>, n int, need int, width int"))
    reach = max((t.width for t in ready), default=1)
    first = _strings(sorted({row[0] for row in index}))

    own = read.filter("text is not null").select("doc_id", words(F.col("text")).alias("w"))
    count = F.floor((F.size("w") - 1) / segment_words).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count), lambda k: F.struct((k * segment_words).alias("base"), F.slice("w", k * segment_words + 1, segment_words + reach - 1).alias("w")))
    segments = own.filter(F.size("w") > 0).select("doc_id", F.explode(cut).alias("s")).select("doc_id", "s.base", "s.w")
    segments = segments.withColumn("ranked", F.array_intersect(_strings(order), F.col("w"))).filter(F.size("ranked") >= min((t.need for t in ready), default=1))

    met = segments.withColumn("word", F.explode(F.array_intersect("ranked", first))).join(indexed, "word")
    met = met.filter(~F.arrays_overlap("ranked", F.slice("prefix", F.lit(1), F.col("i"))) & (F.size(F.array_intersect("own", "ranked")) >= F.col("need")))
    j = F.array_position("ranked", F.col("word")) - 1
    met = met.filter(F.least(F.col("i"), j) + F.least(F.col("n") - F.col("i"), F.size("ranked") - j) >= F.col("need"))

    shared = lambda s: F.size(F.array_intersect(F.col("own"), F.slice("w", s + 1, F.col("width"))))
    starts = F.filter(F.sequence(F.lit(0), F.least(F.size("w"), F.lit(segment_words)) - 1), lambda s: F.array_contains("own", F.get("w", s)))
    verified = F.filter(F.transform(starts, lambda s: F.struct(s.alias("s"), shared(s).alias("shared"))), lambda e: e["shared"] >= F.col("need"))
    found = met.withColumn("e", F.explode(verified))
    block = F.array_join(F.slice("w", F.col("e.s") + 1, F.col("width")), " ")
    return found.select("doc_id", (F.col("base") + F.col("e.s")).cast("bigint").alias("start"), "label", "template", F.col("e.shared").alias("shared"), (F.col("e.shared") / F.col("n")).alias("containment"), block.alias("block"))


def scan_licenses(docs: DataFrame, *, templates=TEMPLATES, phrases=PHRASES, threshold: tuple[int, int] = (9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, base_labels, labels, score) per row of docs.

    places are the (start, label) of the phrases; labels join theirs and those of the templates that a block of words
    meets, sorted and distinct; score is 1 where a phrase stands, else the largest containment, else 0. Null texts are
    empty. Rows of one id, repeated ones too, share the template labels; rows with a null id get none of them. Of
    places or notices alike in all (ties) each counts. An empty table gives no rows. Extra columns, of whatever name, are
    ignored. Very long texts are cut into words whole, and into segments for the notices.
    """
    docs = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    parsed = _parsed(docs.sparkSession, templates, threshold)
    scanned = _read(docs, parsed, phrases)
    met = _blocks(scanned, parsed).filter("doc_id is not null")
    scanned = scanned.select("doc_id", "n_words", "places")
    met = met.groupBy("doc_id").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_most"))
    out = scanned.join(met, "doc_id", "left")
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    both = F.array_sort(F.array_union(base, F.coalesce("_more", F.expr("cast(array() as array<string>)"))))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("_most", F.lit(0.0)))
    return out.select("doc_id", "n_words", "places", base.alias("base_labels"), both.alias("labels"), score.alias("score"))
