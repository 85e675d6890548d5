"""Licence scans by canonical digests.

A text is put into canonical form: lower case, without copyright lines (those of a notice, not a text's own lines that
begin with the word), comment marks and punctuation, with one spelling of equivalent words and single blanks. The digests of whole canonical texts are joined to those of known
licence texts and notices. A document's texts are the document, its paragraphs, its lines, and where a paragraph is
the first one of a known text, the block of as many paragraphs as that has; each is taken as a whole.

The known digests are a small table with a row for each known text, whose size doesn't depend on the documents; it is
broadcast behind a count, so no digest that many documents share meets in one task.

Defined results: a null text is empty; an empty canonical text is no licence; a licence that a document holds several
times, or in a line as well as in a paragraph, is listed once; rows with equal or null keys are judged each by its own
text, repeated rows equally; a text of any length is compared whole; of known texts with one canonical form the first
name wins; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Known digests or documents with a licence beyond this many rows are joined by a shuffle and not broadcast.
BROADCAST_ROWS = 200_000

#: Spellings that count as the same.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub-license": "sublicense", "sub license": "sublicense", "non-commercial": "noncommercial",
    "non-infringement": "noninfringement", "copyright owner": "copyright holder", "copyright owners": "copyright holders", "favour": "favor", "fulfil": "fulfill",
    "acknowledgement": "acknowledgment", "judgement": "judgment", "whilst": "while", "wilful": "willful", "organisation": "organization", 
    "per cent": "percent", "version": "v", "ver": "v", "https": "http",
}

#: Short licence texts and notices without their copyright lines; longer ones are in licence_texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}

#: Titles that stand above a text, besides the names below.
TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["The BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "The BSD License", "BSD License"],
    "BSD-3-Clause": ["The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "The BSD License", "BSD License"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International", "Attribution-ShareAlike 4.0 International"],
}

#: Fixed values, for the published texts in the folder licence_texts (the file's name begins with the licence's): where a
#: text may begin besides its title, and where it may end before what stands after the terms.
STARTS = {
    "Apache-2.0": ["TERMS AND CONDITIONS FOR USE", "1. Definitions."],
    "GPL-2.0": ["Copyright (C) 1989", "Preamble"],
    "GPL-3.0": ["Copyright (C) 2007", "Copyright © 2007", "Preamble"],
    "LGPL-3.0": ["Copyright (C) 2007", "This version of the GNU Lesser"],
    "MPL-2.0": ["1. Definitions"],
    "CC0-1.0": ["CC0 1.0 Universal", "CREATIVE COMMONS CORPORATION IS NOT", "Statement of Purpose"],
    "CC-BY-SA-4.0": ["Creative Commons Corporation (", "Creative Commons Attribution-ShareAlike 4.0 International Public", "By exercising the Licensed Rights"],
    "Unlicense": [],
}
ENDS = {
    "Apache-2.0": ["END OF TERMS AND CONDITIONS", "APPENDIX: How to apply"],
    "GPL-2.0": ["END OF TERMS AND CONDITIONS", "How to Apply These Terms"],
    "GPL-3.0": ["END OF TERMS AND CONDITIONS", "How to Apply These Terms"],
    "MPL-2.0": ["Exhibit A - Source Code"],
    "CC-BY-SA-4.0": ["Creative Commons is not a party to its public"],
    "Unlicense": ["For more information, please refer to"],
}

#: Names by which notices call a licence, and how notices begin.
NAMES = {
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GNU General Public License v3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
}
OPENINGS = ["", "Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This software is licensed under", "This project is licensed under", "This file is licensed under"]


#: A copyright line: the word or sign with what only a notice has after it. "Copyright" before a name is told from a
#: licence's own words by the capital and by WORDS_OF_TEXTS; "(c)" also numbers clauses.
WORDS_OF_TEXTS = "notices?|holders?|owners?|owned|ownership|laws?|licen[cs]es?|interests?|rights?|protection|protected|permissions?|statements?|disclaimers?|works?|treaty|treaties|and|or|in|on|to|of|for|is|as|are|that|which|with|from|under|shall|may|will|be|has|have"
NOTICE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:"
    r"(?i:copyrights?)[^\p{L}\p{N}\n]*(?:\((?i:c)\)|[©<{\[]|\p{N}|(?i:by)\b)[^\n]*"
    rf"|(?i:copyright)\b:?[ \t]+(?!(?i:{WORDS_OF_TEXTS})\b)\p{{Lu}}[^\n]*"
    r"|[Cc]opyright[ \t]+the[ \t]+\p{Lu}[^\n]*"
    r"|©[^\n]*"
    r"|\((?i:c)\)[ \t]*(?:(?i:copyright|by)\b|(?:19|20)\p{N}\p{N}\b)[^\n]*"
    r"|\((?i:c)\)(?:[ \t]+\p{Lu}[\p{L}\p{N}.,&'-]*){1,4}[ \t\r]*"
    r"|(?i:all rights reserved)[^\p{L}\p{N}\n]*"
    r")$"
)


def prepared(text: Column) -> Column:
    """Canonical words of each line, the lines still apart: " words of a line \\n words of the next "."""
    low = F.lower(text)
    marked = low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("all rights reserved")
    out = F.when(marked, F.lower(F.regexp_replace(text, NOTICE, " "))).otherwise(low)
    # two blanks between words, so that each word has both of its own
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}\n]+", "  ")
    out = F.concat(F.lit("  "), F.replace(out, F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    for a, b in sorted(SPELLINGS.items(), key=lambda x: -len(x[0])):
        wide = lambda x: " " + "  ".join(x.replace("-", " ").split()) + " "
        out = F.replace(out, F.lit(wide(a)), F.lit(wide(b)))
        if "  " in wide(a):  # the words may be on two lines; the line's end comes after the first word then
            first, *rest = wide(b).split("  ", 1)
            out = F.replace(out, F.lit(wide(a).replace("  ", "  \n  ", 1)), F.lit(f"{first.rstrip()}  \n {''.join(' ' + x for x in rest)}"))
    out = F.regexp_replace(out, r" v(\d)", " v  $1")
    out = F.regexp_replace(out, r"(\d) +0 ", "$1 ")  # 2.0 is 2
    return F.regexp_replace(out, " +", " ")


def joined_lines(lines: Column) -> Column:
    return F.trim(F.replace(lines, F.lit(" \n"), F.lit("")))


def canonical(text: Column) -> Column:
    """Canonical form of a whole text: its words, one blank apart."""
    return joined_lines(prepared(text))


def published() -> list[tuple[str, str]]:
    """(licence, text) of the files in licence_texts, as published."""
    files = sorted((resources.files(__package__) / "licence_texts").iterdir(), key=lambda f: f.name)
    return [(next(x for x in STARTS if f.name.startswith(f"{x}.")), f.read_text("utf-8")) for f in files if f.name.endswith(".txt")]


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the texts above and the published ones, with and without title and what follows the terms."""
    bodies = list(TEXTS.items())
    for licence, text in published():
        starts = [0, *(text.index(x) for x in STARTS[licence] if x in text)]
        ends = [len(text), *(text.index(x) for x in ENDS.get(licence, []) if x in text)]
        bodies += [(licence, text[a:b]) for a in starts for b in ends]
    titled = [(licence, f"{title}\n\n{text}") for licence, text in bodies for title in NAMES.get(licence, []) + TITLES.get(licence, [])]
    return bodies + titled


def known(spark: SparkSession) -> DataFrame:
    """(licence, text): the full texts, and notices from names and openings."""
    rows = full_texts()
    for licence, names in NAMES.items():
        rows += [(licence, f"{o} {the}{n}") for o in OPENINGS for n in names for the in (("the ", "") if o else ("",))]
    return spark.createDataFrame(rows, "licence string, text string")


def _paragraphs(lines: Column) -> Column:
    return F.split(lines, r" \n(?: \n)+")


def _known_digests(licences: DataFrame) -> DataFrame:
    """digest, licence (null if the digest is of no whole text) and blocks, the numbers of paragraphs of the texts that begin with it."""
    lines = licences.select("licence", prepared(F.col("text")).alias("_lines"))
    whole = lines.select("licence", joined_lines(F.col("_lines")).alias("_c")).filter(F.length("_c") > 0).select(F.sha2("_c", 256).alias("digest"), "licence", F.lit(None).cast("int").alias("_n"))
    parts = lines.select(F.filter(F.transform(_paragraphs(F.col("_lines")), joined_lines), lambda x: F.length(x) > 0).alias("_p")).filter(F.size("_p") > 1)
    first = parts.select(F.sha2(F.element_at("_p", 1), 256).alias("digest"), F.lit(None).cast("string").alias("licence"), F.size("_p").alias("_n"))
    return whole.unionByName(first).groupBy("digest").agg(F.min("licence").alias("licence"), F.array_sort(F.collect_set("_n")).alias("blocks"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def scan(docs: DataFrame, licences: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, whole_licence (of the document as a whole), licences (sorted) and n_places of every row of ``docs``.

    licences: (licence, text) of known texts; where two have one canonical form the first name wins."""
    digests = written(_known_digests(licences), "digests")
    words = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(words).alias("_print"), words.alias("_text"))
    ready = rows.select("_key", "_print", prepared(F.col("_text")).alias("_lines"))
    unit = lambda kind, x: F.struct(F.lit(kind).alias("kind"), joined_lines(x).alias("text"))
    lines, parts = F.split("_lines", "\n"), _paragraphs(F.col("_lines"))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    units = F.concat(F.array(unit("whole", F.col("_lines"))), F.when(F.size(parts) > 1, F.transform(parts, lambda x: unit("paragraph", x))).otherwise(none), F.when(F.size(lines) > 1, F.transform(lines, lambda x: unit("line", x))).otherwise(none))
    cut = ready.select("_key", "_print", F.posexplode(units).alias("at", "unit")).select("_key", "_print", "at", "unit.kind", F.sha2("unit.text", 256).alias("digest"))
    raw = written(cut.join(_small(digests), "digest").select("_key", "_print", "at", "kind", "licence", "blocks"), "hits")
    places = ["_key", "_print", "at", "kind", "licence"]
    hits = raw.filter("licence IS NOT NULL").select(*places)
    starts = raw.filter("kind = 'paragraph' AND size(blocks) > 0").groupBy("_key", "_print").agg(F.collect_set(F.struct("at", "blocks")).alias("_starts"))
    starts = written(starts.withColumnsRenamed({"_key": "_hit", "_print": "_hit_print"}), "starts")
    same = F.col("_key").eqNullSafe(F.col("_hit")) & (F.col("_print") == F.col("_hit_print"))
    if starts.limit(1).count():
        # documents with the first paragraph of a known text: each block of as many paragraphs as that text has
        some = rows.join(_small(starts), same).select("_key", "_print", "_starts", prepared(F.col("_text")).alias("_lines"))
        some = some.select("_key", "_print", F.transform(_paragraphs(F.col("_lines")), joined_lines).alias("_p"), F.sha2(joined_lines(F.col("_lines")), 256).alias("_whole"), F.explode("_starts").alias("_s"))
        some = some.select("_key", "_print", "_p", "_whole", F.col("_s.at").alias("at"), F.explode("_s.blocks").alias("_n"))
        blocks = some.select("_key", "_print", "_whole", "at", F.sha2(F.array_join(F.slice("_p", F.col("at"), F.col("_n")), " "), 256).alias("digest")).filter("digest <> _whole")
        found = blocks.join(_small(digests.filter("licence IS NOT NULL")), "digest").select("_key", "_print", (-F.col("at")).alias("at"), F.lit("block").alias("kind"), "licence")
        hits = hits.unionByName(found)
    of_doc = hits.groupBy("_key", "_print").agg(
        F.max(F.when(F.col("kind") == "whole", F.col("licence"))).alias("whole_licence"), F.collect_set("licence").alias("_licences"), F.size(F.collect_set("at")).cast("long").alias("_n")
    )
    of_doc = written(of_doc.withColumnsRenamed({"_key": "_hit", "_print": "_hit_print"}), "licensed")
    out = rows.select("_key", "_print").join(_small(of_doc), same, "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("_key").alias(key), "whole_licence", F.array_sort(F.coalesce("_licences", none)).alias("licences"), F.coalesce("_n", F.lit(0).cast("long")).alias("n_places"))
