"""Licence scans by canonical digests, in DataFrame operations.

A text is brought to a canonical form (case, copyright lines, punctuation, equivalent spellings, white space), and
its digest is joined to the digests of known licences in the same form. One hash join with the table of known digests,
which is fixed and small, looks up the entire text and every line and every paragraph of it, so notices inside a document are
found too; what is found comes together by row.

Null texts have no digest and no licence; so have texts with nothing left. Repeated rows each get their result. Very long
texts are looked up whole. Empty tables give no rows. Other columns of docs are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

#: Spellings that licences may exchange, and the form that is kept.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme ", "program "),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful ", "willful "),
)
#: Canonical names of licences with texts and notices that grant them.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def _untitled(text: str) -> str:
    """A text without its title, what comes before the first blank line."""
    return re.split(r"\n[ \t]*\n", text.strip(), maxsplit=1)[-1]


def _entire() -> Iterator[tuple[str, str]]:
    """Entire texts: those in the folder licence_texts, and short ones without their titles."""
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = path.read_text("utf-8")
        yield path.stem, text
        if path.stem != "Unlicense":  # it has no title
            yield path.stem, _untitled(text)
        if path.stem in _ENDS:  # how to apply it is often left out
            cut = re.split(_ENDS[path.stem], text, maxsplit=1)[0]
            yield from ((path.stem, cut), (path.stem, _untitled(cut)))
    for name, text in KNOWN[:_SHORT]:
        if text.startswith(f"{name} License "):
            yield name, text.removeprefix(f"{name} License ")
        if name == "BSD-2-Clause":
            yield "BSD-3-Clause", text.replace(" THIS SOFTWARE IS", f" 3. {_THIRD} THIS SOFTWARE IS", 1)


_ENDS = {"Apache-2.0": r"(?<=END OF TERMS AND CONDITIONS)", "GPL-2.0": r"(?<=END OF TERMS AND CONDITIONS)", "GPL-3.0": r"(?<=END OF TERMS AND CONDITIONS)", "LGPL-2.1": r"(?<=END OF TERMS AND CONDITIONS)"}
_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_SHORT = len(KNOWN)
KNOWN = (*KNOWN, *_entire())
#: After lower case, what leads to the canonical form, one after another; \n stays until lines are taken apart. The
#: patterns mean the same in Java and in RE2. Runs are written so that single spaces need no replacing.
_MARKS = "!-/:-@\\[-`{-~©–—‘’“”\t\x0b\x0c\r"
RULES = (
    ("(^|\n)[ \t\x0b\x0c\r]*(?:copyright|\\(c\\)|©|all rights reserved)[^\n]*", "$1"),
    (f" ?[{_MARKS}][ {_MARKS}]*|  +", " "),
    *((f"(^|[ \n]){a}", f"$1{b}") for a, b in EQUIVALENT),
)
_JOIN = " ?\n[ \n]*"


def _any_spelling() -> str:
    """A pattern that finds whether any spelling has to change, by first letters."""
    rest: dict[str, list[str]] = {}
    for a, _ in EQUIVALENT:
        rest.setdefault(a[0], []).append(a[1:])
    return f"(?:^|[ \n])(?=[{''.join(rest)}])(?:{'|'.join(f'{k}(?:{'|'.join(v)})' for k, v in rest.items())})"


def canonical_lines(text: Column) -> Column:
    """The canonical form, still with its line ends."""
    out = F.lower(text)
    for pattern, put in RULES[:2]:
        out = F.regexp_replace(out, pattern, put)
    spelled = out
    for pattern, put in RULES[2:]:
        spelled = F.regexp_replace(spelled, pattern, put)
    return F.when(F.rlike(out, F.lit(_any_spelling())), spelled).otherwise(out)


def joined(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _JOIN, " "))


def digest(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.md5(text.cast("binary")))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> list[tuple[str, str]]:
    """(digest, name) of known texts; of texts that come to the same form, the first counts."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(known)], "i int, licence string, text string")
    found: dict[str, str] = {}
    for r in sorted(rows.select("i", "licence", digest(joined(canonical_lines(F.col("text")))).alias("digest")).collect()):
        found.setdefault(r.digest, r.licence)
    return sorted(found.items())


def licences(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """One row per document: doc_id, digest of the entire text, whole_licence (what the entire text is), licences
    (names found as the text, a paragraph or a line of it, sorted and comma-joined; empty if none)."""
    table = docs.sparkSession.createDataFrame(known_digests(docs.sparkSession, known), "known_digest string, licence string")
    lines = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", canonical_lines(F.col("text")).alias("text"))
    # a text without blank lines is its own paragraph, which is looked up as the entire text
    paragraphs = F.when(F.rlike("text", F.lit("\n *\n")), F.transform(F.split("text", "\n *\n"), joined)).otherwise(F.array().cast("array<string>"))
    parts = F.transform(F.concat(paragraphs, F.transform(F.split("text", "\n"), lambda p: F.trim(p))), lambda p: F.md5(p.cast("binary")))
    rows = lines.select("row", "doc_id", digest(joined(F.col("text"))).alias("digest"), F.coalesce(parts, F.array().cast("array<string>")).alias("parts"))
    each = rows.select("row", "doc_id", "digest", F.posexplode(F.concat(F.array("digest"), "parts")).alias("place", "part"))
    # the entire text is in place 0; of the rest only hits go on, so a task sends little more than a row a document
    hits = each.join(F.broadcast(table), F.col("part") == F.col("known_digest"), "left").filter("place = 0 or licence is not null")
    found = hits.groupBy("row", "doc_id", "digest").agg(F.max(F.when(F.col("place") == 0, F.col("licence"))).alias("whole_licence"), F.array_sort(F.collect_set("licence")).alias("names"))
    return found.select("doc_id", "digest", "whole_licence", F.concat_ws(",", "names").alias("licences"))


def sql_canonical(column: str) -> str:
    """The canonical form, with line ends, in DuckDB SQL."""
    out = f"lower({column})"
    for pattern, put in RULES:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{re.sub(r'[$](\d)', r'\\\1', put)}', 'g')"
    return out


def sql_joined(column: str) -> str:
    return f"trim(regexp_replace({column}, '{_JOIN}', ' ', 'g'))"
