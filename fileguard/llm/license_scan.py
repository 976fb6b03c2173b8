"""Licences by digest: whole texts and single lines are brought to a canonical form, hashed, and joined to known digests.

The canonical form drops case, copyright lines, punctuation and the choice between equivalent spellings, so a notice keeps
its digest however it is set. Nothing is matched in part: a digest either is a known one or it isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileguard.llm.common import documents
from fileguard.llm.license_texts import texts

#: Notices known by default, by SPDX identifier; a caller can give a table (license_id, text) of any size instead.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
]

_MIT = next(text for name, text in NOTICES if name == "MIT" and len(text) > 500)
_ISC = (
    'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, '
    'provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" '
    'AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    'FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES '
    'WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS '
    'ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
)
_BSD = (
    'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following '
    'conditions are met: {0}Redistributions of source code must retain the above copyright notice, this list of conditions and the '
    'following disclaimer. {1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and '
    'the following disclaimer in the documentation and/or other materials provided with the distribution. {2}'
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT {3} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    'NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT '
    'SHALL THE COPYRIGHT {4} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL '
    'DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS '
    'INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING '
    'NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
)
_NAMES = (
    'Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived '
    'from this software without specific prior written permission. '
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    'License. You may obtain a copy of the License at http{0}://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law '
    'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
    'CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and '
    'limitations under the License.'
)
# Whole texts: with and without title, with numbered, bulleted or plain clauses, holder in singular or plural.
NOTICES += [("MIT", f"{title} {_MIT}") for title in ("MIT License", "The MIT License", "The MIT License (MIT)")]
NOTICES += [("ISC", f"{title}{_ISC}") for title in ("", "ISC License ", "The ISC License ", "ISC License (ISC) ")]
NOTICES += [
    (f"BSD-{clauses}-Clause", title + _BSD.format(*marks[:2], marks[2] + _NAMES if clauses == 3 else "", *holders))
    for clauses, titles in (
        (2, ("", "BSD 2-Clause License ", "The BSD 2-Clause License ", "All rights reserved. ", "BSD 2-Clause License All rights reserved. ")),
        (3, ("", "BSD 3-Clause License ", "The BSD 3-Clause License ", "All rights reserved. ", "BSD 3-Clause License All rights reserved. ")),
    )
    for title in titles
    for marks in (("", "", ""), ("1. ", "2. ", "3. "))
    for holders in (("HOLDERS", "HOLDER"), ("HOLDERS", "HOLDERS"), ("HOLDER", "HOLDER"))
]
NOTICES += [("Apache-2.0", _APACHE.format(s)) for s in ("", "s")]
NOTICES += [("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");')]
NOTICES += texts()

#: Spellings that mean the same, as words of the canonical form.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("cc0", "cc zero"), ("v2", "version 2"), ("v3", "version 3"), ("noncommercial", "nc"), ("organisation", "organization")]

#: Lines that state a holder: "copyright" with a sign, a year, its placeholder or "by" right after it; "(c)" with a year or
#: "copyright" after it, since a clause may be marked (c); the sign itself.
DATED = r"copyright[ \t:]*(\(c\)|\x{A9}|by\b|\d{4}|[\[{<]yyyy[\]}>]|[\[{<]year[\]}>])[^\n]*|\(c\)[ \t]*(copyright\b|\d{4}|[\[{<]yyyy[\]}>])[^\n]*|\x{A9}[^\n]*"
#: "Copyright" and a name, nothing else: words that begin with a capital letter, joined by small words.
NAMED = r"(?-i:Copyright)[ \t]+(?-i:(?!License|Notice|Holder|Owner|Act\b|Law)\p{Lu})[\p{L}\p{N}.'\-]*([ \t,]+((?-i:\p{Lu})[\p{L}\p{N}.'\-]*|&|and|of|the|et|al|und|y))*[ \t.,\r]*"
HOLDER = rf"(?imd)^[^\p{{L}}\n\x{{A9}}(]*({DATED}|{NAMED})$"


def canonical(text: Column, spelled: bool = True) -> Column:
    """Lower-case words with one space between them; lines stay lines."""
    text = F.regexp_replace(text, HOLDER, "")
    text = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    if spelled:
        for other, word in SPELLINGS:
            text = F.regexp_replace(text, rf"\b{other}\b", word)
    return text


def unit(line: Column) -> Column:
    """A text or line of the canonical form without outer or repeated spaces."""
    return F.trim(F.regexp_replace(line, r"[ \n]+", " "))


def whole_unit(form: Column) -> Column:
    """A whole text as one line, without lines that only reserve all rights, unless there is nothing else."""
    rest = unit(F.regexp_replace(form, r"(?md)^ *all rights reserved *$", ""))
    return F.when(rest != "", rest).otherwise(unit(form))


def digest(line: Column) -> Column:
    return F.sha2(line, 256)


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id) of a table (license_id, text): one row for each digest, the smallest id where texts coincide;
    notices without a word are left out."""
    form = whole_unit(canonical(F.coalesce("text", F.lit(""))))
    return known.where(form != "").groupBy(digest(form).alias("digest")).agg(F.min("license_id").alias("license_id"))


def license_scan(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row for each distinct doc_id: digest (of the smallest canonical text, should rows share the id), license_id of the
    whole text or null, n_license_lines and line_licenses (distinct ids of matching lines, rising, joined by commas).

    Null and empty texts have the digest of the empty text and no licence; rows with one doc_id count as one document, those
    without an id as one group; an empty table gives an empty result; further columns are ignored.
    """
    known = known_digests(df.sparkSession.createDataFrame(NOTICES, "license_id string, text string") if known is None else known)
    docs = documents(df).select("doc_id", canonical(F.col("text")).alias("form"))
    lines = F.filter(F.transform(F.split("form", "\n"), lambda line: F.trim(line)), lambda line: line != "")
    both = F.concat(
        F.array(F.struct(digest(whole_unit(F.col("form"))).alias("digest"), F.lit(True).alias("is_text"))),
        F.transform(lines, lambda line: F.struct(digest(line).alias("digest"), F.lit(False).alias("is_text"))),
    )
    asked = docs.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.digest", "x.is_text")
    # Whole texts stay without a match, lines don't; only these rows are shuffled.
    found = asked.join(known, "digest", "left").where("is_text or license_id is not null")
    text = F.min(F.when(F.col("is_text"), F.struct("digest", "license_id")))
    return found.groupBy("doc_id").agg(
        text.alias("whole"), F.count_if(~F.col("is_text")).alias("n_license_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("is_text"), F.col("license_id")))), ",").alias("line_licenses"),
    ).select("doc_id", "whole.digest", "whole.license_id", "n_license_lines", "line_licenses")
