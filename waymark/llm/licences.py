"""Operator 4: licences by canonical digest, in DataFrame functions only.

Case, punctuation, list marks, line breaks, copyright lines and equivalent spellings are normalised away; the digest of
the whole text, of each paragraph and of each line is looked up among the digests of known licence texts and notices by
a hash join.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Equivalent spellings, applied in this order to lower-case text without punctuation.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("organisation", "organization"),
    ("fulfilment", "fulfillment"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"),
    ("copyright holder", "copyright owner"), ("whilst", "while"), ("judgement", "judgment"), ("favour", "favor"),
]
COPYRIGHT_LINE = "^(copyright( c)? ([0-9]{4}|by |the |yyyy|year)|c ([0-9]{4}|copyright )|all rights reserved$)"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to """
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def _gnu(what: str, name: str, version: str, mark: str) -> str:
    return f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: Notices of several lines, as they stand in source files: each paragraph by itself.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    *[(f"GPL-{v}.0-or-later", _gnu(w, "General Public License", v, m)) for v, m in (("2", ";"), ("3", ":")) for w in ("program", "file")],
    *[(f"AGPL-{v}.0-or-later", _gnu("program", "Affero General Public License", v, ":")) for v in "3"],
    *[(f"LGPL-{v}-or-later", _gnu(w, "Lesser General Public License", k, m)) for v, k, m in (("2.1", "2.1", ";"), ("3.0", "3", ":")) for w in ("library", "program")],
]

#: Fixed values.  (licence, text): whole licences, and the notices that stand for one in a line.  More come as a table.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    *[("Unlicense", _UNLICENSE + end) for end in ("<https://unlicense.org>", "<http://unlicense.org/>", "<https://unlicense.org/>")],
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST),
    ("BSL-1.0", _BOOST),
    *HEADERS,
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]

#: Most digests that are broadcast; a larger table of known texts is joined by shuffle.
BROADCAST_DIGESTS = 100_000


#: A mark of a list at the start of a line: bullets are punctuation, numbers and letters go like them.
LIST_MARK = "(^|\n)[ \t]*[(]?([0-9]{1,2}|[a-z])[.)][ \t]+"
PARAGRAPH = "\n *\n[ \n]*"


def spelled(t: Column) -> Column:
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def canonical_paragraphs(text: Column) -> Column:
    """The text's paragraphs as arrays of lines: lower case, ASCII letters and digits, single spaces, without list marks and
    copyright lines.  Paragraphs and lines without a letter or digit are left out."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), LIST_MARK, "$1")
    t = F.regexp_replace(t, "[^a-z0-9\n]+", " ")
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(COPYRIGHT_LINE))
    return F.filter(F.transform(F.split(t, PARAGRAPH), lines), lambda p: F.size(p) > 0)


def canonical_text(text: Column) -> Column:
    """The whole text in its canonical form, in which line breaks don't matter."""
    return spelled(F.array_join(F.flatten(canonical_paragraphs(text)), " "))


def canonical(text: str) -> str:
    """The same in plain Python, for the few known texts."""
    t = re.sub("[^a-z0-9\n]+", " ", re.sub(LIST_MARK, r"\1", text.lower()))
    t = " ".join(x.strip() for x in t.split("\n") if x.strip() and not re.search(COPYRIGHT_LINE, x.strip()))
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return t


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """digest, licence of the built-in texts, or of a table (licence, text); one licence for each digest, ties to the least
    name.  A text of which nothing is left stands for no licence."""
    if known is None:
        return spark.createDataFrame(_known_rows(), "digest string, licence string")
    text = known.where("text is not null and licence is not null").select("licence", canonical_text(F.col("text")).alias("t"))
    return text.where("t <> ''").select(F.md5("t").alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def _known_rows() -> list[tuple[str, str]]:
    return sorted({hashlib.md5(canonical(t).encode()).hexdigest(): k for k, t in sorted(KNOWN, reverse=True)}.items())


def scan_licences(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_md5, whole_licence, notice_licences (sorted, distinct), n_lines, n_licence_lines, n_licence_paragraphs:
    one row for each id and text.

    whole_licence is the licence whose whole text the document is; notices are lines, and paragraphs of several lines.  Null
    and empty texts have no lines and null and empty results.  Rows equal in id and text make one row, with counts of
    each of them added up; a null id is an id.  Whole texts are read; other columns don't matter; an empty table gives no rows.
    """
    digests = known_digests(docs.sparkSession, known)
    # the built-in table is a constant; a given one is counted first
    if known is None or digests.count() <= BROADCAST_DIGESTS:
        digests = F.broadcast(digests)
    unit = lambda t, kind: F.struct(F.md5(spelled(t)).alias("digest"), F.lit(kind).alias("kind"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(text_col).alias("text_md5"), canonical_paragraphs(F.col(text_col)).alias("ps"))
    units = F.concat(
        F.array(unit(F.array_join(F.flatten("ps"), " "), 0)),
        F.transform(F.flatten("ps"), lambda x: unit(x, 1)),
        F.transform(F.filter("ps", lambda p: F.size(p) > 1), lambda p: unit(F.array_join(p, " "), 2)),
    )
    found = rows.select("doc_id", "text_md5", F.explode(units).alias("u")).select("doc_id", "text_md5", "u.*").join(digests, "digest", "left")
    kind, told = F.col("kind"), F.col("licence").isNotNull()
    return found.groupBy("doc_id", "text_md5").agg(
        F.max(F.when(kind == 0, F.col("licence"))).alias("whole_licence"),
        F.array_join(F.sort_array(F.collect_set(F.when(kind > 0, F.col("licence")))), ",").alias("notice_licences"),
        F.count_if(kind == 1).alias("n_lines"),
        F.count_if((kind == 1) & told).alias("n_licence_lines"),
        F.count_if((kind == 2) & told).alias("n_licence_paragraphs"),
    )


def op4_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: the licences whose text or notice it holds."""
    return scan_licences(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("\n", "\\n").replace("\t", "\\t") + "'"
    t = f"regexp_replace(regexp_replace(lower(coalesce(text, '')), {quoted(LIST_MARK)}, '\\1', 'g'), '[^a-z0-9\\n]+', ' ', 'g')"

    def told(x: str) -> str:
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return f"md5({x})"

    values = ", ".join(f"('{d}', '{k}')" for d, k in _known_rows())
    return f"""
WITH known(digest, licence) AS (VALUES {values}),
ps AS (SELECT doc_id, md5(text) AS text_md5, list_filter(list_transform(string_split_regex({t}, {quoted(PARAGRAPH)}),
         lambda p: list_filter(list_transform(string_split(p, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '{COPYRIGHT_LINE}'))),
         lambda p: len(p) > 0) AS ps FROM documents),
units AS (SELECT doc_id, text_md5, {told("coalesce(array_to_string(flatten(ps), ' '), '')")} AS digest, 0 AS kind FROM ps
          UNION ALL SELECT doc_id, text_md5, {told("x")}, 1 FROM (SELECT doc_id, text_md5, unnest(flatten(ps)) AS x FROM ps)
          UNION ALL SELECT doc_id, text_md5, {told("array_to_string(p, ' ')")}, 2 FROM (SELECT doc_id, text_md5, unnest(ps) AS p FROM ps) WHERE len(p) > 1)
SELECT doc_id, text_md5, max(CASE WHEN kind = 0 THEN licence END) AS whole_licence,
       coalesce(string_agg(DISTINCT CASE WHEN kind > 0 THEN licence END, ',' ORDER BY CASE WHEN kind > 0 THEN licence END), '') AS notice_licences,
       CAST(count(*) FILTER (kind = 1) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (kind = 1 AND licence IS NOT NULL) AS BIGINT) AS n_licence_lines,
       CAST(count(*) FILTER (kind = 2 AND licence IS NOT NULL) AS BIGINT) AS n_licence_paragraphs
FROM units LEFT JOIN known USING (digest) GROUP BY doc_id, text_md5"""


SQL = _sql()
