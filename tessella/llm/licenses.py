"""License scans: canonical digests of entire texts, joined to those of known licences."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_of

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AUTHOR = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Known licences by SPDX identifier, whole texts (long ones in files) and customary notices.
KNOWN = [
    *((p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))),
    ("AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-only"),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
        "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        + _WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + " For more information, please refer to <https://unlicense.org/>",
    ),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AUTHOR),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    ),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AUTHOR,
    ),
    ("ISC", "SPDX-License-Identifier: ISC"),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT-0",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. " + _WARRANTY,
    ),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
]
#: Spellings that licence texts use alike, as (pattern, spelling).
SPELLINGS = [
    (r"\bhttps\b", "http"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\b(licence|sub license|sub licence)", "license"),
    (r"\bsublicen[cs]e", "license"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bnon (commercial|infringement)", r"non$1"),
    (r"\bper cent\b", "percent"),
    (r"\b(favour|favor)", "favor"),
    (r"\borganisation", "organization"),
    (r"\bwilful", "willful"),
    (r"\bwhilst\b", "while"),
    # numbers of list items, which some copies have as bullets
    (r"\b(?:[1-9]|[a-c]) (redistributions of source|redistributions in binary|neither the name|the origin of|altered source|this notice may)", r"$1"),
]
_TITLE = r"(the )?(mit|isc|zlib|mit no attribution|bsd zero[ -]clause|(bsd )?[023][ -]clause( bsd)?|(simplified|new|modified|revised) bsd)( licen[cs]e)?([ \t]*\([a-z0-9 -]+\))?[ \t\r]*$"
#: Whole lines that differ between copies of a licence: who holds the rights, and titles. A
#: line of a text that only starts with the word copyright is none.
HOLDERS = r"(?im)^[ \t#*/;-]*(copyright[ \t:]*(\(c\)|©|[<\[{])[^\n]*|copyright\b[^\n]*\b(19|20)[0-9][0-9]\b[^\n]*|©[^\n]*|\(c\)[ \t]*(19|20)[0-9][0-9][^\n]*|all rights reserved[^\n]*|" + _TITLE + ")"
#: Known texts up to so many are broadcast.
LISTED = 10_000


def canonical(text: Column) -> Column:
    """Lower-case ASCII words parted by single spaces, without holders' lines, one spelling."""
    out = F.regexp_replace(text, HOLDERS.replace("(?im)", "(?imd)"), " ")
    out = F.trim(F.lower(F.regexp_replace(out, "[^A-Za-z0-9]+", " ")))
    for pattern, spelling in SPELLINGS:
        out = F.regexp_replace(out, pattern, spelling)
    return out


def _marks(table: list[tuple[str, str]]) -> list[str]:
    """Words of which each canonical known text has one: what can't hold any can't match any.

    Taken from ``(canonical text, licence)``: greedily, the word that most of the texts
    left have, of equal ones the longest. Words that a spelling rule may have written are
    passed over, so a mark stands in any text of that canonical form as it is, but for case.
    """
    written = {"http", "holder", "copyright", "license", "noncommercial", "noninfringement", "acknowledgment", "percent", "favor", "organization", "willful", "while"}
    left = [{w for w in text.split() if not any(x in w for x in written)} for text, _ in table]
    if not all(left):  # such a text can only be found by looking at all
        return []
    marks = []
    while left:
        n = Counter(w for words in left for w in words)
        marks.append(max(n, key=lambda w: (len(w) >= 4, n[w] * len(w), w)))
        left = [words for words in left if marks[-1] not in words]
    return marks


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, line_no, license``: entire texts (line 0) and entire lines that are a known licence.

    A document's text, and each of its lines (numbered from 1), is normalised, and its
    digest joined to those of ``known`` (broadcast up to LISTED texts). Only what holds
    no word of any known text (see ``_marks``) is spared the digest. A
    one-line text that matches gives both rows. Null and empty texts match nothing;
    texts of any length, ties, repeated rows, null ids and extra columns are taken row by
    row; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = checkpoint(spark.createDataFrame(known, "license string, text string").select(canonical(F.col("text")).alias("text"), "license"))
    marks = _marks([(r["text"], r["license"]) for r in table.collect()])
    may = lambda unit: reduce(or_, [F.contains(F.lower(unit), F.lit(m)) for m in marks]) if marks else F.lit(True)
    table = table.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("license").alias("license"))
    held = docs.select(F.col(id_col), text_of(docs, text_col).alias("text")).where(may(F.col("text")))
    whole = F.array(F.struct(F.lit(0).alias("line_no"), F.col("text").alias("unit")))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("unit")))
    units = held.select(id_col, F.explode(F.concat(whole, lines)).alias("u")).select(id_col, "u.*").where(may(F.col("unit")))
    found = units.withColumn("digest", F.sha2(canonical(F.col("unit")), 256))
    return found.join(F.broadcast(table) if len(known) <= LISTED else table, "digest").select(id_col, "line_no", "license")


def oracle() -> str:
    """The same for DuckDB."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    canon = f"trim(lower(regexp_replace(regexp_replace(unit, {quoted(HOLDERS)}, ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"
    for pattern, spelling in SPELLINGS:
        canon = f"regexp_replace({canon}, {quoted(pattern)}, {quoted(spelling.replace('$1', chr(92) + '1'))}, 'g')"
    rows = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in KNOWN)
    return f"""
        WITH known AS (SELECT sha256({canon}) AS digest, min(license) AS license FROM (VALUES {rows}) t(license, unit) GROUP BY 1),
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
        units AS (SELECT doc_id, 0 AS line_no, text AS unit FROM documents UNION ALL SELECT doc_id, line_no, unit FROM lines)
        SELECT doc_id, line_no::INT AS line_no, license FROM units JOIN known ON sha256({canon}) = digest"""
