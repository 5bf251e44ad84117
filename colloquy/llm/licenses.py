"""License scans by canonical digests.

A text is brought to a canonical form: lower case, without copyright lines, with words alone
between single spaces, and with one spelling of each of a list of equivalent words. Its digest
is joined to those of known license texts, so that only entire texts match; the lines of a
document are texts too, which finds notices of one line.

Defined results: a null text counts as empty and matches nothing; repeated rows are scanned
each; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Spellings and the ones they count as.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("centre", "center"), ("copyholder", "copyrightholder"), ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelled", "labeled"), ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("optimisation", "optimization"), ("organisation", "organization"),
    ("organisations", "organizations"), ("practise", "practice"), ("programme", "program"), ("recognised", "recognized"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"),
]
MOST = 20_000  # known texts: each is an entry of a table that every task has
_COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n]*(copyright|all rights reserved)[^\n]*"
_COPYRIGHT_SIGN = r"(^|\n)[^\p{L}\p{N}\n]*(\(c\)|©)[^\n]*"
_GAPS = r"[^\p{L}\p{N}]+"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS {}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_CLAUSES = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _bsd(n: int) -> str:
    return _BSD_HEAD + "\n".join(f"{k}. {c}" for k, c in enumerate(_BSD_CLAUSES[:n], 1)) + "\n" + _BSD_TAIL


#: Known texts by the license they stand for.
KNOWN = [
    ("MIT", (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.\n" + _WARRANTY.format("OR COPYRIGHT HOLDERS "))),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        'permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.")),
    ("BSD-2-Clause", _bsd(2)),
    ("BSD-3-Clause", _bsd(3)),
    ("Zlib", (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.")),
    ("Unlicense", (
        "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or "
        "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
        "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law.\n" + _WARRANTY.format("") + "\nFor more information, please refer to <https://unlicense.org/>")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]


#: Digests of the canonical forms of long texts as their stewards publish them, by license.
LONG = [
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("Artistic-1.0-Perl", "ddb49d591ecc4f65a223b9f53f330918100c323532a653c090d21b38e35a3a42"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86"),
    ("GFDL-1.3", "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", "5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30"),
    ("LGPL-2.0", "b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c"),
    ("LGPL-2.1", "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]
#: Words of which each of the long texts has one.
LONG_WORDS = ["apache", "artistic", "cc0", "gnu", "lesser", "mozilla"]


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (_COPYRIGHT, _COPYRIGHT_SIGN):
        out = F.regexp_replace(out, pattern, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, _GAPS, "  "), F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def canonical_text(text: str) -> str:
    """The same for one text on the driver."""
    out = (text or "").lower()
    for pattern in (_COPYRIGHT, _COPYRIGHT_SIGN):
        out = re.sub(pattern.replace(r"\p{L}\p{N}", "a-z0-9"), "\n", out)
    out = " " + re.sub(r"[\W_]+", "  ", out) + " "
    for a, b in EQUIVALENT:
        out = out.replace(f" {a} ", f" {b} ")
    return " ".join(out.split())


def digests(known: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Digest and license of each known text; one license for a digest, the first by name."""
    found = {(hashlib.sha256(canonical_text(t).encode()).hexdigest(), name) for name, t in known if canonical_text(t)}
    return list({d: name for d, name in sorted(found, reverse=True)}.items())


def known_digests(known: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Of a caller's texts, or of those known here and the long ones; more than MOST are an error."""
    found = digests(KNOWN) + [(d, name) for name, d in LONG] if known is None else digests(known)
    if len(found) > MOST:
        raise ValueError(f"{len(found)} texts; at most {MOST} go into a lookup table")
    return found


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, canonical_sha256, license_id (else null), notices.

    notices: the licenses that single lines stand for, sorted, with commas between.
    """
    spark = docs.sparkSession
    found = known_digests(known)
    listed = spark.createDataFrame(found, "digest string, license string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    lines = F.filter(F.split(F.coalesce("__text", F.lit("")), "\n", -1), lambda x: F.length(x) > 0)
    of_lines = F.transform(lines, lambda x: F.sha2(canonical(x), 256))
    by_digest = F.create_map(*(F.lit(x) for pair in found for x in pair)) if found else F.lit(None).cast("map<string,string>")
    names = F.array_sort(F.array_distinct(F.filter(F.transform(of_lines, lambda d: by_digest[d]), lambda x: x.isNotNull())))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("__text")), 256).alias("digest"), F.when(F.col("__text").rlike(_marked(known)), F.array_join(names, ",")).otherwise("").alias("notices"))
    return rows.join(F.broadcast(listed), "digest", "left").select("doc_id", F.col("digest").alias("canonical_sha256"), F.col("license").alias("license_id"), "notices")


def _marked(known: list[tuple[str, str]] | None) -> str:
    """A pattern of words of which each known text has one in its canonical form, in any spelling."""
    texts = [x for _, t in (KNOWN if known is None else known) if (x := canonical_text(t))]
    words = [re.findall(r"(?<!\S)[a-z]+(?!\S)", x) for x in texts]
    if not all(words):
        return ""
    firsts: set[str] = set()
    for found in words:
        if firsts.isdisjoint(found):
            firsts.add(max(found, key=len))
    if known is None:
        firsts.update(LONG_WORDS)
    other = {a for a, b in EQUIVALENT if b in firsts}
    spelt = sorted(w.replace("i", "[iİ]").replace("k", "[k\u212a]") for w in firsts | other)  # letters with these lower cases
    return "(?i)" + "|".join(spelt) if firsts else "$^"


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    out = f"lower(coalesce({x}, ''))"
    for pattern in (_COPYRIGHT, _COPYRIGHT_SIGN):
        out = f"regexp_replace({out}, '{pattern}', chr(10), 'g')"
    out = f"' ' || regexp_replace({out}, '{_GAPS}', '  ', 'g') || ' '"
    for a, b in EQUIVALENT:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


OP4_SQL = f"""
WITH k(digest, license) AS (VALUES {", ".join(f"('{d}', '{n}')" for d, n in known_digests())}
), d AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS digest FROM documents
), l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), m AS (SELECT DISTINCT doc_id, license FROM l JOIN k ON sha256({_sql_canonical("line")}) = k.digest
), n AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM m GROUP BY doc_id)
SELECT doc_id, d.digest AS canonical_sha256, license AS license_id, coalesce(notices, '') AS notices
FROM d LEFT JOIN k USING (digest) LEFT JOIN n USING (doc_id)
"""
