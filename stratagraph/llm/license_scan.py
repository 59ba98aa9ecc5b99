"""Licence scans by canonical digest.

A text is brought to a canonical form with DataFrame functions alone: ASCII letters
in lower case, lines of copyright notices taken out, equivalent spellings made one, everything but letters and digits a single blank.
The SHA-256 of the whole form is joined to the digests of known licences. The known texts are a fixed, short list, which bounds what is broadcast.

Edge cases: null and empty texts have the digest of '' and no licence. Repeated rows give repeated rows. Text around a licence makes it another text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as one, longer ones first where one holds another.
SPELLINGS = (
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sub-licens", "sublicens"),
    ("sub licens", "sublicens"),
    ("merchantibility", "merchantability"),
    ("non-infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("authorise", "authorize"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("whilst", "while"),
    ("https:", "http:"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that begin a notice: they name years and holders, which differ from copy to copy.
_NOTICE = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
_OTHER = r"[\x00-/:-`{-\x7f“”‘’–—…©]+"

#: Licence texts without their notices.
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
LICENSES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_TAIL,
    "BSD-2-Clause": _BSD + _DISCLAIMER,
    "BSD-3-Clause": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _DISCLAIMER,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL,
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}


def canonical(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    low = F.regexp_replace(low, _NOTICE, "\n")
    low = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, low)
    return F.trim(F.regexp_replace(low, _OTHER, " "))


def known(spark: SparkSession, licenses: dict[str, str] | None = None) -> DataFrame:
    """license_id, digest: one row for each canonical form, under its first name."""
    rows = spark.createDataFrame(sorted((licenses or LICENSES).items()), "license_id string, body string")
    return rows.select("license_id", F.sha2(canonical(F.col("body")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses: dict[str, str] | None = None) -> DataFrame:
    """Per row: id, canonical_sha256, license_id (null where the text is no known licence)."""
    rows = docs.select(F.col(id_col), F.sha2(canonical(F.col(text_col)), 256).alias("canonical_sha256"))
    table = F.broadcast(known(docs.sparkSession, licenses))
    return rows.join(table, rows["canonical_sha256"] == table["digest"], "left").select(id_col, "canonical_sha256", "license_id")


def _sql_canonical(text: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), {quoted(_NOTICE)}, chr(10), 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    return f"trim(regexp_replace({out}, {quoted(_OTHER)}, ' ', 'g'), ' ')"


def oracle_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(LICENSES.items()))
    return f"""
WITH known AS (
  SELECT sha256({_sql_canonical('body')}) AS digest, min(license_id) AS license_id FROM (VALUES {values}) AS t(license_id, body) GROUP BY 1
), d AS (
  SELECT doc_id, sha256({_sql_canonical('text')}) AS canonical_sha256 FROM documents
)
SELECT d.doc_id, d.canonical_sha256, known.license_id FROM d LEFT JOIN known ON d.canonical_sha256 = known.digest
"""
