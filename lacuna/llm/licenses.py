"""License scans: whole texts looked up by the digest of their canonical form.

The canonical form lower-cases A-Z, drops a title and copyright lines, makes equivalent spellings one, and turns every run of
punctuation and white space into one space. Known licences go through the same expressions, so a match is an
equality of SHA-256 digests: one projection and one hash join, all of it SQL functions.

Null text counts as empty. A text whose canonical form is empty matches nothing. Rows that repeat a document get
a row each; where two known names have one canonical form, the smaller name is given. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import text_or_empty

# fixed values: public licence texts and the usual one-line notices
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_NO_LIABILITY = (
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
LICENSES = {
    "MIT": (
        "MIT License\n\nCopyright (c) <year> <copyright holders>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of "
        'this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software.\n\n" + _NO_WARRANTY + _NO_LIABILITY
    ),
    "ISC": (
        "ISC License\n\nCopyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER
    ),
    "0BSD": (
        "BSD Zero Clause License\n\nCopyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted.\n\n" + _ISC_DISCLAIMER
    ),
    "BSD-2-Clause": "Copyright (c) <year> <owner>\n\n" + _BSD_START + _BSD_TWO + _BSD_END,
    "BSD-3-Clause": (
        "Copyright (c) <year> <owner>\n\n" + _BSD_START + _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END
    ),
    "Zlib": (
        "zlib License\n\nCopyright (c) <year> <owner>\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the "
        "authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, "
        "and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
}
# fixed values: digests of the canonical forms of long public texts, as Debian's base-files has them, appendices included
DIGESTS = {
    "Apache-2.0": "fcbdc1229c3c0f132b5f86856e32f4095e01497ca28b7d381fb79cb43713fb6f",
    "CC0-1.0": "8a58796fb749d87126983cebc26e6619b99601332e2fee24acbad509518cad3f",
    "GPL-2.0": "a6867825c7ada5a541a99a15091c71fb7a38e00bbafacf795941014b022a19b9",
    "GPL-3.0": "72bae471b202d264903d339721fea4c41ddd5534b7a426780581683e0d649e0b",
    "LGPL-2.1": "5b9d9bbcd8fe8257321bc214dfd50bc81942910d5b74d4110f173af1d6393aa6",
    "LGPL-3.0": "0e4b76b6e59624322ba990d1d340242e86730de87442c15bb2172248c4e49b4a",
    "MPL-2.0": "fed163994fe9fcdd2a56e016ad1b506ec0fd9d98faf279dcfcd347b6daa991df",
}
KNOWN_ROWS = 10_000  #: a table of known licences with no more rows is broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (pattern, replacement) in order, in the syntax that Java and RE2 share; {1} is the first group. The text has line feeds
#: before it. A title is a first line with the word licence that a blank line and more text follow; it goes, as many copies
#: have none or another.
_LEAD = r"[ \t\r#*/;-]*"
_SIGN = r"(?:\(c\)|\x{A9}|&copy;)"
_YEAR = r"(?:19|20)[0-9]{2}"
TITLE = (r"\A[\n \t\r#*/;=-]*[a-z0-9 .,()\"'-]{0,60}licen[cs]e[a-z0-9 .,()\"'-]{0,30}\r?(?:\n[=~_ \t\r#*/;-]+)?\n" + _LEAD + r"\n[ \t\r\n#*/;-]*([a-z0-9<(\[\"'])", "\n\n{1}")
#: A line goes if it starts with "copyright" and a sign, a year or a blank to fill in, or with a sign and one of these; so do
#: lines with a sign that follow such a one, and one further line of at most 80 characters that ends the paragraph, if another
#: follows. At a paragraph's start a line that names a holder or holds a year goes too. A sentence that only wraps at the
#: word stays.
_NOTICE = r"(?:portions )?(?:copyright[ \t:]*(?:" + _SIGN + r"|[0-9]{4}|[<\[{])|" + _SIGN + r"[ \t]*(?:copyright|[0-9]{4}|[<\[{]))"
_HOLDER = r"(?:[^\n ]+ ){0,4}(?:inc|ltd|llc|gmbh|corp|foundation|authors|developers|contributors)"
COPYRIGHT = [
    (r"\n" + _LEAD + _NOTICE + r"[^\n]*\n" + _LEAD + r"[a-z<][^\n]{0,79}(\n" + _LEAD + r"\n[ \t\r\n#*/;-]*[a-z0-9<(\[\"'])", "{1}"),
    (r"\n" + _LEAD + r"(?:" + _NOTICE + r"|all rights reserved)[^\n]*(?:\n" + _LEAD + _SIGN + r"[^\n]*)*", ""),
    (r"(\n" + _LEAD + r")(?:\n" + _LEAD + r"(?:portions )?(?:copyright (?:by|" + _HOLDER + r"|[^\n]*" + _YEAR + r")|\x{A9}|\(c\)[^\n]*" + _YEAR + r")[^\n]*)+", "{1}"),
]
PUNCTUATION = (r"[\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{BF}\x{2010}-\x{206F}\x{3000}-\x{3003}]+", " ")
#: equivalent spellings, both sides made one form; a form need not be a word
SPELLINGS = [
    (r"is(e|ing|ation)", r"iz{1}"),
    (r"yse", "yze"),
    (r"our", "or"),
    (r"licenc", "licens"),
    (r"(of|def)fence", r"{1}fense"),
    (r"ogue", "og"),
    (r"(cent|calib)re", r"{1}er"),
    (r"ll(ed|ing)", r"l{1}"),
    (r"fulfill", "fulfil"),
    (r"(judg|acknowledg)ement", r"{1}ment"),
    (r"whilst", "while"),
    (r"artefact", "artifact"),
    (r"programme", "program"),
    (r"practize", "practice"),
    (r"copyright owner", "copyright holder"),
    (r"sub licens", "sublicens"),
    (r"non commercial", "noncommercial"),
    (r"per cent", "percent"),
    (r"https", "http"),
]


def canonical(text: Column) -> Column:
    out = F.concat(F.lit("\n\n"), F.translate(text, UPPER, LOWER))
    for pattern, to in (TITLE, *COPYRIGHT, PUNCTUATION):
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to.replace("{1}", "$1")))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to.replace("{1}", "$1"))) if "(" in pattern else F.replace(out, F.lit(pattern), F.lit(to))
    return F.trim(out)


def canonical_sql(text: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"chr(10) || chr(10) || translate({text}, '{UPPER}', '{LOWER}')"
    for pattern, to in (TITLE, *COPYRIGHT, PUNCTUATION):
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to.replace('{1}', chr(92) + '1'))}, 'g')"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to.replace('{1}', chr(92) + '1'))}, 'g')" if "(" in pattern else f"replace({out}, {quoted(pattern)}, {quoted(to)})"
    return f"trim({out}, ' ')"


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id with a text, or with the digest of its canonical form."""
    rows = [(k, v, None) for k, v in sorted(LICENSES.items())] + [(k, None, v) for k, v in sorted(DIGESTS.items())]
    return spark.createDataFrame(rows, "license_id string, text string, digest string")


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest of the canonical text, its length, and license_id (null: no known licence).

    ``known`` has license_id and text; in a column digest it may give the digest of a canonical text instead.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    form = canonical(text_or_empty())
    given = F.col("digest") if "digest" in known.columns else F.lit(None).cast("string")
    known = known.where("license_id is not null").select("license_id", form.alias("canonical"), given.alias("given"))
    digest = F.coalesce(F.lower("given"), F.when(F.col("canonical") != "", F.sha2("canonical", 256)))
    known = known.groupBy(digest.alias("digest")).agg(F.min("license_id").alias("license_id")).where("digest is not null")
    if known.count() <= KNOWN_ROWS:
        known = F.broadcast(known)
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), form.alias("canonical"))
    scanned = scanned.select("doc_id", F.sha2("canonical", 256).alias("digest"), F.length("canonical").cast("long").alias("n_canonical"))
    return scanned.join(known, "digest", "left").select("doc_id", "digest", "n_canonical", "license_id")


def oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(LICENSES.items()))
    digests = ", ".join(f"({quoted(v)}, {quoted(k)})" for k, v in sorted(DIGESTS.items()))
    return f"""
        WITH known AS (
            SELECT sha256(c) AS digest, min(license_id) AS license_id
            FROM (SELECT license_id, {canonical_sql("text")} AS c FROM (VALUES {rows}) AS t(license_id, text)) WHERE c <> '' GROUP BY 1
            UNION ALL FROM (VALUES {digests}) AS d(digest, license_id)
        ), scanned AS (
            SELECT doc_id, sha256(c) AS digest, length(c) AS n_canonical
            FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, {canonical_sql("coalesce(text, '')")} AS c FROM documents)
        )
        SELECT doc_id, digest, n_canonical, license_id FROM scanned LEFT JOIN known USING (digest)
    """
