"""Licence scans by canonical digest lookup; DataFrame functions only.

A text is brought into a canonical form - lower case, no copyright lines, no
punctuation, one spelling of words that have several - and its digest is joined
to the digests of known licence texts in the same form. Only a whole text
matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that licence texts spell in several ways (British and American), and the form kept.
EQUIVALENT_WORDS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("customised", "customized"), ("emphasise", "emphasize"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("licence", "license"), ("licences", "licenses"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("noncommercial", "non commercial"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("https", "http"),
]

#: A line with a copyright sign or word and a year, a sign or "by" after it; and the customary line of rights.
COPYRIGHT_LINE = r"(^|\n)[^\n]*(copyright *(\(c\)|©|[0-9]|by )|\(c\) *[0-9]{4}|© *[0-9]{4})[^\n]*"
RIGHTS_LINE = r"(^|\n)[ \t]*all rights reserved\.?[ \t\r]*"
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

#: Texts of public licences, and notices that licences ask for, by their public identifiers.
KNOWN_LICENSES = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
""" + _AS_IS),
    ("MIT-0", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
""" + _AS_IS),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
""" + _ISC_AS_IS),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
""" + _ISC_AS_IS),
    ("BSD-2-Clause", _BSD_2 + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD_2 + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + _BSD_AS_IS),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT-notice", "Released under the MIT License."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
]

#: SHA-256 of the canonical form of longer public licences, as they are commonly distributed. They follow from
#: ``canonical``; a test computes them again from the texts where a machine has these.
KNOWN_DIGESTS = [
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "c4613abc25c25ce20595a7a2e02036d5081280244caf03cf7c548a62ab4be99c"),
    ("GPL-2.0", "6a37b37e4b1cf0da9da2e7e6e75ee31775d6285bf2ed6189d14c9b3fd315c28d"),
    ("GPL-3.0", "335e2e9a39badb7f3faa5b6e393ff8b393f868383be9ddbf866c5821b34f4810"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "469a6324726e3318515c938121859a1acfaba5d131d662968839e23a92b8a873"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]
#: Titles that stand above the texts of KNOWN_LICENSES in files; each is known with its titles and without.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "MIT-0": ["MIT No Attribution"], "ISC": ["ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License"],
}


def titled(texts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The texts, and each again under each of its titles."""
    return [*texts, *((name, f"{title}\n\n{text}") for name, text in texts for title in TITLES.get(name, []))]


def canonical(text: Column) -> Column:
    """The canonical form of a text; null becomes the empty text."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, RIGHTS_LINE, "")
    # two spaces around every word, so that neighbours are both replaced
    out = F.concat(F.lit(" "), F.regexp_replace(out, PUNCTUATION, "  "), F.lit(" "))
    for spelling, kept in EQUIVALENT_WORDS:
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {kept} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id, digest of the given texts (or of the built-in list); the list's size does not grow with the documents."""
    rows = spark.createDataFrame(texts or titled(KNOWN_LICENSES), "license_id string, text string")
    digests = rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("license_digest"))
    if not texts:
        digests = digests.unionByName(spark.createDataFrame(KNOWN_DIGESTS, "license_id string, license_digest string"))
    return digests.groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id (null: no known licence), one row for each row of ``docs``.

    Null texts count as empty; the empty form matches no licence. Repeated rows and null ids stay. Licence texts of
    equal form report the smallest identifier. Other columns are not read.
    """
    known = known if known is not None else known_licenses(docs.sparkSession)
    form = canonical(F.col(f"`{text_col}`"))
    digests = docs.select(F.col(f"`{id_col}`").alias("doc_id"), form.alias("form")).select("doc_id", F.sha2("form", 256).alias("digest"))
    empty = F.sha2(F.lit(""), 256)
    return digests.join(known.where(F.col("license_digest") != empty), F.col("digest") == F.col("license_digest"), "left").select("doc_id", "digest", "license_id")


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        x = f"lower(coalesce({x}, ''))"
        for pattern, by in ((COPYRIGHT_LINE, ""), (RIGHTS_LINE, "")):
            x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"
        x = f"concat(' ', regexp_replace({x}, {quoted(PUNCTUATION)}, '  ', 'g'), ' ')"
        for spelling, kept in EQUIVALENT_WORDS:
            x = f"replace({x}, ' {spelling} ', ' {kept} ')"
        return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"

    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in titled(KNOWN_LICENSES))
    digests = ", ".join(f"({quoted(n)}, {quoted(d)})" for n, d in KNOWN_DIGESTS)
    return f"""WITH raw(license_id, text) AS (VALUES {values}), long(license_id, license_digest) AS (VALUES {digests}),
named AS (SELECT license_id, sha256({form('text')}) AS license_digest FROM raw UNION ALL SELECT license_id, license_digest FROM long),
known AS (SELECT license_digest, min(license_id) AS license_id FROM named GROUP BY 1),
forms AS (SELECT doc_id, sha256({form('text')}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM forms LEFT JOIN known ON digest = license_digest AND digest <> sha256('')"""
