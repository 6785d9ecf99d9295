"""License scans by canonical digests.

Texts of one licence differ in case, punctuation, line breaks, copyright lines and spelling.  All of these are
normalised away, and what is left is hashed; a whole text is the licence whose digest it has, found by a hash join with
the known digests.  The same digests name one-line notices; a line's lookup needs no shuffle while the catalogue is
counted to be small.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS, small, table

# Spellings that licence comparison treats as equal, the second being the canonical one.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licenced": "licensed", "licencee": "licensee", "licencees": "licensees", "licences": "licenses", "licencing": "licensing", "licencor": "licensor", "licencors": "licensors", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "sublicence": "sublicense", "sublicences": "sublicenses", "sublicenced": "sublicensed", "sublicencing": "sublicensing", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Phrases that licence comparison treats as equal, in canonical spelling, the second being the canonical one.
PHRASES = {"copyright owner": "copyright holder", "copyright owners": "copyright holders", "non commercial": "noncommercial", "per cent": "percent", "sub license": "sublicense"}

# Public licence texts and one-line notices.
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR '
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT "
    "OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT '
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
KNOWN = [
    ("0BSD", f"{_PERMIT}.\n{_ISC_END}"),
    ("0BSD", f"Zero-Clause BSD\n{_PERMIT}.\n{_ISC_END}"),
    ("BSD-2-Clause", _BSD2 + _DISCLAIMER),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD2 + _DISCLAIMER),
    ("BSD-3-Clause", _BSD2 + _NAMES + _DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD2 + _NAMES + _DISCLAIMER),
    ("ISC", f"{_PERMIT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("ISC", f"ISC License\n{_PERMIT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
]

# Digests of the canonical words of licence texts too long to state here, as their publishers give them.
LONG = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3-only", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0-only", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "5a03c45024821019e59bbbf8d5bd13f8395e4e13204f3e1cf7fb58b2422ec219"),
    ("LGPL-2.0-only", "289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015"),
    ("LGPL-2.1-only", "5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SPELLED = {a.encode(): b.encode() for a, b in SPELLINGS.items()}
#: Words stand two spaces apart while phrases are replaced, so that phrases in a row don't share a space.
_PHRASES = [(f" {a.replace(' ', '  ')} ".encode(), f" {b.replace(' ', '  ')} ".encode()) for a, b in PHRASES.items()]
_COPYRIGHT = re.compile(rb"(?:copyright (?!holders?\b|owners?\b|notices?\b|licenses?\b|laws?\b)|\xc2\xa9 |all rights reserved)")


def canonical_lines(text: str | None) -> list[bytes]:
    """The canonical words of each line, in order; lines without words and copyright lines are left out.

    Words are runs of ASCII digits, letters (A to Z lower-cased) and characters beyond ASCII.  A copyright line begins
    with "copyright", the copyright sign or "all rights reserved", but not with a phrase such as "copyright holders", which
    a line of a licence may begin with.
    """
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        words = b" " + b"  ".join([_SPELLED.get(w, w) for w in _WORD.findall(line)]) + b" "
        for a, b in _PHRASES:
            words = words.replace(a, b)
        words = words.replace(b"  ", b" ").strip()
        if words and not _COPYRIGHT.match(words + b" "):
            out.append(words)
    return out


def digest(canonical: bytes) -> str:
    return hashlib.sha256(canonical).hexdigest()


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id) of licence texts, one row a digest; without known, of all KNOWN texts and LONG digests."""
    rows = {digest(b" ".join(canonical_lines(t))): name for name, t in known or KNOWN} | ({} if known else {d: name for name, d in LONG})
    return spark.createDataFrame(sorted(rows.items()), "digest string, license_id string")


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its id, the digest of its whole canonical text, the licence that the whole text is (null: none),
    the licences that single lines name (sorted, comma-joined, each once) and the number of such lines.

    Null and empty texts, and texts of copyright lines only, have the digest of nothing and no licence.  Each row stands
    alone; repeated rows are reported each; other columns are ignored.  known has the columns digest and license_id; of
    several licences with one digest the first by name counts.
    """
    one = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    few = one.count() <= BROADCAST_ROWS
    names = {r["digest"]: r["license_id"] for r in one.collect()} if few else {}

    @F.pandas_udf("digest string, lines array<string>")
    def found(texts: pd.Series) -> pd.DataFrame:
        lines = [canonical_lines(t) for t in texts]
        kept = [[digest(y) for y in x] for x in lines]
        if few:  # the licences in place of the digests
            kept = [[names[y] for y in x if y in names] for x in kept]
        return pd.DataFrame({"digest": [digest(b" ".join(x)) for x in lines], "lines": kept})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), found(F.col(text_col)).alias("f")).select("row", "id", F.col("f.digest").alias("whole"), "f.lines")
    if not few:
        lines = rows.select("row", "id", "whole", F.explode_outer("lines").alias("digest"))
        rows = lines.join(one, "digest", "left").groupBy("row", "id", "whole").agg(F.collect_list("license_id").alias("lines"))
    full = rows.join(small(one.withColumnRenamed("digest", "whole")), "whole", "left")
    notices = F.array_join(F.array_sort(F.array_distinct("lines")), ",")
    return full.select(F.col("id").alias(id_col), F.col("whole").alias("digest"), "license_id", notices.alias("notices"), F.size("lines").cast("long").alias("n_notices"))


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the licences of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"), known_digests(spark))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PHRASED = "' ' || array_to_string(list_transform(regexp_extract_all(l, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: coalesce(spelled[w], w)), '  ') || ' '"
for _a, _b in _PHRASES:
    _PHRASED = f"replace({_PHRASED}, {_quoted(_a.decode())}, {_quoted(_b.decode())})"
_CANONICAL = (
    "list_filter(list_transform(string_split(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)), "
    "lambda l: trim(replace({phrases}, '  ', ' '))), "
    "lambda c: c <> '' AND NOT (starts_with(c || ' ', 'copyright ') AND NOT regexp_matches(c, '^copyright (holders?|owners?|notices?|licenses?|laws?)( |$)')) AND NOT starts_with(c || ' ', '© ') AND NOT starts_with(c || ' ', 'all rights reserved'))"
)
LICENSES_SQL = f"""
WITH s AS (SELECT MAP {{{", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in SPELLINGS.items())}}} AS spelled),
k AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in KNOWN)}) AS t(license_id, text)),
kt AS (SELECT sha256(array_to_string({_CANONICAL.format(text="text", phrases=_PHRASED)}, ' ')) AS digest, license_id FROM k, s),
kd AS (SELECT digest, min(license_id) AS license_id FROM (SELECT * FROM kt UNION ALL SELECT * FROM (VALUES {", ".join(f"({_quoted(d)}, {_quoted(n)})" for n, d in LONG)}) AS t(digest, license_id)) GROUP BY digest),
d AS (SELECT doc_id, {_CANONICAL.format(text="coalesce(text, '')", phrases=_PHRASED)} AS lines FROM documents, s),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(license_id) AS n_notices FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM d) JOIN kd USING (digest) GROUP BY doc_id),
w AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS digest FROM d)
SELECT w.doc_id, w.digest, kd.license_id, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices FROM w LEFT JOIN kd USING (digest) LEFT JOIN n ON n.doc_id = w.doc_id
"""
