"""Licence scans by canonical digest (operator 8), built-in functions only.

A text is brought to a canonical form (lower case, copyright lines dropped, spellings that count as equal made equal,
punctuation and white space collapsed) and the digest of the *entire* text is hash-joined to the digests of known
licences.  Long licences are known by their digests alone.  One-line notices are known texts too; every line that holds a
word of one of them is looked up the same way.

Defined cases: a null text is the empty one and matches nothing; repeated rows are kept; an empty table gives no rows;
further columns are ignored; two known texts with one canonical form give the name that sorts first; texts and lines are
digested whole, however long.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: spellings that count as equal, in canonical form (after case and punctuation)
EQUAL_SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme ", "program "),
    ("programmes ", "programs "),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# fixed values: known one-line notices
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# fixed values: known licence texts
TEXTS = (
    ("0BSD", _ISC.format("")),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    (
        "MIT",
        """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

"""
        + _WARRANTY,
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
)


# fixed values: digests of the canonical form of whole licences that are too long to quote
DIGESTS = (
    ("Apache-2.0", "0be25ae8b112b6c47bf696a745855eebba678079747ad8bbf877d928555027f1"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
)


def without_copyright(text: Column) -> Column:
    """Lower case, without lines that state a copyright or reserve all rights."""
    return F.regexp_replace(F.lower(text), r"(?m)^[ \t/*#;-]*(?:copyright\b(?=[^\n]*(?:\d{4}|\(c\)|©))|\(c\)[ \t]|©|all rights reserved)[^\n]*$", "")


def canonical(text: Column) -> Column:
    """The form in which equal licences are equal."""
    # line-comment marks and list marks are punctuation and go with it
    out = F.concat(F.lit(" "), F.regexp_replace(without_copyright(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for one, other in EQUAL_SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return F.trim(F.regexp_replace(out, "  +", " "))


def known(spark, pairs, digests=()) -> DataFrame:
    """(digest, licence) of known texts, and of known digests: as many rows as those, whatever the input."""
    rows = spark.createDataFrame(list(pairs), "licence string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "licence")
    if digests:
        rows = rows.unionByName(spark.createDataFrame(list(digests), "licence string, digest string"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def spelled(word: str) -> set[str]:
    """All spellings that canonical form turns into ``word``, which holds no spelling of two words."""
    out, new = {word}, {word}
    while new:
        new = {w[:i] + one.strip() + w[i + len(other.strip()) :] for w in new for one, other in EQUAL_SPELLINGS if " " not in one.strip() for i in range(len(w)) if w.startswith(other.strip(), i)} - out
        out |= new
    return out


def telling_words(notices) -> list[str] | None:
    """Words in lower case of which every line that is one of ``notices`` holds at least one, or None if there is no such list."""
    joined = [other for one, other in EQUAL_SPELLINGS if " " in one.strip()]
    out: set[str] = set()
    for _, text in notices:
        words = re.findall(r"[^\W_]+", text.lower())
        fit = [w for w in words if w.isascii() and w.isalpha() and not any(w in x.split() or x in w for x in joined)]
        if not fit:
            return None
        out |= spelled(max(fit, key=len))
    return sorted(out)


def scan(docs: DataFrame, texts=TEXTS + NOTICES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text", digests=DIGESTS) -> DataFrame:
    """Per document: digest of the entire canonical text, its licence or null, and the licences of its notice lines (sorted, distinct)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = telling_words(notices)

    def may_hold(x: Column) -> Column:
        if words is None:
            return F.lit(True)
        out = F.lit(False)
        for w in words:
            out = out | F.contains(F.lower(x), F.lit(w))
        return out

    lines = F.when(may_hold(text), F.transform(F.filter(F.split(text, "\n"), may_hold), lambda x: F.sha2(canonical(x), 256)))
    rows = docs.select(id_col, F.sha2(canonical(text), 256).alias("digest"), F.coalesce(lines, F.array().cast("array<string>")).alias("_lines"))
    found = rows.join(F.broadcast(known(spark, texts, digests)), "digest", "left")
    table = known(spark, notices).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("digest", "licence"))).alias("_known"))
    return found.join(F.broadcast(table)).select(
        id_col,
        F.col("digest").alias("text_digest"),
        F.col("licence").alias("text_licence"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("_lines", lambda x: F.element_at("_known", x)), lambda x: x.isNotNull()))), ",").alias("notice_licences"),
    )
