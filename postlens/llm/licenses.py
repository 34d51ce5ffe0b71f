"""Licence scan by canonical digests: whole texts and single lines against known licence texts.

A text is made canonical: lower case, without copyright lines, every run of
other characters than letters and digits one blank, equivalent spellings made
equal. Its SHA-256 is hash-joined with the digests of the known texts, first
for the whole text of a document, then for each of its lines, so that a notice
of one line inside a document is found too. A whole text is looked up a second
time without its title and without lines that name a holder and a year.

Covered as whole texts, with and without title: MIT, MIT-0, ISC, 0BSD, BSD-2-Clause
and BSD-3-Clause (clauses numbered or not), Zlib; by digests of the published
texts in ``LONG``: see there for their names. Other texts, CC ones but CC0-1.0
among them, are known by their notices of one line only, if at all.

Everything is DataFrame functions; the table of known texts is the one side
broadcast, it has the fixed size of ``KNOWN`` (a larger one given by the
caller is joined as Spark sees fit).

Defined results: a null text counts as empty; a text without letters and
digits has the digest of the empty text and no licence; of several known names
with one digest the first in order counts; repeated rows of a doc_id share the
notices of all of them; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

# Spellings counted as equal, as (spelling, stands for).
SPELLINGS = (
    ("licence", "license"), ("organisation", "organization"), ("authoris", "authoriz"), ("recognis", "recogniz"),
    ("favour", "favor"), ("behaviour", "behavior"), ("whilst", "while"), ("fulfilment", "fulfillment"),
    ("https", "http"), ("non commercial", "noncommercial"), ("sub license", "sublicense"),
)

# Published licence texts and the usual notices of one line.
KNOWN = (
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0 notice", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT notice", "Released under the MIT License."),
    ("MIT notice, licensed", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0 notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0 notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0 notice", "Released under CC0 1.0."),
    (
        "MIT",
        """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
)

COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright[ \t]+(\(c\)|©|[0-9])|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"


# Digests of the bare form of published long texts, whole and up to the end of their terms.
LONG = (
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("Unlicense", "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),
)

# A line that names the holder before the year, and the titles of the short texts in canonical form.
NAMED_COPYRIGHT = (
    r"(?im)^[ \t#*/;-]*copyright[ \t:]+[^\n]{1,120}?[ \t,]\(?(?:19|20)[0-9]{2}(?:[ \t,-]+(?:(?:19|20)[0-9]{2}|present))*\)?[ \t.,;]*"
    r"(?:all rights reserved[ \t.]*)?\r?$"
)
TITLE = (
    r"^(?:the )?(?:mit license(?: mit| expat)?|mit expat license|expat license|mit no attribution|isc license(?: isc)?|"
    r"(?:bsd )?zero clause(?: bsd)? license(?: 0bsd)?|0bsd license|bsd [23] clause (?:\w+ )?license|[23] clause bsd license|"
    r"(?:simplified|modified|new|revised) bsd license|bsd license|zlib(?: libpng)? license|unlicense) "
)


def variants() -> list[tuple[str, str]]:
    """The short texts of ``KNOWN`` and what follows from them: BSD with two and three clauses, numbered or not, MIT-0."""
    short = [(name, text) for name, text in KNOWN if not name.split(",")[0].endswith(" notice")]
    texts = dict(short)
    third = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.

THIS SOFTWARE IS"""
    two = texts["BSD-2-Clause"]
    three = two.replace("THIS SOFTWARE IS", third, 1)
    for name, text in (("BSD-2-Clause", two), ("BSD-3-Clause", three)):
        for numbered in (text, re.sub(r"(?m)^[123]\. ", "", text)):
            for holder in ("HOLDER", "HOLDERS", "OWNER"):
                short.append((name, numbered.replace("THE COPYRIGHT HOLDER OR", f"THE COPYRIGHT {holder} OR")))
    short.append(("MIT-0", re.sub(r", subject to the following conditions:.*?Software\.(?=\n\nTHE)", ".", texts["MIT"], flags=re.S)))
    return short


def canonical(text):
    """The canonical form of a string column."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    for spelling, standard in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(standard))
    return F.trim(out)


def bare(text):
    """The canonical form without lines 'Copyright <name> <year>' and without the title: what a licence is known by."""
    given = F.coalesce(text, F.lit(""))
    named = canonical(F.regexp_replace(given, NAMED_COPYRIGHT, "\n"))
    return F.regexp_replace(F.when(given.rlike(NAMED_COPYRIGHT), named).otherwise(canonical(text)), TITLE, "")


def canonical_sql(text: str) -> str:
    """The same in DuckDB SQL."""
    pattern = COPYRIGHT_LINE.replace("'", "''")
    out = f"regexp_replace(lower(coalesce({text}, '')), '{pattern}', chr(10), 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for spelling, standard in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{standard}')"
    return f"trim({out})"


def known_digests(spark, known=KNOWN) -> DataFrame:
    """(known_digest, name) of texts given as (name, text)."""
    rows = spark.createDataFrame([(name, text) for name, text in known], "name string, text string")
    digests = rows.select(F.sha2(canonical(F.col("text")), 256).alias("known_digest"), "name")
    return digests.groupBy("known_digest").agg(F.min("name").alias("name"))


def bare_digests(spark) -> DataFrame:
    """(bare_digest, bare_name) of the short texts and their variants and of the long texts."""
    rows = spark.createDataFrame(variants(), "name string, text string")
    short = rows.select(F.sha2(bare(F.col("text")), 256).alias("bare_digest"), "name")
    long = spark.createDataFrame([(digest, name) for name, digest in LONG], "bare_digest string, name string")
    return short.unionByName(long).groupBy("bare_digest").agg(F.min("name").alias("bare_name"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license, notices) of docs(doc_id, text): the whole text's licence and the notices among its lines.

    ``known`` has known_digest and name; the default is the fixed table above.
    """
    table = F.broadcast(known_digests(docs.sparkSession)) if known is None else known
    digest = F.sha2(canonical(F.col("text")), 256).alias("digest")
    whole = docs.select("doc_id", digest, F.sha2(bare(F.col("text")), 256).alias("key"))
    whole = whole.join(table, whole["digest"] == table["known_digest"], "left")
    if known is None:
        more = F.broadcast(bare_digests(docs.sparkSession))
        whole = whole.join(more, whole["key"] == more["bare_digest"], "left")
        whole = whole.withColumn("name", F.coalesce("name", "bare_name"))
    whole = whole.select("doc_id", "digest", F.col("name").alias("license"))
    lines = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    lines = lines.select("doc_id", F.sha2(canonical(F.col("line")), 256).alias("line_digest"))
    hits = lines.join(table, F.col("line_digest") == F.col("known_digest"))
    notices = hits.groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_set("name").alias("names"))
    joined = whole.join(notices, whole["doc_id"].eqNullSafe(notices["hit_id"]), "left")
    return joined.select("doc_id", "digest", "license", F.array_join(F.array_sort("names"), "; ").alias("notices"))


def oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in KNOWN)
    return f"""WITH known AS (SELECT sha256({canonical_sql('t')}) AS known_digest, min(name) AS name
      FROM (VALUES {values}) v(name, t) GROUP BY 1),
    hits AS (SELECT doc_id, string_agg(DISTINCT name, '; ' ORDER BY name) AS notices
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
      JOIN known ON sha256({canonical_sql('line')}) = known_digest GROUP BY doc_id)
    SELECT d.doc_id, d.digest, k.name AS license, h.notices
    FROM (SELECT doc_id, sha256({canonical_sql('text')}) AS digest FROM documents) d
    LEFT JOIN known k ON k.known_digest = d.digest LEFT JOIN hits h ON h.doc_id IS NOT DISTINCT FROM d.doc_id"""
