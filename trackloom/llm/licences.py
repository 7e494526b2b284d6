"""Licence scan by canonical digest.

Texts are brought to a canonical form: lower case, copyright lines and the like removed,
equivalent spellings made equal, everything but letters and digits reduced to single
blanks. The digest of the whole canonical text is joined by hash with the digests of known
licence texts, and the digest of each line with those of known one-line notices. The table
of known digests is fixed, under 100 rows, and is broadcast. Column functions only.

A licence is known with each of its published titles or none, with "All rights reserved." in its
copyright block or not, and with its appendix or cut after its terms. Those words in the copyright block of a
known licence reserve nothing, so they add no terms to it; the notice itself is still listed.

Defined cases: null text is empty and matches nothing; a text or line that is empty in its
canonical form matches nothing; repeated rows are scanned one by one; texts of any length are
digested whole; licences and terms are listed in order of name; an empty table gives
an empty result; added columns replace kept ones of their names.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

ADDED = ["licence", "notices", "n_notices", "terms"]
# One-line notices and the terms they announce.
NOTICES = {
    "MIT": ("permissive", ["Released under the MIT License.", "Licensed under the MIT License.", "MIT License"]),
    "Apache-2.0": ("permissive", ["Licensed under the Apache License, Version 2.0.", "Apache License, Version 2.0"]),
    "BSD": ("permissive", ["Released under the BSD License.", "Licensed under the BSD License."]),
    "GPL-3.0": (
        "copyleft",
        [
            "This work is licensed under the GNU General Public License, version 3.",
            "Licensed under the GNU General Public License, version 3.",
            "Licensed under the GPL, version 3.",
        ],
    ),
    "CC-BY-4.0": ("permissive", ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."]),
    "CC-BY-SA-4.0": ("copyleft", ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."]),
    "CC-BY-NC-4.0": ("noncommercial", ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."]),
    "CC0-1.0": ("public", ["Released under CC0.", "This work is in the public domain."]),
    "reserved": ("reserved", ["All rights reserved."]),
}
# Whole licence texts, without their copyright lines.
TEXTS = {
    "MIT": (
        "permissive",
        """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "ISC": (
        "permissive",
        """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "Unlicense": (
        "public",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    ),
}
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""
_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
TEXTS["BSD-2-Clause"] = ("permissive", "BSD 2-Clause License\n" + _BSD.format(third=""))
TEXTS["BSD-3-Clause"] = ("permissive", "BSD 3-Clause License\n" + _BSD.format(third=_THIRD))
# The terms of the long licences whose texts, line by line as published, lie in licence_texts.
LONG = {
    "Apache-2.0": "permissive", "BSD-3-Clause-UC": "permissive", "CC0-1.0": "public", "GPL-2.0": "copyleft",
    "GPL-3.0": "copyleft", "LGPL-2.1": "copyleft", "LGPL-3.0": "copyleft", "MPL-2.0": "copyleft",
}
for _name, _terms in LONG.items():
    TEXTS[_name] = (_terms, (Path(__file__).parent / "licence_texts" / f"{_name}.txt").read_text(encoding="utf-8"))
# Titles under which the short licences are published, the words of old copyright blocks, and the end of the long ones' terms.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"],
}
RIGHTS = "All rights reserved."
END = "END OF TERMS AND CONDITIONS"
# Pairs of equivalent spellings, the second one canonical.
SPELLINGS = [
    ("licenc", "licens"), ("sub-licens", "sublicens"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"),
    ("copyright owner", "copyright holder"), ("favour", "favor"), ("fulfil ", "fulfill "), ("organis", "organiz"), ("analys", "analyz"),
    ("&", " and "), ("http:", "https:"), ("while ", "whilst "),
]
#: Lines that name a holder or a year, or end with a year: running text that happens to start with the word stays.
COPYRIGHT = r"(?m)^[^\p{L}\n]*(?:copyright[^\p{L}\n]*(?:[0-9<\[\x{00a9}:]|\(c\)|by\b)[^\n]*|(?:\(c\)|\x{00a9})[^\n]*|copyright\b[^\n]*\b[0-9]{4}[^\p{L}0-9\n]*)$"
#: Held by every known text or notice before it is made canonical, whatever stands between two words.
HINT = r"(?i)licen[cs]|permission|copyright|rights|public[^a-zA-Z0-9]+domain|cc0"


def canonical(text: Column) -> Column:
    """The canonical form of a text or line."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def published() -> list[tuple[str, str, str]]:
    """(licence, terms, text) of every form that a whole licence is known in."""
    out = []
    for name, (terms, text) in TEXTS.items():
        out.append((name, terms, text))
        if name in TITLES:
            body = text.partition("\n")[2]
            out += [(name, terms, f"{title}\n{rights}\n{body}") for title in ("", *TITLES[name]) for rights in ("", RIGHTS)]
        before, end, _ = text.partition(END)
        if end:
            out += [(name, terms, before), (name, terms, before + end)]
    return out


def known(spark: SparkSession) -> DataFrame:
    """(form, licence, terms, digest) of all known texts and notices."""
    rows = [("text", *x) for x in published()]
    rows += [("line", k, terms, t) for k, (terms, ts) in NOTICES.items() for t in ts]
    df = spark.createDataFrame(rows, "form string, licence string, terms string, t string")
    return df.select("form", "licence", "terms", digest(F.col("t")).alias("digest")).dropDuplicates(["form", "digest"])


def scan_licences(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of docs with the licence a text is, and the notices in its lines.

    Every known text and notice holds a word of HINT, so other texts and lines need no digest.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(text_col, F.lit(""))
    names = [c for c in keep if c.lower() not in {*ADDED, "_text", "_whole", "_lines", "_row", "_terms", "_whole_terms"}]
    base = docs.select(*[F.col(f"`{c}`") for c in names], text.alias("_text"))
    lines = F.transform(F.filter(F.split("_text", "\n"), lambda x: x.rlike(HINT)), digest)
    found = scratch.save(
        base.select(
            *[F.col(f"`{c}`") for c in base.columns if c != "_text"],
            F.when(F.col("_text").rlike(HINT), digest(F.col("_text"))).alias("_whole"),
            F.when(F.col("_text").rlike(HINT), F.filter(lines, lambda x: x.isNotNull())).alias("_lines"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    digests = F.broadcast(known(docs.sparkSession))
    each = found.select("_row", F.explode("_lines").alias("digest")).join(digests.filter("form = 'line'"), "digest")
    notices = each.groupBy("_row").agg(
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"),
        F.count(F.lit(1)).alias("n_notices"),
        F.collect_set("terms").alias("_terms"),
    )
    whole = F.broadcast(known(docs.sparkSession).filter("form = 'text'").select(F.col("digest").alias("_whole"), "licence", F.col("terms").alias("_whole_terms")))
    out = found.join(whole, "_whole", "left").join(notices, "_row", "left")
    told = F.coalesce("_terms", F.array().cast("array<string>"))
    told = F.when(F.col("_whole_terms").isNotNull(), F.array_remove(told, "reserved")).otherwise(told)
    terms = F.array_sort(F.array_distinct(F.concat(told, F.when(F.col("_whole_terms").isNotNull(), F.array("_whole_terms")).otherwise(F.array().cast("array<string>")))))
    out = out.withColumns({
        "licence": F.coalesce("licence", F.lit("")), "notices": F.coalesce("notices", F.lit("")),
        "n_notices": F.coalesce("n_notices", F.lit(0)).cast("long"), "terms": F.array_join(terms, ","),
    })
    return out.select(*[F.col(f"`{c}`") for c in base.columns if c != "_text"], *ADDED)
