"""Licence scan: canonical digests of whole texts and of single lines, joined with known digests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import small_side

#: Spellings that count as equal, replaced in this order after lower-casing.
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("sub-licens", "sublicens"), ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"), ("per cent", "percent"), ("authoris", "authoriz"), ("organis", "organiz"),
    ("recognis", "recogniz"), ("utilis", "utiliz"), ("initialis", "initializ"), ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"), ("merchantibility", "merchantability"), ("favour", "favor"), ("whilst", "while"),
    ("programme", "program"), ("https://", "http://"), ("&", " and "),
)
#: Spellings of several words, replaced again where the lines are joined.
WRAPPED = tuple(x for x in SPELLINGS if " " in x[0])
#: A line that opens like this names a holder or a year and is no part of the terms. Words of the terms after "copyright",
#: as where "copyright notice" begins a line, are no holder, and "(c)" without a year numbers an item.
COPYRIGHT_LINE = (
    r"^[^0-9A-Za-z©]*(©|all rights reserved|\(c\)\s*(copyright|.*[0-9]{4})|copyright:?\s*(\(c\)|©|[0-9]{4})|copyright:?\s+(?!(notices?|holders?|"
    r"owners?|owned|licen[sc]es?|laws?|statements?|interests?|disclaimers?|permissions?|rights?|protections?|acts?|treat(y|ies)|conditions?|"
    r"and|or|the|on|in|of|is|are|to|for|as|with|that|this|which|information|status|material|infringement|applies)\b)[^\s])"
)

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_BSD_3 = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Public licence texts and notices by SPDX identifier.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
     "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software. " + _AS_IS),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", _ISC_GRANT + ". " + _ISC_END),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)
#: Title lines under which the texts above are found.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": (
        "BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License", "New BSD License", "Modified BSD License",
    ),
}
#: Canonical digests of long texts: as published, and without what follows the end of the terms.
LONG_TEXTS = (
    ("036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b", "Apache-2.0"),
    ("6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64", "Apache-2.0"),
    ("f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe", "Apache-2.0"),
    ("98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6", "GPL-1.0"),
    ("89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70", "GPL-1.0"),
    ("6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", "GPL-1.0"),
    ("e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1", "GPL-2.0"),
    ("6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", "GPL-2.0"),
    ("e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", "GPL-2.0"),
    ("5e06bcb7b8c914d3ffb433229937b503a624ae6c7bb9ac1cad01e35a324bcb6d", "GPL-3.0"),
    ("092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191", "GPL-3.0"),
    ("ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", "GPL-3.0"),
    ("e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d", "LGPL-2.0"),
    ("430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2", "LGPL-2.0"),
    ("504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", "LGPL-2.0"),
    ("d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f", "LGPL-2.1"),
    ("bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df", "LGPL-2.1"),
    ("48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "LGPL-2.1"),
    ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "LGPL-3.0"),
    ("cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6", "MPL-1.1"),
    ("6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d", "MPL-2.0"),
    ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "CC0-1.0"),
    ("15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b", "GFDL-1.2"),
    ("2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d", "GFDL-1.3"),
    ("e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2", "Artistic-1.0-Perl"),
)


def variants(name: str, text: str) -> list[str]:
    """A known text as it is found: under a title or none, its items numbered or bulleted. Notices have no variants."""
    if text.startswith("Redistribution"):
        texts = [text, re.sub(r" [123]\. ", " * ", text)]
    elif text.startswith(_ISC_GRANT):
        texts = [text, text.replace("and/or", "and", 1)]
    else:
        texts = [text]
    if len(text) < 300:
        return texts
    return [head + t for head in ("", *(f"{title}\n" for title in TITLES.get(name, ()))) for t in texts]


def canonical_line(line: Column) -> Column:
    """Lower case, equal spellings, every run of ASCII or typographic punctuation and white space one blank; copyright
    lines are empty."""
    low = F.lower(line)
    text = low
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.trim(F.regexp_replace(text, r"[^a-z0-9\x{80}-\x{200F}\x{2040}-\x{10FFFF}]+", " "))
    return F.when(F.regexp_like(low, F.lit(COPYRIGHT_LINE)), F.lit("")).otherwise(text)


def canonical_digest(text: str) -> str:
    """The same canonical form on the driver, for the handful of known texts."""
    lines = []
    for line in text.split("\n"):
        low = line.lower()
        if re.search(COPYRIGHT_LINE, low):
            continue
        for old, new in SPELLINGS:
            low = low.replace(old, new)
        lines.append(re.sub("[^a-z0-9\x80-\u200f\u2040-\U0010ffff]+", " ", low).strip(" "))
    whole = " ".join(x for x in lines if x)
    for old, new in WRAPPED:
        whole = whole.replace(old, new)
    return hashlib.sha256(whole.encode()).hexdigest()


def known_digests(known: Iterable[tuple[str, str]] = KNOWN) -> list[tuple[str, str]]:
    return sorted({(canonical_digest(t), name) for name, text in known for t in variants(name, text)})


def scan(docs: DataFrame, known: Iterable[tuple[str, str]] = KNOWN) -> DataFrame:
    """One row per document row: ``doc_id, digest, license, n_notices, notices``.

    ``digest`` is the digest of the canonical whole text and ``license`` the known licence it equals, else
    null. A licence also shows as a notice that fills a line: each line is looked up by the same
    digest, ``n_notices`` counts those found and ``notices`` lists their licences, sorted and joined by
    commas. Every lookup is one hash join of digests.

    A null text has null in all columns but ``doc_id`` and ``n_notices`` (0); a text without letters or
    digits matches nothing. If several known licences share a digest, the first name is taken. Repeated rows
    give repeated results. Columns other than ``doc_id, text`` are not looked at.
    """
    spark = docs.sparkSession
    rows = known_digests(known) + (list(LONG_TEXTS) if known is KNOWN else [])
    first: dict[str, str] = {}
    for digest, name in rows:
        if digest != hashlib.sha256(b"").hexdigest():
            first.setdefault(digest, name)
    names = spark.createDataFrame(list(first.items()), "known STRING, license STRING")
    names, _ = small_side(names)

    key = F.xxhash64("doc_id", "text").alias("key")
    lines = F.transform(F.split("text", "\n"), canonical_line)
    base = docs.select("doc_id", key, lines.alias("lines"))
    whole = F.array_join(F.filter("lines", lambda x: x != ""), " ")
    for old, new in WRAPPED:
        whole = F.replace(whole, F.lit(old), F.lit(new))
    whole = F.sha2(whole, 256)
    whole_rows = base.select("doc_id", "key", whole.alias("digest")).join(
        names, F.col("digest") == F.col("known"), "left"
    ).drop("known")
    units = F.explode(F.filter("lines", lambda x: x != ""))
    found = (
        base.where(F.size("lines") > 1).select("key", units.alias("line"))
        .select("key", F.sha2("line", 256).alias("known")).join(names, "known")
        .groupBy("key").agg(F.count(F.lit(1)).alias("found"), F.collect_set("license").alias("names"))
    )
    copies = whole_rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    found = found.join(copies, "key").select(
        "key", (F.col("found") / F.col("copies")).cast("long").alias("found"), "names"
    )
    return whole_rows.join(found, "key", "left").select(
        "doc_id", "digest", "license", F.coalesce("found", F.lit(0).cast("long")).alias("n_notices"),
        F.when(F.col("digest").isNotNull(), F.coalesce(F.array_join(F.sort_array("names"), ","), F.lit(""))).alias("notices"),
    )
