"""Licence scan by canonical digests.

A text is brought to a canonical form (case, copyright lines, punctuation, equivalent spellings, white space), and the
digests of the whole text and of each of its lines are looked up among the digests of known licence texts and notices.
Everything is a DataFrame expression; only hits and one narrow row per document are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import lower_ascii, small_side
from .license_digests import DIGESTS

# Spellings that count as equal, after punctuation is gone.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("favour", "favor"), ("honour", "honor"),
    ("judgement", "judgment"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("whilst", "while"),
    ("wilful", "willful"), ("copyright owner", "copyright holder"), ("https", "http"),
)

# Public licence texts and usual notices, (id, text).
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_SUBJECT = "subject to the following conditions: "
TEXTS = (
    ("MIT", "MIT License\n" + _MIT_GRANT + _SUBJECT + _MIT_NOTICE + _MIT_WARRANTY),
    ("MIT", _MIT_GRANT + _SUBJECT + _MIT_NOTICE + _MIT_WARRANTY),
    ("MIT-0", "MIT No Attribution\n" + _MIT_GRANT.removesuffix(", ") + ". " + _MIT_WARRANTY),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ". " + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_THIRD + _BSD_WARRANTY),
    *NOTICES,
)

# Names of licences in notices, and the notices; only whole lines or texts count.
NAMES = {
    "MIT": ("the MIT License",), "ISC": ("the ISC License",), "Zlib": ("the zlib License",), "BSL-1.0": ("the Boost Software License, Version 1.0", "the Boost Software License 1.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License",), "BSD-3-Clause": ("the BSD 3-Clause License",), "Unlicense": ("the Unlicense",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0"),
    "EPL-2.0": ("the Eclipse Public License, Version 2.0", "the Eclipse Public License 2.0", "the EPL 2.0"),
    **{f"{short}-{v}": tuple(x for long in (f"the GNU {name}", f"the GNU {short}", f"the {short}") for x in (f"{long}, version {plain}", f"{long} v{plain}", f"{long}v{plain}"))
       for short, name, versions in (("GPL", "General Public License", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",)))
       for v in versions for plain in [v.removesuffix(".0")]},
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal"),
    **{f"CC-{short}-{v}": (f"CC {short} {v}", f"a Creative Commons {name} {v} International License", f"the Creative Commons {name} {v} International License")
       for short, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                           ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("4.0",)},
}
PHRASES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.")
USUAL_NOTICES = (
    *((name, p.format(x)) for name, called in NAMES.items() for x in called for p in PHRASES),
    *((name, f"SPDX-License-Identifier: {name}{end}") for name in NAMES for end in (("", "-only", "-or-later") if "GPL" in name else ("",))),
)

# a line that names who holds the rights, with a sign, a year or a place for it
COPYRIGHT_LINE = r"(?md)^[^\p{L}\p{N}\n]*(copyright[^\p{L}\p{N}\n]*(c\)|©|[0-9<\[])|©|\(c\)|all rights reserved)[^\n]*$"


def canonical_text(text: Column) -> Column:
    """Lower case, no copyright lines, words with single spaces, usual spellings; line ends stay."""
    plain = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}\n]+", " ")
    for other, usual in SPELLINGS:
        plain = F.replace(plain, F.lit(other), F.lit(usual))
    return plain


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " *\n[ \n]*", " "))


def known_digests(spark, texts: Sequence[tuple[str, str]] = (*TEXTS, *USUAL_NOTICES), digests: Sequence[tuple[str, str]] = DIGESTS) -> DataFrame:
    """``digest, license``: one row per known text; texts that become equal keep the first id, and ``texts`` come before ``digests``."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "place int, license string, text string")
    known = rows.select("place", "license", F.sha2(_one_line(canonical_text(F.col("text"))), 256).alias("digest"))
    ready = spark.createDataFrame([(len(texts) + i, *d) for i, d in enumerate(digests)], "place int, license string, digest string")
    return known.unionByName(ready).groupBy("digest").agg(F.min_by("license", "place").alias("license"))


def scan_licenses(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Per document row: ``doc_id, digest`` of the whole text, its ``license`` if it is a known text as a whole,
    ``notices`` (sorted ids of the lines that are known texts), ``n_notice_lines`` and ``has_license``.

    Null and empty texts have the digest of the empty text, no licence and no notice; repeated rows give a row each; a
    null doc_id is kept; an empty ``known`` finds nothing; other columns are ignored. Lines end with a line feed.
    """
    forms = documents.select("doc_id", canonical_text(F.col("text")).alias("form"))
    keyed = forms.select("doc_id", F.sha2(_one_line(F.col("form")), 256).alias("whole"), F.split("form", "\n").alias("lines"))
    # place 0 is the whole text, the others are its lines; a text of one line is not looked up twice
    lines = F.when(F.size("lines") > 1, F.col("lines")).otherwise(F.array().cast("array<string>"))
    units = keyed.select("doc_id", "whole", F.posexplode(F.concat(F.array(F.lit("")), lines)).alias("place", "line"))
    units = units.select("doc_id", "whole", "place", F.when(F.col("place") == 0, F.col("whole")).otherwise(F.sha2(F.trim("line"), 256)).alias("digest"))
    found = units.join(small_side(cut_lineage(known)), "digest", "left").where((F.col("place") == 0) | F.col("license").isNotNull())
    is_whole = F.col("place") == 0
    per_text = found.groupBy("doc_id", "whole").agg(
        F.sum(is_whole.cast("long")).alias("_rows"), F.max(F.when(is_whole, F.col("license"))).alias("license"),
        F.array_sort(F.collect_set(F.when(~is_whole, F.col("license")))).alias("notices"), F.sum((~is_whole).cast("long")).alias("_lines"))
    # rows with the same doc_id and canonical text meet in a group and have the same result
    each = per_text.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return each.select("doc_id", F.col("whole").alias("digest"), "license", "notices", (F.col("_lines") / F.col("_rows")).cast("long").alias("n_notice_lines"),
                       (F.col("license").isNotNull() | (F.size("notices") > 0)).alias("has_license"))
