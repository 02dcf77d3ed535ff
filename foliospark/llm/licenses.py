"""Licence scan by canonical digest: whole texts against known licence texts.

A text is brought to a canonical form in which copies of a licence agree whatever their case, punctuation, wrapping,
copyright holders and spelling; its SHA-256 is then looked up among those of known licences. All of it is SQL
expressions, so the scan is a projection and one hash join with a small table.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Spellings that licence matching guidelines hold to be equivalent, as one form.
EQUIVALENTS = (("licence", "license"), ("licenced", "licensed"), ("licencing", "licensing"), ("organisation", "organization"), ("authorised", "authorized"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("behaviour", "behavior"), ("centre", "center"), ("programme", "program"), ("fulfil", "fulfill"), ("judgement", "judgment"), ("noncommercial", "non commercial"), ("sublicence", "sublicense"), ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("http", "https"))

#: Short public licence texts and standard notices, by SPDX name.
KNOWN: dict[str, tuple[str, ...]] = {
    "MIT": (
        'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "Released under the MIT License.",
    ),
    "ISC": ('ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',),
    "0BSD": ('BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',),
    "BSD-2-Clause": ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License, Version 2.0.",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",),
}

_GRANT = "{program} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.\n\n{program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details.\n\nYou should have received a copy of the GNU {name} General Public License along with this {short}. If not, see <https://www.gnu.org/licenses/>."


def _gnu(name: str, version: str, program: str = "This program", short: str = "program") -> tuple[str, str]:
    """The notice of a GNU licence, and a line that names it."""
    full = _GRANT.format(name=name, version=version, program=program, short=short, stop=":", comma=",").replace("GNU  ", "GNU ")
    return full, f"This work is licensed under the GNU {name} General Public License, version {version}.".replace("GNU  ", "GNU ")


def _creative(name: str, title: str) -> tuple[str, ...]:
    """Usual notices of a Creative Commons licence, version 4.0."""
    return (
        f"This work is licensed under a Creative Commons {title} 4.0 International License.",
        f"This work is licensed under the Creative Commons {title} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{name}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        f"Licensed under CC {name.upper()} 4.0.",
    )


KNOWN["GPL-2.0"] = _gnu("", "2")
KNOWN["GPL-3.0"] = tuple(dict.fromkeys((*KNOWN["GPL-3.0"], *_gnu("", "3"))))
KNOWN["LGPL-2.1"] = _gnu("Lesser", "2.1", "This library", "library")
KNOWN["LGPL-3.0"] = _gnu("Lesser", "3")
KNOWN["AGPL-3.0"] = _gnu("Affero", "3")
KNOWN["MPL-2.0"] = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",)
KNOWN["BSD-3-Clause"] = (KNOWN["BSD-2-Clause"][0].replace("THIS SOFTWARE IS PROVIDED", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED", 1),)
KNOWN["Unlicense"] = ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",)
KNOWN["CC0-1.0"] = ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",)
for _name, _title in {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}.items():
    KNOWN[f"CC-{_name.upper()}-4.0"] = _creative(_name, _title)

#: A line that names a copyright holder; such lines differ between copies of one licence.
COPYRIGHT_LINE = r"(?i)(^|\n)[^\n0-9A-Za-z]*(copyright|\(c\)|©)([^\n]*(\(c\)|©|[0-9]{4})|[ \t]+by )[^\n]*"
RESERVED_LINE = r"(?i)(^|\n)[^\n0-9A-Za-z]*all rights reserved[^\n]*"
NOT_WORD = r"[^0-9A-Za-z\x80-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """The canonical form; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(out, RESERVED_LINE, "\n")
    # A-Z alone, so that the form doesn't hang on a runtime's Unicode tables.
    out = F.translate(out, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.concat(F.lit(" "), F.regexp_replace(out, NOT_WORD, " "), F.lit(" "))
    for a, b in EQUIVALENTS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def known_digests(spark: SparkSession, known: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(digest, license): fixed-size table of the known texts' digests."""
    rows = [(name, text) for name, texts in (known or KNOWN).items() for text in texts]
    return spark.createDataFrame(rows, "license string, known string").select(F.sha2(canonical(F.col("known")), 256).alias("license_digest"), "license").groupBy("license_digest").agg(F.min("license").alias("license"))


def digests_of(texts: DataFrame) -> DataFrame:
    """(license_digest, license) of a table (license, text) of licence texts, such as a whole public list; the least
    name of equal texts. Null and empty texts are left out."""
    rows = texts.select("license", canonical(F.col("text")).alias("form")).filter("form <> ''")
    return rows.groupBy(F.sha2("form", 256).alias("license_digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, id_col="doc_id", text_col="text", known: dict[str, tuple[str, ...]] | None = None, digests: DataFrame | None = None) -> DataFrame:
    """Digest and licence (null: none) of every document.

    ``digests`` is a table as digests_of() makes it, of any size; else the texts of ``known``, or KNOWN, are looked up.
    Null and empty texts have the digest of the empty form, which is no licence. Repeated rows give a row each.
    """
    forms = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(canonical(F.col(text_col)), 256).alias("license_digest"))
    table = digests if digests is not None else known_digests(docs.sparkSession, known)
    return forms.join(common.bounded_broadcast(table, 100_000), "license_digest", "left").select("doc_id", "license_digest", "license")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    nl = "chr(10)"
    out = f"regexp_replace(coalesce({text}, ''), {q(COPYRIGHT_LINE)}, {nl}, 'g')"
    out = f"regexp_replace({out}, {q(RESERVED_LINE)}, {nl}, 'g')"
    out = f"translate({out}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"' ' || regexp_replace({out}, {q(NOT_WORD)}, ' ', 'g') || ' '"
    out = functools.reduce(lambda s, e: f"replace({s}, {q(f' {e[0]} ')}, {q(f' {e[1]} ')})", EQUIVALENTS, out)
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in KNOWN.items() for text in texts)
    return f"""
with k as (select sha256({_sql_canonical("t")}) as license_digest, min(n) as license from (values {values}) v(n, t) group by 1),
d as (select doc_id, sha256({_sql_canonical("text")}) as license_digest from documents)
select d.doc_id, d.license_digest, k.license from d left join k on d.license_digest = k.license_digest
"""


QUERIES = {"op3_licenses": op3_licenses}
ORACLE = {"op3_licenses": _oracle()}
