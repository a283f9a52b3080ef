"""Licence scan by canonical digest lookup (DataFrame functions only).

A whole text is normalised (ASCII case, copyright lines, equivalent spellings, punctuation), hashed
and hash-joined to the digests of known licence texts; each line is looked up likewise among known
one-line notices. The digest table is built in and therefore of a fixed size, so it is broadcast.

Null or empty texts, and texts with no ASCII letter or digit, get the digest of the empty string and
no licence. Repeated rows give repeated rows. An empty table gives an empty result. Only ``doc_id``
and ``text`` are read, so further columns never clash.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that licence matching treats as equal.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non-infringement"),
    ("favour", "favor"),
    ("https://", "http://"),
    ("owner", "holder"),
]
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|all rights reserved)[^\n]*"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so"
)


def _gnu(name: str, where: str, version: str, later: bool) -> str:
    """The notice that a file under a GNU licence of version 2 or 3 carries."""
    what = f"the terms of the GNU {name} as published by the Free Software Foundation"
    terms = f"{what}, either version {version} of the License, or (at your option) any later version." if later else f"{what}, version {version}."
    return (
        f"This program is free software: you can redistribute it and/or modify it under {terms}\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.\n"
        f"You should have received a copy of the GNU {name} along with this program. If not, see {where}."
    )


#: Whole licence texts, and notices of files where the licence itself is longer.
LICENSES = {
    "MIT": _MIT_GRANT + ", subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n" + _WARRANTY,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL,
    "ISC": _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL,
    "0BSD": _ISC_GRANT + ".\n" + _ISC_TAIL,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for "
    "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
    "restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
    "is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
    "original software.\n3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless "
    "required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License.",
}
LICENSES |= {
    "MIT-0": _MIT_GRANT + ".\n" + _WARRANTY,
    "X11": _MIT_GRANT + ", subject to the following conditions:\nThe above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software.\n" + _WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM")
    + "\nExcept as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote "
    "the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this "
    "software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit "
    "of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
    + _WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + "\nFor more information, please refer to <https://unlicense.org/>",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\nPermission is hereby granted, free of charge, to any person or "
    'organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, '
    "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
    "permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the "
    "Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
    "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
    "derivative works are solely in the form of machine-executable object code generated by a source language processor.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR "
    "ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\nCopyright (C) 2004 Sam Hocevar\nEveryone is permitted to "
    "copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is "
    "changed.\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n"
    "0. You just DO WHAT THE FUCK YOU WANT TO.",
    "FSFAP": "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided "
    "the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0-or-later-header": _gnu("General Public License", "<https://www.gnu.org/licenses/>", "2", True),
    "GPL-3.0-or-later-header": _gnu("General Public License", "<https://www.gnu.org/licenses/>", "3", True),
    "GPL-3.0-only-header": _gnu("General Public License", "<https://www.gnu.org/licenses/>", "3", False),
    "AGPL-3.0-or-later-header": _gnu("Affero General Public License", "<https://www.gnu.org/licenses/>", "3", True),
    "LGPL-3.0-or-later-header": _gnu("Lesser General Public License", "<https://www.gnu.org/licenses/>", "3", True),
}
LICENSES |= {f"{k}-titled": f"{t}\n{LICENSES[k]}" for k, t in {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License"}.items()}
#: One-line notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC0-1.0": "Released under CC0 1.0.",
}
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: str) -> str:
    """Driver-side twin of ``canonical_column``, for the built-in texts."""
    t = text.translate(str.maketrans(UPPER, LOWERED))
    t = re.sub(COPYRIGHT_LINE, "\n", t)
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return re.sub(r"[^a-z0-9]+", " ", t).strip(" ")


def canonical_column(text: Column, copyright_lines: bool = True) -> Column:
    t = F.translate(text, UPPER, LOWERED)
    if copyright_lines:
        t = F.regexp_replace(t, COPYRIGHT_LINE, "\n")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, digest, license_id (null: none), notices (ids of the notice lines found, sorted, comma-joined).

    One narrow stage: the licence side has a fixed number of rows and is broadcast.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(digest(t), k.removesuffix("-titled")) for k, t in LICENSES.items()], "digest string, license_id string")
    text = F.coalesce(F.col("text"), F.lit(""))
    notice = F.create_map(*[F.lit(x) for k, t in NOTICES.items() for x in (canonical(t), k)])
    # regexp_like is a plain scan; only lines with a licence word are normalised
    lines = F.filter(F.split(F.translate(text, UPPER, LOWERED), "\n"), lambda x: x.contains("licens") | x.contains("licenc") | x.contains("released"))
    found = F.transform(lines, lambda x: F.try_element_at(notice, canonical_column(x, copyright_lines=False)))
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.sha2(canonical_column(text), 256).alias("digest"),
            F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",").alias("notices"),
        )
        .join(F.broadcast(known), "digest", "left")
        .select("doc_id", "digest", "license_id", "notices")
    )


def oracle() -> str:
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canon(t: str, lines: bool) -> str:
        e = f"translate({t}, '{UPPER}', '{LOWERED}')"
        if lines:
            e = f"regexp_replace({e}, {q(COPYRIGHT_LINE)}, chr(10), 'g')"
        for a, b in SPELLINGS:
            e = f"replace({e}, {q(a)}, {q(b)})"
        return f"trim(regexp_replace({e}, '[^a-z0-9]+', ' ', 'g'), ' ')"

    known = ", ".join(f"({q(digest(t))}, {q(k.removesuffix('-titled'))})" for k, t in LICENSES.items())
    notices = ", ".join(f"({q(canonical(t))}, {q(k)})" for k, t in NOTICES.items())
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWERED}')"
    return f"""
WITH known(digest, license_id) AS (VALUES {known}), notice(line, notice_id) AS (VALUES {notices}),
d AS (SELECT doc_id, sha256({canon("coalesce(text, '')", True)}) AS digest, row_number() OVER () AS rn, {low} AS low FROM documents),
l AS (SELECT rn, unnest(string_split(low, chr(10))) AS line FROM d),
f AS (SELECT DISTINCT l.rn, notice_id FROM (SELECT rn, {canon("line", False)} AS line FROM l
      WHERE line LIKE '%licens%' OR line LIKE '%licenc%' OR line LIKE '%released%') l JOIN notice USING (line)),
g AS (SELECT rn, string_agg(notice_id, ',' ORDER BY notice_id) AS notices FROM f GROUP BY rn)
SELECT d.doc_id, d.digest, known.license_id, coalesce(g.notices, '') AS notices
FROM d LEFT JOIN known USING (digest) LEFT JOIN g ON g.rn = d.rn"""
