"""License scan by sentence rules. DataFrame functions only.

A text is cut at line ends and after . ; : ! ? before white space.  Known licence
sentences are looked for in its normalised form (lower case, letters and digits only,
single spaces), each from a cut to a cut; within one, a single line end and the cut after
"v." or "Identifier:" count as a space, so wrapped sentences are found, with or without
comment signs before their lines, but blank lines and sentence ends do not.  Where
several start at one place the longest is taken; those of one normalised form have one
identifier, the last, in results and rules.  The identifiers of those that are known, in
order, are matched against ordered licence rules.  A rule matches where its
identifiers follow one another among the known ones; longer rules win over rules they
contain, and of equally long ones the one of smaller identifiers goes first.

Known are the notices that stand in files and the sentences of the short licences in
full (MIT, BSD, ISC, zlib, Unlicense, Boost), the headings of the long ones (Apache, GPL,
LGPL, AGPL, MPL, EPL), Creative Commons notices, SPDX tags and short statements such as
"Released under the MIT License.".

Scale: one narrow scan, no shuffle.  Only texts that hold one of the words every
known sentence has at least one of are cut up; the tables are fixed and small.

Defined cases: null, empty and blank text have no sentence and no licence; a very long
text is scanned as a whole; sentences repeated in a text count each; repeated rows are
scanned alike; an empty table gives an empty result; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences of licences and notices, by identifier.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "You may not use this file except in compliance with the License.",
    3: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    4: "Licensed under the Apache License, Version 2.0 (the License);",
    5: "You may obtain a copy of the License at",
    6: "http://www.apache.org/licenses/LICENSE-2.0",
    7: "https://www.apache.org/licenses/LICENSE-2.0",
    8: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    9: "See the License for the specific language governing permissions and limitations under the License.",
    10: "Released under the MIT License.",
    11: "The MIT License (MIT)",
    12: "MIT License",
    13: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    14: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    15: "Licensed under the MIT License.",
    16: "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    17: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    18: "Apache License",
    19: "Version 2.0, January 2004",
    20: "This work is licensed under the GNU General Public License, version 3.",
    21: "This program is free software:",
    22: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    23: "You should have received a copy of the GNU General Public License along with this program.",
    24: "This program is free software;",
    25: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    26: "either version 2 of the License, or (at your option) any later version.",
    27: "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    30: "Licensed under CC BY 4.0.",
    31: "Licensed under CC BY-SA 4.0.",
    32: "Licensed under CC BY-NC 4.0.",
    33: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    34: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    35: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    36: "This work is dedicated to the public domain under CC0 1.0 Universal.",
    37: "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    40: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    41: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    42: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    43: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    44: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    45: "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    46: "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;",
    47: "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    48: "BSD 2-Clause License",
    49: "BSD 3-Clause License",
    50: "All rights reserved.",
    51: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    52: "Unauthorized copying of this file, via any medium is strictly prohibited.",
    53: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    54: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    55: "Mozilla Public License Version 2.0",
    60: "ISC License",
    61: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    62: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    63: "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    64: "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    65: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    70: "This library is free software:",
    71: "This library is free software;",
    72: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    73: "either version 2.1 of the License, or (at your option) any later version.",
    74: "either version 3 of the License, or (at your option) any later version.",
    75: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    76: "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    77: "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    78: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    79: "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    80: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    81: "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    82: "See the GNU General Public License for more details.",
    83: "See the GNU Lesser General Public License for more details.",
    84: "See the GNU Affero General Public License for more details.",
    85: "You should have received a copy of the GNU Lesser General Public License along with this library;",
    86: "You should have received a copy of the GNU Affero General Public License along with this program.",
    87: "GNU GENERAL PUBLIC LICENSE",
    88: "GNU LESSER GENERAL PUBLIC LICENSE",
    89: "GNU AFFERO GENERAL PUBLIC LICENSE",
    90: "Version 2, June 1991",
    91: "Version 2.1, February 1999",
    92: "Version 3, 29 June 2007",
    93: "Version 3, 19 November 2007",
    94: "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    95: "You should have received a copy of the GNU Lesser General Public License along with this program.",
    100: "This is free and unencumbered software released into the public domain.",
    101: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    110: "This software is provided as-is, without any express or implied warranty.",
    111: "In no event will the authors be held liable for any damages arising from the use of this software.",
    112: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    113: "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    114: "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    115: "This notice may not be removed or altered from any source distribution.",
    120: "Boost Software License - Version 1.0 - August 17th, 2003",
    121: "Distributed under the Boost Software License, Version 1.0.",
    122: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    130: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    131: "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    132: "Eclipse Public License - v 2.0",
}
# Licence rules, as the identifiers that follow one another, with the licence's SPDX name.
RULES = [
    ((1,), "Apache-2.0"),
    ((4,), "Apache-2.0"),
    ((4, 2), "Apache-2.0"),
    ((4, 2, 3), "Apache-2.0"),
    ((4, 2, 5, 6), "Apache-2.0"),
    ((4, 2, 5, 7), "Apache-2.0"),
    ((4, 2, 3, 8, 9), "Apache-2.0"),
    ((4, 2, 5, 6, 8, 9), "Apache-2.0"),
    ((4, 2, 5, 7, 8, 9), "Apache-2.0"),
    ((18, 19), "Apache-2.0"),
    ((18, 19, 27), "Apache-2.0"),
    ((10,), "MIT"),
    ((15,), "MIT"),
    ((13,), "MIT"),
    ((13, 14), "MIT"),
    ((12, 13, 14), "MIT"),
    ((11, 13, 14), "MIT"),
    ((13, 14, 16, 17), "MIT"),
    ((12, 13, 14, 16, 17), "MIT"),
    ((11, 13, 14, 16, 17), "MIT"),
    ((20,), "GPL-3.0"),
    ((21, 22), "GPL-3.0-or-later"),
    ((21, 22, 23), "GPL-3.0-or-later"),
    ((21, 22, 80, 81, 82), "GPL-3.0-or-later"),
    ((21, 22, 80, 81, 82, 23), "GPL-3.0-or-later"),
    ((21, 78), "GPL-3.0-only"),
    ((24, 25, 26), "GPL-2.0-or-later"),
    ((24, 25, 26, 80, 81, 82, 23), "GPL-2.0-or-later"),
    ((24, 25, 74), "GPL-3.0-or-later"),
    ((24, 77), "GPL-2.0-only"),
    ((87, 92), "GPL-3.0"),
    ((87, 90), "GPL-2.0"),
    ((87, 92, 94), "GPL-3.0"),
    ((87, 90, 94), "GPL-2.0"),
    ((71, 72, 73), "LGPL-2.1-or-later"),
    ((71, 72, 73, 79, 81, 83, 85), "LGPL-2.1-or-later"),
    ((71, 72, 74), "LGPL-3.0-or-later"),
    ((70, 75), "LGPL-3.0-or-later"),
    ((21, 75), "LGPL-3.0-or-later"),
    ((88, 91), "LGPL-2.1"),
    ((88, 92), "LGPL-3.0"),
    ((21, 76), "AGPL-3.0-or-later"),
    ((21, 76, 80, 81, 84, 86), "AGPL-3.0-or-later"),
    ((89, 93), "AGPL-3.0"),
    ((36,), "CC0-1.0"),
    ((37,), "CC0-1.0"),
    ((40, 41, 42), "BSD-2-Clause"),
    ((48, 40, 41, 42), "BSD-2-Clause"),
    ((40, 41, 42, 45, 46), "BSD-2-Clause"),
    ((40, 41, 42, 43), "BSD-3-Clause"),
    ((49, 40, 41, 42, 43), "BSD-3-Clause"),
    ((40, 41, 42, 44, 43), "BSD-4-Clause"),
    ((50,), "all-rights-reserved"),
    ((51,), "MPL-2.0"),
    ((51, 53), "MPL-2.0"),
    ((51, 54), "MPL-2.0"),
    ((55,), "MPL-2.0"),
    ((52,), "proprietary"),
    ((61,), "ISC"),
    ((62,), "ISC"),
    ((60, 61), "ISC"),
    ((60, 62), "ISC"),
    ((61, 63, 64), "ISC"),
    ((65,), "0BSD"),
    ((100,), "Unlicense"),
    ((100, 101), "Unlicense"),
    ((110, 111, 112), "Zlib"),
    ((112,), "Zlib"),
    ((120,), "BSL-1.0"),
    ((121,), "BSL-1.0"),
    ((122,), "BSL-1.0"),
    ((130,), "EPL-2.0"),
    ((131,), "EPL-1.0"),
    ((132,), "EPL-2.0"),
]
# Creative Commons licences, names of licences in short statements, and SPDX names in tags.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
COMMONS_VERSIONS = {"4.0": "4.0 International", "3.0": "3.0 Unported"}
NAMED = {
    "MIT": "MIT License",
    "Apache-2.0": "Apache License 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "GPL-2.0": "GNU General Public License v2.0",
    "GPL-3.0": "GNU General Public License v3.0",
    "LGPL-2.1": "GNU Lesser General Public License v2.1",
    "LGPL-3.0": "GNU Lesser General Public License v3.0",
    "AGPL-3.0": "GNU Affero General Public License v3.0",
    "MPL-2.0": "Mozilla Public License 2.0",
    "ISC": "ISC License",
}
TAGS = "0BSD AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 EPL-1.0 EPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
STATEMENTS = "Licensed Released Distributed".split()


def plain(sentence: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", sentence.lower()))


def _made() -> None:
    """Sentences that follow a rule, each a licence rule of its own; those known already keep their identifiers."""
    known = {plain(s): i for i, s in SENTENCES.items()}

    def add(i: int, sentence: str, name: str) -> None:
        i = known.setdefault(plain(sentence), i)
        SENTENCES.setdefault(i, sentence)
        if ((i,), name) not in RULES:
            RULES.append(((i,), name))

    for a, (code, name) in enumerate(COMMONS.items()):
        for b, (version, long) in enumerate(COMMONS_VERSIONS.items()):
            spdx = f"CC-{code}-{version}"
            add(200 + 10 * a + 4 * b, f"Licensed under CC {code} {version}.", spdx)
            for c, article in enumerate(("a", "the")):
                add(201 + 10 * a + 4 * b + c, f"This work is licensed under {article} Creative Commons {name} {long} License.", spdx)
    for a, (spdx, name) in enumerate(NAMED.items()):
        for b, verb in enumerate(STATEMENTS):
            add(300 + 10 * a + b, f"{verb} under the {name}.", spdx)
        add(300 + 10 * a + 8, f"This project is licensed under the {name}.", spdx)
    for a, spdx in enumerate(TAGS):
        add(500 + a, f"SPDX-License-Identifier: {spdx}", spdx)


_made()
#: Every normalised known sentence has one of these words; checked in the tests.
WORDS = ("licen", "copyright", "copy", "rights", "permission", "redistribut", "software", "domain", "altered", "warrant", "version", "terms and conditions", "advertising materials", "business interruption")
#: Sentence ends, and the cuts after an abbreviation and a tag, which may stand within a sentence.
END, SHORT = r"(?<=[.;:!?])(?<!\b[vV]\.)(?<!Identifier:)[\x20\x09-\x0D]+", r"(?<=\b[vV]\.|Identifier:)[\x20\x09-\x0D]+"
OTHER = r"[^\p{L}\p{N}\n]+"


def _plain(c: Column) -> Column:
    """Normalised text: a line feed for a cut that a sentence may run across, two or more for one that it may not."""
    cut = F.regexp_replace(F.regexp_replace(c, END, "\n\n"), SHORT, "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(cut), OTHER, " "), " ?\n ?", "\n"), F.lit(" "))


def known_sentences() -> dict[str, int]:
    """Normalised form and identifier."""
    return {plain(s): i for i, s in SENTENCES.items()}


def ordered_rules() -> list[tuple[str, str]]:
    """(identifiers that follow one another, as signs; name), longer rules first."""
    known = known_sentences()
    rules = sorted((tuple(known[plain(SENTENCES[i])] for i in ids), name) for ids, name in RULES)
    return [("".join(f"|{i}|" for i in ids), name) for ids, name in sorted(rules, key=lambda r: (-len(r[0]), r[0]))]


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences (known ones), sentence_ids (in order, joined by commas), licenses (sorted names, joined by commas)."""
    known = known_sentences()
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    likely = F.col("text").rlike("(?i)" + "|".join(WORDS))
    any_of = "|".join(s.replace(" ", r"[ \n]") for s in sorted(known, key=len, reverse=True))
    whole = rf"(?<![^\n])(?:{any_of})(?![^\n])"
    found = F.transform(F.regexp_extract_all(_plain(F.col("text")), F.lit(whole), F.lit(0)), lambda s: F.try_element_at(table, F.translate(s, "\n", " ")))
    ids = F.when(likely, found).otherwise(F.array().cast("array<int>"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
    trail = F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|"))
    # a longer rule takes its trail away from the rules that it contains
    rules = F.array(*(F.struct(F.lit(sign).alias("sign"), F.lit(name).alias("name")) for sign, name in ordered_rules()))
    none = F.array().cast("array<string>")

    def step(state: Column, rule: Column) -> Column:
        names = F.when(state["rest"].contains(rule["sign"]), F.array_append(state["names"], rule["name"])).otherwise(state["names"])
        many = rule["sign"].contains("||")
        return F.struct(F.when(many, F.replace(state["rest"], rule["sign"], F.lit("|0|"))).otherwise(state["rest"]).alias("rest"), names.alias("names"))

    names = F.aggregate(rules, F.struct(trail.alias("rest"), none.alias("names")), step, lambda state: state["names"])
    held = rows.withColumn("names", F.when(F.size("ids") > 0, F.array_sort(F.array_distinct(names))).otherwise(none))
    return held.select("doc_id", F.size("ids").cast("bigint").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join("names", ",").alias("licenses"))
