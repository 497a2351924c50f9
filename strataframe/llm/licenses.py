"""License scans by conditional compression, confirmed by exact wording differences.

A candidate block is a stretch of words, across line breaks, where some
template can be at all: it has a word without which more of the template's
words are missing than the tolerance allows, and enough of the others around
it. Nothing is aligned to form it. Each block is compressed alone and with
every template as zstandard raw dictionary, and the templates are ranked by the
bytes saved. The winners - those near the greatest saving - are confirmed by
their exact wording differences (words inserted, deleted or replaced): the
stretches with the fewest stay. Where no winner is confirmed, the next in rank
are tried, as long as the block has words enough for one; what a block has
left between hits is a block again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.llm.rowwise import append_columns

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."

#: Texts of short public licenses, the headers that the long ones ask for, and the usual one-line notices.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "AGPL-3.0-header": _GNU.format("Affero ", "3"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": f"{_BSD_START} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD_START} {_BSD_NAMES} {_BSD_END}",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": _GNU.format("", "2"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _GNU.format("", "3"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": _GNU.format("Lesser ", "3"),
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MIT-text": f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "all-rights-reserved": "All rights reserved.",
}

#: Templates whose saving is at least this share of the greatest one are winners.
WINNERS = 0.9

HIT = T.StructType([
    T.StructField("line", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("reduction", T.DoubleType()),
    T.StructField("different_words", T.IntegerType()), T.StructField("missing_words", T.IntegerType()),
])
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def stretches(block: list[str], template: list[str], limit: int) -> list[tuple[int, int, int]]:
    """(differences, start, end) of the best stretch of the block at every end, if it has ``limit`` differences or fewer.

    A difference is a word of the template not in place, or a word of the
    stretch that is not the template's. Of equal ones the longest is taken, which has the most words in place.
    """
    m, k = len(template), len(block) + 1
    out, old = [], [i * k for i in range(m + 1)]  # differences * k + start
    for end, word in enumerate(block, 1):
        new = [end]
        for i, w in enumerate(template):
            best = min(new[i], old[i + 1]) + k
            new.append(min(best, old[i]) if w == word else best)
        if new[m] < (limit + 1) * k and new[m] < old[m] + k:  # else the word adds nothing
            cost, start = divmod(new[m], k)
            if start < end:
                out.append((cost, start, end))
        old = new
    return out


def _blocks(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Parts that overlap, together."""
    out, end = [], -1
    for part in parts:
        if part[0] >= end:
            out.append([])
        out[-1].append(part)
        end = max(end, part[1])
    return out


def _beside(taken: list[tuple[int, int]], a: int) -> list[tuple[int, int]]:
    """The stretches before and after a place; ``taken`` is sorted and without overlaps."""
    at = bisect_left(taken, (a, a))
    return taken[max(0, at - 1) : at + 1]


def split_differences(cost: int, length: int, m: int) -> tuple[int, int]:
    """(missing, other) words of a stretch of ``length`` words against a template of ``m``."""
    return (cost + m - length) // 2, (cost + length - m) // 2


def differences(block: list[str], template: list[str]) -> tuple[int, int]:
    """(words of the template not in place, words of the block inside the aligned stretch that are not the template's)."""
    cost, start, end = min(stretches(block, template, len(template)), default=(len(template), 0, 0))
    return split_differences(cost, end - start, len(template))


class Template:
    def __init__(self, name: str, text: str, tolerance: float):
        self.name, self.words = name, words(text)
        self.limit = int(tolerance * len(self.words))
        self.reach = len(self.words) + self.limit  # no stretch within the limit is longer
        self.counts = Counter(self.words)
        known = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=3)
        self.packed = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=known)
        # without any of these words more than ``limit`` are missing; long words and numbers are the rare ones
        self.seeds, left = [], self.limit + 1
        for w in sorted(self.counts, key=lambda w: (-len(w) - 8 * w[0].isdigit(), w)):
            if left > 0:
                self.seeds.append(w)
                left -= self.counts[w]


class Scanner:
    """Blocks are formed, compressed with every template, and the templates confirmed in order of what they save."""

    def __init__(self, templates: dict[str, str], tolerance: float):
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.templates = [Template(name, text, tolerance) for name, text in sorted(templates.items())]
        self.seeds: dict[str, list[int]] = {}
        for k, t in enumerate(self.templates):
            for w in t.seeds:
                self.seeds.setdefault(w, []).append(k)

    def saved(self, raw: bytes, k: int, alone: int) -> int:
        """Bytes that the template as dictionary saves of a compressed block, which takes ``alone`` without it."""
        return alone - len(self.templates[k].packed.compress(raw))

    def regions(self, own: list[str], low: int, high: int) -> list[tuple[int, int, int]]:
        """(start, end, template) of the parts of own[low:high] that have words enough for a template, in order."""
        at: dict[int, list[int]] = {}
        for p in range(low, high):
            for k in self.seeds.get(own[p], ()):
                at.setdefault(k, []).append(p)
        out = []
        for k, places in at.items():
            t, parts = self.templates[k], []
            for p in places:  # a stretch with this word is inside
                a, b = max(low, p - t.reach + 1), min(high, p + t.reach)
                if parts and a <= parts[-1][1]:
                    parts[-1][1] = b
                else:
                    parts.append([a, b])
            for a, b in parts:
                have = Counter(own[a:b])
                if sum(min(c, have[w]) for w, c in t.counts.items()) >= len(t.words) - t.limit:
                    out.append((a, b, k))
        return sorted(out)

    def ranked(self, raw: bytes) -> list[tuple[int, int]]:
        """(bytes saved, template) of every template, the greatest saving first."""
        alone = len(self.plain.compress(raw))
        return sorted(((self.saved(raw, k, alone), k) for k in range(len(self.templates))), key=lambda x: (-x[0], x[1]))

    def confirmed(self, own: list[str], ranking: list[tuple[int, int]], parts: list[tuple[int, int, int]]) -> list[tuple]:
        """The stretches of the first winners that are confirmed, those with the fewest differences: (differences, -words, name, start, end, template)."""
        order = [(less, k) for less, k in ranking if any(t == k for _, _, t in parts)]
        while order:
            least = order[0][0] * WINNERS if order[0][0] > 0 else order[-1][0]
            winners, order = [k for less, k in order if less >= least], [x for x in order if x[0] < least]
            found = []
            for a, b, k in parts:
                if k in winners:
                    t = self.templates[k]
                    found += [(cost, -len(t.words), t.name, a + x, a + y, k) for cost, x, y in stretches(own[a:b], t.words, t.limit)]
            if found:
                found.sort()
                return [f for f in found if f[0] == found[0][0]]
        return []

    def hits(self, text: str) -> list[tuple]:
        """(rank, start in the lowered text, license, reduction, different, missing) of the stretches that stay, in their order."""
        text = text.lower()
        own = _WORD.findall(text)
        if not any(w in self.seeds for w in own):
            return []
        spans, out, open_ = [], [], [(0, len(own))]
        raw = lambda a, b: text[spans[a][0] : spans[b - 1][1]].encode("utf-8", "surrogatepass")
        while open_:
            parts = self.regions(own, *open_.pop())
            if parts and not spans:
                spans = [m.span() for m in _WORD.finditer(text)]
            for block in _blocks(parts):
                low, high = block[0][0], max(b for _, b, _ in block)
                taken: list[tuple[int, int]] = []
                for cost, m, name, a, b, k in self.confirmed(own, self.ranked(raw(low, high)), block):
                    if all(b <= x or y <= a for x, y in _beside(taken, a)):
                        insort(taken, (a, b))
                        piece = raw(a, b)
                        alone = len(self.plain.compress(piece))
                        missing, other = split_differences(cost, b - a, -m)
                        out.append(((cost, m, name), spans[a][0], name, self.saved(piece, k, alone) / max(1, alone), other, missing))
                if taken:
                    open_ += [(x, y) for x, y in zip([low, *(b for _, b in taken)], [*(a for a, _ in taken), high], strict=True) if x < y]
        return sorted(out, key=lambda hit: hit[1])

    def block(self, text: str) -> tuple | None:
        """(license, reduction, different, missing) of the confirmed stretch with the fewest differences."""
        found = self.hits(text)
        return min(found)[2:] if found else None

    def text(self, text: str | None) -> list[dict]:
        out, line, seen = [], 0, 0
        if text and (found := self.hits(text)):
            low = text.lower()
            for _, start, name, less, other, missing in found:
                line, seen = line + low.count("\n", seen, start), start
                out.append({"line": line, "license": name, "reduction": less, "different_words": other, "missing_words": missing})
        return out


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, tolerance: float = 0.2) -> DataFrame:
    """``docs`` with ``license_hits``: line number (of the first word, from 0), license, size reduction, and the exact wording differences.

    A hit is a stretch of words, across line breaks, within ``tolerance`` of a
    template's words; a text can have many, and of overlapping ones one stays:
    that of the template that saves most of the block, or of those that save
    nearly as much the one with the fewest differences.
    Null and empty texts have no hits. An existing column of that name is replaced.
    """
    templates = templates or TEMPLATES
    state: dict = {}

    def fn(texts):
        if "s" not in state:
            state["s"] = Scanner(templates, tolerance)
        kinds = {"integer": pa.int32(), "string": pa.string(), "double": pa.float64()}
        kind = pa.list_(pa.struct([(f.name, kinds[f.dataType.typeName()]) for f in HIT.fields]))
        return [pa.array([state["s"].text(t.as_py()) for t in texts], kind)]

    return append_columns(docs, [text_col], [T.StructField("license_hits", T.ArrayType(HIT))], fn)


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_hits, licenses, different_words): sorted distinct licenses joined by a comma."""
    names = F.array_sort(F.array_distinct(F.transform("license_hits", lambda h: h["license"])))
    wrong = F.aggregate("license_hits", F.lit(0).cast("long"), lambda acc, h: acc + h["different_words"] + h["missing_words"])
    return scanned.select(id_col, F.size("license_hits").cast("long").alias("n_hits"), F.concat_ws(",", names).alias("licenses"), wrong.alias("different_words"))
