"""License scans by conditional compression.

The words about each one that speaks of licensing, on whatever lines they are, are looked at in windows of bounded size.
A window is compressed by itself and with the wording of each license as a raw zstandard dictionary; the license that
saves the most bytes ranks first. A license counts only when the wording is really there, whatever it saves: its words
and the window's are aligned, and the differences are reported.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm import text as T
from siftmark.llm.shared import tuned

SPEAKS = r"licen[sc]|copyright|public\W+domain|warrant|redistribut|permission|spdx|creative\W+commons|liable|liability"
LEAST_SHARE, MOST_RANKED = 0.85, 4
LEVEL = 19

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 public domain dedication.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_MIT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)
#: Whole texts, without the lines that name the holder.
TEMPLATES |= {
    "MIT-text": f"{TEMPLATES['MIT-permission']}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: {_MIT} {_AS_IS}",
    "BSD-2-Clause-text": f"{TEMPLATES['BSD-redistribution']}: {_BSD[0]} {_BSD[1]} {_BSD[3]}",
    "BSD-3-Clause-text": f"{TEMPLATES['BSD-redistribution']}: {' '.join(_BSD)}",
    "ISC-text": f"{TEMPLATES['ISC']}, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0-text": f"{TEMPLATES['Apache-2.0-notice']} http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-text": f"{TEMPLATES['GPL-notice']}, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}
SCHEMA = "doc_id long, line int, lines int, license string, rank int, saved int, plain_size int, share double, missing string, extra string"
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def wording(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def aligned(template: list[str], block: list[str]) -> tuple[float, list[str], list[str], int, int]:
    """(share of the template's words that the block has in order, those missing, words of the block in between, first
    place that agrees, place after the last). Words before the first and after the last don't belong to the wording."""
    same = [m for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return 0.0, template, [], 0, 0
    kept = {i for m in same for i in range(m.a, m.a + m.size)}
    inside = {j for m in same for j in range(m.b, m.b + m.size)}
    low, high = same[0].b, same[-1].b + same[-1].size
    return len(kept) / len(template), [w for i, w in enumerate(template) if i not in kept], [block[j] for j in range(low, high) if j not in inside], low, high


def differences(template: list[str], block: list[str]) -> tuple[float, list[str], list[str]]:
    """The first three of aligned()."""
    return aligned(template, block)[:3]


class Ranker:
    """Compressors with each template as a dictionary."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [wording(t) for t in templates.values()]
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.given = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.words]
        self.cache: dict[str, tuple[int, list[tuple[int, int]]]] = {}

    def savings(self, block: str) -> tuple[int, list[tuple[int, int]]]:
        """(compressed size, [(bytes saved, template)], the most first; ties go to the longer wording, then by order)."""
        if block not in self.cache:
            raw = block.encode()
            size = len(self.plain.compress(raw))
            saved = [(size - len(c.compress(raw)), k) for k, c in enumerate(self.given)]
            if len(self.cache) > 10_000:
                self.cache.clear()
            self.cache[block] = size, sorted(saved, key=lambda x: (-x[0], -len(self.words[x[1]]), x[1]))
        return self.cache[block]

    def reach(self, least: float) -> int:
        """Words that a license with its differences can span, at most."""
        return max((len(w) + _slack(w, least) for w in self.words), default=0)

    def exact(self, block: list[str]) -> tuple[int, int, int] | None:
        """(template, where it begins, where it ends) of the longest wording that is there to the word; the first place."""
        joined = f" {' '.join(block)} "
        best = max((k for k, w in enumerate(self.words) if w and f" {' '.join(w)} " in joined), key=lambda k: (len(self.words[k]), -k), default=None)
        if best is None:
            return None
        low = joined[: joined.index(f" {' '.join(self.words[best])} ") + 1].count(" ") - 1
        return best, low, low + len(self.words[best])

    def close(self, k: int, block: list[str], least: float) -> tuple | None:
        """The place where a wording differs least, as aligned() gives it, if that is little enough."""
        words, slack = self.words[k], _slack(self.words[k], least)
        own, need = set(words), least * len(words) - 1e-9
        has = [0]
        for w in block:
            has.append(has[-1] + (w in own))
        best = None
        if words and has[-1] >= need:
            span = len(words) + slack
            for j in range(max(1, len(block) - span + 1)):
                if has[min(j + span, len(block))] - has[j] >= need:
                    share, missing, extra, low, high = aligned(words, block[j : j + span])
                    if share >= least and len(extra) <= slack and (best is None or len(missing) + len(extra) < len(best[1]) + len(best[2])):
                        best = share, missing, extra, j + low, j + high
        return best

    def found(self, lines: list[str], least: float, ranked: int) -> list[tuple]:
        """Licenses in a block: first the longest that are there to the word, then the best ranked that differ, then
        what the words before and after hold. At the end of each are the places of its first word and after its last."""
        block = [w for line in lines for w in wording(line)]
        return self._within(block, 0, len(block), least, ranked, [])

    def _within(self, block: list[str], low: int, high: int, least: float, ranked: int, whole: list) -> list[tuple]:
        part = block[low:high]
        if (hit := self.exact(part)) is not None:
            k, a, b = hit
            share, missing, extra = 1.0, [], []
        else:
            near = {k: x for k in range(len(self.words)) if (x := self.close(k, part, least))}
            if not near:
                return []
            order = [k for _, k in self._ranking(block, whole)[1]]
            first = [k for k in order[:ranked] if k in near] or [k for k in order if k in near]
            k = first[0]
            share, missing, extra, a, b = near[k]
        size, saved = self._ranking(block, whole)
        rank, gain = next((i + 1, g) for i, (g, x) in enumerate(saved) if x == k)
        one = (self.names[k], rank, gain, size, share, " ".join(missing), " ".join(extra), low + a, low + b)
        return [one, *self._within(block, low, low + a, least, ranked, whole), *self._within(block, low + b, high, least, ranked, whole)]

    def _ranking(self, block: list[str], whole: list) -> tuple[int, list[tuple[int, int]]]:
        if not whole:
            whole.append(self.savings(" ".join(block)))
        return whole[0]

    def licenses(self, text: str, least: float, ranked: int) -> Iterator[tuple]:
        """(first line, lines, license and what found() gives of it) of all licenses of a text.

        Windows are twice the reach and begin a reach apart. A license that begins in the later half is whole in
        the next one, so it is left to that.
        """
        reach = self.reach(least)
        spans = [m.span() for m in _WORD.finditer(text)]
        starts, words = [a for a, _ in spans], [text[a:b].lower() for a, b in spans]
        breaks = [m.start() for m in re.finditer("\n", text)]
        regions: list[list[int]] = []
        for m in re.finditer(SPEAKS, text, re.I):
            at = max(0, bisect_right(starts, m.start()) - 1)
            low, high = max(0, at - reach), min(len(words), at + reach + 1)
            if regions and low <= regions[-1][1]:
                regions[-1][1] = high
            else:
                regions.append([low, high])
        for low, high in regions:
            done = low
            for at in range(low, high, reach):
                last = at + 2 * reach >= high
                begin, end = max(at, done), min(at + 2 * reach, high)
                for x in sorted(self._within(words[begin:end], 0, end - begin, least, ranked, []), key=lambda x: x[7]):
                    a, b = begin + x[7], begin + x[8]
                    if last or a < at + reach:
                        line, to = bisect_right(breaks, starts[a]), bisect_right(breaks, starts[b - 1])
                        yield line, to - line + 1, *x[:7]
                        done = b
                if last:
                    break


def _slack(words: list[str], least: float) -> int:
    """Words in between that a wording may have."""
    return int((1 - least) * len(words) + 0.5)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_SHARE, ranked: int = MOST_RANKED) -> DataFrame:
    """(doc_id, line, lines, license, rank, saved, plain_size, share, missing, extra), a row for each license found.

    line is the line on which the license begins and lines the number it spans. saved is what its wording takes off
    plain_size, the compressed size of the window it is in, and rank its place by that; neither decides whether it is
    found. share is the part of the license's words that are there in their order, `least` or more; missing and extra
    are the words that differ. Where several wordings fit the same words an exact one goes before one that differs, and
    of exact ones the longest; of others the best ranked is given, one under the `ranked` best only where none of
    these fits.

    A very long text is looked at in all its windows. Null, empty and other texts without a candidate word give no row. Rows with a null doc_id and repeated rows
    are each scanned. Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    tuned(docs.sparkSession)
    given = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(given)
        for batch in batches:
            rows = []
            for i, text in zip(T.column_of(batch, "doc_id").to_pylist(), T.column_of(batch, "text").to_pylist()):
                rows += [(i, *x) for x in ranker.licenses(text, least, ranked)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string()))], ["doc_id", "line", "lines", "license", "rank", "saved", "plain_size", "share", "missing", "extra"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.where(F.col("text").rlike(f"(?i){SPEAKS}")).mapInArrow(run, SCHEMA)
