"""License scans by conditional compression.

Candidate blocks, what is around words that licences use as far as a wording can reach, are compressed with each template as a raw zstandard dictionary. The
template that saves the most against no dictionary is the likely source. Each template is also aligned to its places in the
block, and is confirmed at each by the exact differences in wording and by what its dictionary saves there. Rows stay where
they are; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (licence, wording); public notices, fixed values.
TEMPLATES = [
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
_MARK = re.compile(r"licen[cs]e|licensing|copyright|redistribut|creative commons|\bCC[ -]BY\b|permission is hereby|all rights reserved|public domain|spdx", re.IGNORECASE)
#: One of these, in small letters, is in whatever a mark matches.
_HINTS = ("licen", "copyright", "redistribut", "creative commons", "cc by", "cc-by", "permission is hereby", "rights reserved", "public domain", "spdx")
_WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
#: How far from a mark is looked, against the length of the longest wording.
REACH = 1.5
#: At its place a template saves this share of its own compressed size at least, and lacks or changes this share of the template's words at most, and no number.
MIN_SAVED, MAX_CHANGED = 0.3, 0.1


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks(text: str | None, reach: int) -> Iterator[tuple[int, int]]:
    """Where the candidate blocks of a whole text start and end: all that is within ``reach`` of a mark, cut between words."""
    low = text.casefold() if text else ""
    if not any(x in low for x in _HINTS):
        return
    start = at = None
    for m in _MARK.finditer(text):
        if start is not None and m.start() - reach > at:
            yield start, at
            start = None
        if start is None:
            start = max(0, m.start() - reach)
            while start and not text[start - 1].isspace():
                start -= 1
        at = max(at or 0, min(len(text), m.end() + reach))
        while at < len(text) and not text[at].isspace():
            at += 1
    if start is not None:
        yield start, at


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = [(name, text, words(text)) for name, text in templates]
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.with_ = [zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in templates]
        self.frame = len(self.plain.compress(b""))
        self.sizes = [self.size(self.plain, " ".join(t.lower().split())) for _, t in templates]
        self.places = [Counter(t) for _, _, t in self.templates]
        self.reach = int(REACH * max((len(t) for _, t in templates), default=0))

    def size(self, by: zstandard.ZstdCompressor, text: str) -> int:
        return len(by.compress(text.encode())) - self.frame

    def differences(self, block: list[str], template: list[str]) -> tuple[list[str], list[str]]:
        """Words that the block lacks of the template, and those that it has between the first and the last in common."""
        ops = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
        equal = [k for k, op in enumerate(ops) if op[0] == "equal"]
        if not equal:
            return template, []
        lacks = [w for tag, i, j, _, _ in ops if tag != "equal" for w in template[i:j]]
        extra = [w for tag, _, _, i, j in ops[equal[0] : equal[-1]] if tag != "equal" for w in block[i:j]]
        return lacks, extra

    def aligned(self, k: int, own: list[str]) -> Iterator[tuple[int, int]]:
        """Places (from, to) of the block's words where most of template ``k`` may be, by the words that a run of its length shares."""
        want, n = self.places[k], len(self.templates[k][2])
        room = int(MAX_CHANGED * n)
        held: Counter = Counter()
        common = 0
        for e in range(len(own) + room):
            if e < len(own):
                common += held[own[e]] < want[own[e]]
                held[own[e]] += 1
            if e >= n:
                w = own[e - n]
                held[w] -= 1
                common -= held[w] < want[w]
            # a template with words put between has some of them beyond the run
            if common >= n - 2 * room:
                yield max(0, e - n + 1 - room), min(len(own), e + 1 + room)

    def confirmed(self, block: str) -> list[tuple]:
        """(from, to, template, saved, differences) of the templates that are in a block, each at its place in characters, without overlaps."""
        found = [(m.start(), m.end()) for m in _WORD.finditer(block)]
        own = [block[i:j] for i, j in found]
        hits = []
        for k, (_, _, template) in enumerate(self.templates):
            for x, y in self.aligned(k, own):
                equal = [b for b in SequenceMatcher(None, template, own[x:y], autojunk=False).get_matching_blocks() if b.size]
                if not equal:
                    continue
                i, j = x + equal[0].b, x + equal[-1].b + equal[-1].size
                lacks, extra = self.differences(own[i:j], template)
                changed = len(lacks) + len(extra)
                if changed > MAX_CHANGED * len(template) or any(w[0].isdigit() for w in lacks):
                    continue
                text = " ".join(block[found[i][0] : found[j - 1][1]].split())
                saved = (self.size(self.plain, text) - self.size(self.with_[k], text)) / max(1, self.sizes[k])
                if saved >= MIN_SAVED:
                    hits.append((changed, -len(template), i, j, k, round(saved, 6), " ".join([f"-{w}" for w in lacks] + [f"+{w}" for w in extra])))
        out: list[tuple] = []
        for _, _, i, j, k, saved, text in sorted(set(hits)):  # the fewest differences, then a longer wording before one within it
            if all(j <= o[0] or o[1] <= i for o in out):
                out.append((i, j, k, saved, text))
        return [(found[i][0], found[j - 1][1], *rest) for i, j, *rest in sorted(out)]

    def scan(self, text: str | None) -> Iterator[tuple]:
        spans = list(blocks(text, self.reach))
        breaks = [m.start() for m in re.finditer("\n", text)] if spans else []
        line = lambda at: bisect_right(breaks, at - 1)
        for start, end in spans:
            block = text[start:end]
            low = block.lower()
            sure = self.confirmed(low if len(low) == len(block) else "".join(c.lower() if len(c.lower()) == 1 else c for c in block))
            if sure:
                for i, j, k, saved, differences in sure:
                    yield line(start + i), line(start + j), self.templates[k][0], saved, True, differences
                continue
            data = " ".join(low.split())
            alone = self.size(self.plain, data)
            saved = [1 - self.size(c, data) / max(1, alone) for c in self.with_]
            k = min(range(len(saved)), key=lambda k: (-saved[k], k))
            lacks, extra = self.differences(words(block), self.templates[k][2])
            yield line(start), line(end), self.templates[k][0], round(saved[k], 6), False, " ".join([f"-{w}" for w in lacks] + [f"+{w}" for w in extra])


_scanners: dict[tuple, Scanner] = {}


def scanned(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per template that is confirmed in a candidate block of a text, or one for a block without any: ``id_col, first_line, last_line, license, saved, confirmed, differences``.

    license: the template's; saved: what its dictionary saves at its place, as a share of the template's own compressed
    size, or in a block without any the share of the block's; confirmed: see MIN_SAVED and MAX_CHANGED; differences:
    ``-word`` it lacks and ``+word`` it has instead. Null and empty texts have no blocks; repeated rows are scanned each.
    Of templates at one place the one with fewer differences is taken, then the longer. The lines are those of the place,
    or of the block. A block reaches REACH times the longest template to either side of each mark, across line breaks, so
    that it holds whatever wording the mark is in; blocks that meet are one, however long.
    """
    key = tuple(templates or TEMPLATES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _scanners:
            _scanners[key] = Scanner(list(key))
        scan = _scanners[key].scan
        for pdf in batches:
            rows = [(i, *r) for i, t in zip(pdf["id"], pdf["text"], strict=True) for r in scan(t)]
            yield pd.DataFrame(rows, columns=["id", "first_line", "last_line", "license", "saved", "confirmed", "differences"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(src.dtypes)['id']}, first_line int, last_line int, license string, saved double, confirmed boolean, differences string"
    return src.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
