"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits, A-Z lower-cased (bytes above 127 count as letters). Shingles have five words. A template with m shingles is looked for in
windows of ceil(1.25 m) shingles that start every max(1, m // 4) shingles, so each verbatim copy lies in a window whole. A window matches if it holds
0.75 of the template's distinct shingles; then their Jaccard similarity is at least 0.5, and BANDS bands of one row miss it with probability 2^-BANDS.
All windows of all texts of a chunk are hashed together: the smallest hash of a window comes from minima over doubling widths.
Every occurrence is returned: windows that match and start fewer than m shingles (rounded down to strides) apart are one, and its best window stands for it.
Of copies that touch, a window across two can count as one more.

The templates are a fixed, small list that is shipped to the tasks. Texts are scanned whole. Null and empty texts have no match; repeated rows are scanned alike; very long texts are scanned whole, one at a time;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import map_arrow, spans_of_texts, text_buffer

SHINGLE = 5
BANDS = 20
CONTAINED = 0.75
CHUNK = 1 << 20
#: Notices, grants and disclaimers as their licenses word them, and short statements.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-short": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}


def separators() -> np.ndarray:
    table = np.ones(256, bool)
    table[128:] = False
    table[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    return table


def shingles_of(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the whole shingles of all texts and offsets into them; texts of fewer words have none."""
    words, at = vec.word_hashes(vec.lower_table()[buffer], offsets, separators(), seed=3)
    hashes, out = vec.shingle_hashes(words, at, SHINGLE)
    short = np.diff(at) < SHINGLE
    if short.any():
        keep = ~np.repeat(short, np.diff(out))
        counts = np.where(short, 0, np.diff(out))
        return hashes[keep], np.concatenate([[0], np.cumsum(counts)])
    return hashes, out


def multipliers(bands: int = BANDS) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 32, bands, dtype=np.uint32) | np.uint32(1)


class Template:
    def __init__(self, name: str, text: str, bands: int = BANDS):
        raw = np.frombuffer(text.encode(), np.uint8)
        self.name, self.shingles = name, np.unique(shingles_of(raw, np.array([0, len(raw)]))[0])
        if not len(self.shingles):
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        m = len(self.shingles)
        self.width, self.stride, self.needed = math.ceil(1.25 * m), max(1, m // 4), math.ceil(CONTAINED * m - 1e-9)
        self.least = max(2, min(m, 4 * self.stride))  # m, rounded down to strides
        self.keys = ((self.shingles >> np.uint64(32)).astype(np.uint32)[None, :] * multipliers(bands)[:, None]).min(1)


def windows(counts: np.ndarray, template: Template) -> tuple[np.ndarray, np.ndarray]:
    """Text and first shingle (in its text) of every window of a template: all starts below the text's count."""
    n = -(-counts // template.stride)
    of = np.repeat(np.arange(len(counts)), n)
    return of, (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * template.stride


def candidates(hashes: np.ndarray, offsets: np.ndarray, templates: list[Template], bands: int = BANDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each template the windows (text, first shingle) that share a band key with it."""
    counts = np.diff(offsets)
    pad = max(t.width for t in templates)
    at = offsets[:-1] + pad * np.arange(len(counts))  # texts stand apart, so that no window reaches into the next
    total = len(hashes) + pad * len(counts)
    filled = np.zeros(total, bool)
    place = np.arange(len(hashes)) + np.repeat(at - offsets[:-1], counts)
    filled[place] = True
    base = np.zeros(total, np.uint32)
    base[place] = (hashes >> np.uint64(32)).astype(np.uint32)
    where = [windows(counts, t) for t in templates]
    starts = [at[of] + first for of, first in where]
    hit = [np.zeros(len(s), bool) for s in starts]
    by_level: dict[int, list[int]] = {}
    for k, t in enumerate(templates):
        by_level.setdefault(t.width.bit_length() - 1, []).append(k)
    for band, factor in enumerate(multipliers(bands)):
        low = np.where(filled, base * factor, np.uint32(0xFFFFFFFF))
        level = 0
        while True:
            for k in by_level.get(level, ()):
                t, s = templates[k], starts[k]
                hit[k] |= np.minimum(low[s], low[s + (t.width - (1 << level))]) == t.keys[band]
            level += 1
            if level > max(by_level):
                break
            step = 1 << (level - 1)
            low[:-step] = np.minimum(low[:-step], low[step:])
    return [(of[h], first[h]) for (of, first), h in zip(where, hit, strict=True)]


def apart(found: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """From (shingles in common, first shingle) of the windows that match, the occurrences, by first shingle: the best window (the earlier of equal ones), then the
    best that starts `least` shingles or more from all taken, and so on."""
    taken: list[tuple[int, int]] = []
    for common, first in sorted(found, key=lambda x: (-x[0], x[1])):
        k = bisect_left(taken, (first, 0))
        if (k == 0 or first - taken[k - 1][0] >= least) and (k == len(taken) or taken[k][0] - first >= least):
            taken.insert(k, (first, common))
    return taken


def scan(hashes: np.ndarray, offsets: np.ndarray, templates: list[Template], bands: int = BANDS) -> list[list[tuple[str, int, float]]]:
    """For each text the occurrences of each template: name, first word of the window, share of the template's shingles in it."""
    out: list[list] = [[] for _ in range(len(offsets) - 1)]
    if not len(hashes):
        return out
    for t, (texts, firsts) in zip(templates, candidates(hashes, offsets, templates, bands), strict=True):
        matches: dict[int, list[tuple[int, int]]] = {}
        for i, first in zip(texts.tolist(), firsts.tolist(), strict=True):
            window = hashes[offsets[i] + first : min(offsets[i] + first + t.width, offsets[i + 1])]
            common = int(np.isin(t.shingles, window).sum())
            if common >= t.needed:
                matches.setdefault(i, []).append((common, first))
        for i, found in matches.items():
            out[i] += [(t.name, first, common / len(t.shingles)) for first, common in apart(found, t.least)]
    return out


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, bands: int = BANDS) -> DataFrame:
    """id_col, n_shingles, matches (template, first_word, contained; each occurrence, by template and place) for every row: one pass over the two columns, no shuffle."""
    texts = dict(TEMPLATES if templates is None else templates)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    match = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("contained", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(n, t, bands) for n, t in sorted(texts.items())]
        for batch in batches:
            buffer, offsets = text_buffer(batch.column(1))
            for a, b in spans_of_texts(offsets, CHUNK):
                hashes, at = shingles_of(buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found = scan(hashes, at, known, bands)
                rows = [[{"template": n, "first_word": f, "contained": c} for n, f, c in x] for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at).astype(np.int64)), pa.array(rows, match)], names=["id", "n_shingles", "matches"])

    return map_arrow(narrow, run, f"id {kind}, n_shingles long, matches array<struct<template: string, first_word: long, contained: double>>").withColumnRenamed("id", id_col)
