"""Operator 8, license scans: MinHash bands over overlapping text windows, then exact shingle containment.

Templates fall into size classes by their shingles, each a power of two. For a class of size c, a text's shingles are
cut into windows of 2c, a new one every c, so every run of up to c shingles lies whole in one window. A template of
more than c/2 shingles that is there whole then has Jaccard similarity above 1/4 with the window (the window holds at
most 2c, the template at least c/2); with BANDS bands of one row each, the chance that no band agrees is below
0.75 ** BANDS, which is one in a million for 48. A template of which 80 % is there is still found with a chance above
0.9999. Windows that agree in a band retrieve the template; the exact share of the template's shingles that the window
and its neighbours hold, c more on either side, decides, so a notice that words were put into isn't split.

Shingles are of SHINGLE words (license notices may be as short as five words, so the five words of the near-duplicate
operators would leave one shingle); words are runs of letters, digits and non-ASCII characters, lower-cased.

Cases: null and empty texts match nothing; a text of fewer than SHINGLE words matches nothing; ties don't arise, since
every template that matches is reported; repeated rows are reported as often as they occur; an empty table gives an
empty result; extra columns are not read. Very long texts are scanned whole, of any length, in blocks of about BLOCK words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import ByteWords, bounded_batches, not_alphanumeric, read_table, shingle_hashes, slices
from quarryline.llm.decontamination import lowered_words

SHINGLE, BANDS, CONTAINMENT = 3, 48, 0.8
#: Words of whole texts whose band values are computed together (one longer text goes alone).
BLOCK = 1 << 18

#: Public license notices, and the full texts of the short licenses; longer licenses are found by their notices.
TEMPLATES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT/notice": "Released under the MIT License",
    "MIT/licensed": "Licensed under the MIT License",
    "MIT/text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD-2-Clause/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0",
    "Unlicense/text": "This is free and unencumbered software released into the public domain.",
    "MIT/full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause/full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC/full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib/full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


class Templates:
    """Shingles and band values of the templates, by size class."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS):
        import pyarrow as pa

        self.names = list(templates)
        h, first = lowered_words(pa.array(list(templates.values()), pa.string()), ByteWords(not_alphanumeric()))
        self.sets = [np.unique(shingle_hashes(h[first[i] : first[i + 1]], SHINGLE)) for i in range(len(self.names))]
        rng = np.random.default_rng(20240229)
        self.factors = rng.integers(1 << 40, 1 << 63, bands, np.uint64) * np.uint64(2) + np.uint64(1)
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                classes.setdefault(1 << int(len(s) - 1).bit_length(), []).append(i)
        self.classes = {c: (np.array(m), np.array([[(s := self.sets[i] * f).min() for i in m] for f in self.factors])) for c, m in classes.items()}

    def candidates(self, shingles: np.ndarray, real: np.ndarray, first: np.ndarray):
        """{(size, text, first shingle of a window, template)} of the windows that agree with a template of their class in a band.

        shingles: of many texts, one after the other; real: False for those that reach into the next text; first: where
        each text's shingles begin (one more at the end). Block minima of a larger class come from those of the class below.
        """
        blocks, below, begin = {}, 1, first  # for each class: starts among the blocks of the class below, and the text of each block
        for size in sorted(self.classes):
            count = -(-np.diff(begin) // (size // below))
            end = np.concatenate([[0], np.cumsum(count)])
            text = np.repeat(np.arange(len(count)), count)
            within = np.arange(end[-1]) - end[:-1][text]
            blocks[size] = (begin[:-1][text] + within * (size // below), text, within)
            below, begin = size, end
        found = set()
        for band, f in enumerate(self.factors):
            least = shingles * f
            least[~real] = ~np.uint64(0)
            for size, (starts, text, within) in blocks.items():
                if not len(starts):
                    continue
                least = np.minimum.reduceat(least, starts)
                pair = least.copy()
                same = text[:-1] == text[1:]
                pair[:-1][same] = np.minimum(least[:-1], least[1:])[same]
                members, values = self.classes[size]
                for k, v in zip(members, values[band], strict=True):
                    found.update((size, int(text[w]), int(within[w]) * size, int(k)) for w in np.flatnonzero(pair == v))
        return found

    def matches(self, shingles: np.ndarray, real: np.ndarray, first: np.ndarray):
        """(text, template, windows that hold it, best containment); overlapping windows count once.

        A window that holds it only with its neighbours counts if it is beside none that is counted.
        """
        held: dict[tuple[int, int], list] = {}
        for size, text, start, k in sorted(self.candidates(shingles, real, first)):
            own = shingles[first[text] : first[text + 1]]
            share = float(np.isin(self.sets[k], own[max(0, start - size) : start + 3 * size]).mean())
            if share >= CONTAINMENT:
                alone = float(np.isin(self.sets[k], own[start : start + 2 * size]).mean()) >= CONTAINMENT
                held.setdefault((text, k), []).append((start, alone, share, size))
        out = []
        for (text, k), found in sorted(held.items()):
            size, n = found[0][3], 0
            whole = np.array([start for start, alone, _, _ in found if alone], np.int64)
            split = np.array([start for start, alone, _, _ in found if not alone and not (np.abs(whole - start) <= 2 * size).any()], np.int64)
            for starts, apart in ((whole, size), (split, 2 * size)):
                n += bool(len(starts)) + int((np.diff(starts) > apart).sum())
            out.append((text, k, n, max(x[2] for x in found)))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row per document and template that it holds: doc_id, license, n_matches, containment."""
    ready = Templates(templates or TEMPLATES)
    id_type = dict(docs.dtypes)["doc_id"]

    def search(batches):
        import pyarrow as pa

        words = ByteWords(not_alphanumeric())
        for batch in (part for b in batches for part in slices(b, 1)):
            h, first = lowered_words(batch.column(1), words)
            rows, at = [], 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(first, first[at] + BLOCK, "right")) - 1)
                own = first[at : stop + 1] - first[at]
                rolled = np.append(shingle_hashes(h[first[at] : first[stop]], SHINGLE), np.zeros(min(SHINGLE - 1, int(own[-1])), np.uint64))
                real = np.ones(len(rolled), bool)
                for back in range(1, SHINGLE):  # the last words of a text begin no shingle of it
                    real[np.maximum(own[1:] - back, 0)[own[1:] >= back]] = False
                rows.extend((at + i, *x) for i, *x in ready.matches(rolled, real, own))
                at = stop
            text, k, n, share = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text, pa.int64())), pa.array([ready.names[x] for x in k], pa.string()), pa.array(n, pa.int32()), pa.array(share, pa.float64())], ["doc_id", "license", "n_matches", "containment"])

    return bounded_batches(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(search, f"doc_id {id_type}, license string, n_matches int, containment double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, license, n_matches, containment of the templates it holds."""
    return scan(read_table(spark, sf_dir, "documents"))
