"""License scan: winnowed fingerprints find candidates, banded alignment measures them.

The templates' three-word grams are winnowed into an inverted index (fingerprint to template and
place); short templates are kept under every pair of words that names the license instead. The same
grams of a text look candidates up; places that agree on a diagonal, give or take the band, are one
candidate. A banded alignment of the template with the text around it counts the matched words, and
the words that name the license must stand in the span. The templates are a parameter of fixed size and
travel with the job; texts are scanned where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.arrays import LOWER, NOT_WORD, PAD, mixed, sliding_min, word_bounds, text_slices
from proofline.llm.decontamination import word_hashes

# --- fixed values: notices, headers and whole texts of public licenses ----------------------------
GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
TWO_CLAUSES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
THIRD_CLAUSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the"
LATER = "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": GRANT,
    "MIT-whole": GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
    "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-whole": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE "
    "AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
    "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC": "Released under the ISC License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
    "in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
    "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
    "under the License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-header": f"{FREE} GNU General Public License {LATER.format(2)}",
    "GPL-3.0-header": f"{FREE} GNU General Public License {LATER.format(3)}",
    "LGPL-3.0-header": f"{FREE} GNU Lesser General Public License {LATER.format(3)}",
    "AGPL-3.0-header": f"{FREE} GNU Affero General Public License {LATER.format(3)}",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD": CONDITIONS,
    "BSD-2-whole": f"{CONDITIONS} {TWO_CLAUSES} {BSD_WARRANTY}",
    "BSD-3-whole": f"{CONDITIONS} {TWO_CLAUSES} {THIRD_CLAUSE} {BSD_WARRANTY}",
}
#: Runs of words that must stand in a span for it to be this license and no other.
NAMING = {
    "MIT": ["mit"], "ISC": ["isc"],
    "Apache-2.0": ["apache license", "2 0"], "Apache-2.0-header": ["apache license", "2 0"],
    "MPL-2.0": ["mozilla public license", "2 0"], "MPL-2.0-header": ["mozilla public license", "2 0"],
    "GPL-2.0": ["gnu general public license", "2"], "GPL-2.0-header": ["gnu general public license", "version 2"],
    "GPL-3.0": ["gnu general public license", "3"], "GPL-3.0-header": ["gnu general public license", "version 3"],
    "LGPL-3.0-header": ["gnu lesser general public license", "version 3"],
    "AGPL-3.0-header": ["gnu affero general public license", "version 3"],
    "CC-BY-4.0": ["cc by 4 0"], "CC-BY-SA-4.0": ["by sa 4 0"], "CC-BY-ND-4.0": ["by nd 4 0"], "CC-BY-NC-4.0": ["by nc 4 0"],
    "BSD-3-whole": ["neither the name"],
}
# --------------------------------------------------------------------------------------------------
#: A run of four words in place is certain to hold a kept gram. A template from ``SHORT`` words on has
#: such a run whenever a fifth of its words at most is altered; shorter ones go by their naming words.
GRAM, WINDOW, SHORT = 3, 2, 16
#: Words the text may be ahead of or behind the template; share of the template that must match.
BAND, LEAST_COVERAGE = 8, 0.8
#: Alignments remembered by a task, as the same notice comes again and again.
REMEMBERED = 4096


def _hashes(text: str) -> np.ndarray:
    raw = text.encode()
    data = np.zeros(len(raw) + PAD, dtype=np.uint8)
    data[: len(raw)] = LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, _ = word_bounds(data, np.array([0, len(raw)]), NOT_WORD)
    return word_hashes(data, starts, ends)


def pair_grams(hashes: np.ndarray) -> np.ndarray:
    """A hash for each two words in a row."""
    return mixed(mixed(hashes[:-1]) ^ hashes[1:])


def word_grams(pairs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash for each three words in a row, from those of two."""
    return mixed(pairs[:-1] ^ hashes[GRAM - 1 :])


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: the smallest gram of each window of grams."""
    count = len(grams)
    least = sliding_min(grams, min(WINDOW, count))
    chosen = np.zeros(count, dtype=bool)
    for shift in range(count - len(least) + 1):
        chosen[shift : shift + len(least)] |= grams[shift : shift + len(least)] == least
    return np.flatnonzero(chosen)


def _within(run: np.ndarray, words: np.ndarray) -> list[int]:
    """Where ``run`` stands in ``words``."""
    return [i for i in range(len(words) - len(run) + 1) if np.array_equal(words[i : i + len(run)], run)]


class Templates:
    """Word hashes of templates, the runs that name them, and the inverted index: sorted grams of two
    and of three words with template number and place. One of two words is enough to be found."""

    def __init__(self, texts: dict[str, str], naming: dict[str, list[str]]):
        self.names = list(texts)
        self.words = [_hashes(text) for text in texts.values()]
        self.runs = [[_hashes(run) for run in naming.get(name, [])] for name in self.names]
        entries: dict[int, list[tuple]] = {2: [], GRAM: []}
        for number, (words, runs) in enumerate(zip(self.words, self.runs, strict=True)):
            if len(words) < 2:
                continue
            pairs = pair_grams(words)
            if len(words) < SHORT:
                named = {i + k for run in runs for i in _within(run, words) for k in range(len(run))} or set(range(len(words)))
                entries[2] += [(pairs[i], number, i) for i in range(len(pairs)) if i in named or i + 1 in named]
            else:
                grams = word_grams(pairs, words)
                entries[GRAM] += [(grams[i], number, int(i)) for i in winnowed(grams)]
        self.index = {}
        for size, rows in entries.items():
            rows.sort()
            self.index[size] = tuple(np.array([r[k] for r in rows], dtype=np.uint64 if k == 0 else np.int64) for k in range(3))

    def candidates(self, grams: np.ndarray, size: int, kept: np.ndarray) -> set[tuple[int, int]]:
        """(template, diagonal) of the kept places of a text's grams."""
        prints, numbers, places = self.index[size]
        left, right = np.searchsorted(prints, grams[kept], "left"), np.searchsorted(prints, grams[kept], "right")
        return {(int(numbers[k]), int(kept[h] - places[k])) for h in np.flatnonzero(right > left) for k in range(left[h], right[h])}

    def named(self, number: int, span: np.ndarray) -> bool:
        return all(_within(run, span) for run in self.runs[number])


def banded_alignment(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Matched words, and first and last matched word of the text, of the best alignment in which
    word i of the template meets a word within ``band`` of i + diagonal. Later starts win ties, so
    the span is tight."""
    width = 2 * band + 1
    best = np.zeros(width + 1, dtype=np.int64)
    first = np.full(width + 1, -1, dtype=np.int64)
    last = np.full(width + 1, -1, dtype=np.int64)
    for i, word in enumerate(template):
        place = np.arange(i + diagonal - band, i + diagonal + band + 1)
        inside = (place >= 0) & (place < len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[place[inside]] == word
        # Cell j of this row stands for text[place[j]]; cell j of the last row for the word before.
        # ``skip`` leaves the template word out, ``step`` matches it.
        skip, skip_first, skip_last = best[1:].copy(), first[1:].copy(), last[1:].copy()
        step = best[:-1] + 1
        new, new_first, new_last = skip, skip_first, skip_last
        take = same & (step > skip)
        new[take] = step[take]
        new_first[take] = np.where(first[:-1][take] < 0, place[take], first[:-1][take])
        new_last[take] = place[take]
        # Words of the text may be left out: a cell is at least as good as the one before it.
        lead = np.maximum.accumulate(new)
        source = np.maximum.accumulate(np.where(new == lead, np.arange(width), 0))
        best[:-1], first[:-1], last[:-1] = lead, new_first[source], new_last[source]
        best[-1], first[-1], last[-1] = best[-2], first[-2], last[-2]
    at = int(np.argmax(best[:-1]))
    return int(best[at]), int(first[at]), int(last[at])


def _spans(hashes: np.ndarray, templates: Templates, known: dict) -> list[tuple[int, int, int, int]]:
    """(template, first word, last word, matched) of each notice of one text."""
    if len(hashes) < 2:
        return []
    pairs = pair_grams(hashes)
    candidates = templates.candidates(pairs, 2, np.arange(len(pairs)))
    if len(hashes) >= GRAM:
        grams = word_grams(pairs, hashes)
        candidates |= templates.candidates(grams, GRAM, winnowed(grams))
    found: list[tuple[int, int, int, int]] = []
    previous: tuple[int, int] | None = None
    for number, diagonal in sorted(candidates):
        if previous and previous[0] == number and diagonal - previous[1] <= BAND // 2:
            continue
        previous = (number, diagonal)
        template = templates.words[number]
        begin = max(0, diagonal - BAND)
        around = hashes[begin : diagonal + len(template) + BAND]
        key = (number, diagonal - begin, around.tobytes())
        if key not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[key] = banded_alignment(template, around, diagonal - begin)
        matched, first, last = known[key]
        if matched >= LEAST_COVERAGE * len(template) and templates.named(number, around[first : last + 1]):
            found.append((number, begin + first, begin + last, matched))
    # Of overlapping spans the one with most words matched stays, then the better covered, the earlier.
    kept: list[tuple[int, int, int, int]] = []
    for span in sorted(found, key=lambda s: (-s[3], -s[3] / len(templates.words[s[0]]), s[1], s[0])):
        if not any(span[1] <= k[2] and k[1] <= span[2] for k in kept):
            kept.append(span)
    return sorted(kept)


def _scan_batches(batches: Iterator[pa.RecordBatch], texts: dict[str, str], naming: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
    templates, known = Templates(texts, naming), {}
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        rows: list[tuple] = []
        for begin, _, data, offsets in text_slices(batch.column("text")):
            low = LOWER[data]
            starts, ends, counts = word_bounds(low, offsets, NOT_WORD)
            hashes = word_hashes(low, starts, ends)
            first = np.cumsum(counts) - counts
            # Only texts with a gram of the index are looked at one by one.
            row = np.repeat(np.arange(len(counts)), counts)
            pairs = pair_grams(hashes) if len(hashes) > 1 else hashes[:0]
            grams = word_grams(pairs, hashes) if len(hashes) >= GRAM else hashes[:0]
            met = [row[: len(g)][np.isin(g, templates.index[size][0])] for size, g in ((2, pairs), (GRAM, grams))]
            for i in np.unique(np.concatenate(met)):
                for number, a, b, matched in _spans(hashes[first[i] : first[i] + counts[i]], templates, known):
                    start, end = starts[first[i] + a] - offsets[i], ends[first[i] + b] - offsets[i]
                    rows.append((ids[begin + i], templates.names[number], a, b, int(start), int(end), matched, matched / len(templates.words[number])))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["doc_id", "license", "first_word", "last_word", "start_byte", "end_byte", "matched", "coverage"],
        )


def scan(docs: DataFrame, templates: dict[str, str] | None = None, naming: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, license, first_word, last_word, start_byte, end_byte, matched, coverage: one row for
    each span of a text that covers a template. Of spans that overlap, the one with most words
    matched is given, so a header is not also reported as the notice it begins with.

    ``templates`` are texts by name, ``naming`` the runs of words a span must hold by the same names;
    both have defaults together. Words are runs of letters, digits and other non-ASCII characters,
    lower-cased; null and wordless texts give no rows, repeated rows give repeated spans, one template
    may be found several times in a text. Certain to be looked at is a template that is whole but for a
    fifth of its words exchanged in place; one whose words are strewn among others may not be. Templates
    of one word cannot be found.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, runs = (TEMPLATES, NAMING) if templates is None else (templates, {})
    return narrow.mapInArrow(
        partial(_scan_batches, texts=texts, naming=runs if naming is None else naming),
        "doc_id long, license string, first_word long, last_word long, start_byte long, end_byte long, matched long, coverage double",
    )
