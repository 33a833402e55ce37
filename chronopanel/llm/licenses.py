"""License notices by winnowed fingerprints and banded alignment (operator 4).

Word n-grams of every template are hashed, winnowed (in every window of
consecutive hashes the least is kept, the last of equals) and put in an inverted
index.  A text is winnowed alike, so any run of ``GRAM + WINDOW - 1`` words it
shares with a template gives a common fingerprint; templates with one become
candidates around the diagonal it names.  There a local alignment in a band tells
which words of the template are matched, its coverage, and the span in the text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import text_slices

GRAM, WINDOW, BAND, COVERAGE = 3, 3, 6, 0.75
WORD = re.compile(r"[^\W_]+")

# Licenses by SPDX identifier, and the names they go by in notices.
NAMES = {
    "MIT": ["the *MIT* License"],
    "ISC": ["the *ISC* License"],
    "Apache-2.0": ["the *Apache* License, Version *2.0*"],
    "MPL-2.0": ["the *Mozilla* Public License, version *2.0*"],
    "EPL-2.0": ["the *Eclipse* Public License, version *2.0*"],
    "BSD-2-Clause": ["the *BSD* *2*-Clause License"],
    "BSD-3-Clause": ["the *BSD* *3*-Clause License"],
    "GPL-2.0": ["the *GNU General* Public License, version *2*"],
    "GPL-3.0": ["the *GNU General* Public License, version *3*"],
    "LGPL-2.1": ["the *GNU Lesser General* Public License, version *2.1*"],
    "LGPL-3.0": ["the *GNU Lesser General* Public License, version *3*"],
    "AGPL-3.0": ["the *GNU Affero General* Public License, version *3*"],
    "CC0-1.0": ["*CC0* *1.0*", "the *CC0* *1.0* Universal Public Domain Dedication"],
    "CC-BY-4.0": ["*CC BY 4.0*", "a *Creative Commons Attribution 4.0* International License"],
    "CC-BY-SA-4.0": ["*CC BY-SA 4.0*", "a *Creative Commons Attribution-ShareAlike 4.0* International License"],
    "CC-BY-ND-4.0": ["*CC BY-ND 4.0*", "a *Creative Commons Attribution-NoDerivatives 4.0* International License"],
    "CC-BY-NC-4.0": ["*CC BY-NC 4.0*", "a *Creative Commons Attribution-NonCommercial 4.0* International License"],
    "CC-BY-NC-SA-4.0": ["*CC BY-NC-SA 4.0*", "a *Creative Commons Attribution-NonCommercial-ShareAlike 4.0* International License"],
    "CC-BY-NC-ND-4.0": ["*CC BY-NC-ND 4.0*", "a *Creative Commons Attribution-NonCommercial-NoDerivatives 4.0* International License"],
}
PHRASES = ("Licensed under {}", "Released under {}", "This work is licensed under {}", "Distributed under {}",
           "Available under the terms of {}")
# Well-known license texts and file headers; words between asterisks have to be matched without a word between them.
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_THIRD = ("3. *Neither* the name of the copyright holder nor the names of its *contributors* may be used to *endorse or promote* products "
          "derived from this software without specific prior written permission. ")
_NO_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_HEADER = ("{what} is free software{stop} you can redistribute it and/or modify it under the terms of the {name} as published by the Free "
           "Software Foundation{either} *version {number}* of the License, or (at your option) any later version")
PASSAGES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
                 "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
                 "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
                 "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
                 "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
                 "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
                 "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
                 "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies",
    "BSD-2-Clause": _BSD,
    "BSD-2-Clause whole": _BSD + _NO_WARRANTY,
    "BSD-3-Clause": _BSD + _THIRD,
    "BSD-3-Clause whole": _BSD + _THIRD + _NO_WARRANTY,
    "Apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                  "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "Apache-2.0 header": "Licensed under the *Apache* License, Version *2.0* (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                         "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
                         "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
                         "for the specific language governing permissions and limitations under the License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the *Mozilla* Public License, v. *2.0*. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the *Eclipse* Public License *2.0* "
               "which is available at https://www.eclipse.org/legal/epl-2.0",
    "GPL-2.0": _HEADER.format(what="This program", stop=";", name="*GNU General* Public License", either="; either", number="2"),
    "GPL-3.0": _HEADER.format(what="This program", stop=":", name="*GNU General* Public License", either=", either", number="3"),
    "LGPL-2.1": _HEADER.format(what="This library", stop=";", name="*GNU Lesser General* Public License", either="; either", number="2.1"),
    "LGPL-3.0": _HEADER.format(what="This library", stop=":", name="*GNU Lesser General* Public License", either=", either", number="3"),
    "AGPL-3.0": _HEADER.format(what="This program", stop=":", name="*GNU Affero General* Public License", either=", either", number="3"),
    "CC0-1.0": "To the extent possible under law, the author has waived all *copyright* and related or neighboring rights to this work",
    "CC0-1.0 text": "The person who associated a work with this deed has dedicated the work to the *public domain* by *waiving* all of his or "
                    "her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent "
                    "allowed by law",
}


@dataclass(frozen=True)
class Template:
    license_id: str
    name: str
    words: tuple[str, ...]
    musts: frozenset  # places of words that have to be matched
    joined: frozenset = frozenset()  # musts whose next word is one too, with no word of the text between them


def template(license_id: str, name: str, text: str) -> Template:
    """Words between asterisks have to be matched, a run of them word after word."""
    words, musts = [], set()
    for k, part in enumerate(text.split("*")):
        own = WORD.findall(part.lower())
        if k % 2:
            musts.update(range(len(words), len(words) + len(own)))
        words += own
    return Template(license_id, name, tuple(words), frozenset(musts), frozenset(m for m in musts if m + 1 in musts))


def standard_templates() -> list[Template]:
    short = [
        template(key, phrase.format(name.replace("*", "")), phrase.format(name))
        for key, names in NAMES.items() for name in names for phrase in PHRASES]
    return short + [template(key.split()[0], f"{key} text", text) for key, text in PASSAGES.items()]


def word_hashes(words: list[str]) -> np.ndarray:
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    own = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in distinct), np.uint64, len(distinct))
    return own[codes]


def gram_hashes(hashes: np.ndarray) -> np.ndarray:
    h = np.zeros(max(0, len(hashes) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        h = (h ^ hashes[k:len(hashes) - GRAM + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def winnow(grams: np.ndarray) -> np.ndarray:
    """Places kept: in every window of ``WINDOW`` hashes the least, the last of equals."""
    if len(grams) <= WINDOW:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(views)) + WINDOW - 1 - views.argmin(axis=1))


class Index:
    """Inverted index from fingerprints to templates and places; as large as the templates."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        rows = []
        for k, t in enumerate(templates):
            grams = gram_hashes(word_hashes(list(t.words)))
            rows += [(int(grams[p]), k, int(p)) for p in winnow(grams)]
        rows.sort()
        self.prints = np.array([r[0] for r in rows], np.uint64)
        self.where = np.array([r[1:] for r in rows], np.int64).reshape(-1, 2)

    def hits(self, grams: np.ndarray, places: np.ndarray) -> np.ndarray:
        """``(text place, template, template place)`` of all common fingerprints."""
        lo = np.searchsorted(self.prints, grams[places], "left")
        n = np.searchsorted(self.prints, grams[places], "right") - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.column_stack([np.repeat(places, n), self.where[at]])


def align(want: tuple[str, ...], words: list[str], diagonal: int, band: int = BAND, taken: list[tuple[int, int]] = ()):
    """Best local alignment within ``band`` of ``text place - template place = diagonal``, outside the text places ``taken``.

    A match counts 2, a mismatch, insertion or omission -1.  Returns matched
    template places, first and last text place, the score, and the text places
    matched (or None).
    """
    low, high = diagonal - band, diagonal + len(want) + band
    shut = {j for a, b in taken for j in range(max(a, low), min(b, high) + 1)}
    width, n = 2 * band + 1, len(words)
    score = [[0] * (width + 2) for _ in range(len(want) + 1)]  # column c stands for text place i - 1 + diagonal + c - 1 - band
    back = [[0] * (width + 2) for _ in range(len(want) + 1)]
    best, end = 0, None
    for i in range(1, len(want) + 1):
        row, above, way = score[i], score[i - 1], back[i]
        for c in range(1, width + 1):
            j = i - 1 + diagonal + c - 1 - band
            if not 0 <= j < n or j in shut:
                continue
            step = above[c] + (2 if want[i - 1] == words[j] else -1)
            gap, skip = above[c + 1] - 1 if c < width else -1, row[c - 1] - 1
            top = max(step, gap, skip, 0)
            row[c] = top
            way[c] = 0 if not top else 1 if top == step else 2 if top == gap else 3
            if top > best:
                best, end = top, (i, c)
    if end is None:
        return None
    i, c = end
    matched, at = [], []
    while i and back[i][c]:
        j = i - 1 + diagonal + c - 1 - band
        if back[i][c] == 1:
            if want[i - 1] == words[j]:
                matched.append(i - 1)
                at.append(j)
            i -= 1
        elif back[i][c] == 2:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return (matched[::-1], at[-1], at[0], best, at[::-1]) if matched else None


def _holds(t: Template, got: tuple, coverage: float) -> bool:
    """Whether an alignment covers the template and all its musts, each run of them word after word."""
    matched, places = got[0], got[4]
    if len(matched) < coverage * len(t.words):
        return False
    where = dict(zip(matched, places))
    return all(m in where for m in t.musts) and all(where[m + 1] == where[m] + 1 for m in t.joined)


def scan(words: list[str], hits: np.ndarray, index: Index, coverage: float) -> list[tuple]:
    """Matches of one text: ``(template, coverage, first word, last word, matched words)``, best of overlapping ones."""
    found = []
    for k in np.unique(hits[:, 1]):
        t = index.templates[k]
        own = hits[hits[:, 1] == k]
        diagonals = own[:, 0] - own[:, 2]
        order = np.lexsort((own[:, 0], diagonals))
        seen, taken = [], []  # alignments made near this diagonal, and the spans of matches there
        for mine in np.split(order, np.flatnonzero(np.diff(diagonals[order])) + 1):
            d, places = int(diagonals[mine[0]]), own[mine, 0]
            seen = [s for s in seen if d - s[0] <= BAND]
            taken = [s for s in taken if d - s[0] <= 2 * BAND]
            for p in places:  # every fingerprint lies in an alignment made around it, or gives rise to one
                if any(a <= p <= b for _, a, b in seen):
                    continue
                got = align(t.words, words, d, taken=[s[1:] for s in taken])
                if got is None:
                    break
                seen.append((d, got[1], got[2]))
                if not _holds(t, got, coverage):
                    seen.append((d, int(p), int(p)))
                    break
                taken.append((d, got[1], got[2]))
                found.append((got[3], len(got[0]) / len(t.words), got[1], got[2], len(got[0]), int(k)))
    found.sort(key=lambda f: (-f[0] * f[1], -f[0], f[2], f[5]))
    out, taken = [], []
    for score, share, first, last, n, k in found:
        if all(last < a or first > b for a, b in taken):
            taken.append((first, last))
            out.append((k, share, first, last, n))
    return sorted(out, key=lambda m: m[2])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[Template] | None = None,
         coverage: float = COVERAGE) -> DataFrame:
    """One row per notice: ``(key, license_id, template, coverage, n_matched, start_char, end_char)``.

    ``coverage`` is the share of the template's words matched; the span is in code
    points of the whole text.  Of overlapping matches the best aligned is kept.
    Texts without a notice, null and empty ones give no row; repeated rows give
    theirs again.  Other columns are not read.
    """
    index = Index(templates if templates is not None else standard_templates())
    if any(len(t.words) < GRAM + WINDOW - 1 for t in index.templates):
        raise ValueError(f"templates need {GRAM + WINDOW - 1} words, or a notice may be missed")
    fields = [docs.schema[key], *[T.StructField(n, t) for n, t in (
        ("license_id", T.StringType()), ("template", T.StringType()), ("coverage", T.DoubleType()),
        ("n_matched", T.IntegerType()), ("start_char", T.IntegerType()), ("end_char", T.IntegerType()))]]

    def run(batches):
        for part, texts in text_slices(batches, text):
            split = [WORD.findall(t.lower()) for t in texts]
            flat = [w for d in split for w in d]
            sizes = np.array([len(d) for d in split])
            start = np.cumsum(sizes) - sizes
            hashes, rows, out = word_hashes(flat), [], []
            grams = gram_hashes(hashes)
            if not len(grams):
                continue
            # Windows over the whole slice keep all that a text's own windows keep; hits across texts are left out.
            places = winnow(grams)
            ends = np.minimum(start + np.maximum(sizes - GRAM + 1, 0), len(grams))
            own = [  # texts with no more hashes than one window keep their least
                np.array([e - 1 - int(np.argmin(grams[s:e][::-1]))]) for s, e in zip(start, ends) if 0 < e - s <= WINDOW]
            if own:
                places = np.unique(np.concatenate([places, *own]))
            hits = index.hits(grams, places)
            doc = np.searchsorted(start, hits[:, 0], "right") - 1
            inside = hits[:, 0] + GRAM <= start[doc] + sizes[doc]
            hits, doc = hits[inside], doc[inside]
            for d in np.unique(doc):
                mine = hits[doc == d]
                mine[:, 0] -= start[d]
                spans = None
                for k, share, first, last, n in scan(split[d], mine, index, coverage):
                    spans = spans or _spans(texts[d], split[d])
                    t = index.templates[k]
                    rows.append(d)
                    out.append((t.license_id, t.name, share, n, spans[first][0], spans[last][1]))
            if rows:
                kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]],
                    names=[f.name for f in fields])

    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, T.StructType(fields))


def _spans(text: str, words: list[str]) -> list[tuple[int, int]]:
    """Word spans in the text; lower-casing may lengthen a letter, so words are found in it as they stand."""
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    place = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
    if len(place) != len(low):  # a letter whose lower case depends on its neighbours
        return [m.span() for m in WORD.finditer(text)]
    return [(int(place[a]), int(place[b - 1]) + 1) for a, b in spans]
