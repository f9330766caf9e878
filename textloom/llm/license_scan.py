"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from importlib import resources
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, width

#: Share of a template's words, aligned in order, from which a text carries it.
COVERAGE = 0.8

#: Texts of public licenses, and notices that stand for longer ones.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "mit": MIT_GRANT
    + (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-2-clause": BSD_TERMS + BSD_WARRANTY,
    "bsd-3-clause": BSD_TERMS + BSD_NAMES + BSD_WARRANTY,
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "This project is licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-grant": MIT_GRANT.rsplit(",", 1)[0],
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
}

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(word: str) -> str:
    return word.lower().strip(".,;:()\"'") or word


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, whose second numbers rise (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back[i] = piles[at - 1] if at else -1
        tops[at:at] = [] if at < len(tops) else [b]
        piles[at:at] = [] if at < len(piles) else [i]
        tops[at], piles[at] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of equal words in a and b: equal ends first, then words that are unique to both as
    anchors, the longest rising run of them, and the gaps between in the same way. A gap without such
    anchors is aligned by a longest common subsequence."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, p, q = todo.pop()
        while i < j and p < q and a[i] == b[p]:
            out.append((i, p))
            i, p = i + 1, p + 1
        while i < j and p < q and a[j - 1] == b[q - 1]:
            j, q = j - 1, q - 1
            out.append((j, q))
        if i == j or p == q:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[p:q])
        place = {w: k for k, w in enumerate(b[p:q], p) if in_b[w] == 1}
        anchors = rising([(k, place[w]) for k, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in place])
        if anchors:
            for x, y in anchors:
                out.append((x, y))
                todo.append((i, x, p, y))
                i, p = x + 1, y + 1
            todo.append((i, j, p, q))
        else:
            out += common(a, b, i, j, p, q)
    return sorted(out)


def common(a: list[str], b: list[str], i: int, j: int, p: int, q: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two gaps by the Hunt-Szymanski method: memory grows with the matches."""
    where: dict[str, list[int]] = {}
    for y in range(q - 1, p - 1, -1):
        where.setdefault(b[y], []).append(y)
    return rising([(x, y) for x in range(i, j) for y in where.get(a[x], ())])  # in one x the places fall, so a run takes x once


def all_templates() -> dict[str, str]:
    """TEMPLATES and the whole licenses in the folder beside this file, by name."""
    whole = sorted(x for x in resources.files(__package__).joinpath("licenses").iterdir() if x.name.endswith(".txt"))
    return TEMPLATES | {x.name.removesuffix(".txt"): x.read_text() for x in whole}


class Template:
    """A template's words and those of which every text that carries it must have one: all but
    COVERAGE of the words can be missing, so of any more words one is there; the rarest serve."""

    def __init__(self, name: str, text: str, rarity: Counter, coverage: float):
        self.name = name
        self.words = [normal(w) for w in WORD.findall(text)]
        self.need = ceil(coverage * len(self.words) - 1e-9)
        self.times = Counter(self.words)
        #: The places of each word, as the bits of a whole number, from the template's start and from its end.
        self.places: dict[str, int] = {}
        self.backwards: dict[str, int] = {}
        for y, word in enumerate(self.words):
            self.places[word] = self.places.get(word, 0) | 1 << y
            self.backwards[word] = self.backwards.get(word, 0) | 1 << (len(self.words) - 1 - y)
        self.must: set[str] = set()
        missing = 0
        for word, n in sorted(Counter(self.words).items(), key=lambda x: (rarity[x[0]], -len(x[0]), x[0])):
            if missing > len(self.words) - self.need:
                break
            self.must.add(word)
            missing += n


def templates(coverage: float = COVERAGE, texts: dict[str, str] | None = None) -> list[Template]:
    texts = all_templates() if texts is None else texts
    rarity = Counter(w for t in texts.values() for w in {normal(x) for x in WORD.findall(t)} if len(w) <= 5)
    return [Template(name, text, rarity, coverage) for name, text in texts.items()]


def windows(words: list[str], t: Template) -> Iterator[tuple[int, int]]:
    """Stretches of a text around its words of t.must, each wide enough for the whole template; stretches
    that overlap are one."""
    reach = 2 * len(t.words)
    start = end = -1
    for k in (k for k, w in enumerate(words) if w in t.must):
        if start >= 0 and k - reach <= end:
            end = k + reach
        else:
            if start >= 0:
                yield start, min(end, len(words))
            start, end = max(0, k - reach), k + reach
    if start >= 0:
        yield start, min(end, len(words))


def reached(hits: list[int], bits: list[int], at: int, step: int, full: int, need: int) -> int:
    """The first of hits from `at` on (step 1) or back (-1) by which `need` of the template's words came in order, or -1. bits has the
    places of each hit's word in the template; the lengths of common subsequences with its starts are the zeros of one whole
    number, which a word changes by one addition."""
    state = full
    while 0 <= at < len(hits):
        places = state & bits[at]
        state = ((state + places) | (state - places)) & full
        if full.bit_length() - state.bit_count() >= need:
            return at
        at += step
    return -1


def stretches(words: list[str], t: Template) -> list[tuple[int, int]]:
    """(first, last) of stretches without common words, each shorter than twice the template with t.need of its
    words in order: the one that ends first, from its latest start, then the next behind it. No choice has more.

    A stretch can only end where so many words of the template, each as often as the template has it, lie within that reach. From
    the first such place the words that count in order are found forwards, and the latest start backwards from there.
    """
    m, full = len(t.words), (1 << len(t.words)) - 1
    hits = [x for x, w in enumerate(words) if w in t.places]
    ends, inside, count, lo = [], Counter(), 0, 0
    for k, x in enumerate(hits):
        word = words[x]
        inside[word] += 1
        count += inside[word] <= t.times[word]
        while hits[lo] <= x - 2 * m:
            count -= inside[words[hits[lo]]] <= t.times[words[hits[lo]]]
            inside[words[hits[lo]]] -= 1
            lo += 1
        if count >= t.need:
            ends.append((k, lo))
    forwards, backwards = [t.places[words[x]] for x in hits], [t.backwards[words[x]] for x in hits]
    out, at, e = [], 0, 0
    while True:
        while e < len(ends) and ends[e][0] < at:
            e += 1
        if e == len(ends):
            return out
        at = max(at, ends[e][1])
        last = reached(hits, forwards, at, 1, full, t.need)
        if last < 0:
            return out
        first = reached(hits, backwards, last, -1, full, t.need)
        if hits[last] - hits[first] < 2 * m:
            out.append((hits[first], hits[last]))
            at = last + 1
        else:
            at = first + 1


def occurrences(words: list[str], t: Template) -> Iterator[list[tuple[int, int]]]:
    """The alignment of every occurrence of a template: patience on each stretch with the words up to its neighbours, whose anchors reach
    beyond the stretch; if that has fewer than t.need words, as where nothing in it is unique, on the stretch alone without anchors."""
    found = stretches(words, t)
    lo = 0
    for (first, last), (hi, _) in zip(found, [*found[1:], (len(words), 0)], strict=False):
        lo, hi = max(lo, last + 1 - 2 * len(t.words)), min(hi, first + 2 * len(t.words))
        at, best = lo, tight(patience(words[lo:hi], t.words), t)
        if len(best) < t.need:
            at, best = first, common(words[first : last + 1], t.words, 0, last + 1 - first, 0, len(t.words))
        yield [(at + x, y) for x, y in best]
        lo = at + best[-1][0] + 1


def found_in(text: str, known: list[Template]) -> list[dict]:
    spans = list(WORD.finditer(text))
    words = [normal(m[0]) for m in spans]
    present = set(words)
    out = []
    for t in known:
        if present.isdisjoint(t.must):
            continue
        for lo, hi in windows(words, t):
            for aligned in occurrences(words[lo:hi], t):
                first, last = lo + aligned[0][0], lo + aligned[-1][0]
                out.append({"license": t.name, "words": len(aligned), "coverage": len(aligned) / len(t.words), "start": spans[first].start(), "end": spans[last].end()})
    return apart(out)


def apart(found: list[dict]) -> list[dict]:
    """Of finds that overlap, the one with most aligned words, then the most coverage, stays."""
    kept: list[dict] = []
    for x in sorted(found, key=lambda x: (-x["words"], -x["coverage"], x["start"], x["license"])):
        if all(x["end"] <= y["start"] or x["start"] >= y["end"] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x["start"])


def tight(aligned: list[tuple[int, int]], t: Template) -> list[tuple[int, int]]:
    """The part of an alignment within a stretch of twice the template's length that has most words."""
    best: list[tuple[int, int]] = []
    lo = 0
    for hi, (x, _) in enumerate(aligned):
        while x - aligned[lo][0] >= 2 * len(t.words):
            lo += 1
        if hi - lo + 1 > len(best):
            best = aligned[lo : hi + 1]
    return best


def scanned(batches: Iterator[pa.RecordBatch], coverage: float, texts: dict[str, str]) -> Iterator[pa.RecordBatch]:
    known = templates(coverage, texts)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [found_in(t or "", known) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, kind)], names=["key", "licenses"])


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE, texts: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """One row per license found: key, license, coverage, start, end (offsets in code points).

    Words compare in lower case without surrounding marks. A text carries a template if patience alignment
    puts at least `coverage` of the template's words in order into a stretch of twice its length; all
    occurrences in one text are rows of their own, as many as stretches without common words hold; of overlapping ones
    that with most aligned words stays, then that of the most coverage, the earlier, and the first name. The work is one
    pass without a shuffle.

    texts: the templates by name, or a table (license, text) of at most BROADCAST_BYTES, which goes to every task.
    Templates without words match nothing. Null, empty and blank texts have no rows; very long texts are scanned
    whole; repeated rows and null or repeated keys are scanned each; other columns, whatever their names, are ignored.
    """
    if isinstance(texts, DataFrame):
        table = texts.select("license", "text").where("license IS NOT NULL AND text IS NOT NULL")
        if width(table) > BROADCAST_BYTES:
            raise ValueError(f"templates of more than {BROADCAST_BYTES} bytes")
        texts = {r["license"]: r["text"] for r in table.orderBy("license", "text").collect()}
    texts = all_templates() if texts is None else texts
    texts = {name: t for name, t in texts.items() if WORD.search(t)}
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(lambda it: scanned(it, coverage, texts), f"key {kind}, licenses array<struct<license:string,coverage:double,start:long,end:long>>")
    return found.select(F.col("key").alias(key), F.explode("licenses").alias("x")).select(key, "x.license", "x.coverage", "x.start", "x.end")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
