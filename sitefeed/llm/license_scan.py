"""License scan by conditional compression.

Two kinds of templates: the full texts of common licenses with the standard
headers of others (``license_texts``, ``HEADERS``), and short notices, every name
form of a license (``FORMS``) in every wording of ``FRAMES``. A block is compressed
alone and once with each template in question as a zstandard raw dictionary; the
templates that save something are ranked by the share they save and confirmed by
the exact differences in wording. The license of the best confirmed template is
named; if several of its wordings are confirmed, the one with most words equal, an
edit counting as three, describes the place. Then the text before and after it is
tried again.

Only words that name a license or its version are untouchable, in the template
and in the text: they must stand in both. A notice is found as a whole, with at
most ``EDITS`` of its words edited. Of a full text any stretch is found that has
``LEAST`` words equal and at most one edit to three of them; such a stretch
always has three equal words in a row, by which blocks are found. Where licenses
share a wording and save the same, the shortest text that has it is named.

Words are letters, digits and non-ASCII, lower-cased in A-Z, so capitals, line
breaks and signs between words do not matter. Whole texts are searched. Null or
empty texts have no licenses. Spans count code points of the text, end
exclusive. Repeated rows give repeated rows; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import pkgutil
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.llm.common import per_batch
from sitefeed.llm.words import TO_LOWER, Texts, slices

# Common licenses, the forms of their names, the wordings of notices.
FULL = (
    "Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-SA-4.0", "CC0-1.0", "GFDL-1.2",
    "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1",
    "MPL-2.0", "NCSA", "OFL-1.1", "Unlicense", "Zlib",
)
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License "
    "as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. "
    "{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. "
    "You should have received a copy of the GNU {1}General Public License along with this {0}. If not, see https://www.gnu.org/licenses/."
)
HEADERS = (
    ("AGPL-3.0", _GNU.format("program", "Affero ", "3")),
    ("GPL-1.0", _GNU.format("program", "", "1")),
    ("GPL-2.0", _GNU.format("program", "", "2")),
    ("GPL-3.0", _GNU.format("program", "", "3")),
    ("LGPL-2.0", _GNU.format("library", "Library ", "2")),
    ("LGPL-2.1", _GNU.format("library", "Lesser ", "2.1")),
    ("LGPL-3.0", _GNU.format("library", "Lesser ", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
)


def _gnu(short: str, long: str, *versions: str) -> dict[str, tuple[str, ...]]:
    """Name forms of the versions of a GNU license."""
    out = {}
    for v in versions:
        shown = {v, v.removesuffix(".0")}
        forms = [f.format(x) for x in sorted(shown) for f in (f"GNU {long}, version {{}}", f"{long}, version {{}}", f"GNU {long} {{}}", f"GNU {long} v{{}}", f"{short} {{}}", f"{short}v{{}}", f"{short} v{{}}", f"{short} version {{}}", f"GNU {short} v{{}}", f"GNU {short}v{{}}")]
        out[f"{short}-{v}"] = tuple(forms)
    return out


def _commons(kind: str, words: str) -> dict[str, tuple[str, ...]]:
    return {f"CC-{kind}-{v}": (f"CC {kind} {v}", f"Creative Commons {words} {v}", f"Creative Commons {words} {v} International License", f"Creative Commons {kind} {v}") for v in ("4.0", "3.0")}


FORMS = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License v2.0", "Apache License, Version 2", "Apache 2 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"),
    "ISC": ("ISC License",),
    "MIT": ("MIT License", "MIT licence"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    **_gnu("AGPL", "Affero General Public License", "3.0"),
    **_gnu("GPL", "General Public License", "1.0", "2.0", "3.0"),
    **_gnu("LGPL", "Lesser General Public License", "2.1", "3.0"),
    **_gnu("LGPL", "Library General Public License", "2.0"),
    **_gnu("GFDL", "Free Documentation License", "1.2", "1.3"),
    **_commons("BY", "Attribution"),
    **_commons("BY-NC", "Attribution-NonCommercial"),
    **_commons("BY-SA", "Attribution-ShareAlike"),
    **_commons("BY-ND", "Attribution-NoDerivatives"),
    **_commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    **_commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
}
FRAMES = (
    "Licensed under the {}", "Licensed under {}", "Released under the {}", "Released under {}", "This work is licensed under the {}",
    "This work is licensed under a {}", "Available under the {}", "under the terms of the {}", "Licensed under the terms of the {}",
    "Distributed under the terms of the {}", "Published under the {}",
)
#: Words that name a license; in notices the numbers of versions, too, in texts those after "version".
NAMES = frozenset(
    "affero agpl agplv3 apache artistic boost bsd cc cc0 eclipse epl gfdl gnu gpl gplv1 gplv2 gplv3 isc lesser lgpl lgplv2 lgplv3 library "
    "mit mozilla mpl nc nd sa noncommercial noderivatives sharealike sil unlicense zlib simplified modified".split()
)
CUES = ("licen", "released", "permission", "redistribution", "copyright", "warrant", "gpl", "creative commons", "spdx", "under the terms", "available under", "published under")
WORD_CUES = (*(c.split()[0] for c in CUES if c not in ("under the terms",)), "terms")

#: Words on either side of a cue or seed; share of a notice's words that may differ.
AROUND, EDITS = 30, 0.25
#: Equal words that a stretch of a full text needs; equal words in a row that lead to it.
LEAST, SEED = 15, 3
#: Blocks longer than this are cut with an overlap of the longest notice.
BLOCK_WORDS = 120
LEVEL = 9
NEVER = 1_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def word_spans(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].translate(_LOWER), m.start(), m.end()) for m in _WORD.finditer(text)]


def words_of(text: str) -> list[str]:
    return [w for w, _, _ in word_spans(text)]


def is_number(word: str) -> bool:
    return word.removeprefix("v").isdigit()


class Template:
    """Name and words of a license; the words that are untouchable; its compressor."""

    def __init__(self, name: str, text: str, notice: bool):
        self.name, self.words = name, words_of(text)
        self.named = [w in NAMES or (notice and is_number(w)) for w in self.words]
        if not notice:
            for i in range(1, len(self.words)):
                after = self.words[i - 1] == "version" or (self.named[i - 1] and is_number(self.words[i - 1]))
                self.named[i] |= is_number(self.words[i]) and after
        self.names = {w for w, named in zip(self.words, self.named, strict=True) if named}

    @property
    @lru_cache(maxsize=None)  # noqa: B019
    def compressor(self) -> zstandard.ZstdCompressor:
        primer = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=primer, write_content_size=False)


@lru_cache(maxsize=1)
def notices() -> list[Template]:
    found: dict[tuple[str, tuple[str, ...]], Template] = {}
    for name, forms in FORMS.items():
        for text in [f.format(form) for form in forms for f in FRAMES] + [f"SPDX-License-Identifier: {name}"]:
            t = Template(name, text, True)
            found.setdefault((name, tuple(t.words)), t)
    return list(found.values())


@lru_cache(maxsize=1)
def full_texts() -> list[Template]:
    texts = [(n, (pkgutil.get_data("sitefeed.llm", f"license_texts/{n}.txt") or b"").decode()) for n in FULL]
    return [Template(n, t, False) for n, t in texts + list(HEADERS)]


@lru_cache(maxsize=1)
def vocabulary() -> tuple[dict[str, int], list[np.ndarray], dict[tuple[str, ...], list[int]]]:
    """Numbers of the words of all full texts; the texts in numbers; which texts have a run of ``SEED`` words."""
    numbers: dict[str, int] = {}
    coded, seeds = [], {}
    for k, t in enumerate(full_texts()):
        coded.append(np.array([numbers.setdefault(w, len(numbers)) for w in t.words]))
        for i in range(len(t.words) - SEED + 1):
            texts = seeds.setdefault(tuple(t.words[i : i + SEED]), [])
            if not texts or texts[-1] != k:
                texts.append(k)
    return numbers, coded, seeds


def savings(words: list[str], tried: list[Template]) -> list[tuple[float, int]]:
    """(share saved, place in ``tried``) of the templates that save something of a block, best first."""
    block = " ".join(words).encode()
    alone = len(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress(block))
    found = [(1 - len(t.compressor.compress(block)) / alone, k) for k, t in enumerate(tried)]
    return sorted((x for x in found if x[0] > 0), key=lambda x: (-x[0], x[1]))


def differences(template: Template, block: list[str]) -> tuple[int, int, int]:
    """Least word edits of the whole template to a stretch of the block: edits, begin, end."""
    size = len(block)
    fixed = [w in NAMES or is_number(w) for w in block]
    rows = [[0] * (size + 1)]
    skip = [NEVER if n else 1 for n in template.named]
    extra = [NEVER if n else 1 for n in fixed]
    for w, cost in zip(template.words, skip, strict=True):
        above, row = rows[-1], [rows[-1][0] + cost]
        for j, b in enumerate(block):
            change = 0 if w == b else max(cost, extra[j])
            row.append(min(above[j] + change, above[j + 1] + cost, row[-1] + extra[j]))
        rows.append(row)
    end = min(range(size + 1), key=lambda j: (rows[-1][j], j))
    i, j = len(template.words), end
    while i:
        w, cost = template.words[i - 1], skip[i - 1]
        if j and rows[i][j] == rows[i - 1][j - 1] + (0 if w == block[j - 1] else max(cost, extra[j - 1])):
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + cost:
            i -= 1
        else:
            j -= 1
    return rows[-1][end], j, end


def best_stretch(template: Template, coded: np.ndarray, words: list[str], numbers: dict[str, int]) -> tuple[int, int, int, int]:
    """The stretches of template and block that agree best: score, edits, begin and end in the block.

    The score is the number of equal words less three for an edit. Row by row of
    the block, over all places of the template at once; every cell carries where
    its stretch began and its edits.
    """
    n = len(coded)
    cost = np.where(np.array(template.named), NEVER, 3)
    skipped = np.concatenate([[0], np.cumsum(cost)])
    places = np.arange(n + 1)
    score, start, edits = (np.zeros(n + 1, np.int64) for _ in range(3))
    best = (0, 0, 0, 0)
    for i, w in enumerate(words):
        number, extra = numbers.get(w, -1), NEVER if w in NAMES else 3
        equal = coded == number
        above = score - extra
        here, since, changed = np.maximum(above, 0), np.where(above > 0, start, i + 1), np.where(above > 0, edits + 1, 0)
        along = score[:-1] + np.where(equal, 1, -np.maximum(cost, extra))
        better = along > here[1:]
        here[1:] = np.where(better, along, here[1:])
        since[1:] = np.where(better, np.where(score[:-1] > 0, start[:-1], i), since[1:])
        changed[1:] = np.where(better, np.where(score[:-1] > 0, edits[:-1], 0) + ~equal, changed[1:])
        # Words of the template that the text lacks.
        ahead = here + skipped
        running = np.maximum.accumulate(ahead)
        source = np.maximum.accumulate(np.where(ahead == running, places, 0))
        score = running - skipped
        start, edits = since[source], changed[source] + (places - source)
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(edits[at]), int(start[at]), i + 1)
    return best


def text_stretches(words: list[str]) -> list[tuple[int, int, str, int]]:
    """(begin, end, name, edits) in words of the stretches of full texts."""
    numbers, coded, seeds = vocabulary()
    hits = [(i, s) for i in range(len(words) - SEED + 1) if (s := seeds.get(tuple(words[i : i + SEED])))]
    regions: list[tuple[list[int], set[int]]] = []
    for i, texts in hits:
        low, high = max(0, i - AROUND), min(len(words), i + SEED + AROUND)
        if regions and low <= regions[-1][0][1]:
            regions[-1][0][1] = high
            regions[-1][1].update(texts)
        else:
            regions.append(([low, high], set(texts)))
    found = []
    for (low, high), texts in regions:
        known = [w in numbers for w in words[low:high]]
        if sum(known) < LEAST:
            continue
        pending = [(low, high)]
        while pending:
            a, b = pending.pop()
            if b - a < LEAST:
                continue
            # Texts that share too few words with the part, or no run, cannot be in it.
            part, inside = set(), set(words[a:b])
            for i in range(a, b - SEED + 1):
                part.update(seeds.get(tuple(words[i : i + SEED]), ()))
            tried = [k for k in sorted(part & texts) if sum(w in own_words(k) for w in words[a:b]) >= LEAST and inside]
            options = []
            for saved, k in savings(words[a:b], [full_texts()[k] for k in tried]) if tried else []:
                template = full_texts()[tried[k]]
                score, edits, begin, end = best_stretch(template, coded[tried[k]], words[a:b], numbers)
                if score > 0 and score + 3 * edits >= LEAST:
                    options.append((saved, (-score, len(template.words)), template.name, edits, a + begin, a + end))
            if options:
                *_, name, edits, begin, end = winner(options)
                found.append((begin, end, name, edits))
                pending += [(a, begin), (end, b)]
    return sorted(found)


def winner(options: list[tuple]) -> tuple:
    """Of confirmed (savings, difference, name, ...) the license with most savings, in its nearest wording."""
    name = min((-saved, difference, name) for saved, difference, name, *_ in options)[-1]
    return min((o for o in options if o[2] == name), key=lambda o: (o[1], -o[0], o[3:]))


@lru_cache(maxsize=None)
def own_words(k: int) -> frozenset[str]:
    return frozenset(full_texts()[k].words)


def candidate_blocks(words: list[str]) -> list[tuple[int, int]]:
    """Word ranges around cues, merged, cut to bounded length with overlaps."""
    ranges: list[list[int]] = []
    for i, w in enumerate(words):
        if any(c in w for c in WORD_CUES):
            begin, end = max(0, i - AROUND), min(len(words), i + AROUND + 1)
            if ranges and begin <= ranges[-1][1]:
                ranges[-1][1] = end
            else:
                ranges.append([begin, end])
    step = BLOCK_WORDS - max(len(t.words) for t in notices()) - 8
    return [(b, min(b + BLOCK_WORDS, end)) for begin, end in ranges for b in range(begin, max(begin + 1, end - (BLOCK_WORDS - step)), step)]


def licenses(text: str) -> list[tuple[int, int, str, int]]:
    """(begin, end, name, word edits) of the notices of a text."""
    spans = word_spans(text)
    words = [w for w, _, _ in spans]
    out = text_stretches(words)
    # The parts outside of full texts are searched for notices.
    low = 0
    for begin, end in [(a, b) for a, b, _, _ in out] + [(len(words), len(words))]:
        out = out + [(low + a, low + b, name, edits) for a, b, name, edits in short_notices(words[low:begin])]
        low = end
    return [(spans[a][1], spans[b - 1][2], name, edits) for a, b, name, edits in sorted(out)]


def short_notices(words: list[str]) -> list[tuple[int, int, str, int]]:
    """(begin, end, name, edits) in words of the notices."""
    found: dict[tuple[int, int], tuple[int, int, str]] = {}
    for begin, end in candidate_blocks(words):
        pending = [(begin, end)]
        while pending:
            low, high = pending.pop()
            inside = set(words[low:high])
            tried = [t for t in notices() if t.names <= inside]
            options = []
            for saved, k in savings(words[low:high], tried) if tried else []:
                own = tried[k]
                edits, a, b = differences(own, words[low:high])
                if edits <= EDITS * len(own.words):
                    options.append((saved, (4 * edits - len(own.words), 0), own.name, edits, low + a, low + b))
            if options:
                _, (rank, _), name, edits, a, b = winner(options)
                found[a, b] = min(found.get((a, b), (rank, edits, name)), (rank, edits, name))
                pending += [(low, a), (b, high)]
    # Overlapping blocks may both report a notice, one of them cut short.
    kept: list[tuple[int, int, str, int]] = []
    for (a, b), (_, edits, name) in sorted(found.items(), key=lambda x: (x[1][0], x[0])):
        if all(b <= c or a >= d for c, d, _, _ in kept):
            kept.append((a, b, name, edits))
    return sorted(kept)


def suspects(texts: Texts) -> np.ndarray:
    """Numbers of the texts with a cue."""
    small = TO_LOWER[texts.data].tobytes()
    marked = []
    for cue in CUES:
        at = small.find(cue.encode())
        while at >= 0:
            text = int(np.searchsorted(texts.offsets, at, "right")) - 1
            marked.append(text)
            at = small.find(cue.encode(), int(texts.offsets[text + 1]))
    return np.unique(np.array(marked, np.int64))


def scan(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, found (array of name, begin, end, edits)."""
    kind = pa.struct([("name", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])

    def work(batch: pa.RecordBatch):
        column = batch.column(1)
        found: list[list[dict]] = [[] for _ in range(len(column))]
        for texts in slices(column):
            for i in suspects(texts):
                row = texts.row + int(i)
                notices = licenses(column[row].as_py() or "")
                found[row] = [{"name": n, "begin": a, "end": b, "edits": e} for a, b, n, e in notices]
        yield pa.table({"doc_id": batch.column(0), "found": pa.array(found, pa.list_(kind))})

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return per_batch(rows, "doc_id bigint, found array<struct<name: string, begin: int, end: int, edits: int>>", work)


def report(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_notices, licenses (names, comma-joined), spans (name:begin:end:edits)."""
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["name"])))
    spans = F.transform("found", lambda x: F.concat_ws(":", x["name"], x["begin"], x["end"], x["edits"]))
    return scan(documents).select(
        "doc_id",
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(names, ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"),
    )
