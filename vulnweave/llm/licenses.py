"""License scans: passages against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow

#: Names of licences as notices write them, by SPDX id. Each gives the short notices of NOTICES.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "AGPL-3.0 License"),
    "Apache-2.0": ("Apache License 2.0", "Apache 2.0 License", "Apache License, Version 2.0"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "CC-BY-4.0": ("CC BY 4.0 License", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0 License", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal License"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "GPL-2.0": ("GNU General Public License v2.0", "GNU General Public License, version 2", "GPL-2.0 License"),
    "GPL-3.0": ("GNU General Public License v3.0", "GNU General Public License, version 3", "GPL-3.0 License"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "Unlicense": ("Unlicense License",),
    "Zlib": ("zlib License",),
}

NOTICES = ("Licensed under the {}", "This project is licensed under the {}", "Released under the {}", "Distributed under the terms of the {}", "under the {}")

#: Notices and licences. A text holds a template if a passage is like it enough. What follows a slash tells apart the forms of one licence.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "all-rights-reserved-line": "All rights reserved.",
    "MIT/rest": 'IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT/grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "Copyright. All rights reserved. No part of this publication may be reproduced without written permission.",
}

TEMPLATES |= {f"{k}-line/{name}/{n}": notice.format(name) for k, names in NAMES.items() for name in names for n, notice in enumerate(NOTICES)}
TEMPLATES |= {f"{k}-line/spdx": f"SPDX-License-Identifier: {k}" for k in NAMES}

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def normalise(text: str) -> list[str]:
    """Lower-case words; numbers keep their dots."""
    return _WORD.findall(text.lower())


def _bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


class Scanner:
    """Templates by bigram, with the bounds on size that spare most comparisons."""

    def __init__(self, templates: dict[str, str], least: float) -> None:
        self.least = least
        self.own = {k: Counter(_bigrams(normalise(t))) for k, t in templates.items()}
        self.size = {k: sum(c.values()) for k, c in self.own.items()}
        self.at: dict[tuple[str, str], list[str]] = defaultdict(list)
        for k, c in self.own.items():
            for b in c:
                self.at[b].append(k)
        #: No passage of more bigrams can reach `least`, since the template has no more to share.
        self.longest = {k: int(n * (2 - least) / least) for k, n in self.size.items()}
        #: Dice >= least takes at least so many common bigrams, since a passage has at least as many as are common.
        self.fewest = {k: least * n / (2 - least) for k, n in self.size.items()}
        self.anchors = self._anchors(templates)

    def _anchors(self, templates: dict[str, str]) -> list[str]:
        """Words, the longest first, such that without any of them too few of a template's bigrams are left."""
        chosen: set[str] = set()
        for k in templates:
            for w in sorted({w for b in self.own[k] for w in b}, key=lambda w: (w not in chosen, -len(w), w)):
                if sum(n for b, n in self.own[k].items() if not chosen & set(b)) < self.fewest[k]:
                    break
                chosen.add(w)
        return sorted(w for w in chosen if not any(v != w and v in w for v in chosen))

    def passages(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, Dice, first word, words) of the best passage for each template that reaches `least`.

        A passage begins and ends with a bigram of the template, so what stands around it has no part in its figure. The
        first of equal ones counts, and of these the shortest.
        """
        low = text.lower()
        if not any(a in low for a in self.anchors):
            return []
        words = _WORD.findall(low)
        pairs = _bigrams(words)
        hits: dict[str, list[int]] = defaultdict(list)
        for i, b in enumerate(pairs):
            if b in self.at:
                for k in self.at[b]:
                    hits[k].append(i)
        found = []
        for k, places in hits.items():
            size, need, own, longest = self.size[k], self.fewest[k], self.own[k], self.longest[k]
            least = max(1, math.ceil(need - 1e-9))
            best, end = (0.0, 0, 0), 0
            for n, i in enumerate(places):
                while end < len(places) and places[end] < i + longest:
                    end += 1
                if end - n < least:  # the bounds on size: too few of the template's bigrams within the longest passage
                    continue
                window: Counter = Counter()
                common = 0
                for j in places[n:end]:
                    b = pairs[j]
                    window[b] += 1
                    common += window[b] <= own[b]
                    dice = 2 * common / (size + j - i + 1)
                    if dice > best[0]:
                        best = (dice, i, j - i + 2)
            if best[0] >= self.least:
                found.append((k, *best))
        return sorted(found)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """The best passage for each licence. Of passages about as long that overlap, those less like their templates don't count: versions of a licence differ in a word."""
        found = self.passages(text)
        kept: dict[str, tuple[str, float, int, int]] = {}
        for k, dice, at, n in found:
            rival = any(d > dice and 2 * (min(at + n, a + m) - max(at, a)) > n and m <= 2 * n and n <= 2 * m for _, d, a, m in found)
            name = k.split("/")[0]
            if not rival and (name not in kept or (dice, n) > (kept[name][1], kept[name][3])):
                kept[name] = (name, dice, at, n)
        return sorted(kept.values())


@functools.lru_cache(4)
def _scanner(templates: tuple[tuple[str, str], ...], least: float) -> Scanner:
    return Scanner(dict(templates), least)


def scan_licenses(docs: DataFrame, *, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license_id, dice, start_word, n_words: a row for each text and licence (or kind of notice) whose best passage has a Dice coefficient of `least` or more.

    Null or empty text: no row. Null doc_id: kept. Repeated rows: their results repeat. Ties: the longest template's passage, and of its own the first. Whole texts
    count. Empty table: no rows. Other columns are ignored. Templates are few and fixed; they go to the tasks with the code.
    """
    given = tuple(sorted((templates or TEMPLATES).items()))

    def rows(batches):
        scanner = _scanner(given, least)
        for batch in batches:
            out = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for x in scanner.scan(t)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["doc_id", "license_id", "dice", "start_word", "n_words"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, license_id string, dice double, start_word long, n_words long")
