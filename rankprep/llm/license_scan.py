"""License scans by conditional compression: how much smaller a block gets when a template is known."""

from __future__ import annotations

import bisect
import difflib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Wordings by which licenses are granted or rights kept; notices, openings of long texts, short texts whole.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD": (
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "proprietary": ("All rights reserved.",),
}
#: Names by which licenses are called; versions are read without a leading v and closing zeros.
NAMES = {
    "Apache-2.0": ("Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",),
    "GPL-3.0": ("GNU General Public License v3.0", "GPL v3.0"),
    "GPL-2.0": ("GNU General Public License v2.0", "GPL v2.0"),
    "LGPL-2.1": ("GNU Lesser General Public License v2.1", "LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License v3.0", "LGPL v3.0"),
    "AGPL-3.0": ("GNU Affero General Public License v3.0", "AGPL v3.0"),
    "MPL-2.0": ("Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "BSD": ("BSD License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "Unlicense": ("The Unlicense",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0", "CC BY 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0", "CC BY-ND 4.0"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC BY-NC-SA 4.0"),
    "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "CC BY-NC-ND 4.0"),
    "CC0-1.0": ("Creative Commons Zero 1.0", "CC0 1.0"),
}
#: Names of fewer bytes than this, too few to compress, are a notice after a grant only.
SHORT = 12
GRANTS = ("Licensed under", "Released under", "Distributed under")


def _wordings() -> dict[str, tuple[str, ...]]:
    """The notices, the names, and for each license its identifier after the tag that source files have."""
    out = {}
    for name in dict.fromkeys([*NOTICES, *NAMES]):
        own, names = [*NOTICES.get(name, ())], [*NAMES.get(name, ())]
        if names:
            gnu = name.split("-")[0].endswith("GPL")
            ids = [f"{name}{end}" for end in ("", "-only", "-or-later")] if gnu else [name]
            own += [f"SPDX-License-Identifier: {x}" for x in ids]
            if "-" in name:
                names += [name, name.replace("-", "v").removesuffix(".0")] if gnu else [name]
            own += [x for x in names if len(x) >= SHORT and " " in x or x.endswith("License")]
            own += [f"{grant} {x}" for grant in GRANTS for x in names if x not in own]
        out[name] = tuple(dict.fromkeys(own))
    return out


TEMPLATES = _wordings()
#: Words near which a notice may stand, wherever lines are broken.
_CUE = re.compile(
    rb"(?i)licen[cs]|copyright|rights|redistribut|\b[al]?gpl|\bcc0|\bmpl\b|provided[^a-z0-9]+as[^a-z0-9]+is|(?:released|distributed)[^a-z0-9]+under|"
    + b"|".join(
        rb"[^a-z0-9]+".join(words.split())
        for words in (b"eclipse public", b"free and unencumbered", b"permission is hereby", b"permission to use", b"public domain", b"creative commons", b"CC BY", b"free software", b"mozilla public", b"provided that the following")
    )
)
_WORD = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Words that tell licenses apart, and numbers of versions: a wording that lacks one of its own, or has one more, is another.
_TELLING = re.compile(rb"(?:a|l)?gpl(?:v?[0-9.]+)?|mpl|epl|cc0|[0-9]-clause|[a-z0-9]+(?:-[a-z0-9]+)*-[0-9]+(?:\.[0-9]+)*(?:-only|-or-later)?|affero|lesser|library|share|alike|sharealike|non|commercial|noncommercial|non-commercial|noderiv\w*|no-?derivatives|derivatives|nc|nd|sa|by(?:-\w+)+|attribution(?:-\w+)*|apache|mit|bsd|isc|mozilla|eclipse|v?[0-9]+(?:\.[0-9]+)*|not|no|except")
_VERSION = re.compile(rb"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*")
#: Other words that may stand between a wording's, besides one for each that is missing; short wordings take fewer.
MORE = 6


def _plain(words: list[bytes]) -> list[bytes]:
    """Lower-case words, versions without a leading v and closing zeros."""
    return [m[1] if (m := _VERSION.fullmatch(w)) else w for w in words]


class Scanner:
    """The wordings, and compressors for each, made once in each task."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least_share: float):
        import zstandard

        self.wordings = [(name, text) for name, own in sorted(templates.items()) for text in own]
        self.words = [_plain(_WORD.findall(text.lower().encode())) for _, text in self.wordings]
        self.kinds = [frozenset(w) for w in self.words]
        self.lost = [int(len(w) * (1 - least_share) + 1e-9) for w in self.words]  # words that may be missing
        self.more = [min(MORE, max(0, len(w) - 2)) for w in self.words]
        self.reach = max((len(w) for w in self.words), default=0) + MORE
        longest = max((sum(map(len, w)) + len(w) for w in self.words), default=0)

        def compressor(text: bytes) -> zstandard.ZstdCompressor:  # tables of a notice's size, as there is one for each wording
            given = {"dict_data": zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if text else {}
            size = zstandard.ZstdCompressionParameters.from_level(3, source_size=2 * longest, dict_size=len(text), write_content_size=False, write_dict_id=False)
            return zstandard.ZstdCompressor(compression_params=size, **given)

        self.alone = compressor(b"")
        self.given = [compressor(b"\n" * 8 + b" ".join(w)) for w in self.words]  # a dictionary's first bytes are not matched
        self.known: dict[tuple[bytes, int], tuple[int, float]] = {}  # notices repeat word for word

    def reduction(self, block: bytes, i: int) -> tuple[int, float]:
        """How many bytes smaller the block gets when the wording is known, and that relative to its size alone."""
        if (block, i) not in self.known:
            if len(self.known) >= 10_000:
                self.known.clear()
            alone = len(self.alone.compress(block))
            saved = alone - len(self.given[i].compress(block))
            self.known[block, i] = (saved, saved / alone)
        return self.known[block, i]

    def regions(self, text: bytes, starts: list[int]) -> Iterator[tuple[int, int]]:
        """Ranges of words around cues, a wording's length to either side; those that meet are one."""
        first = last = -1
        for m in _CUE.finditer(text):
            a, b = bisect.bisect_right(starts, m.start()) - 1, bisect.bisect_left(starts, m.end())
            a, b = max(0, a - self.reach), min(len(starts), b + self.reach)
            if first >= 0 and a <= last:
                last = max(last, b)
                continue
            if first >= 0:
                yield first, last
            first, last = a, b
        if first >= 0:
            yield first, last

    def align(self, i: int, near: list[bytes | None]) -> tuple[int, int, int] | None:
        """(start, end, words) of what these words have of the wording, in its order; None if another notice stands between."""
        same = [m for m in difflib.SequenceMatcher(None, self.words[i], near, autojunk=False).get_matching_blocks() if m.size]
        if not same or None in near[same[0].b : same[-1].b + same[-1].size]:
            return None
        return same[0].b, same[-1].b + same[-1].size, sum(m.size for m in same)

    def blocks(self, own: list[bytes | None]) -> list[tuple[tuple, int, int, int, float]]:
        """(rank, wording, start, end, relative reduction): candidate blocks, where enough words of a wording stand, by
        the bytes that knowing it saves. Blocks of one wording that meet count as the best of them, the fullest first; of
        equals the longest wording and the first place."""
        found, there = [], frozenset(own)
        for i, (want, kinds) in enumerate(zip(self.words, self.kinds, strict=True)):
            if not want or len(kinds - there) > self.lost[i]:
                continue
            inside = [0, *itertools.accumulate(w in kinds for w in own)]
            places: dict[tuple[int, int], int] = {}
            for p, w in enumerate(own):
                end = min(len(own), p + len(want) + self.more[i])
                if w not in kinds or inside[end] - inside[p] < len(want) - self.lost[i]:
                    continue
                got = self.align(i, own[p:end])
                if got is not None:
                    places[p + got[0], p + got[1]] = got[2]
            met: list[tuple] = []
            last = 0
            for a, b in [*sorted(places), (len(own), len(own))]:
                if met and a >= last:
                    best = max(saved for saved, *_ in met)
                    found += [((-best, -len(want), met[0][1], i, *rank), i, x, y, gain) for saved, x, y, gain, rank in met if saved > 0]
                    met = []
                if a < b:
                    saved, gain = self.reduction(b" ".join(own[a:b]), i)
                    met.append((saved, a, b, gain, (-places[a, b], b - a, a)))
                    last = max(last, b)
        return sorted(found)

    def confirm(self, i: int, block: list[bytes]) -> tuple[list[str], list[str]] | None:
        """(missing, extra): the exact differences from the wording; None if they are too many or tell another license."""
        same = [m for m in difflib.SequenceMatcher(None, self.words[i], block, autojunk=False).get_matching_blocks() if m.size]
        kept = {k for m in same for k in range(m.a, m.a + m.size)}
        inside = {k for m in same for k in range(m.b, m.b + m.size)}
        missing = [w for k, w in enumerate(self.words[i]) if k not in kept]
        extra = [w for k, w in enumerate(block) if k not in inside]
        if len(missing) > self.lost[i] or len(extra) > len(missing) + self.more[i] or any(_TELLING.fullmatch(w) for w in (*missing, *extra)):
            return None
        return [w.decode() for w in missing], [w.decode() for w in extra]

    def notices(self, text: bytes) -> list[dict]:
        """Every confirmed notice of a text, in its order; no two share a word."""
        lower = text.lower()
        places = [m.span() for m in _WORD.finditer(lower)]
        out = []
        for a, b in self.regions(text, [s for s, _ in places]):
            own: list[bytes | None] = _plain([lower[s:e] for s, e in places[a:b]])
            again = True
            while again:
                again = False
                for _, i, x, y, gain in self.blocks(own):
                    if None in own[x:y]:
                        continue
                    differences = self.confirm(i, own[x:y])
                    if differences is not None:
                        own[x:y] = [None] * (y - x)
                        out.append((places[a + x][0], {"license": self.wordings[i][0], "reduction": gain, "missing": differences[0], "extra": differences[1]}))
                        again = True
        out.sort(key=lambda x: x[0])
        line = before = 0
        for at, hit in out:
            line, before = line + text.count(b"\n", before, at), at
            hit["line"] = line
        return [hit for _, hit in out]


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least_share: float = 0.9) -> DataFrame:
    """(doc_id, line, license, reduction, missing, extra) of every confirmed notice in the whole texts.

    Around cues, each block that has ``least_share`` of a wording's words in order is compressed alone and with the wording
    as a raw zstandard dictionary, both as lower-case words joined by spaces. Blocks are ranked by the bytes saved; from
    the first on, one is confirmed by its exact differences in wording: at most MORE words besides one for each missing
    (fewer in short wordings), and none, missing or extra, that tells licenses apart (lesser, affero, a version). Confirmed
    notices share no word, and what is left is looked at again. ``line`` is where the notice begins, ``reduction`` the
    relative one of its block; ``missing`` and ``extra`` are the differences. A license's bare name is a notice.
    Null and empty texts have no notices; very long texts are scanned whole; repeated rows give repeated results; further
    columns are not looked at; an empty table gives an empty one.
    """
    templates = templates or TEMPLATES

    def scan(batch: pa.RecordBatch) -> Iterator[dict]:
        scanner = Scanner(templates, least_share)
        texts = batch.column(1).cast(pa.large_binary())
        for a in range(0, batch.num_rows, 500):
            out: dict[str, list] = {k: [] for k in ("doc_id", "line", "license", "reduction", "missing", "extra")}
            for i, text in enumerate(texts.slice(a, 500).to_pylist()):
                for hit in scanner.notices(text) if text and _CUE.search(text) else ():
                    out["doc_id"].append(batch.column(0)[a + i].as_py())
                    for k in ("line", "license", "reduction", "missing", "extra"):
                        out[k].append(hit[k])
            yield out

    schema = "doc_id long, line long, license string, reduction double, missing array<string>, extra array<string>"
    return map_arrow(docs.select("doc_id", "text"), scan, schema)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "line", "license", F.round("reduction", 6).alias("reduction"), F.size("missing").alias("n_missing"), F.size("extra").alias("n_extra"))
