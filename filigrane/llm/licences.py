"""License scans: a positional index of rare licence words, relative positions that agree, mandatory phrases."""
from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.llm.common import base, id_out, map_arrow

#: The phrases whose every place counts, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public notices (label, text, phrases that must stand in a match; '|' separates alternatives).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
            "this permission notice shall be included in all copies or substantial portions of the Software.",
     ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
                     "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
                     "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
                     "materials provided with the distribution.",
     ["redistribution and use in source and binary forms", "must retain the above copyright notice"]),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
                     "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
                     "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
                     "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
                     "contributors may be used to endorse or promote products derived from this software without specific prior "
                     "written permission.",
     ["redistribution and use in source and binary forms", "to endorse or promote products derived from this software"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies.",
     ["for any purpose with or without fee is hereby granted", "appear in all copies"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
             "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions", ["provided as is without any express or implied warranty", "alter it and redistribute it freely"]),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
              "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
              "and transmit the Software, and to prepare derivative works of the Software",
     ["any person or organization obtaining a copy", "use reproduce display distribute execute and transmit"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
                  "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
                  "purpose, commercial or non-commercial, and by any means.",
     ["free and unencumbered software released into the public domain"]),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
               "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
               "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
     ["licensed under the apache license version 2 0", "except in compliance with the license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
            "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
     ["redistribute it and or modify it under the terms of the gnu general public license"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
             "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
             "version.", ["under the terms of the gnu lesser general public license|under the terms of the gnu library general public license"]),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
             "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
             "version.", ["under the terms of the gnu affero general public license"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
     ["subject to the terms of the mozilla public license"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
            "available at https://www.eclipse.org/legal/epl-2.0/", ["under the terms of the eclipse public license"]),
    ("proprietary", "This software is the confidential and proprietary information of the company. You shall not disclose such "
                    "confidential information and shall use it only in accordance with the terms of the license agreement you entered "
                    "into with the company.", ["confidential and proprietary information of", "shall not disclose such confidential information"]),
    ("gpl", "This work is licensed under the GNU General Public License", ["licensed under the gnu general public license"]),
    ("mit", "Released under the MIT License", ["released under the mit license"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["licensed under the apache license version 2 0"]),
]
#: Short marks. Creative Commons by name and by sign, and identifiers in file headers.
COMMONS = {"cc-by": ("BY", "Attribution"), "cc-by-sa": ("BY-SA", "Attribution-ShareAlike"), "cc-by-nc": ("BY-NC", "Attribution-NonCommercial"),
           "cc-by-nd": ("BY-ND", "Attribution-NoDerivatives"), "cc-by-nc-sa": ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
           "cc-by-nc-nd": ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")}
IDENTIFIERS = {"mit": "MIT", "apache": "Apache-2.0", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause", "isc": "ISC",
               "gpl": "GPL-3.0", "lgpl": "LGPL-2.1", "agpl": "AGPL-3.0", "mpl": "MPL-2.0", "epl": "EPL-2.0", "zlib": "Zlib", "boost": "BSL-1.0"}

#: Share of a template's anchor weight that has to stand at agreeing places.
COVERED = 0.7
#: Words by which places in a long template may drift apart, as a part of its length; short templates may not drift.
DRIFT, SHORT = 5, 12
#: Score of a text that holds a phrase but no template.
PHRASE_SCORE = 0.5

_SPLIT = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased."""
    return text.encode().translate(_SPLIT).split()


def default_templates() -> list[tuple[str, str, list[str]]]:
    """All notices, and the short marks spelt out."""
    out = list(TEMPLATES)
    for label, (sign, name) in COMMONS.items():
        for version in ("4.0", "3.0"):
            sign_words, name_words = (b" ".join(words(f"{x} {version}")).decode() for x in (f"CC {sign}", name))
            out.append((label, f"Licensed under CC {sign} {version}", [sign_words]))
            out.append((label, f"This work is licensed under a Creative Commons {name} {version} International License",
                        [f"creative commons {name_words}"]))
    for label, name in IDENTIFIERS.items():
        text = f"SPDX-License-Identifier: {name}"
        out.append((label, text, [b" ".join(words(text)).decode()]))
    return out


@dataclass
class Template:
    label: str
    size: int
    drift: int
    places: dict[bytes, np.ndarray]  # anchor word -> its places in the template
    weight: np.ndarray  # of every place, 0 where no anchor stands
    keys: list[list[list[bytes]]]  # mandatory phrases, each with its alternatives, as words


def build_index(templates: list[tuple[str, str, list[str]]], n: int, df: dict[bytes, int]) -> list[Template]:
    """The rarer half of each template's distinct words, three at least, are its anchors, by document frequency in the corpus
    (equal ones by the word); the inverse frequency is their weight."""
    out = []
    for label, text, keys in templates:
        ws = words(text)
        rare = sorted(set(ws), key=lambda w: (df.get(w, 0), w))
        anchors = rare[:max(3, (len(rare) + 1) // 2)]
        places = {w: np.array([i for i, x in enumerate(ws) if x == w], np.int64) for w in anchors}
        weight = np.zeros(len(ws))
        for w, at in places.items():
            weight[at] = math.log((n + 2) / (df.get(w, 0) + 1))
        out.append(Template(label, len(ws), 0 if len(ws) < SHORT else len(ws) // DRIFT, places, weight,
                            [[words(a) for a in k.split("|")] for k in keys]))
    return out


def find_phrase(ws: list[bytes], phrase: list[bytes], start: int = 0, end: int | None = None) -> list[int]:
    """Places in ws[start:end] at which the words of the phrase stand one behind the other."""
    out, n = [], len(phrase)
    end = len(ws) if end is None else min(end, len(ws))
    at = start
    try:
        while True:
            at = ws.index(phrase[-1], at, end)
            if at - n + 1 >= start and ws[at - n + 1:at + 1] == phrase:
                out.append(at - n + 1)
            at += 1
    except ValueError:
        return out


def match(ws: list[bytes], templates: list[Template], anchors: frozenset[bytes]) -> list[tuple[str, int, int, float]]:
    """(label, first word, end, score) of the templates in a text. A match that lies within one of a longer template goes."""
    found: dict[bytes, list[int]] = {}
    for i, w in enumerate(ws):
        if w in anchors:
            found.setdefault(w, []).append(i)
    if not found:
        return []
    out = []
    for t in templates:
        need = COVERED * t.weight.sum() - 1e-9
        if sum(t.weight[at].sum() for w, at in t.places.items() if w in found) < need:
            continue  # not even all together
        out += [(t.label, a, b, s, t.size) for a, b, s in _aligned(ws, t, found, need)]
    keep = [m for m in out if not any(o[4] > m[4] and o[1] <= m[1] and m[2] <= o[2] for o in out)]
    return sorted({(label, a, b, s) for label, a, b, s, _ in keep}, key=lambda m: (m[1], m[0], m[2]))


def _aligned(ws: list[bytes], t: Template, found: dict[bytes, list[int]], need: float):
    """Postings by relative position: anchors whose places in text and template differ by nearly the same number."""
    shift, place = [], []
    for w, at in t.places.items():
        if w in found:
            p = np.array(found[w], np.int64)
            shift.append((p[:, None] - at).ravel())
            place.append(np.broadcast_to(at, (len(p), len(at))).ravel())
    shift, place = np.concatenate(shift), np.concatenate(place)
    order = np.lexsort((place, shift))
    shift, place = shift[order].tolist(), place[order].tolist()
    weight = t.weight.tolist()
    times = [0] * t.size
    held, first, last, keys = 0.0, 0, 0, None
    while last < len(shift):
        q = place[last]
        held += weight[q] if not times[q] else 0.0
        times[q] += 1
        while shift[last] - shift[first] > t.drift:
            times[place[first]] -= 1
            held -= weight[place[first]] if not times[place[first]] else 0.0
            first += 1
        last += 1
        if held < need:
            continue
        while last < len(shift) and shift[last] - shift[first] <= t.drift:  # what else agrees with it
            q = place[last]
            held += weight[q] if not times[q] else 0.0
            times[q] += 1
            last += 1
        a = max(0, shift[first])
        b = min(len(ws), shift[last - 1] + t.size)
        if keys is None:
            keys = [sorted((k, k + len(alt)) for alt in key for k in find_phrase(ws, alt)) for key in t.keys]
        if all(_within(key, a, b) for key in keys):
            yield a, b, round(min(1.0, held / float(t.weight.sum())), 4)
            first, held, times = last, 0.0, [0] * t.size


def _within(places: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether the first of the places from a on ends before b; all are about equally long."""
    at = bisect_left(places, (a, 0))
    return at < len(places) and places[at][1] <= b


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of rows of (_id, _text) with words, and in how many of them each word of the vocabulary stands. Counts are summed
    per task first; no more than the vocabulary comes back."""
    def run(batches):
        n, df = 0, Counter()
        for b in batches:
            for t in b.column(1):
                ws = set(words(t.as_py()))
                n += bool(ws)
                df.update(ws & vocabulary)
        yield {"word": [None, *df], "n": [n, *df.values()]}
    got = map_arrow(docs, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in got}
    return count.pop(None, 0), count


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: list[tuple[str, str, list[str]]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places: array of label and start, matches: array of label, start, end and score; a row per row of docs.

    places are all places of the base phrases by start; matches are templates, found by their rarest words: one pass over
    the corpus counts in how many texts each licence word stands, a second one looks up every occurrence of a template's
    anchors, takes those whose places differ from the template's by nearly the same number, and keeps a stretch that
    covers COVERED of the anchor weight and holds every mandatory phrase. Starts and ends are words from 0, ends exclusive;
    score is the covered share.

    Null and empty texts have no words, a null id stays null, repeated rows give repeated results, an empty table gives an
    empty result. Nothing but the counts of licence words is shuffled; memory is bounded by the longest text."""
    docs = base(docs, id_col, text_col)
    chosen = default_templates() if templates is None else templates
    n, df = document_frequencies(docs, frozenset(w for _, text, _ in chosen for w in words(text)))
    index = build_index(chosen, n, df)
    anchors = frozenset(w for t in index for w in t.places)
    base_phrases = [(words(p), label) for p, label in (BASE_PHRASES if phrases is None else phrases).items()]

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"n_words": [], "places": [], "matches": []}
            for t in b.column(1):
                ws = words(t.as_py())
                at = sorted((k, label) for p, label in base_phrases for k in find_phrase(ws, p))
                out["n_words"].append(len(ws))
                out["places"].append([{"label": label, "start": k} for k, label in at])
                out["matches"].append([{"label": m[0], "start": m[1], "end": m[2], "score": m[3]} for m in match(ws, index, anchors)])
            yield {"_id": b.column(0)} | out
    return map_arrow(docs, run, "_id long, n_words long, places array<struct<label:string,start:long>>, "
                                "matches array<struct<label:string,start:long,end:long,score:double>>").select(
        id_out(), "n_words", "places", "matches")
