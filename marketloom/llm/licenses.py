"""License scans: cosine of sparse TF-IDF vectors to templates, and inheritance from the nearest directory above.

A file's headers are its lines that name a license cue, each alone and joined over gaps of GAP lines at most; a license
file is a file of LEAST_WORDS words or a license file's name whose whole text is close to a template. A tag's expression of several
licenses is given as such, and names and years beside a reservation of all rights don't count. A license has several templates: its text (license_texts/, where we
have it), its standard header, its name and notices of one line. Terms are words but STOP and pairs of them in lower case,
weighted by log inverse frequency over the templates. The template with the best cosine wins where it reaches LEAST; equal
cosines go to the first name, and Proprietary gives way to any license that reaches LEAST. A file without a header
of its own takes the license of the nearest license file in its directory or above, found by joining each file's
ancestor directories with the directories that have license files.

Null and empty texts have no license of their own; a null path has no directory and inherits nothing; texts of any length are
scanned whole, a text with a cue also against the templates as one; several license files in a directory give the first name; repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import table

LEAST = 0.6
#: So many directories at most are sent to every task; more are joined, where a directory of very many files is split by AQE.
BROADCAST_DIRECTORIES = 20_000
#: A file is a license file where its whole text reaches this.
LEAST_FILE = 0.5
CUES = ("license", "licence", "copyright", "spdx", "permission", "redistribut", "public domain", "all rights reserved")
TERM = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
#: Lines without a cue that may lie between two of a header, and lines after its last cue that it is tried with.
GAP = 8
TAILS = (0, 3, 16)
STOP = frozenset("a an and any are as at be been for from has have if in is it its not of on or such that the their this to was were which will with you your".split())
SPDX = re.compile(r"spdx-license-identifier:")
#: A tag's expression of several licenses, and its parts.
EXPRESSION = re.compile(r"spdx-license-identifier:[ \t]*([\w.+() -]*\b(?:or|and|with)\b[\w.+() -]*)", re.IGNORECASE)
PART = re.compile(r"[()]|[\w.+-]+")
#: Who holds the rights, and since when, in a notice that reserves them all.
HOLDER = re.compile(r"(copyright|©|\(c\))[^\n;]*?(?=[.,\s]*all rights reserved)", re.IGNORECASE)
#: A text without a license file's name is one only with so many words.
LEAST_WORDS = 20
FILE_NAME = re.compile(r"^(un)?licen[cs]e|^copying|^copyright|^notice", re.IGNORECASE)
#: Templates by license and, after a #, which of its templates it is.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under Creative Commons Attribution CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved. No part may be reproduced without permission.",
    "Proprietary#short": "All rights reserved.",
    "Proprietary#copyright": "Copyright (c). All rights reserved.",
}
NAMES = {
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "Apache-2.0": "Apache License, Version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-SA-4.0": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "Creative Commons Zero 1.0 Universal, CC0, public domain dedication",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "ISC": "ISC License",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "MIT": "MIT License",
    "MPL-2.0": "Mozilla Public License, version 2.0",
}
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details. You should have received a copy of the {} along with this program. If not, see https://www.gnu.org/licenses/."
for _name, _long in NAMES.items():
    TEMPLATES[f"{_name}#name"] = _name
    TEMPLATES[f"{_name}#long"] = f"Licensed under the {_long}."
    TEMPLATES[f"{_name}#see"] = f"Licensed under the {_long} - see the LICENSE file for details."
    if "GNU" in _long:
        _kind, _version = _long.split(", version ")
        TEMPLATES[f"{_name}#or-later"] = f"{_name}-or-later"
        TEMPLATES[f"{_name}#only"] = f"{_name}-only"
        TEMPLATES[f"{_name}#header"] = GNU.format(_kind, _version, _kind, _kind)
TEMPLATES["Apache-2.0#header"] = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
TEMPLATES["MPL-2.0#header"] = TEMPLATES["MPL-2.0"] + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
for _path in sorted(Path(__file__).with_name("license_texts").glob("*.txt")):
    TEMPLATES[f"{_path.stem}#text"] = _path.read_text()


def terms(text: str) -> Counter:
    words = [w for w in TERM.findall(text.lower()) if w not in STOP]
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


class Templates:
    """Weighted unit vectors of the templates, by term."""

    def __init__(self, texts: dict[str, str]):
        counts = {k: terms(t) for k, t in sorted(texts.items())}
        seen = Counter(t for c in counts.values() for t in c)
        self.idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in seen.items()}
        self.other = math.log(1 + len(counts)) + 1
        self.by_term: dict[str, list[tuple[str, float]]] = {}
        for name, c in counts.items():
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            for t, n in c.items():
                self.by_term.setdefault(t, []).append((name, n * self.idf[t] / norm))

    def best(self, text: str) -> tuple[str | None, float]:
        """The closest template and its cosine."""
        c = terms(text)
        norm = math.sqrt(sum((n * self.idf.get(t, self.other)) ** 2 for t, n in c.items()))
        dots: dict[str, float] = {}
        for t, n in c.items():
            for name, w in self.by_term.get(t, ()):
                dots[name] = dots.get(name, 0.0) + n * self.idf[t] * w
        if not dots:
            return None, 0.0
        name = min(dots, key=lambda k: (-dots[k], k))
        return name, dots[name] / norm


def expression(tag: str, templates: Templates) -> tuple[str | None, float]:
    """A tag's expression with the licenses' names as we have them, and the least of their cosines; None if none is known."""
    out, known = [], []
    for part in PART.findall(tag):
        name, cosine = (None, 0.0) if part.lower() in ("or", "and", "with", "(", ")") else templates.best(part)
        if name and cosine >= LEAST and (not out or out[-1] != "WITH"):
            known.append(cosine)
            out.append(name.partition("#")[0])
        else:
            out.append(part.upper() if part.lower() in ("or", "and", "with") else part)
    return (" ".join(out).replace("( ", "(").replace(" )", ")"), min(known)) if known else (None, 0.0)


def scan_text(text: str, templates: Templates, name: str = "") -> tuple[str | None, float, bool]:
    """License, cosine, and whether the text is a license file: close to a license as a whole, and as long as one or of a license file's name."""
    low = text.lower()
    tag = EXPRESSION.search(text) if "spdx-license-identifier" in low else None
    if tag is not None and (told := expression(tag[1], templates))[0]:
        return *told, False
    if "all rights reserved" in low:
        low = HOLDER.sub("copyright (c)", low)
    cues = [c for c in CUES if c in low]
    split = low.split("\n") if cues else []
    at = [i for i, line in enumerate(split) if any(c in line for c in cues)]
    if not at:
        return None, 0.0, False
    lines, runs = [split[i] for i in at], [[at[0], at[0]]]
    for i in at[1:]:
        if i - runs[-1][1] <= GAP + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    joined = [" ".join(split[i : min(j + 1 + tail, len(split))]) for i, j in runs for tail in TAILS if j > i]
    found = [templates.best(SPDX.sub("", header)) for header in dict.fromkeys(lines + joined)]
    found = [((x or "").partition("#")[0] or None, y) for x, y in found]
    given, cosine = max(found, key=lambda x: (x[1] >= LEAST and x[0] != "Proprietary", x[1], [-ord(c) for c in x[0] or ""]))
    whole, close = templates.best(SPDX.sub("", low))
    if close >= LEAST_FILE and (FILE_NAME.match(name) or len(text.split(None, LEAST_WORDS)) >= LEAST_WORDS):
        whole = whole.partition("#")[0]
        if whole == "Proprietary" != given and cosine >= LEAST:
            whole, close = given, cosine
        return whole, max(close, cosine if given == whole else close), True
    return (given, cosine, False) if cosine >= LEAST else (None, cosine, False)


def scan(files: DataFrame, keys: list[str], texts: dict[str, str] | None = None, path: str | None = None) -> DataFrame:
    """keys, license, cosine and is_license_file for each row of files, whose text is in column text; path is the key that names a file, if one does."""
    at = keys.index(path) if path is not None else None
    kept = files.select(*keys, F.col("text").alias("__text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", license string, cosine double, is_license_file boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates(texts or TEMPLATES)
        for batch in batches:
            named = [""] * batch.num_rows if at is None else [(p or "").rpartition("/")[2] for p in batch.column(at).to_pylist()]
            rows = [scan_text(t or "", own, n) for t, n in zip(batch.column(batch.num_columns - 1).to_pylist(), named)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_())))], [*keys, "license", "cosine", "is_license_file"])

    return kept.mapInArrow(run, out)


def licenses(files: DataFrame, key: str, path: str = "path", texts: dict[str, str] | None = None) -> DataFrame:
    """Rows (key, path, license, cosine, is_license_file, origin, from_directory): origin is header, file, inherited or none."""
    found = scan(files, [key, path], texts, path)
    parts = F.split(F.regexp_replace(F.col(path), "/[^/]*$", ""), "/")
    directory = F.when(F.instr(path, "/") > 0, F.regexp_replace(F.col(path), "/[^/]*$", "")).when(F.col(path).isNotNull(), F.lit(""))
    found = table(found.withColumn("__dir", directory), "scanned")
    holders = found.where("is_license_file AND __dir IS NOT NULL").groupBy(F.col("__dir").alias("above")).agg(F.min("license").alias("given"))
    # Each directory once, with itself and those above it, nearest last.
    steps = F.when(F.col("__dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    above = found.where("__dir IS NOT NULL").groupBy("__dir").agg(F.first(path).alias(path)).select("__dir", F.posexplode(steps).alias("depth", "above"))
    nearest = table(above.join(holders, "above").groupBy("__dir").agg(F.max_by(F.struct("given", "above"), "depth").alias("near")), "nearest")
    if nearest.count() <= BROADCAST_DIRECTORIES:
        nearest = F.broadcast(nearest)
    own = F.when(F.col("is_license_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return found.join(nearest, "__dir", "left").select(key, path, F.coalesce("license", "near.given").alias("license"), "cosine", "is_license_file", own.alias("origin"), F.when(own == "inherited", F.col("near.above")).alias("from_directory"))
