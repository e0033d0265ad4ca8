"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by path joins.

Units of a file are its lines (headers and notices, wherever they stand) and its blocks (runs of lines without a blank
one; a licence file is mostly one block). A unit's vector has a weight tf * idf for each of its words; the document
frequencies behind idf are counted over all files, for the words of the templates; a word in no template has the idf of an
unseen word. The licence of a file is the template with the largest cosine of all units, if at least ``THRESHOLD``. Dot
products of all units are summed sparsely from the words they share with templates; the full norm is taken only where the
bound from a norm with all words distinct reaches the threshold.

The whole of a file is one more unit, compared with the full licence texts: with a cosine of at least ``WHOLE`` it is a licence
file of that licence. So is a file that has a licence and is named like one (the way that long texts, of which there is no
full template, are found). A licence file's licence holds for its directory: files without a licence of their own inherit
from the nearest ancestor directory that has one. A passing phrase in a file licenses that file alone.
Directories are joined by path: the distinct directories of files are exploded into their ancestors (as many as the path
is deep), joined with licensed directories, and the deepest match wins; files then join their directory.

Defined results: null texts have no licence of their own; of equal cosines the first template wins; of several licence
files in a directory the one of the largest cosine (to six places), then of the smallest path, then the first licence by name; a null path inherits nothing; repeated rows
give repeated results; very long lines and files are scored whole, in memory proportional to their words; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, map_rows, materialise, salted_left_join, small, to_arrow

THRESHOLD = 0.6
WHOLE = 0.8
HOT_SHARE = 0.01
WORD = re.compile(r"[^\W_]+")
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([-._][^/]*)?$"
OWN = "key long, path string, license string, score double, whole boolean"

# Notices and opening paragraphs by licence identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "MIT": [
        "Released under the MIT License.",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal public domain dedication."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}


# Full licence texts by licence identifier.
FULL_TEXTS = {
    "MIT": [
        "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD-3-Clause": [
        "BSD 3-Clause License Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/",
    ],
}

def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Scorer:
    """Cosines of units to all templates."""

    def __init__(self, templates: dict[str, list[str]], df: dict[str, int], n: int, full: dict[str, list[str]] | None = None):
        full = FULL_TEXTS if full is None else full
        self.names = [k for k, texts in templates.items() for _ in texts]
        texts = [words_of(t) for all_of in templates.values() for t in all_of]
        wholes = [words_of(t) for all_of in full.values() for t in all_of]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts + wholes for w in t))}
        self.unseen = float(np.log((1 + n) / 1) + 1)
        self.idf = np.array([np.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in self.vocabulary])
        m = np.zeros((len(self.vocabulary), len(texts)))
        for j, t in enumerate(texts):
            for w in t:
                m[self.vocabulary[w], j] += 1
        m *= self.idf[:, None]
        self.whole_names = [k for k, texts_of in full.items() for _ in texts_of]
        self.wholes = np.zeros((len(self.vocabulary), len(wholes)))
        for j, t in enumerate(wholes):
            for w in t:
                self.wholes[self.vocabulary[w], j] += 1
        self.wholes *= self.idf[:, None]
        self.wholes /= np.sqrt((self.wholes * self.wholes).sum(0))
        # a word's contribution to the dot products, once for each time it occurs
        self.dots = self.idf[:, None] * m / np.sqrt((m * m).sum(0))

    def whole(self, words: list[str], code: np.ndarray) -> tuple[str, float] | None:
        """The full text that a file is, with its cosine."""
        if not self.whole_names:
            return None
        known = np.bincount(code[code >= 0], minlength=len(self.vocabulary)) * self.idf
        dot = known @ self.wholes
        norm = known @ known + (code < 0).sum() * self.unseen**2  # at least: with all unknown words distinct
        if dot.max() < WHOLE * np.sqrt(norm) - 1e-9:
            return None
        score, j = self.exact(words, dot)
        return (self.whole_names[j], score) if score >= WHOLE else None

    def exact(self, words: list[str], dot: np.ndarray) -> tuple[float, int]:
        tf: dict[str, int] = {}
        for w in words:
            tf[w] = tf.get(w, 0) + 1
        get = self.vocabulary.get
        norm = sum((c * (self.idf[i] if (i := get(w)) is not None else self.unseen)) ** 2 for w, c in tf.items()) ** 0.5
        best = int(np.argmax(dot))
        return float(dot[best] / norm), best

    def __call__(self, text: str | None, threshold: float) -> tuple[str, float, bool] | None:
        """``(licence, cosine, whether the file is a full licence text)``: of a full text, else of the best unit that reaches the
        threshold."""
        lines = [words_of(x) for x in (text or "").split("\n")]
        flat = [w for x in lines for w in x]
        if not flat:
            return None
        get = self.vocabulary.get
        code = np.array([get(w, -1) for w in flat], np.int64)
        if not (code >= 0).any():
            return None
        if found := self.whole(flat, code):
            return *found, True
        at = np.cumsum([0, *map(len, lines)])
        weight = np.where(code >= 0, self.idf[code], self.unseen) ** 2
        ends = np.concatenate([[0], np.cumsum(weight)])
        place = np.flatnonzero(code >= 0)
        which = np.searchsorted(at, place, side="right") - 1  # the line of each template word
        units = [(i, i + 1) for i in np.unique(which).tolist()]
        start = None
        for i, x in enumerate([*lines, []]):  # blocks of several lines
            if x and start is None:
                start = i
            elif not x and start is not None:
                if i - start > 1:
                    units.append((start, i))
                start = None
        best = None
        for a, b in units:
            lo, hi = np.searchsorted(place, [at[a], at[b]])
            if lo == hi:
                continue
            dot = self.dots[code[place[lo:hi]]].sum(0)
            if dot.max() < threshold * np.sqrt(ends[at[b]] - ends[at[a]]) - 1e-9:
                continue
            score, j = self.exact(flat[at[a] : at[b]], dot)
            if score >= threshold and (best is None or score > best[1] + 1e-12):
                best = (self.names[j], score, False)
        return best


def document_frequencies(files: DataFrame, text_col: str, templates: dict[str, list[str]]) -> tuple[dict[str, int], int]:
    """In how many files each template word occurs, and the number of files: counted in each task, then summed."""
    vocabulary = frozenset(w for known in (templates, FULL_TEXTS) for all_of in known.values() for t in all_of for w in words_of(t))

    def run(it):
        import pyarrow as pa

        df: dict[str, int] = {}
        n = 0
        for batch in it:
            for text in batch.column(0):
                n += 1
                for w in vocabulary.intersection(words_of(text.as_py() or "")):
                    df[w] = df.get(w, 0) + 1
        df[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(df)), pa.array(list(df.values()), pa.int64())], schema=arrow)

    arrow = to_arrow(files.sparkSession, "word string, n long")
    counts = files.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in counts.collect()}  # at most one row for each template word
    return found, found.pop("", 0)


def directory(path: Column) -> Column:
    """The directory of a path: all before the last slash; the root is empty."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, key_col: str, path_col: str, text_col: str, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``key, path, license, score, origin, from_dir`` of every file; ``origin`` is own, inherited or none."""
    templates = templates or TEMPLATES
    df, n = document_frequencies(files, text_col, templates)

    def make():
        scorer = Scorer(templates, df, n)

        def each(row):
            key, path, text = row
            yield key, path, *(scorer(text, threshold) or (None, None, False))

        return each

    own = map_rows(files.select(F.col(key_col).cast("long"), F.col(path_col).cast("string"), F.col(text_col)), make, OWN)
    own = materialise(own.withColumn("dir", F.coalesce(directory(F.col("path")), F.lit(""))), "licence-own")
    holders = own.where("license IS NOT NULL AND path IS NOT NULL").where(F.col("whole") | F.col("path").rlike(LICENCE_NAME))
    licensed = holders.groupBy("dir").agg(F.min(F.struct((-F.round("score", 6)).alias("s"), "path", "license"))["license"].alias("dir_license"))
    licensed = materialise(licensed.withColumnRenamed("dir", "from_dir"), "licence-dirs")
    bare = own.where("license IS NULL AND path IS NOT NULL")
    dirs = bare.groupBy("dir").agg(F.count("*").alias("files"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    chain = dirs.select("dir", F.explode(F.array_union(F.array(F.lit("")), above)).alias("from_dir"))  # the root is above relative paths too
    found = chain.join(checked_broadcast(licensed), "from_dir")
    nearest = found.withColumn("r", F.row_number().over(Window.partitionBy("dir").orderBy(F.length("from_dir").desc()))).where("r = 1")
    nearest = materialise(nearest.select("dir", "from_dir", "dir_license"), "licence-nearest")
    if small(nearest):
        joined = own.join(F.broadcast(nearest), "dir", "left")
    else:
        hot = dirs.where(F.col("files") > max(1000, int(n * HOT_SHARE))).select("dir")  # fewer than 1 / HOT_SHARE rows
        joined = salted_left_join(own, nearest, "dir", hot)
    inherits = F.col("license").isNull() & F.col("dir_license").isNotNull() & F.col("path").isNotNull()
    return joined.select(
        "key", "path",
        F.coalesce("license", F.when(inherits, F.col("dir_license"))).alias("license"),
        F.round("score", 6).alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("from_dir")).alias("from_dir"),
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree by source and thousands and hundreds of their id; each tenth is named as a notice, so that
    its licence, if it has one, holds for its directory. (The table has no paths; these are made up.)"""
    doc = F.col("doc_id")
    name = F.when(doc % 10 == 0, F.concat(F.lit("NOTICE."), doc.cast("string"))).otherwise(F.concat(doc.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), F.floor(doc / 1000).cast("string"), F.floor(doc / 100).cast("string"), name)
    return scan(docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text").withColumnRenamed("key", "doc_id")
