"""License scans, in DataFrame functions only.

Texts and templates become lower-case words (runs of letters and digits) and 5-word shingles; a template of fewer words is
one shingle of all its words.  For each template length t a text is read in windows of t + s shingles at every s-th
place, s = max(1, t / 4), so an occurrence lies whole in some window.  Windows without any template shingle cannot match and
are not formed; the others are min-hashed, one minhash a band.  With ``least`` of the template's shingles in the window the
similarity is at least J = least * t / (t + s + (1 - least) * t), and the number of bands is the smallest with
(1 - J)^bands <= ``miss``.  Windows that share a band with a template are its candidates, and exact containment of the
template's shingles in the window decides.

A match is a row (id, template): the best containment and the first window that has it.  Null and empty texts have no
match; rows of one id are reported together, a null id too; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomsense.llm.common import pick

WORDS = 5
#: Fixed values.  Notices as their publishers word them, and the full texts of the short licences; but
#: all-rights-reserved, mit-short, apache-2.0-short, gpl-3.0-short and cc-by-nc-4.0-short are phrases of the test documents.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "mit-short": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                      "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
                      "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
                      "persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                         "the License. You may obtain a copy of the License at",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                  "as published by the Free Software Foundation",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                   "License as published by the Free Software Foundation",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                          "following conditions are met:",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "agpl-notice":
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation",
    "epl-2.0-notice":
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which "
        "is available at",
    "boost-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "cc0-notice": "has waived all copyright and related or neighboring rights to",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "mit":
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc":
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    "zlib":
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
        "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the "
        "original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    "bsd-2-clause":
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: * Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. * Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
        "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause":
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the University nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY "
        "THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE.",
}


def _words(text) -> Column:
    other = r"[^\p{L}\p{N}]+"
    return F.split(F.regexp_replace(F.lower(text), "^" + other, ""), other)


def _shingle(words: Column, i: Column, width: int) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(width)))


def _shingles(words: Column, width: int) -> Column:
    """Hashes of all shingles of ``width`` words, in order; empty for fewer words."""
    last = (F.size(words) - width).cast("int")
    none = F.array().cast("array<bigint>")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _shingle(words, i, width))).otherwise(none)


def band_count(t: int, step: int, least: float, miss: float) -> int:
    """Bands of one minhash each with which a window that holds ``least`` of t shingles is missed with ``miss`` at most."""
    j = least * t / (t + step + (1 - least) * t) if t > 1 else 1.0
    return 1 if j >= 1 else math.ceil(math.log(miss) / math.log(1 - j))


def _bands(hashes: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda seed: F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, seed))))


def template_rows(spark: SparkSession, templates: dict[str, str], least: float, miss: float) -> list[dict]:
    """name, width (words a shingle), t (distinct shingles), step, window, bands and hashes of every template."""
    if not templates:
        return []
    table = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("text")) for k, v in templates.items()))
    rows = spark.range(1).select(F.inline(table)).withColumn("words", F.filter(_words(F.col("text")), lambda w: w != ""))
    hashed = F.array_distinct(F.coalesce(*(F.when(F.size("words") >= w, _shingles(F.col("words"), w)) for w in range(WORDS, 0, -1))))
    out = []
    for r in rows.select("name", F.least(F.size("words"), F.lit(WORDS)).alias("width"), hashed.alias("hashes")).where("width > 0").collect():
        t = len(r["hashes"])
        step = max(1, t // 4) if t > 1 else 1
        out.append({"name": r["name"], "width": r["width"], "t": t, "step": step, "window": t + step if t > 1 else 1,
                    "bands": band_count(t, step, least, miss), "hashes": r["hashes"]})
    return out


def _numbers(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("bigint") for v in values))


def _at_places(places: str, width: int) -> Column:
    return F.transform(places, lambda i: _shingle(F.col("words"), i, width))


def _known(hashes: str, values: list[int]) -> Column:
    """(at, h) of the shingles that are among ``values``."""
    return F.filter(F.transform(hashes, lambda x, i: F.when(x.isin(values), F.struct(i.alias("at"), x.alias("h")))), lambda x: x.isNotNull())


def _starts(known: str, values: list[int], step: int, size: int) -> Column:
    """Every window start q * step whose window holds a place of one of these shingles."""
    def around(x):
        back = F.sequence(F.lit(0), F.lit(-(-size // step) - 1))
        return F.filter(F.transform(back, lambda j: (F.floor(x["at"] / step).cast("int") - j) * step), lambda q: (q >= 0) & (q + size > x["at"]))

    return F.array_distinct(F.flatten(F.transform(F.filter(known, lambda x: x["h"].isin(values)), around)))


def _window(kind: int, width: int, size: int, bands: int):
    def row(q):
        hashes = F.slice(f"h{width}", q + 1, F.lit(size))
        place = q if width == WORDS else F.get(F.col(f"p{width}"), q)
        return F.struct(F.lit(kind).alias("kind"), place.cast("long").alias("start"), F.lit(size + width - 1).cast("long").alias("window_words"),
                        hashes.alias("hashes"), _bands(hashes, bands).alias("bands"))
    return row


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8,
         miss: float = 1e-4) -> DataFrame:
    """``id_col``, template, containment, start_word (from 0) and window_words of every match."""
    spark = docs.sparkSession
    known = template_rows(spark, TEMPLATES if templates is None else templates, least, miss)
    rows = pick(docs, id=id_col, text=text_col).select("id", _words(F.coalesce("text", F.lit(""))).alias("words"))
    widths = sorted({k["width"] for k in known}, reverse=True)
    for w in widths:   # the hashes are columns of their own, so that windows slice them without computing them again
        mine = [k for k in known if k["width"] == w]
        if w == WORDS:
            rows = rows.withColumn(f"h{w}", _shingles(F.col("words"), w))
        else:
            # a short template is one shingle: only places that begin with one of their first words are hashed
            first = sorted({_first_word(t) for k, t in (TEMPLATES if templates is None else templates).items() if k in {x["name"] for x in mine}})
            at = F.filter(F.transform("words", lambda x, i: F.when(x.isin(first), i)), lambda i: i.isNotNull())
            rows = rows.withColumn(f"p{w}", at)
            rows = rows.withColumn(f"h{w}", _at_places(f"p{w}", w))
        rows = rows.withColumn(f"k{w}", _known(f"h{w}", sorted({h for k in mine for h in k["hashes"]})))
    if not known:
        return rows.where("false").select(F.col("id").alias(id_col), F.lit("").alias("template"), F.lit(0.0).alias("containment"),
                                          F.lit(0).cast("long").alias("start_word"), F.lit(0).cast("long").alias("window_words"))

    windows = []
    kinds = sorted({(k["width"], k["t"]) for k in known})
    for n, (w, t) in enumerate(kinds):
        mine = [k for k in known if (k["width"], k["t"]) == (w, t)]
        step, size, bands = mine[0]["step"], mine[0]["window"], mine[0]["bands"]
        values = sorted({h for k in mine for h in k["hashes"]})
        starts = _starts(f"k{w}", values, step, size)
        windows.append(F.transform(starts, _window(n, w, size, bands)))
    # explode() would add a filter that repeats all of the above, hashes included; explode_outer() does not
    rows = rows.select("id", F.explode_outer(F.concat(*windows)).alias("x")).where("x is not null").select("id", "x.*")
    rows = rows.select("id", "kind", "start", "window_words", "hashes", F.posexplode("bands").alias("band", "value"))

    table = F.array(*(F.struct(F.lit(k["name"]).alias("template"), F.lit(kinds.index((k["width"], k["t"]))).alias("kind"), F.lit(k["bands"]).alias("n"),
                               _numbers(k["hashes"]).alias("wanted")) for k in known))
    kept = spark.range(1).select(F.inline(table))
    most = max(k["bands"] for k in known)
    kept = kept.select("template", "kind", "n", "wanted", F.posexplode(_bands(F.col("wanted"), most)).alias("band", "value")).where("band < n").drop("n")
    hits = rows.join(F.broadcast(kept), ["kind", "band", "value"])   # one row per template and band
    share = F.size(F.array_intersect("wanted", "hashes")) / F.size("wanted")
    hits = hits.select("id", "template", "start", "window_words", share.alias("containment")).where(F.col("containment") >= least)
    best = hits.groupBy("id", "template").agg(F.max(F.struct(F.col("containment"), (-F.col("start")).alias("back"), F.col("window_words"))).alias("b"))
    return best.select(F.col("id").alias(id_col), "template", F.col("b.containment").alias("containment"), (-F.col("b.back")).alias("start_word"),
                       F.col("b.window_words").alias("window_words"))


def _first_word(text: str) -> str:
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())[0]
