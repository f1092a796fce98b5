"""Licence scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

A notice is a unit of a file that holds a cue word: a line or a sentence of it, a sentence whose wrapped lines are joined, or,
in a file named as a licence file, its whole text. Every notice and template is a sparse vector of term counts times inverse
template frequency. A template is compared only with units that hold its deciding terms (the names of licences and their versions, ``DECIDING``)
and, but for whole texts, no deciding term that is foreign to its licence: a near text with another name is another licence.
Whole texts come first: where one reaches ``WHOLE_COSINE`` with a template, the greatest such cosine decides;
otherwise the greatest cosine of the other units, at least ``MIN_COSINE``; below ``SURE_COSINE`` a unit must be nearer by ``MARGIN``
than to any other licence, or it names none. Equal cosines go to the template of more weight, as more of it was seen, then to
the licence that sorts first. A file without a licence inherits from
the nearest directory above that has a licence file (``LICENSE``, ``LICENCE``, ``COPYING`` or ``NOTICE``, with or without an ending)
with a known licence, of several the surest. DataFrame functions only; texts are known by 128 bits of them, so
copies are one, and directories, not files, are joined with their ancestors.

Defined cases: a null or empty text has no notice; rows without doc_id are scanned as any other; a null path has no
directory and inherits nothing; repeated rows, and several texts under one doc_id, are scanned each; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import checked_join, cut

MIN_COSINE, WHOLE_COSINE = 0.5, 0.75
#: What the best licence of a unit must be ahead of the next one, unless its cosine is this sure.
MARGIN, SURE_COSINE = 0.03, 0.9
#: Names of licences and their versions; a unit is a notice of the licence that it names, however near another text is.
DECIDING = (
    "0bsd affero agpl apache artistic attribution blueoak boost bsd bsl by cc cc0 cddl commercial eclipse epl eupl gpl isc lesser lgpl library "
    "microsoft mit mozilla mpl nc nd noderivatives noderivs noncommercial openssl proprietary python sa sharealike "
    "unencumbered unlicense wtfpl zlib v1 v2 v3 v4 1 2 3 4"
).split()
#: Every template holds one of these, and a unit without any is no notice.
CUE = r"(?i)licen[sc]|creative commons|\bcc(0|[ -]by)\b|copyright|spdx|permission (is hereby|to use)|redistribution|redistribute|general public|public domain"
SENTENCE, BLANK = r"\n|(?<!\b[Vv])\.\s+", r"\n[^\p{L}\p{N}\n]*\n|(?<!\b[Vv])\.\s+"  # not within "v. 2.0"
TERM = r"[a-z0-9]+"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)([.-].*)?$"
#: Rows of templates' terms that may be broadcast.
MOST_TERMS = 50_000

#: Identifiers of public licences as source files name them.
IDENTIFIERS = {
    "AGPL-3.0": ("AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0"),
    "Apache-2.0": ("Apache-2.0",),
    "BSD-2-Clause": ("BSD-2-Clause",),
    "BSD-3-Clause": ("BSD-3-Clause",),
    "CC-BY-4.0": ("CC-BY-4.0",),
    "0BSD": ("0BSD",),
    "Artistic-2.0": ("Artistic-2.0",),
    "BSL-1.0": ("BSL-1.0",),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0",),
    "CC-BY-NC-ND-4.0": ("CC-BY-NC-ND-4.0",),
    "CC-BY-NC-SA-4.0": ("CC-BY-NC-SA-4.0",),
    "CC-BY-ND-4.0": ("CC-BY-ND-4.0",),
    "EPL-1.0": ("EPL-1.0",),
    "EPL-2.0": ("EPL-2.0",),
    "LGPL-2.0": ("LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.0"),
    "WTFPL": ("WTFPL",),
    "Zlib": ("Zlib",),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0",),
    "CC0-1.0": ("CC0-1.0",),
    "GPL-2.0": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0"),
    "GPL-3.0": ("GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"),
    "ISC": ("ISC",),
    "LGPL-2.1": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1"),
    "LGPL-3.0": ("LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0"),
    "MIT": ("MIT",),
    "MPL-2.0": ("MPL-2.0",),
    "Unlicense": ("Unlicense",),
}

#: The usual short notices of public licences.
NOTICES = (
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "licensed under the BSD 2-Clause License"),
    ("CC-BY-4.0", "licensed under the Creative Commons Attribution 4.0 International License"),
    ("Artistic-2.0", "licensed under the Artistic License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-1.0", "licensed under the Eclipse Public License, version 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "licensed under the Eclipse Public License, version 2.0"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.0", "licensed under the GNU Library General Public License, version 2"),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("Zlib", "licensed under the zlib License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "licensed under the ISC License"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
    "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
#: Whole texts of public licences short enough to be given so; longer ones are known by their heads above.
TEXTS = (
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The "
        "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This "
        "notice may not be removed or altered from any source distribution",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ),
)
TEMPLATES = NOTICES + TEXTS + tuple((k, f"SPDX-License-Identifier: {name}") for k, names in IDENTIFIERS.items() for name in names)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TEMPLATES)], "template int, license string, notice string")


def terms(notice: Column) -> Column:
    return F.regexp_extract_all(F.lower(notice), F.lit(TERM), F.lit(0))


def deciding(found: Column) -> Column:
    """The deciding terms among an array of terms."""
    return F.array_intersect(found, F.array(*map(F.lit, DECIDING)))


def template_vectors(known: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(license, template, needs, allows, term, weight, norm) and (term, idf) of a table of templates, and their number; both are written.

    ``needs`` are the deciding terms of the template, ``allows`` those of all templates of its licence.
    """
    n = known.count()
    counted = cut(known.select("template", "license", F.explode(terms(F.col("notice"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf")), "template-terms")
    idf = cut(counted.groupBy("term").agg((F.log((1 + n) / (1 + F.count("*"))) + 1).alias("idf")), "idf")
    weighed = counted.join(idf, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    needs = known.select("template", "license", deciding(terms(F.col("notice"))).alias("needs"))
    allows = needs.groupBy("license").agg(F.array_distinct(F.flatten(F.collect_list("needs"))).alias("allows"))  # of a licence, fixed values
    rules = needs.join(allows, "license").drop("license")
    return cut(weighed.join(norms, "template").join(rules, "template").select("license", "template", "needs", "allows", "term", "weight", "norm"), "template-vectors"), idf, n


def notices(text: Column, is_licence: Column) -> Column:
    """The units of a text that hold a cue word, each once; the whole text, of a licence file, is the first."""
    lines = F.filter(F.split(text, SENTENCE), lambda s: s.rlike(CUE))
    joined = F.filter(F.transform(F.split(text, BLANK), lambda s: F.trim(F.regexp_replace(s, r"\s*\n[^\p{L}\p{N}\n]*", " "))), lambda s: s.rlike(CUE))
    return F.concat(F.array(F.when(is_licence, text)), F.array_distinct(F.concat(lines, joined)))


def detect(files: DataFrame, known: DataFrame, least: float = MIN_COSINE, whole: float = WHOLE_COSINE) -> DataFrame:
    """(key, is_licence, license, cosine) of the texts with a notice that is near enough to a template; ``files`` has (key, is_licence, text)."""
    vectors, idf, n = template_vectors(known)
    key = ["key", "is_licence"]
    units = files.where(F.col("text").rlike(CUE)).select(*key, F.posexplode(notices(F.col("text"), F.col("is_licence"))).alias("place", "notice")).where("notice is not null")
    # Copies of a text add to all counts of a unit alike, which leaves its cosines as they are.
    counted = units.select(*key, "place", F.explode(terms(F.col("notice"))).alias("term")).groupBy(*key, "place", "term").agg(F.count("*").alias("tf"))
    own = F.col("tf") * F.coalesce("idf", F.log(F.lit(1.0 + n)) + 1)
    weighed = cut(checked_join(counted, idf, "term", "left", limit=MOST_TERMS).withColumn("own", own), "notice-terms")
    decides = F.collect_set(F.when(F.col("term").isin(DECIDING), F.col("term")))  # no more than there are deciding terms
    norms = weighed.groupBy(*key, "place").agg(F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("own_norm"), decides.alias("decides"))
    shared = checked_join(weighed.where("idf is not null"), vectors, "term", "inner", limit=MOST_TERMS)
    dots = shared.groupBy(*key, "place", "license", "template", "norm", "needs", "allows").agg(F.sum(F.col("own") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, [*key, "place"]).withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("own_norm")), 9))
    foreign = F.size(F.array_except("decides", "allows")) > 0
    scored = scored.where((F.size(F.array_except("needs", "decides")) == 0) & ((F.col("place") == 0) | ~foreign))
    scored = scored.where(F.col("cosine") >= F.when(F.col("place") == 0, F.greatest(F.lit(whole), F.lit(least))).otherwise(F.lit(least)))
    per = scored.groupBy(*key, "place", "license").agg(F.max(F.struct("cosine", F.round("norm", 9).alias("norm"))).alias("m"))
    ranked = per.groupBy(*key, "place").agg(F.sort_array(F.collect_list(F.struct("m.cosine", "m.norm", "license")), asc=False).alias("all"))  # one per licence
    ahead = F.col("all")[0]["cosine"] - F.coalesce(F.try_element_at("all", F.lit(2))["cosine"], F.lit(0.0))
    sure = (F.col("place") == 0) | (F.col("all")[0]["cosine"] >= SURE_COSINE) | (ahead >= MARGIN)
    best = ranked.where(sure).select(*key, "place", F.explode(F.filter("all", lambda x: x["cosine"] == F.col("all")[0]["cosine"])).alias("x"))
    order = F.struct((F.col("place") > 0).alias("part"), (-F.col("x.cosine")).alias("least"), (-F.col("x.norm")).alias("norm"), F.col("x.license").alias("license"))
    return best.groupBy(*key).agg(F.min(order).alias("best")).select(*key, "best.license", (-F.col("best.least")).alias("cosine"))


def directory(path: Column) -> Column:
    """All of a path before its last slash; null without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def ancestors(folder: Column) -> Column:
    """The folder and all folders above it, deepest first."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, known: DataFrame | None = None, least: float = MIN_COSINE) -> DataFrame:
    """(doc_id, path, license, cosine, origin, licensed_by) of files (doc_id, path, text); origin is own, inherited or none."""
    is_licence = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE), F.lit(False))
    files = files.select("doc_id", "path", "text", F.unhex(F.md5("text")).alias("key"), is_licence.alias("is_licence"))
    found = cut(detect(files, templates(files.sparkSession) if known is None else known, least), "licenses")
    narrow = files.select("doc_id", "path", "key", "is_licence", directory(F.col("path")).alias("folder"))
    own = cut(checked_join(narrow, found, ["key", "is_licence"], "left").drop("key"), "own")
    licensed = own.where(F.col("is_licence") & F.col("license").isNotNull() & F.col("folder").isNotNull())
    granted = licensed.groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("least"), "license"))["license"].alias("granted"))
    folders = own.where("folder is not null").select("folder").distinct()
    above = folders.select(F.col("folder").alias("of"), F.posexplode(ancestors(F.col("folder"))).alias("up", "folder"))
    nearest = checked_join(above, cut(granted, "granted"), "folder", "inner").groupBy("of").agg(F.min(F.struct("up", "granted", "folder")).alias("near"))
    nearest = cut(nearest.select(F.col("of").alias("folder"), "near.granted", F.col("near.folder").alias("licensed_by")), "nearest")
    out = checked_join(own, nearest, "folder", "left")
    has = F.col("license").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "granted").alias("license"),
        F.round("cosine", 6).alias("cosine"),
        F.when(has, "own").when(F.col("granted").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("licensed_by")).alias("licensed_by"),
    )
