"""Licence scans: sparse TF-IDF cosine of licence passages to templates, then
inheritance from the nearest ancestor directory by path joins.

DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from brook.llm.common import ready, scratch, text_key

# The texts of short licences, standard headers, titles and
# notices by which licences are known.
_AS_IS_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT'
    " LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
    " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)"
    " ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"
    " are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
    " this software without specific prior written permission. ")


def _gnu(name: str, version: str, program: str = "program") -> str:
    """The header that the GNU licences ask for."""
    return (
        f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free"
        f" Software Foundation, either version {version} of the License, or (at your option) any later version. This {program} is distributed in"
        " the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
        f" PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {program}."
        " If not, see https://www.gnu.org/licenses/.")


TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
            " documentation files",
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files'
            ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,'
            " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
            " furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included"
            ' in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS'
            " OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
            " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER"
            " IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
            " DEALINGS IN THE SOFTWARE."],
    "ISC": ["Licensed under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
            " that the above copyright notice and this permission notice appear in all copies.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
            ' that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR'
            " DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO"
            " EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING"
            " FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
            " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD + _AS_IS_BSD],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted",
                     _BSD + _BSD_NAMES + _AS_IS_BSD],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004",
                   "you may not use this file except in compliance with the Apache License",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the'
                   " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
                   ' law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES'
                   " OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and"
                   " limitations under the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "redistribute it and/or modify it under the terms of the GNU General Public License, version 3",
                "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _gnu("General Public License", "3")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "redistribute it and/or modify it under the terms of the GNU General Public License, version 2",
                "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _gnu("General Public License", "2")],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                 _gnu("Lesser General Public License", "3", "library")],
    "LGPL-2.1": ["licensed under the GNU Lesser General Public License, version 2.1.",
                 "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _gnu("Lesser General Public License", "2.1", "library")],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3.",
                 "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _gnu("Affero General Public License", "3")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
                " with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["Eclipse Public License - v 2.0",
                "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is"
                " available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
                  " compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial"
                  " or non-commercial, and by any means."],
    "CC0-1.0": ["Released under CC0 1.0.", "Creative Commons CC0 1.0 Universal public domain dedication"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
}
# Identifier lines: the licence's own name, with the endings that the GNU names take.
TEMPLATES = {name: [*texts, *[f"SPDX-License-Identifier: {name}{end}" for end in ("", *(("-only", "-or-later") if "GPL" in name else ()))]]
             for name, texts in TEMPLATES.items()}
# What marks a licence passage, where passages end, what a word
# is, which file names are licence files, and the least cosine of a match.
CUES = r"(?i)licen[sc]e|copyright|spdx|redistribut|hereby granted|unencumbered"
BREAKS = r"\n|(?<=[.!?;])[\x20\t]+"
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice)[^/]*$"
LEAST = 0.6
# What opens a comment line, what closes one, a block comment,
# and where sentences and paragraphs end.
OPENS = r"^[\x20\t]*(?:/\*+|\*+/|\*+|//+|#+|<!--|--+|;+|%+)[\x20\t]?"
CLOSES = r"[\x20\t]*(?:\*+/|-->)[\x20\t]*$"
BLOCK = r"/\*[^\x00]*?\*/|<!--[^\x00]*?-->"
SENTENCES = r"(?<=[.!?;])\s+"
PARAGRAPHS = r"\n[\x20\t\r]*\n"


def _bare(text: Column) -> Column:
    """A text without the marks of its comment lines."""
    return F.regexp_replace(F.regexp_replace(text, "(?m)" + OPENS, ""), "(?m)" + CLOSES, "")


def passages_of(body: Column) -> Column:
    """The passages of a text that may name a licence, as they stand: its lines
    and sentences; the sentences of its paragraphs, which may be wrapped over
    lines and behind comment marks; and its comments, runs of comment lines or
    block comments, as a whole."""
    cued = lambda parts: F.filter(parts, lambda x: x.rlike(CUES))
    joined = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    paragraphs = F.transform(cued(F.split(_bare(body), PARAGRAPHS)), joined)
    sentences = cued(F.flatten(F.transform(paragraphs, lambda x: F.split(x, SENTENCES))))
    # Lines that open no comment break the run.
    marked = F.transform(F.split(body, r"\r?\n"), lambda x: F.when(x.rlike(OPENS), _bare(x)).otherwise(F.lit("\x00")))
    runs = cued(F.split(F.array_join(marked, "\n"), "\x00"))
    blocks = F.transform(cued(F.regexp_extract_all(body, F.lit(BLOCK), F.lit(0))), _bare)
    return F.array_distinct(F.concat(cued(F.split(body, BREAKS)), sentences, F.transform(F.concat(runs, blocks), joined)))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def match_passages(passages: DataFrame) -> DataFrame:
    """``unit, licence, cosine`` of passages (``unit, passage, n``: a name,
    the text, how often it occurs) whose best template reaches ``LEAST``.

    Term weights are tf * (ln((1 + N) / (1 + df)) + 1) over all passages, each
    counted as often as it occurs, and all templates.  Only terms of templates
    are joined (a list of fixed size, broadcast); norms use all terms."""
    spark = passages.sparkSession
    texts = [(name, i, t) for name, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    # Aggregated, the templates' terms are a few hundred rows.
    templates = (spark.createDataFrame(texts, "licence string, variant int, passage string")
                 .select("licence", "variant", F.explode(_terms(F.col("passage"))).alias("term"))
                 .groupBy("licence", "variant", "term").agg(F.count("*").alias("tf")))
    terms = scratch(passages.select("unit", "n", F.explode(_terms(F.col("passage"))).alias("term"))
                    .groupBy("unit", "n", "term").agg(F.count("*").alias("tf")), "licence-terms")
    total = (passages.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) + len(texts)
    df = (terms.groupBy("term").agg(F.sum("n").alias("df"))
          .union(templates.groupBy("term").agg(F.count("*").alias("df"))).groupBy("term").agg(F.sum("df").alias("df")))
    idf = scratch(df.select("term", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf")), "licence-idf")
    weigh = lambda t: t.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    known = weigh(templates)
    norm = known.groupBy("licence", "variant").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm2"))
    known = F.broadcast(scratch(known.join(norm, ["licence", "variant"]).select(
        "licence", "variant", "term", (F.col("w") / F.col("norm2")).alias("w2")), "licence-templates"))
    found = weigh(terms).select("unit", "term", "w")
    norms = found.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = found.join(known, "term").groupBy("unit", "licence", "variant").agg(F.sum(F.col("w") * F.col("w2")).alias("dot"))
    best = dots.join(norms, "unit").select("unit", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")) \
        .where(F.col("cosine") >= LEAST)
    one = Window.partitionBy("unit").orderBy(F.desc("cosine"), "licence")  # at most a row for each template
    return best.withColumn("r", F.row_number().over(one)).where("r = 1").drop("r")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``doc, path, own_licence, cosine, licence, inherited_from`` of every row.

    Passages are lines, sentences (wrapped ones included) and whole comments
    with a licence cue (``passages_of``); a file whose name says licence,
    copying or notice is a passage as a whole as well.  Each distinct
    passage is compared with all templates once; ``own_licence`` is the best
    match of a file's passages (ties: the first name).  A file without one
    inherits the licence of the nearest directory above it (its own first)
    that holds a matched licence file; of several there, the best match,
    then the first name.

    Null and empty texts have no passages; a null path has no directory and
    neither gives nor inherits.  Repeated rows are separate rows with the same
    answer; null ids are carried through; other columns are not read.  An empty
    table gives an empty result."""
    ready(files)
    cued = F.coalesce(F.col(text_col).rlike(CUES), F.lit(False))
    named = F.coalesce(F.col(path_col).rlike(LICENCE_FILE), F.lit(False))
    body = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.when(cued, passages_of(body)).otherwise(F.array().cast("array<string>"))
    parts = F.array_distinct(F.concat(parts, F.when(named & (body != ""), F.array(body)).otherwise(F.array().cast("array<string>"))))
    folder = F.when(F.col(path_col).contains("/"), F.regexp_replace(F.col(path_col), "/[^/]*$", "")).when(
        F.col(path_col).isNotNull(), F.lit(""))
    rows = scratch(files.select(F.col(id_col).cast("long").alias("doc"), F.col(path_col).alias("path"), folder.alias("folder"),
                                named.alias("named"), text_key(text_col).alias("text_hash"), parts.alias("parts")),
                   "licence-rows")
    units = (rows.select("text_hash", F.explode("parts").alias("passage"))
             .select(F.xxhash64("passage").alias("unit"), "passage"))
    passages = scratch(units.groupBy("unit").agg(F.first("passage").alias("passage"), F.count("*").alias("n")), "licence-units")
    matched = scratch(match_passages(passages), "licence-matched")
    # The best match of each text: distinct texts, at most a row for each passage.
    of_text = (rows.where(F.size("parts") > 0).dropDuplicates(["text_hash", "named"])
               .select("text_hash", "named", F.explode("parts").alias("p"))
               .select("text_hash", "named", F.xxhash64("p").alias("unit")).join(matched, "unit"))
    order = F.struct((-F.col("cosine")).alias("c"), F.col("licence").alias("l"))
    of_text = scratch(of_text.groupBy("text_hash", "named").agg(F.min(order).alias("b"))
                      .select("text_hash", "named", F.col("b.l").alias("own_licence"), (-F.col("b.c")).alias("cosine")),
                      "licence-texts")
    own = scratch(rows.drop("parts").join(of_text, ["text_hash", "named"], "left"), "licence-own")
    given = (own.where("named AND own_licence IS NOT NULL AND folder IS NOT NULL").groupBy(F.col("folder").alias("above"))
             .agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own_licence").alias("l"))).alias("b"))
             .select("above", F.col("b.l").alias("given")))
    # Path join on distinct directories: each with itself and all above it.
    names = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/"))
    folders = own.where("own_licence IS NULL AND folder IS NOT NULL").select("folder").distinct()
    nearest = (folders.select("folder", F.posexplode(F.array_distinct(above)).alias("depth", "above")).join(given, "above")
               .groupBy("folder").agg(F.max(F.struct("depth", "above", "given")).alias("b"))
               .select("folder", F.col("b.above").alias("inherited_from"), F.col("b.given").alias("given")))
    out = own.join(scratch(nearest, "licence-folders"), "folder", "left")
    return out.select("doc", "path", "own_licence", "cosine", F.coalesce("own_licence", "given").alias("licence"),
                      F.when(F.col("own_licence").isNull(), F.col("inherited_from")).alias("inherited_from"))
