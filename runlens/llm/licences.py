"""Licence scan: TF-IDF cosine of notices to templates, then inheritance from the nearest directory with a licence file.

Only DataFrame functions. A notice is a sentence that names a licence, a block (lines up to an empty one, joined, without
comment marks) or a whole text; sentences are compared with TEMPLATES, blocks and texts with HEADERS and the files in
`licence_texts`. SPDX identifiers count as they are. Equal notices are compared once. Term weights come
from the templates: (1 + ln count) times ln((1 + templates) / (1 + templates with the term)) + 1. A file without a licence
of its own takes that of the nearest directory above it that holds a licence file; directories are resolved once each, by
joins of a directory's ancestors to the directories that have one.
"""

from __future__ import annotations

from itertools import chain
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.llm import common

# Licence identifiers and the sentences by which files name them.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
_gnu = [("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")]
_dates = {"GPL-2.0": "June 1991", "GPL-3.0": "29 June 2007", "LGPL-2.1": "February 1999", "LGPL-3.0": "29 June 2007", "AGPL-3.0": "19 November 2007"}
_free = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, "
_hope = (" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
         "PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program.")
_later, _only = "either version {1} of the License, or (at your option) any later version.", "version {1} of the License."
_apache = ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
           " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
           ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
           "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.")
_mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:")
_isc = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.")
_names = [("MIT", "MIT License"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache 2.0 License"), ("BSD-2-Clause", "BSD 2-Clause License"),
          ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License 2.0"), *[(k, f"GNU {n}General Public License v{v}") for k, n, v in _gnu]]
#: Headers of files as one block and in part, titles, and the sentence of project descriptions.
HEADERS = [
    *[(k, (_free + how + rest).format(n, v)) for k, n, v in _gnu for how in (_later, _only) for rest in ("", _hope)],
    *[(k, f"GNU {n}General Public License Version {v}{date}") for k, n, v in _gnu for date in ("", f", {_dates[k]}")],
    *[("Apache-2.0", "".join(_apache[:k])) for k in (1, 2, 3)], ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", _mpl + " If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."), ("MPL-2.0", _mpl), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MIT", _mit), ("ISC", _isc), *_names, *[(k, f"This project is licensed under the {n} - see the LICENSE file for details.") for k, n in _names],
]
#: Licences by their SPDX identifier.
SPDX = sorted({k for k, _ in TEMPLATES + HEADERS} | set("0BSD Artistic-2.0 BSL-1.0 EPL-1.0 EPL-2.0 GPL-1.0 LGPL-2.0 MIT-0 MPL-1.1 OFL-1.1 Unlicense WTFPL Zlib".split()))
NOTICE = "licen[cs]e|hereby granted|spdx"
BLOCK_NOTICE = NOTICE + "|redistribution and use"
LEAST = 0.7
#: A licence file has one of these names, or its notice is at least this share of its words.
FILE_NAMES = "(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
FILE_SHARE = 0.25


def sentences(text: Column) -> Column:
    """Parts of lines that end with a full stop, semicolon, question or exclamation mark before a space, in lower case."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "([.;!?])[ \t\r]+", "$1\n"), "\n")


def blocks(text: Column) -> Column:
    """Lines up to an empty one, joined, in lower case and without comment marks; and the whole text in the same way."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?m)^[ \t]*(?:/\*+|//+|\*+/?|#+|;+|--+|<!--|%+|rem\b|dnl\b)|\*/|-->|\r", "")
    joined = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.array_distinct(F.transform(F.array_append(F.split(plain, r"\n[ \t]*\n"), plain), joined))


def identifiers(text: Column) -> Column:
    """Licences named after SPDX-License-Identifier, each once."""
    rest = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("spdx-license-identifier:[ \t]*([^\n]*)"), 1)
    named = F.transform(F.flatten(F.transform(rest, lambda x: F.split(x, "[^a-z0-9.+-]+"))), lambda x: F.regexp_replace(x, r"(-only|-or-later|\+)$", ""))
    known = F.create_map(*chain.from_iterable((F.lit(x.lower()), F.lit(x)) for x in SPDX))
    return F.array_distinct(F.filter(F.transform(named, lambda x: F.element_at(known, x)), lambda x: x.isNotNull()))


def terms(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit("[a-z0-9]+(?:[.][0-9]+)?"), 0)


def long_templates() -> list[tuple[str, str]]:
    """Headers and full texts."""
    return HEADERS + [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))]


def templates(spark: SparkSession, fixed: list[tuple[str, str]]) -> DataFrame:
    """A fixed list with a number for each."""
    order = Window.partitionBy(F.lit(0)).orderBy("text")
    return spark.createDataFrame(fixed, "licence string, text string").select("licence", F.row_number().over(order).alias("template"), F.lower("text").alias("text"))


def weighted(texts: DataFrame, ids: list[str], text: str, idf: DataFrame, unseen: Column) -> DataFrame:
    """ids, term, w: unit vectors of the texts."""
    counts = texts.select(*ids, F.explode(terms(F.col(text))).alias("term")).groupBy(*ids, "term").agg(F.count("*").alias("tf"))
    idf = F.broadcast(idf.withColumnRenamed("term", "_t"))  # one row per term of the fixed templates
    w = counts.join(idf, F.col("term") == F.col("_t"), "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", unseen))
    norm = w.groupBy(*ids).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, ids).select(*ids, "term", (F.col("w") / F.col("norm")).alias("w"))


def notices(rows: DataFrame, least: float, texts: list[tuple[str, str]]) -> DataFrame:
    """id, licence, score: distinct notices (columns id, notice) that reach `least` with a template of `texts`, and the best one."""
    fixed = templates(rows.sparkSession, texts)
    n = len(texts)
    df = fixed.select("template", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    unseen = F.log(F.lit(1.0 + n)) + 1
    known = weighted(fixed, ["licence", "template"], "text", idf, unseen).select("licence", "template", F.col("term").alias("_t"), F.col("w").alias("v"))
    own = weighted(rows.dropDuplicates(["id"]), ["id"], "notice", idf, unseen)
    cosine = own.join(F.broadcast(known), F.col("term") == F.col("_t")).groupBy("id", "licence", "template").agg(F.sum(F.col("w") * F.col("v")).alias("score"))
    cosine = cosine.withColumn("score", F.round("score", 6)).where(F.col("score") >= least)
    best = cosine.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("id", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    """Everything before the last slash; empty for a name alone."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The folder itself and those above it, the nearest first; the last is the empty one."""
    parts = F.split(folder, "/")
    inner = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.array_distinct(F.concat(inner, F.array(F.lit(""))))


def scanned(files: DataFrame, key: str, path: str = "path", text: str = "text", least: float = LEAST) -> DataFrame:
    """Key, path, own_licence and own_score (best notice of the whole text; 1 for an identifier), licence (own, else inherited), from_directory.

    Rows with null or empty text have no notice but inherit; a null path has no directory and inherits from none but
    keeps its own. Repeated rows are kept. Of several licence files of a directory the best score counts, then the
    licence's name. Ties between notices go to the licence's name. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = F.array_distinct(F.filter(sentences(body), lambda s: s.rlike(NOTICE)))
    long = F.filter(blocks(body), lambda s: s.rlike(BLOCK_NOTICE))
    some = body.rlike("(?i)" + BLOCK_NOTICE)
    rows = files.select(
        F.col(key), F.col(path), F.size(common.words(body)).alias("_words"), F.when(some, found).alias("_found"), F.when(some, long).alias("_long"),
        F.when(body.rlike("(?i)spdx"), identifiers(body)).alias("_spdx"))
    rows = common.saved(rows.withColumn("_row", F.monotonically_increasing_id()), "files")

    def scored(column: str, texts: list[tuple[str, str]]) -> DataFrame:
        each = rows.select("_row", "_words", F.explode(column).alias("notice")).withColumn("id", F.xxhash64("notice"))
        with_words = each.select("_row", "id", (F.size(common.words(F.col("notice"))) / F.col("_words")).alias("_share"))
        return with_words.join(notices(each.select("id", "notice"), least, texts), "id").select("_row", "licence", "score", "_share")

    named = rows.select("_row", F.explode("_spdx").alias("licence"), F.lit(1.0).alias("score"), F.lit(0.0).alias("_share"))
    every = scored("_found", TEMPLATES).unionByName(scored("_long", long_templates())).unionByName(named)
    own = every.groupBy("_row").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence", (-F.col("_share")).alias("share"))).alias("b"))
    own = own.select(F.col("_row").alias("_r"), F.col("b.licence").alias("own_licence"), (-F.col("b.s")).alias("own_score"), (-F.col("b.share")).alias("_share"))
    rows = common.saved(rows.drop("_found", "_long", "_spdx").join(own, F.col("_row") == F.col("_r"), "left").drop("_r", "_row").withColumn("_dir", directory(F.col(path))), "own")
    name = F.regexp_extract(F.col(path), "([^/]*)$", 1)
    holders = rows.where("own_licence is not null and _dir is not null").where(name.rlike(FILE_NAMES) | (F.col("_share") >= FILE_SHARE))
    holders = holders.groupBy("_dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_licence")).alias("b"))
    holders = holders.select(F.col("_dir").alias("_holder"), F.col("b.own_licence").alias("_licence"))
    folders = rows.where("own_licence is null and _dir is not null").select("_dir").distinct()
    upward = folders.select("_dir", F.posexplode(ancestors(F.col("_dir"))).alias("_steps", "_up")).join(holders, F.col("_up") == F.col("_holder"))
    nearest = upward.groupBy("_dir").agg(F.min(F.struct("_steps", "_licence", "_holder")).alias("n"))
    nearest = nearest.select(F.col("_dir").alias("_d"), F.col("n._licence").alias("_inherited"), F.col("n._holder").alias("from_directory"))
    out = rows.join(nearest, F.col("own_licence").isNull() & (F.col("_dir") == F.col("_d")), "left")
    return out.select(key, path, "own_licence", "own_score", F.coalesce("own_licence", "_inherited").alias("licence"), "from_directory")
