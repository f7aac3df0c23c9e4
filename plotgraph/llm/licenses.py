"""Licence scans by a trained paragraph classifier, in DataFrame operations only."""

from __future__ import annotations

import functools
import json
import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

UNKNOWN = "unknown"

#: How licences of each family are stated, in notices and in the paragraphs of their texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the Apache License for the specific language governing permissions and limitations under the License.",
        "Distributed under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "isc": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistribution and use in source and binary forms are permitted.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Licensed under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "zlib": (
        "Licensed under the zlib License.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        "SPDX-License-Identifier: Zlib",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "wtfpl": (
        "Licensed under the WTFPL, version 2.",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. Do what the fuck you want to public license.",
        "SPDX-License-Identifier: WTFPL",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is distributed under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "epl": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "cddl": (
        "Licensed under the Common Development and Distribution License, version 1.0.",
        "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the CDDL.",
        "SPDX-License-Identifier: CDDL-1.0",
    ),
    "eupl": (
        "Licensed under the EUPL, version 1.2.",
        "Licensed under the European Union Public Licence, as soon as they will be approved by the European Commission.",
        "SPDX-License-Identifier: EUPL-1.2",
    ),
    "artistic": (
        "Licensed under the Artistic License 2.0.",
        "You can redistribute it and/or modify it under the same terms as Perl itself, that is, the Artistic License.",
        "SPDX-License-Identifier: Artistic-2.0",
    ),
    "psf": (
        "Licensed under the Python Software Foundation License.",
        "Distributed under the terms of the PSF License Agreement for Python.",
        "SPDX-License-Identifier: PSF-2.0",
    ),
    "ofl": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "Released under the Open Font License.",
        "SPDX-License-Identifier: OFL-1.1",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
        "Available under the Creative Commons Attribution License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under a Creative Commons Attribution-NonCommercial License.",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Available under a Creative Commons Attribution-NoDerivs License.",
    ),
    "cc0": (
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "odbl": (
        "This database is made available under the Open Database License.",
        "Any rights in individual contents of the database are licensed under the Database Contents License.",
        "Available under the ODbL, version 1.0.",
    ),
    "gfdl": (
        "Licensed under the GNU Free Documentation License.",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
        "SPDX-License-Identifier: GFDL-1.3-only",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright 2020 Example Company. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ),
}
#: Sentences that stand around a licence statement.
AROUND = ("Copyright (c) 2019 the authors.", "This file is part of the project.", "See the LICENSE file for details.", "Version 1.2 of the software.")
#: Sentences with words of licences that state none.
OTHERS = (
    "He lost his driver's license in the city of Apache Junction.", "The public library is open to the general public on all days.", "A software version was released on Monday.",
    "Students at MIT published a paper about source code.", "Wir gehen mit ihm nach Hause mit dem Zug.", "Mit der Zeit wird es besser.", "The gnu is a large animal of the open plain.",
    "She was granted permission to leave without charge.", "All seats are reserved for members.", "Human rights are universal rights of any person.", "The foundation published a free report about mozilla and other browsers.",
    "He is a licensed engineer and works under the general manager.", "The terms of the contract are subject to change.", "The author has written a work of common interest.", "A copy of the form is attached to this file.",
    "Redistribution of income is a matter of public debate.", "The Apache helicopter is version two of the design.", "Please read the documentation files of the source before use.", "The creative team found a common attribution for its international work.",
    "The conditions of the road are met with caution.", "No part of the city was spared in any form.", "The license plate has the number 3.", "Free software is discussed at the meeting.", "Commercial use of the park is permitted on Sundays.",
    "The publisher sent a copy of the publication to the company.", "Copyright law is taught in the second year.", "The domain of the function is universal.", "In compliance with the law, the law applies.", "cc the team by mail.", "by the way, nc is a state.",
)
#: Words that say nothing about a licence by themselves.
COMMON = frozenset("a an and are as at be by for from has his he in is it its may no not of on or so that the their this to was were with without under you your any all other can if which we our will they have had but what who when there been how see being been its one more new 0 1 2 3 4 5 2019 2020 v".split())
#: Words of statements that are frequent in other texts; a line with these alone isn't read.
WEAK = frozenset("nd nc sa only do example".split())
LENGTHS = (1, 2, 3)
#: N-grams that name a family; families share most other words of their statements.
NAMES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("apache",),
    "mit": ("mit", "permission is hereby"),
    "isc": ("isc", "permission to use"),
    "bsd": ("bsd", "redistribution and use", "redistributions of source"),
    "zlib": ("zlib", "granted to anyone"),
    "boost": ("boost", "bsl", "person or organization"),
    "unlicense": ("unlicense", "and unencumbered software"),
    "wtfpl": ("wtfpl", "want to public"),
    "gpl": ("gnu general", "gpl"),
    "lgpl": ("lesser general", "lgpl"),
    "agpl": ("affero general", "agpl"),
    "mpl": ("mozilla public", "mpl"),
    "epl": ("eclipse public", "epl"),
    "cddl": ("common development and", "cddl"),
    "eupl": ("eupl", "european union public"),
    "artistic": ("artistic",),
    "psf": ("psf", "python software foundation"),
    "ofl": ("ofl", "open font license"),
    "cc-by": ("cc by 4", "attribution 4", "attribution 3", "attribution license"),
    "cc-by-sa": ("by sa", "attribution sharealike"),
    "cc-by-nc": ("by nc", "attribution noncommercial"),
    "cc-by-nd": ("by nd", "attribution noderivatives", "attribution noderivs"),
    "cc0": ("cc0", "has waived all"),
    "odbl": ("odbl", "open database license", "database contents license"),
    "gfdl": ("gfdl", "free documentation license"),
    "all-rights-reserved": ("rights reserved", "of this publication"),
}


#: N-grams by which a family is referred to; each alone is a template, compared as a whole.
TITLES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("apache license", "apache 2 0", "apache licensed", "the apache license"),
    "mit": ("mit licensed", "under mit", "under the mit"),
    "isc": ("under the isc", "isc licensed", "under isc"),
    "bsd": ("bsd licensed", "clause bsd license", "under the bsd", "under bsd"),
    "zlib": ("the zlib license", "under the zlib", "zlib licensed"),
    "boost": ("boost software license",),
    "unlicense": ("the unlicense", "and unencumbered software"),
    "wtfpl": ("the wtfpl", "under wtfpl", "wtfpl license"),
    "gpl": ("gnu general public", "gnu gpl", "gpl version", "under the gpl", "gpl licensed"),
    "lgpl": ("lesser general public", "under the lgpl", "lgpl version", "lgpl licensed"),
    "agpl": ("affero general public", "under the agpl", "agpl version", "agpl licensed"),
    "mpl": ("mozilla public license", "under the mpl", "mpl version"),
    "epl": ("eclipse public license", "under the epl", "epl licensed"),
    "cddl": ("common development and", "under the cddl", "cddl licensed"),
    "eupl": ("under the eupl", "eupl licensed", "european union public"),
    "artistic": ("the artistic license",),
    "psf": ("the psf license", "software foundation license", "under the psf"),
    "ofl": ("open font license", "under the ofl"),
    "cc-by": ("cc by 4", "cc by 3", "commons attribution 4", "commons attribution 3", "commons attribution license"),
    "cc-by-sa": ("cc by sa", "attribution sharealike"),
    "cc-by-nc": ("cc by nc", "attribution noncommercial"),
    "cc-by-nd": ("cc by nd", "attribution noderivatives", "attribution noderivs"),
    "cc0": ("cc0 1 0", "under cc0"),
    "odbl": ("open database license", "under the odbl", "database contents license"),
    "gfdl": ("free documentation license", "under the gfdl"),
    "all-rights-reserved": ("all rights reserved",),
}
#: Sentences that refer to a licence.
FRAMES = ("Available {}.", "The code and its parts are made available, subject to its terms: {}, see the LICENSE file.", "{}")
#: N-grams of a template that a part of it must hold to be compared by its own length.
PART = 10


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def ngrams(found: Column) -> Column:
    """All distinct 1- to 3-grams of the words."""

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(found) - n), lambda i: F.array_join(F.slice(found, i + 1, n), " "))
        return F.when(F.size(found) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(found, *map(of, LENGTHS[1:])))


def known_ngrams(found: Column, known: list[str]) -> Column:
    """Those of ``ngrams`` that are ``known``; others are built only where each of their words stands in that place of a known one."""

    def of(n: int) -> Column:
        grams = [g.split(" ") for g in known if g.count(" ") == n - 1]
        places = [sorted({g[k] for g in grams}) for k in range(n)]

        def at(w: Column, i: Column) -> Column:
            parts = [w, *[F.get(found, i + k) for k in range(1, n)]]
            fits = functools.reduce(lambda a, b: a & b, [p.isin(x) for p, x in zip(parts, places, strict=True)])
            return F.when(fits, F.concat_ws(" ", *parts))

        return F.filter(F.transform(found, at), lambda g: g.isin([" ".join(g) for g in grams]))

    return F.array_distinct(F.concat(*map(of, LENGTHS)))


def _useful(found: Column) -> Column:
    """N-grams with a word that isn't common."""
    common = F.array(*map(F.lit, sorted(COMMON)))
    return F.filter(found, lambda g: F.size(F.array_except(F.split(g, " "), common)) > 0)


def examples(spark: SparkSession) -> DataFrame:
    """``family, text, held``: the statements alone and with sentences around them.

    Of every family with more than two statements one is held out for
    calibration, in all its forms; so is every fourth sentence that states none.
    """
    rows = []
    for family, texts in TEMPLATES.items():
        for i, t in enumerate(texts):
            forms = [t, *[f"{a} {t}" for a in AROUND[:2]], *[f"{t} {a}" for a in AROUND[2:]], f"{OTHERS[len(rows) % len(OTHERS)]} {t}"]
            rows += [(family, form, i == 1 and len(texts) > 2) for form in forms]
        rows += [(family, frame.format(t), False) for t in TITLES[family] for frame in FRAMES]
    plain = [*OTHERS, *AROUND[1:], *[f"{a} {b}" for a, b in zip(OTHERS, OTHERS[7:] + OTHERS[:7], strict=True)], *[""] * 20]
    return spark.createDataFrame(rows + [(UNKNOWN, t, i % 4 == 3) for i, t in enumerate(plain)], "family string, text string, held boolean")


@functools.cache
def fit(spark: SparkSession) -> dict:
    """Multinomial logistic regression on n-grams of the templates, with an unknown class; fitted once a session.

    The n-grams of the licence statements are the vocabulary (a fixed, small
    number); sentences that only share words with them teach the unknown class.
    A temperature, chosen on held-out examples, calibrates the probabilities; then all
    examples are fitted.
    """
    data = examples(spark).withColumn("grams", _useful(ngrams(words(F.col("text"))))).coalesce(1).cache()
    families = [*sorted(TEMPLATES), UNKNOWN]
    index = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    templates = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, text string").select("family", _useful(ngrams(words(F.col("text")))).alias("grams"))
    titles = [(f, [t]) for f, ts in TITLES.items() for t in ts]
    templates = templates.unionByName(spark.createDataFrame(titles, "family string, grams array<string>"))
    counts = CountVectorizer(inputCol="grams", outputCol="x", binary=True, vocabSize=16384, minDF=1.0).fit(templates.coalesce(1))
    seen = counts.transform(data).withColumn("y", index.cast("double"))
    regression = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=0.001, elasticNetParam=0.1, maxIter=100, standardization=False)
    model = regression.fit(seen.filter("not held"))
    held = [(int(r["y"]), list(r["rawPrediction"])) for r in model.transform(seen.filter("held")).select("y", "rawPrediction").collect()]
    model = regression.fit(seen)
    data.unpersist()

    def loss(t: float) -> float:
        total = 0.0
        for y, m in held:
            top = max(m)
            total += math.log(sum(math.exp(t * (v - top)) for v in m)) - t * (m[y] - top)
        return total

    sharpness = min((0.25 * 1.25**k for k in range(10)), key=loss)
    weight = model.coefficientMatrix.toArray()
    grams = [(g, [float(sharpness * w) for w in weight[:, i]]) for i, g in enumerate(counts.vocabulary)]
    stated: dict[str, list[list[str]]] = {}
    for r in templates.collect():
        stated.setdefault(r["family"], []).append(r["grams"])
    return {"families": families, "templates": stated, "grams": grams, "bias": [float(sharpness * b) for b in model.interceptVector], "anchors": sorted({w for g, _ in grams for w in g.split(" ")} - COMMON - WEAK)}


def longest_statement() -> int:
    """Words of the longest template."""
    return max(len(re.findall(r"[^\W_]+", t)) for texts in TEMPLATES.values() for t in texts)


def name_words() -> list[str]:
    """Of every name of a family its longest word that isn't common: a passage that names the family has it."""
    return sorted({_own(name)[0] for names in NAMES.values() for name in names})


def _own(name: str) -> list[str]:
    """The words of the name that aren't common, the longest first."""
    return sorted((w for w in name.split(" ") if w not in COMMON), key=lambda w: -len(w))


def needed_words(templates: list[list[str]], named: list[str], overlap: float) -> list[str] | None:
    """Words of which a passage has one if it holds ``overlap`` or more of the n-grams of a template; None if it may have none.

    Of each template words are chosen until too few n-grams for that overlap are
    without a chosen word: those of ``named``, and common ones, only where no other is left.
    """
    needed: set[str] = set()
    for grams in templates:
        least = min(PART, next((n for n in range(len(grams) + 1) if n / len(grams) >= overlap), len(grams) + 1))
        if least == 0:
            return None
        rest = [g.split(" ") for g in grams]
        while len(rest) >= least:
            held = {w: sum(w in g for g in rest) for g in rest for w in g}
            word = min(held, key=lambda w: (w in named, w in COMMON, w not in needed, -held[w], w))
            needed.add(word)
            rest = [g for g in rest if word not in g]
    return sorted(needed)


def wanted_words(model: dict, overlap: float) -> list[tuple[list[str], ...]]:
    """Of each name of a family each word that isn't common, then ``needed_words``: a passage that confirms a family by its name has one word of each list of an entry."""
    out = []
    for family in sorted(model["templates"]):
        needed = needed_words(model["templates"][family], [_own(name)[0] for name in NAMES[family]], overlap)
        out += [(*[[w] for w in _own(name)], *([needed] if needed is not None else [])) for name in NAMES[family]]
    return out


def passages(docs: DataFrame, anchors: list[str], reach: int | None = None, named: list[str] | None = None, wanted: list[tuple[list[str], ...]] | None = None) -> DataFrame:
    """``doc_id, paragraph, lines, words``: each line with an anchor, and windows over joined lines that have a word of ``named`` (the anchors if it isn't given).

    If ``wanted`` is given, windows instead have a word of each list of one of its entries.

    A run of lines that aren't blank (a line without letters and digits is) is
    read as one text, however it was wrapped.  Windows of twice ``reach`` words
    begin every ``reach`` words (by default those of the longest template), so
    every statement up to that length lies whole in one, every word is in two,
    and no passage is longer.  ``paragraph`` is the line (from 0) that a passage
    begins in, ``lines`` is 1 for a line and null for a window.  A line longer
    than a window is read in windows only.
    """
    reach = reach or longest_statement()
    wanted = wanted or [(named or anchors,)]
    naming = sorted({w for entry in wanted for w in entry[0]})
    marks = sorted({*anchors, *(w for entry in wanted for x in entry for w in x)})
    entries = F.from_json(F.lit(json.dumps(wanted)), "array<array<array<string>>>")
    kind = "array<struct<paragraph:int,lines:int,words:array<string>>>"

    def marked(found: Column) -> Column:
        return F.filter(found, lambda w: w.isin(marks))

    def held(mark: Column) -> Column:
        full = F.exists(entries, lambda entry: F.forall(entry, lambda x: F.arrays_overlap(x, mark)))
        return F.exists(mark, lambda w: w.isin(naming)) & full

    def line(text: Column, i: Column) -> Column:
        return let(words(text), lambda w: F.struct(i.alias("i"), w.alias("w"), marked(w).alias("mark")))

    def windows(lines: Column) -> Column:
        # Behind the mark that ends a run stands the number of the next one's first line; words hold no such mark.
        end = lambda x: F.array(F.struct(F.concat(F.lit("\x01"), (x["i"] + 1).cast("string")).alias("w"), x["i"].alias("i")))
        flat = F.flatten(F.transform(lines, lambda x: F.when(F.size(x["w"]) > 0, F.transform(x["w"], lambda v: F.struct(v.alias("w"), x["i"].alias("i")))).otherwise(end(x))))
        cut = let(flat, lambda f: F.transform(F.sequence(F.lit(0), F.size(f), F.lit(reach)), lambda at: F.slice(f, at + 1, 2 * reach)))
        text = lambda v: F.concat_ws(" ", v[0]["i"].cast("string"), F.array_join(F.transform(v, lambda e: e["w"]), " "))
        runs = lambda v: F.transform(F.split(text(v), "\x01"), lambda run: F.filter(F.split(run, " "), lambda w: w != ""))
        kept = F.filter(cut, lambda v: let(marked(F.transform(v, lambda e: e["w"])), held))
        each = F.flatten(F.transform(kept, lambda v: F.transform(runs(v), lambda r: F.struct(r[0].cast("int").alias("paragraph"), F.lit(None).cast("int").alias("lines"), F.slice(r, 2, 2 * reach).alias("words")))))
        return F.filter(each, lambda x: let(marked(x["words"]), held)).cast(kind)

    def found(lines: Column) -> Column:
        short = F.filter(lines, lambda x: (F.size(x["w"]) <= 2 * reach) & F.exists(x["mark"], lambda w: w.isin(anchors)))
        alone = F.transform(short, lambda x: F.struct(x["i"].alias("paragraph"), F.lit(1).alias("lines"), x["w"].alias("words"))).cast(kind)
        several = let(F.array_distinct(F.flatten(F.transform(lines, lambda x: x["mark"]))), held)
        return F.concat(alone, F.when(several, windows(lines)).otherwise(F.array().cast(kind)))

    every = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), line)
    # For an inner explode Spark would filter by the array's size first, and so derive it three times.
    return docs.select("doc_id", F.explode_outer(let(every, found)).alias("p")).filter("p is not null").select("doc_id", "p.*")


def licence_paragraphs(docs: DataFrame, model: dict, probability: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """``doc_id, paragraph, lines, family, probability, overlap, confirmed`` of every passage that is likelier a licence than not.

    A passage is a line of ``text`` with a word of the vocabulary that is
    neither common nor in WEAK, or a window over a run of non-blank lines,
    see ``passages``; texts are read whole, however long, and no passage grows
    with them.  A passage without any word of the vocabulary that isn't common
    has no feature, so it is unknown.
    The passages' distinct n-grams are joined with the weights (a table of fixed
    size, broadcast), summed and turned to probabilities.  The likeliest family
    of a line is reported if it has ``probability`` or more, and every family is
    that is confirmed in a passage likelier of any licence than of none by that
    ``probability``: the passage names it and holds ``overlap`` or more of the
    n-grams of one of its templates.  A line that names no family confirms its
    likeliest by the overlap alone.

    Null and empty texts have no passages with features.  Repeated rows are
    scanned each; other columns are left out.
    """
    spark = docs.sparkSession
    families, k = model["families"], len(model["families"])
    # A family that several lines state together is confirmed by its name and an overlap only, so windows that can't have both have nothing to report.
    line = passages(docs, model["anchors"], wanted=wanted_words(model, overlap))
    # N-grams without a weight would find nothing in the join.
    known = known_ngrams(F.col("words"), [g for g, _ in model["grams"]])
    grams = line.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "paragraph", "lines", F.explode_outer(known).alias("gram"))
    weights = spark.createDataFrame(model["grams"], "gram string, w array<double>")
    hits = grams.join(F.broadcast(weights), "gram")  # weights: the templates' n-grams, a fixed number
    sums = hits.groupBy("row", "doc_id", "paragraph", "lines").agg(F.collect_list("gram").alias("grams"), *[F.sum(F.col("w")[i]).alias(f"m{i}") for i in range(k)])
    margin = F.array(*[F.col(f"m{i}") + model["bias"][i] for i in range(k)])
    top = sums.select("doc_id", "paragraph", "lines", "grams", margin.alias("m")).withColumn("best", F.array_max("m"))
    total = F.aggregate("m", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("best")))
    likeliest = F.element_at(F.array(*map(F.lit, families)), F.array_position("m", F.col("best")).cast("int"))
    top = top.withColumn("total", total).withColumn("top", likeliest)
    chance = lambda at: F.exp(F.col("m")[at] - F.col("best")) / F.col("total")
    top = top.filter(chance(families.index(UNKNOWN)) <= 1 - probability)
    # One row a family: its place in ``m``, names and templates; all of fixed size.
    stated = [{"family": f, "at": families.index(f), "names": NAMES[f], "templates": model["templates"][f]} for f in sorted(TEMPLATES)]
    stated = F.from_json(F.lit(json.dumps(stated)), "array<struct<family:string,at:int,names:array<string>,templates:array<array<string>>>>")

    def rate(f: Column) -> Column:
        def alike(t: Column) -> Column:
            both = F.size(F.array_intersect(t, F.col("grams")))
            return F.greatest(both / F.size(t), F.when(both >= PART, both / F.size("grams")))

        share = F.array_max(F.transform(f["templates"], alike))
        return F.struct(f["family"].alias("family"), chance(f["at"]).alias("probability"), share.alias("overlap"), F.arrays_overlap(f["names"], F.col("grams")).alias("named"))

    # Others can be neither reported nor confirmed.
    able = F.filter(stated, lambda f: (f["family"] == F.col("top")) | F.arrays_overlap(f["names"], F.col("grams")))
    rated = top.select("doc_id", "paragraph", "lines", "top", F.transform(able, rate).alias("rated"))
    rated = rated.withColumn("clear", F.exists("rated", lambda r: r["named"] & (r["overlap"] >= overlap)))
    each = rated.select("doc_id", "paragraph", "lines", "top", "clear", F.explode("rated").alias("r"))
    first = F.col("lines").isNotNull() & (F.col("r.family") == F.col("top"))
    sure = (F.col("r.overlap") >= overlap) & (F.col("r.named") | (first & ~F.col("clear")))
    each = each.select("doc_id", "paragraph", "lines", "r.family", "r.probability", "r.overlap", sure.alias("confirmed"), first.alias("first"))
    return each.filter(F.col("confirmed") | (F.col("first") & (F.col("probability") >= probability))).drop("first")


def scan(docs: DataFrame, model: dict, **parameters) -> DataFrame:
    """``doc_id, licences, licence, probability, n_unconfirmed`` of every id of ``docs(doc_id, text)``.

    ``licences`` are the confirmed families, sorted; ``licence`` is the one of
    highest probability (ties: the first by name), ``unknown`` if there is none.
    Rows that repeat an id count as one document, null ids as another.
    """
    found = licence_paragraphs(docs, model, **parameters)
    sure = F.col("confirmed")
    by_doc = found.groupBy(F.col("doc_id").alias("_d")).agg(
        F.array_sort(F.collect_set(F.when(sure, F.col("family")))).alias("licences"),
        F.min(F.when(sure, F.struct((-F.col("probability")).alias("p"), F.col("family")))).alias("best"),
        F.count(F.when(~sure, 1)).alias("n_unconfirmed"),
    )
    ids = docs.select("doc_id").distinct()
    joined = ids.join(by_doc, ids["doc_id"].eqNullSafe(F.col("_d")), "left")
    return joined.select(
        "doc_id", F.coalesce("licences", F.array().cast("array<string>")).alias("licences"), F.coalesce("best.family", F.lit(UNKNOWN)).alias("licence"),
        (-F.col("best.p")).alias("probability"), F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed"),
    )
