"""Statements in words that no template has, windows over lines, and very long texts."""

import re
import time

import pytest
from pyspark.sql import functions as F

from plotgraph.llm import licenses

#: Statements of each family that aren't among the templates.
HELD_OUT = [
    ("apache-2.0", "The library is made available under the terms of the Apache License 2.0."), ("apache-2.0", "Code: Apache-2.0 licensed, see LICENSE."),
    ("apache-2.0", "you may not use these files except in compliance with the Apache License, Version 2.0"),
    ("mit", "This package is open-source software licensed under MIT."), ("mit", "MIT License, copyright (c) 2016 Jane Roe"), ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("isc", "The code is available under the ISC license."), ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "Distributed under the 2-clause BSD license."), ("bsd", "BSD licensed, see LICENSE for details"), ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("zlib", "This tool uses the zlib License."), ("zlib", "Permission is granted to anyone to use this software for any purpose and to redistribute it freely"),
    ("boost", "Use, modification and distribution are subject to the Boost Software License, Version 1.0."), ("boost", "Available under the Boost Software License."),
    ("unlicense", "This code is released under the Unlicense."), ("unlicense", "This program is free and unencumbered software in the public domain."),
    ("wtfpl", "You may use it under the WTFPL license."),
    ("gpl", "Licensed under the GNU General Public License as published by the Free Software Foundation; version 2."), ("gpl", "This file is under the GPL version 3."), ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl", "You can redistribute this library under the terms of the GNU Lesser General Public License."), ("lgpl", "Licensed under the LGPL, version 3."),
    ("agpl", "This server is covered by the GNU Affero General Public License."), ("agpl", "Licensed under the AGPL version 3."),
    ("mpl", "The contents of this file are subject to the Mozilla Public License Version 1.1."), ("mpl", "Licensed under the MPL, version 2.0."),
    ("epl", "The materials are available under the terms of the Eclipse Public License v2.0."), ("epl", "Licensed under the EPL 2.0."),
    ("cddl", "Licensed under the CDDL, version 1.0."), ("cddl", "This file is subject to the terms of the Common Development and Distribution License."),
    ("eupl", "Licensed under the EUPL."), ("artistic", "This module is under the Artistic License."), ("psf", "Available under the PSF License."), ("psf", "Distributed under the terms of the Python Software Foundation License."),
    ("ofl", "The font is licensed under the SIL Open Font License."), ("cc-by", "This article is licensed under a Creative Commons Attribution 3.0 License."), ("cc-by", "Photo: CC BY 4.0"),
    ("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."), ("cc-by-sa", "Content is available under CC BY-SA 3.0."), ("cc-by-nc", "This work is under a Creative Commons Attribution-NonCommercial 3.0 License."),
    ("cc-by-nd", "Licensed under a Creative Commons Attribution-NoDerivs 3.0 License."), ("cc0", "Released into the public domain under CC0 1.0."), ("odbl", "The data is licensed under the Open Database License (ODbL)."),
    ("gfdl", "Text under the GNU Free Documentation License, Version 1.2."), ("all-rights-reserved", "(c) 1999 by the author. All rights reserved."), ("all-rights-reserved", "No part of this publication may be reproduced in any form without the prior written permission of the publisher."),
]
#: Sentences that use such words and state no licence.
PLAIN = [
    "The Apache tribe lived in the southwest.", "He studied physics at MIT before he moved.", "The fishing licence expired last year.", "A general strike hit the public transport.", "The eclipse was seen by the public.", "The rocket boost lasted two minutes.",
    "An artistic programme was shown in the hall.", "The database was opened to the team on Monday.", "A font of knowledge, said the teacher.", "The European Union agreed on a budget.", "Copyright is a difficult subject.", "Permission to enter was refused.",
    "The mozilla was a big lizard in the film.", "The common good needs creative ideas.", "Attribution of the painting is disputed.", "Rights and duties are two sides of a coin.", "The terms of sale are printed below.", "The warranty covers parts only.",
    "All seats are reserved for guests.", "Seats reserved, all rights of way closed.", "The library is open from nine.", "Python is a large snake.", "The program was distributed to the audience.", "The software was sold without fee.", "A free meal was granted to the winners.",
    "The licence of the pub was renewed.", "Version 2.0 of the plan is better.", "In the public domain of debate, much is said.", "Zlib compresses the stream.", "The gnu and the zebra share the plain.", "Perl itself is a language.", "The foundation was laid in 1920.",
]


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit(spark)


def test_precision_and_recall(spark, model):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([t for _, t in HELD_OUT] + PLAIN)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(docs, model).collect()}
    right = sum(family in got[i] for i, (family, _) in enumerate(HELD_OUT))
    said = sum(len(v) for v in got.values())
    missed = [HELD_OUT[i] for i, (family, _) in enumerate(HELD_OUT) if family not in got[i]]
    extra = [(got[i], t) for i, t in enumerate([t for _, t in HELD_OUT] + PLAIN) if set(got[i]) - ({HELD_OUT[i][0]} if i < len(HELD_OUT) else set())]
    assert right >= 0.9 * len(HELD_OUT), missed
    assert right >= 0.95 * said, extra
    assert len({f for f, _ in HELD_OUT}) >= 24 and set(licenses.TEMPLATES) == {f for f, _ in HELD_OUT}


def test_every_template_is_found(spark, model):
    rows = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(docs, model).collect()}
    assert [r for i, r in enumerate(rows) if r[0] not in got[i]] == []


def plain_passages(text, anchors, reach):
    """Lines with an anchor, and windows over runs of lines, written out."""
    lines = [[w for w in re.split(r"[\W_]+", x.lower()) if w] for x in text.split("\n")]
    out = [(i, 1, w) for i, w in enumerate(lines) if len(w) <= 2 * reach and anchors & set(w)]
    flat = []
    for i, w in enumerate(lines):
        flat += [(x, i) for x in w] or [(None, i)]
    if not any(anchors & set(w) for w in lines):
        return out
    for at in range(0, len(flat) + 1, reach):
        run = []
        for x, i in [*flat[at : at + 2 * reach], (None, 0)]:
            if x is not None:
                run.append((x, i))
            elif run:
                if anchors & {w for w, _ in run}:
                    out.append((run[0][1], None, [w for w, _ in run]))
                run = []
    return out


def test_passages_against_brute_force(spark):
    texts = ["", "one\ntwo gpl\n\nthree gpl four\nfive", "gpl " * 23, "a\n" * 17 + "mit\n" + "b c d\n" * 9 + " \n--\nmit", "x y z", "\n\nmit\n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.passages(docs, ["gpl", "mit"], reach=5).collect()
    got = sorted(repr((r["doc_id"], r["paragraph"], r["lines"], r["words"])) for r in rows)
    want = sorted(repr((i, *p)) for i, t in enumerate(texts) for p in plain_passages(t or "", {"gpl", "mit"}, 5))
    assert got == want


def test_confirmation_against_brute_force(spark, model):
    """Names, overlap and confirmation of lines, from their n-grams."""
    texts = [t for _, t in HELD_OUT] + PLAIN
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = {g for g, _ in model["grams"]}
    for r in licenses.licence_paragraphs(docs, model).filter("lines = 1").collect():
        w = [x for x in re.split(r"[\W_]+", texts[r["doc_id"]].lower()) if x]
        grams = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)} & known
        both = [(len(grams & set(t)), len(t)) for t in model["templates"][r["family"]]]
        share = max(max(n / size, n / len(grams) if n >= licenses.PART else 0) for n, size in both)
        assert abs(share - r["overlap"]) < 1e-12
        if r["confirmed"]:
            assert share >= 0.6
        elif grams & set(licenses.NAMES[r["family"]]):
            assert share < 0.6


def test_very_long_text_of_short_lines(spark, model):
    """200,000 lines of a word each, and one line as long, with a statement in each."""
    many = "\n".join(["version"] * 100_000 + ["Released under the", "MIT License."] + ["license"] * 100_000)
    one = " ".join(["version"] * 100_000 + ["Licensed under the GNU Affero General Public License, version 3."] + ["plain"] * 100_000)
    docs = spark.createDataFrame([(1, many), (2, one)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(docs, model).collect()}
    assert "mit" in got[1] and "agpl" in got[2]
    assert time.time() - began < 60


def test_short_names_over_several_lines(spark):
    """A name without any other word of licences, wrapped over lines, is in a window."""
    docs = spark.createDataFrame([(1, "distributed under the\nMIT\nterms")], "doc_id long, text string")
    model = licenses.fit(spark)
    found = licenses.passages(docs, model["anchors"], named=licenses.name_words()).filter("lines is null").collect()
    assert [r["words"] for r in found] == [["distributed", "under", "the", "mit", "terms"]]
    assert licenses.scan(docs, model).first()["licences"] == ["mit"]


GERMAN = "Wir gehen mit ihm nach Hause,\ndanach mit dem Zug in die Stadt\nund mit allen ans Meer.\n" * 40


def test_no_windows_without_words_of_a_statement(spark, model, monkeypatch):
    """A name that is a frequent word of a language ("mit") makes no windows by itself; with a statement wrapped over lines it does."""
    made, whole = [], licenses.passages
    monkeypatch.setattr(licenses, "passages", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    docs = spark.createDataFrame([(1, GERMAN), (2, GERMAN + "Released under the\nMIT License.\n" + GERMAN)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(docs, model).collect()}
    assert got == {1: [], 2: ["mit"]}
    windows = [r["doc_id"] for r in made[0].filter("lines is null").collect()]
    assert windows == [2, 2]


@pytest.mark.parametrize("overlap", [0.6, 0.2, 0.0])
def test_windows_left_out_report_nothing(spark, model, monkeypatch, overlap):
    """Paragraphs are the same as with a window wherever a line has a word of the vocabulary or of a name."""
    stated = [t for _, t in HELD_OUT] + PLAIN + [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts = [re.sub(r"((?:\S+ ){3})", "\\1\n", t) for t in stated] + [f"{GERMAN}{t}\n{GERMAN}" for t in stated[::7]] + ["\n".join(stated)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()

    def found():
        rows = licenses.licence_paragraphs(docs, model, overlap=overlap).collect()
        return sorted((r["doc_id"], r["paragraph"], r["lines"] or 0, r["family"], round(r["probability"], 9), round(r["overlap"], 9), r["confirmed"]) for r in rows)

    got, whole = found(), licenses.passages
    monkeypatch.setattr(licenses, "passages", lambda docs, anchors, **_: whole(docs, anchors, named=[*anchors, *licenses.name_words()]))
    assert got == found() and any(r[2] == 0 for r in got)
    docs.unpersist()


def test_known_ngrams_against_all(spark, model):
    """They are those of all n-grams that are known, in texts of any length, with repeats."""
    known = [g for g, _ in model["grams"]]
    texts = ["", "mit", "the mit", "under the", *[t for _, t in HELD_OUT], " ".join(t for _, t in HELD_OUT) * 2, *PLAIN]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("w", licenses.words(F.col("text")))
    for r in docs.select("text", licenses.known_ngrams(F.col("w"), known).alias("got"), licenses.ngrams(F.col("w")).alias("every")).collect():
        assert len(set(r["got"])) == len(r["got"])
        assert set(r["got"]) == set(r["every"]) & set(known), r["text"]


def test_needed_words():
    """Without a needed word fewer n-grams of a template are left than its overlap takes."""
    grams = ["licensed", "mit", "license", "licensed under", "the mit", "mit license", "licensed under the", "under the mit", "the mit license"]
    assert licenses.needed_words([grams], ["mit"], 0.6) == ["license", "licensed"]
    assert licenses.needed_words([["under the mit"]], ["mit"], 0.6) == ["the"]
    assert licenses.needed_words([["mit"]], ["mit"], 0.6) == ["mit"]
    assert licenses.needed_words([grams], ["mit"], 0.0) is None
