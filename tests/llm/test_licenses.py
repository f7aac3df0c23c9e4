"""Licence families: held-out statements, look-alikes and a brute-force score."""

import math
import re
import textwrap

import pytest

from plotgraph.llm import licenses

STATED = [
    ("apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("mit", "The code is released under the MIT License, see below."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", "Text: Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Images are licensed under CC BY-SA 4.0."),
    ("all-rights-reserved", "(c) 2021 Acme. All rights reserved."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0, by its authors."),
]
PLAIN = ["He lost his license.", "Mit dem Apache nach Hause.", "The general public may use version 3.", "Erth wasti ofhe.", "", "all seats reserved"]


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit(spark)


def brute(text, model):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    grams = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
    m = list(model["bias"])
    for g, weights in model["grams"]:
        if g in grams:
            m = [a + b for a, b in zip(m, weights)]
    e = [math.exp(x - max(m)) for x in m]
    return model["families"][m.index(max(m))], 1 / sum(e)


def test_families(spark, model):
    texts = [t for _, t in STATED] + PLAIN
    docs = spark.createDataFrame([(i, f"Intro.\n{t}\nEnd.", "q") for i, t in enumerate(texts)] + [(100, None, "q"), (101, "", "q"), (None, "All rights reserved.", "q"), (100, None, "q")], "doc_id long, text string, licence string")
    got = {r["doc_id"]: r for r in licenses.scan(docs, model).collect()}
    assert len(got) == len(texts) + 3
    for i, (family, _) in enumerate(STATED):
        assert got[i]["licence"] == family and got[i]["licences"] == [family], got[i]
    for i in range(len(STATED), len(texts)):
        assert got[i]["licences"] == [], texts[i]
    assert got[None]["licence"] == "all-rights-reserved" and got[100]["licence"] == "unknown"
    rows = {(r["doc_id"], r["paragraph"]): r for r in licenses.licence_paragraphs(docs, model).collect()}
    for i, t in enumerate(texts):
        family, p = brute(t, model)
        if family == "unknown" or p < 0.5:
            assert (i, 1) not in rows
        else:
            assert rows[i, 1]["family"] == family and abs(rows[i, 1]["probability"] - p) < 1e-9
    assert licenses.scan(docs.limit(0), model).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""


@pytest.mark.parametrize("width", [30, 72])
def test_wrapped_notices(spark, model, width):
    texts, expected = [], []
    for family, notice in (("mit", MIT), ("gpl", GPL), ("lgpl", LGPL)):
        wrapped = textwrap.wrap(notice, width)
        for form in (wrapped, ["Tools of the trade, version 1.2", "", *wrapped, "", "The end."], [" *", *(f" * {x}" for x in wrapped), " *"], ["The first part of a longer line. " * 20 + wrapped[0], *wrapped[1:]]):
            texts.append("\n".join(form))
            expected.append([family])
    texts += ["Released under the\n\nMIT License.", "Released under the\nMIT License.", "\n".join(PLAIN)]
    expected += [[], ["mit"], []]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(docs, model).collect()}
    assert got == dict(enumerate(expected))


def test_two_families_in_a_line(spark, model):
    texts = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["apache-2.0", "mit"],
        "Licensed under the MIT license or the Apache License, Version 2.0.": ["apache-2.0", "mit"],
        "Licensed under the GNU Affero General Public License, version 3.": ["agpl"],
        "Licensed under the GNU Lesser General Public License, version 2.1.": ["lgpl"],
        "Licensed under CC BY-SA 4.0.": ["cc-by-sa"],
        "Licensed under CC BY 4.0.": ["cc-by"],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(docs, model).collect()}
    assert got == dict(enumerate(texts.values()))


def test_no_python_in_plan(spark, model):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licenses.scan(docs, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
