from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from tests.llm.conftest import prose, vocabulary
from wayline.llm import op5_licences as op


@pytest.fixture(scope="module")
def model(spark):
    return op.train(spark.read.parquet(f"{SF01}/documents.parquet"))


def test_agrees_with_plain_phrase_search(spark, model):
    phrases = {"Apache-2.0": "apache license", "MIT": "mit license", "GPL-3.0": "gnu general public license",
               "CC-BY-NC-4.0": "cc by-nc 4.0", "Proprietary": "all rights reserved"}
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = {r.doc_id: set(filter(None, r.families.split(","))) for r in op.summary(op.scan(docs, model)).collect()}
    right = sum(got[r.doc_id] == {f for f, p in phrases.items() if p in r.text.lower()}
                for r in docs.select("doc_id", "text").collect())
    assert right / len(got) >= 0.99


def test_notices_inside_long_lines_and_unknown_text(spark, docs_of, model):
    rng = random.Random(9)
    words = vocabulary(rng)
    rows, want = [], {}
    for i, (family, clauses) in enumerate(op.TEMPLATES.items()):
        for j, clause in enumerate(clauses):
            n = 100 * i + j
            rows.append((n, f"{prose(rng, words, 70)} {clause}. {prose(rng, words, 45)}"))
            want[n] = family
            assert op.clauses()[[(c.family, c.number) for c in op.clauses()].index((op.FAMILIES.index(family), j))].own
    rows += [(10_000 + k, prose(rng, words, 200) + " all the rights are under version 2 of the terms") for k in range(20)]
    got = {r.doc_id: r for r in op.scan(docs_of(rows), model).collect()}
    right = sum(any(f.family == w for f in got[n].found) for n, w in want.items())
    print([(n, w) for n, w in want.items() if not any(f.family == w for f in got[n].found)])
    assert right / len(want) >= 0.95
    assert not any(got[10_000 + k].found for k in range(20))


def test_places_and_edges(spark, docs_of, model):
    mit = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, f"x\n\n{mit}\nplain\n{mit}"), (4, mit), (None, mit.upper()),
            (5, "word " * 200_000 + mit), (6, "é" * 1000)]
    docs = docs_of(rows).withColumn("found", F.lit(1)).withColumn("family", F.lit(1))
    got = op.scan(docs, model).collect()
    assert len(got) == len(rows)
    assert [[f.line for f in r.found] for r in got if r.doc_id == 4] == [[2, 4], [0]]
    twice = op.scan(docs_of([(1, f"{mit} {mit} words between them here {mit}")]), model).first().found
    assert [f.family for f in twice] == ["MIT"] * 3 and len({f.word for f in twice}) == 3
    assert [r.found[0].family for r in got if r.doc_id is None] == ["MIT"]
    assert [r.found[0].family for r in got if r.doc_id == 5] == ["MIT"]
    assert all(not r.found for r in got if r.doc_id in (1, 2, 3, 6))
    assert op.summary(op.scan(docs.limit(0), model)).count() == 0


def test_training_without_ordinary_text(docs_of):
    model = op.train(docs_of([(1, None)]).limit(1))
    w = op._features(op._words("Licensed under the Apache License, Version 2.0"))
    assert model.probabilities(model.weights[w].sum(axis=0, keepdims=True)).argmax() == op.FAMILIES.index("Apache-2.0")


def test_copies_do_not_thin_out_the_ordinary_text(docs_of, monkeypatch):
    rng = random.Random(5)
    words = vocabulary(rng)
    few = [prose(rng, words, 20) for _ in range(20)]
    monkeypatch.setattr(op, "Classifier", lambda samples, labels: labels)
    labels = op.train(docs_of([(i, few[i % 20]) for i in range(8000)]), sample_docs=5)
    mixed = op.MIXED * sum(map(len, op.TEMPLATES.values()))
    assert 5 <= (labels == 0).sum() - mixed <= 40       # windows of five different texts


PROBES = {
    "/* Released under the\n * MIT License */\nint x;": {"MIT"},
    "Copyright 2020 Someone. All rights\nreserved.": {"Proprietary"},
    "// Licensed under the Apache License,\n// Version 2.0 (the \"License\");\n// you may not use this file": {"Apache-2.0"},
    "# This program is free software; you can redistribute it and/or\n# modify it under the terms of the GNU General Public License\n"
    "# as published by the Free Software Foundation; either version 2\n# of the License, or (at your option) any later version.": {"GPL-2.0"},
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": {"GPL-3.0"},
    " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n"
    " * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or any later version.": {"LGPL-2.1"},
    "You may redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
    "version 3.": {"AGPL-3.0"},
    "It is distributed under the terms of the GNU General Public License as published by the Free Software Foundation.": {"GPL"},
    "Texts are licensed under CC BY 4.0 unless noted.": {"CC-BY-4.0"},
    "This work is licensed under CC BY-SA 4.0.": {"CC-BY-SA-4.0"},
    "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.": {"CC-BY-NC-4.0"},
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.": {"MPL-2.0"},
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted": {"ISC"},
    "This is free and unencumbered software released into the public domain.": {"Unlicense"},
    "To the extent possible under law, the author has waived all copyright and\nrelated or neighboring rights to this work.": {"CC0-1.0"},
    "Released under the MIT License. All rights reserved.": {"MIT", "Proprietary"},
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that": {"BSD"},
    # Licence-like words of no family.
    "Use of the service is subject to the terms of the vendor agreement, version 2 of which is available at the office.": set(),
    "The general public may obtain a copy of the report, and the author reserves all the rights of reply.": set(),
    "A driving license was released under the new law, with permission granted to any person free of fines.": set(),
}


def test_held_out_wording(spark, docs_of, model):
    """Wrapped, prefixed and reworded notices; precision and recall over families."""
    texts = list(PROBES)
    got = {r.doc_id: {f.family for f in r.found} for r in op.scan(docs_of(list(enumerate(texts))), model).collect()}
    wrong = {texts[i]: got[i] for i in got if got[i] != PROBES[texts[i]]}
    found, true = sum(map(len, got.values())), sum(map(len, PROBES.values()))
    right = sum(len(got[i] & PROBES[texts[i]]) for i in got)
    assert right / true >= 0.95 and right / max(found, 1) >= 0.95, wrong
