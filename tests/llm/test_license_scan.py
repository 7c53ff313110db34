import random
import textwrap
import time

from pyspark.sql import functions as F

from foliospark.llm.license_scan import RULES, SENTENCES, rule_met, scan_licenses

MIT = (
    "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
    ' "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,'
    " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,'
    " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)


def test_rules_refer_to_sentences():
    assert {i for _, ids in RULES for i in ids} <= set(SENTENCES)
    texts = [t for ts in SENTENCES.values() for t in ts]
    assert len(texts) == len(set(texts))


def test_scan(docs_of):
    rows = [
        (1, None), (2, ""), (3, "Nothing here. At all!"), (4, "Licensed under the Apache License, Version 2.0."), (5, MIT), (6, "x " * 40_000 + ".\nReleased under the MIT License."),
        (7, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (8, "Released under the MIT License now."), (4, "Licensed under the Apache License, Version 2.0."),
        (9, "This program is free software: all of it. All Rights Reserved; MIT license"),
    ]
    got = sorted((r["doc_id"], r["license"], r["licenses"], r["n_known"]) for r in scan_licenses(docs_of(rows)).collect() if r["n_known"])
    assert got == [
        (4, "Apache-2.0", "Apache-2.0", 1), (4, "Apache-2.0", "Apache-2.0", 1), (5, "MIT", "MIT", 4), (6, "MIT", "MIT", 1),
        (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0 Proprietary", 2), (9, "MIT", "MIT Proprietary", 3),
    ]
    assert scan_licenses(docs_of(rows)).count() == len(rows)


def test_order_of_identifiers_matters(docs_of):
    sentences = {"a": ["first"], "b": ["second"]}
    rules = [("both", ["a", "b"]), ("one", ["b"])]
    rows = [(1, "first.\nother\nsecond"), (2, "second.\nfirst"), (3, "First!\nSecond!"), (4, "firstly\nsecond")]
    got = {r["doc_id"]: r["license"] for r in scan_licenses(docs_of(rows), sentences=sentences, rules=rules).collect()}
    assert got == {1: "both", 2: "one", 3: "both", 4: "one"}


def test_empty_table(docs_of):
    assert scan_licenses(docs_of([])).count() == 0


def test_every_known_sentence_can_be_met(docs_of):
    """On one line, wrapped, and wrapped in comments, with the cuts that tags and versions hold."""
    rows, want = [], {}
    for name, texts in SENTENCES.items():
        for t in texts:
            usual = t.replace("spdx license identifier ", "SPDX-License-Identifier: ").replace("license v 2 0", "License, v. 2.0")
            for text in (usual + ".", textwrap.fill(usual, 30) + ".", textwrap.fill(usual, 30, initial_indent="# ", subsequent_indent=" * ")):
                want[len(rows)] = name
                rows.append((len(rows), "Title\n\n" + text + "\n\nMore text."))
    assert {r["doc_id"]: r["known"] for r in scan_licenses(docs_of(rows)).collect()} == want


def test_wrapped_texts(docs_of):
    gpl = (
        "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n"
        "    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n"
    )
    rows = [(1, "\n\n".join(textwrap.fill(p, 70) for p in MIT.splitlines())), (2, gpl), (3, "// SPDX-License-Identifier: MIT\n// Copyright"), (4, "Released under the MIT.\nLicense"), (5, "the MIT\n\nLicense"),
            (6, "MIT License\n" + "\n".join(textwrap.fill(p, 70) for p in MIT.splitlines()[2:]))]
    got = {r["doc_id"]: (r["license"], r["n_known"]) for r in scan_licenses(docs_of(rows)).collect()}
    assert got == {1: ("MIT", 4), 2: ("GPL-3.0-or-later", 2), 3: ("MIT", 1), 4: (None, 0), 5: (None, 0), 6: ("MIT", 4)}


def test_notices_in_longer_sentences_and_tags(docs_of):
    rows = [
        (1, "This project is licensed under the MIT License - see the LICENSE file for details."), (2, "Foo is licensed under the MIT License."), (3, "SPDX-License-Identifier: BSD-3-Clause"),
        (4, "# SPDX-License-Identifier: (MIT OR Apache-2.0)"), (5, "SPDX-License-Identifier: GPL-3.0-or-later OR ISC"), (6, "Our code, 2019, is released under the Apache License, Version 2.0; see LICENSE"),
        (7, "It isn't licensed under the MIT License any more."), (8, "under the MIT License"),
    ]
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(docs_of(rows)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "Apache-2.0 MIT", 5: "GPL-3.0 ISC", 6: "Apache-2.0", 7: "", 8: ""}


def test_very_long_repeated_notices_are_linear(docs_of):
    """A megabyte of two-clause notices, each of which lacks what a three-clause one ends with."""
    notice = "\n".join(". ".join(x.capitalize() for x in SENTENCES[name]) + "." for name in ("bsd-forms", "bsd-source", "bsd-binary"))
    rows = [(1, (notice + "\n\n") * 2500), (1, (notice + "\n\n") * 2500), (2, "|" * 500_000), (3, "spdx license identifier " * 20_000)]
    assert len(rows[0][1]) > 1_000_000
    began = time.perf_counter()
    got = sorted((r["doc_id"], r["license"], r["n_known"]) for r in scan_licenses(docs_of(rows)).collect())
    assert got == [(1, "BSD-2-Clause", 7500), (1, "BSD-2-Clause", 7500), (2, None, 0), (3, None, 0)]
    assert time.perf_counter() - began < 60


def test_rules_by_brute_force(spark):
    rng = random.Random(4)
    rules = [[rng.choice("abcd") for _ in range(rng.randint(1, 4))] for _ in range(20)]
    rows = [(k, [rng.choice("abcde") for _ in range(rng.randint(0, 9))]) for k in range(200)]
    found = spark.createDataFrame(rows, "k int, ids array<string>").select("k", F.array(*[rule_met(F.col("ids"), r) for r in rules]).alias("met")).collect()

    def in_order(rule, ids):
        left = iter(ids)
        return all(x in left for x in rule)

    assert {r["k"]: r["met"] for r in found} == {k: [in_order(r, ids) for r in rules] for k, ids in rows}
