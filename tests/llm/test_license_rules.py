import random
import string

from millrace.llm import license_rules as L

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def places(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(i, label) for phrase, label in L.BASE_PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), found


TEXTS = [
    None, "", "...", "MIT License", "the MIT\n\nlicense, and the Apache-License; CC-BY 4.0", "permit license", "émit license", "mit licenseé",
    "cc by cc by", "GNU General Public License version 3.0 or later", "x" * 50_000 + " mit license", "Licensed under the Apache License, Version 2.0",
    "SPDX-License-Identifier: GPL-2.0-only", "Creative Commons Attribution-ShareAlike 4.0", "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
]


def test_base_places_match_plain_search(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.license for r in L.with_licenses(rows).collect()}
    for i, text in enumerate(TEXTS):
        n, found = places(text)
        r = got[i]
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "gpl-3.0" in got[9].labels and "apache-2.0" in got[11].labels and got[12].labels == "gpl-2.0"
    assert got[13].labels == "cc-by-sa-4.0" and got[14].labels == "mit" and got[0].score == 0


FOUND = [
    ("GPLv3", "gpl-3.0"), ("GPL3", "gpl-3.0"), ("GPL v3.0", "gpl-3.0"), ("gpl 2.1", "gpl"), ("LGPL-2.1+", "lgpl-2.1"), ("GNU GPL, version 2 or later", "gpl-2.0"),
    ("Apache 2.0", "apache-2.0"), ("Apache License version2.0", "apache,apache-2.0"), ("Apache kafka 2.0", ""), ("MPL 2.0", "mpl-2.0"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2.0,mit"), ("SPDX-License-Identifier: (GPL-2.0-only WITH x) AND (BSD-3-Clause OR MIT)", "bsd-3-clause,gpl-2.0,mit"),
    ("# Permission is hereby granted, free of charge, to any\n# person obtaining a copy of\n#   this software", "mit"),
    (" * you can redistribute it and/or modify\n * it under the terms of the GNU General\n * Public License", "gpl"),
    ("// Redistribution and use in source\n// and binary forms, with or without\n// modification", "bsd"), ("SSPL, Server Side Public License v1", "sspl-1.0"),
]


def test_spellings_frames_and_expressions():
    rules = L.default_rules()
    for text, labels in FOUND:
        kept = {r.label for _, _, r in L.detections(text.lower().encode(), rules, L.gates(rules))} | {x for _, x in places(text)[1]}
        assert ",".join(sorted(kept)) == labels, text


def test_detections_match_all_rules_without_gate_or_suppression_order():
    """Every rule on every text, then containment by comparing all pairs in order of strength."""
    rules, rng = L.default_rules(), random.Random(4)
    parts = [t for t, _ in FOUND] + ["words between", "licensed under the terms of the MIT license", "cc-by-sa 4.0", "CC0 1.0 universal", "https://creativecommons.org/licenses/by-nc/4.0/", "all rights reserved"]
    for _ in range(40):
        text = " \n".join(rng.choices(parts, k=6)).lower().encode()
        found = [(*m.span("id" if r.kind == "tag" else 0), i) for i, r in enumerate(rules) for m in r.pattern.finditer(text)]
        found.sort(key=lambda x: (-rules[x[2]].priority, x[0] - x[1], x[0], x[2]))
        kept = [x for k, x in enumerate(found) if not any(y[0] <= x[0] and x[1] <= y[1] for y in found[:k])]
        assert [(a, b, r) for a, b, r in L.detections(text, rules, L.gates(rules))] == [(a, b, rules[i]) for a, b, i in sorted(kept, key=lambda x: (x[0], x[1]))]


def test_there_are_hundreds_of_rules_in_order():
    rules = L.default_rules()
    assert len(rules) > 300 and [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


def test_containment_suppression_matches_comparison_of_all():
    rng = random.Random(3)
    for _ in range(3000):
        found = [(a, a + rng.randrange(1, 6), i) for i in range(rng.randrange(9)) for a in [rng.randrange(12)]]
        kept = []
        for x in found:
            if not any(k[0] <= x[0] and x[1] <= k[1] for k in kept):
                kept.append(x)
        assert L.suppressed(found) == kept


def test_empty_table_and_clashing_names(spark):
    rows = spark.createDataFrame([("a", 1)], "text string, license int")
    assert L.with_licenses(rows).columns == ["text", "license"]
    assert L.with_licenses(rows.limit(0)).count() == 0
