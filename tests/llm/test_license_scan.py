import random

import pytest

from lexivec.llm import license_scan, queries


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return license_scan.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_templates_and_variants(model):
    rng = random.Random(2)
    right = total = 0
    for family, texts in license_scan.TEMPLATES.items():
        for t in texts:
            assert license_scan.classify(model, t)[0] == family, t
            assert license_scan.classify(model, f"  {t.upper()} ")[0] == family
            for _ in range(5):
                words = t.split()
                if len(words) > 6:
                    del words[rng.randrange(len(words))]
                total += 1
                right += license_scan.classify(model, " ".join(["note", *words, "see", "file"]))[0] == family
    assert right >= 0.85 * total


def test_unknown(model):
    for t in (*license_scan.NO_GRANT, "", "plain prose", "license", "the license plate of the car was stolen and copyright matters little"):
        assert license_scan.classify(model, t)[0] == license_scan.UNKNOWN, t


def test_calibration_on_paragraphs_that_training_did_not_see(spark, model):
    """Licence lines with other words around them, and lines of a larger table: how likely the model calls its choice is how often it is right."""
    rng = random.Random(11)
    lines = [x for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(150).collect() for x in (r.text or "").split("\n") if x.strip()]
    plain = [x for x in lines if not any(license_scan.confirms(f, license_scan.words_of(x)) >= license_scan.LEAST_SHARE for f in license_scan.TEMPLATES)][:600]
    said = [(f, " ".join([*rng.choice(plain).split()[:3], *t.split(), "here"])) for f, own in license_scan.TEMPLATES.items() for t in own for _ in range(4)]
    sure, right = [], []
    for want, text in [*said, *((license_scan.UNKNOWN, x) for x in plain)]:
        p = model.probabilities(license_scan.features(license_scan.words_of(text)))
        sure.append(p.max())
        right.append(license_scan.FAMILIES[int(p.argmax())] == want)
    assert abs(sum(sure) / len(sure) - sum(right) / len(right)) < 0.1 and sum(right) > 0.9 * len(right)


def brute(model, text):
    """All windows of each block: the least that hold enough of a template, widened by lines that add pairs, and their single lines; then the most telling first."""
    out = []
    for block in license_scan.blocks(text):
        n, words = len(block), [license_scan.words_of(x) for _, _, x in block]

        def pairs(a, b, words=words):
            flat = [w for own in words[a : b + 1] for w in own]
            return set(zip(flat, flat[1:], strict=False))

        spans = set()
        for t, (_, wanted) in enumerate(license_scan._ALL):
            enough = [(a, b) for a in range(n) for b in range(a, n) if len(pairs(a, b) & wanted) >= license_scan._ENOUGH[t]]
            for a, b in enough:
                if any((c, d) != (a, b) and a <= c and d <= b for c, d in enough):
                    continue
                while True:
                    ahead = b + 1 < n and pairs(a, b + 1) & wanted > pairs(a, b) & wanted
                    behind = a > 0 and pairs(a - 1, b) & wanted > pairs(a, b) & wanted
                    if not ahead and not behind:
                        break
                    a, b = a - bool(behind), b + bool(ahead)
                spans.add((a, b))
        spans |= {(k, k) for a, b in spans for k in range(a, b + 1)}
        best = []
        for a, b in spans:
            family = license_scan.classify(model, " ".join(x for _, _, x in block[a : b + 1]))[0]
            if family != license_scan.UNKNOWN:
                best.append((-max(len(pairs(a, b) & t) for t in license_scan._PAIRS[family]), b - a, a, b, family))
        taken = set()
        for _, _, a, b, family in sorted(best):
            if taken.isdisjoint(range(a, b + 1)):
                taken.update(range(a, b + 1))
                out.append((family, block[a][0], block[b][1]))
    return sorted(out, key=lambda x: x[1])


def test_findings_match_brute_force_over_all_windows(docs_of, model):
    rng = random.Random(12)
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(1, 3)):
            words = rng.choice([t for own in license_scan.TEMPLATES.values() for t in own]).split()
            cut = sorted(rng.sample(range(1, len(words)), min(len(words) - 1, rng.randint(0, 3)))) if len(words) > 1 else []
            lines += [" ".join(words[a:b]) for a, b in zip([0, *cut], [*cut, len(words)], strict=True)]
            lines += rng.sample(["", "int x;", "plain prose of a file", "see the readme"], rng.randint(0, 2))
        texts.append("\n".join(lines))
    got = {r.doc_id: r.findings for r in license_scan.scan_documents(docs_of(enumerate(texts)), model).collect()}
    for i, text in enumerate(texts):
        assert got[i] == ",".join(f"{f}:{a}:{b}" for f, a, b in brute(model, text)), text


def test_spans_and_odd_rows(docs_of, model):
    text = "first line\n\nReleased under the MIT License.\n\U0001f600 x\nLicensed under CC BY-NC 4.0."
    docs = docs_of([(1, text), (2, None), (3, ""), (None, "Released under the MIT License."), (4, "word " * 100_000)])
    got = {r.doc_id: r for r in license_scan.scan_documents(docs, model).collect()}
    assert got[1].findings == "mit:12:43,cc-by-nc:48:76" and got[1].families == "cc-by-nc,mit" and got[1].n_paragraphs == 4
    assert text[12:43] == "Released under the MIT License."
    assert got[2].n_paragraphs == got[3].n_found == 0 and got[None].families == "mit" and got[4].n_found == 0
    assert license_scan.scan_documents(docs_of([]), model).count() == 0


def test_no_line_is_skipped_that_a_template_confirms():
    for i, (_, pairs) in enumerate(license_scan._ALL):
        left = [p for p in pairs if not any(a in w for w in p for a in license_scan.ANCHORS)]
        assert len(left) < license_scan._ENOUGH[i]


def test_all_rights_reserved_in_the_whole_table(spark, sf_dir):
    lines = {"All rights reserved.": "all-rights-reserved", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op3_license_scans(spark, sf_dir).collect():
        own = text[r.doc_id].split("\n")
        assert {lines[x] for x in own if x in lines} == set(filter(None, r.families.split(","))) and r.n_found == sum(x in lines for x in own)


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
    "bsd": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above""",
    "gpl-3.0": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
}


@pytest.mark.parametrize("family", WRAPPED)
def test_wrapped_notices(docs_of, model, family):
    notice = WRAPPED[family]
    alone = f"Some prose here\n\n{notice}\n\nmore words"
    amid = f"int x;\nint y;\n{notice}\nint z;\n"
    rows = {r.doc_id: r for r in license_scan.scan_documents(docs_of([(0, alone), (1, amid)]), model).collect()}
    for i, text in enumerate((alone, amid)):
        assert rows[i].families == family and rows[i].n_found == 1, rows[i]
        _, start, end = rows[i].findings.split(":")
        part = text[int(start) : int(end)]
        assert part in notice and part.count("\n") >= 1


NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TOLD_APART = [
    (NOTICE.format("Affero General Public License", 3), "agpl-3.0"),
    (NOTICE.format("General Public License", 2), "gpl-2.0-or-later"),
    (NOTICE.format("General Public License", 3), "gpl-3.0"),
    (NOTICE.format("Lesser General Public License", 3), "lgpl-3.0"),
    (NOTICE.format("Lesser General Public License", 2.1), "lgpl"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
    ("Licensed under CC BY-NC-ND 4.0.", "cc-by-nc-nd"),
    ("This is not released under the MIT License.", "unknown"),
    ("Never released under the BSD License.", "unknown"),
    ("The MIT license does not apply here.", "unknown"),
    ("Licensed under the Apache License, Version 1.1.", "unknown"),
    ("She studied the MIT License at length in her course on law", "unknown"),
    ("There is NO WARRANTY. Released under the MIT License.", "mit"),
    ("MIT License", "mit"),
    ("The MIT License (MIT)", "mit"),
    ("License: MIT", "mit"),
    ("Mozilla Public License 2.0", "mpl-2.0"),
    ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3.0"),
    ("SPDX-License-Identifier: GPL-2.0+", "gpl-2.0-or-later"),
    ("License: BSD-2-Clause", "bsd"),
]


@pytest.mark.parametrize(("text", "family"), TOLD_APART)
def test_licences_named_alike_are_told_apart(docs_of, model, text, family):
    """As a line, and wrapped among others."""
    assert license_scan.classify(model, text)[0] == family
    words = text.split()
    wrapped = "\n".join(["int x;", *(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)), "int y;"])
    rows = license_scan.scan_documents(docs_of([(0, text), (1, wrapped)]), model).collect()
    assert all(r.families == ("" if family == "unknown" else family) for r in rows), rows
    assert all(0.5 <= float(p) <= 1 for r in rows for p in filter(None, r.probabilities.split(",")))


def test_a_denial_in_the_line_before(docs_of, model):
    rows = license_scan.scan_documents(docs_of([(0, "This file is not\nreleased under the MIT License."), (1, "It does not.\nReleased under the MIT License."), (2, "not\n\nReleased under the MIT License.")]), model).collect()
    assert {r.doc_id: r.families for r in rows} == {0: "", 1: "mit", 2: "mit"}


def test_templates_that_training_left_out_are_told_by_calibrated_probabilities(spark):
    """Without one text of each family that has several: how likely the model calls its choice of those is about how often it is right."""
    lines = [r.text.split("\n")[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text <> ''").collect()]
    own = dict(license_scan.TEMPLATES)
    left_out = [(f, texts[1]) for f, texts in own.items() if len(texts) > 2]
    try:
        license_scan.TEMPLATES.update({f: tuple(t for t in texts if (f, t) not in left_out) for f, texts in own.items()})
        model = license_scan.train(lines[: len(lines) // 2])
    finally:
        license_scan.TEMPLATES.update(own)
    unseen = [(license_scan.UNKNOWN, x) for x in lines[len(lines) // 2 :] if not any(license_scan.confirms(f, license_scan.words_of(x)) >= license_scan.LEAST_SHARE for f in own)]
    gaps = []
    for cases in (left_out, unseen):  # both kinds count alike
        said = [(want, model.probabilities(license_scan.features(license_scan.words_of(t)))) for want, t in cases]
        right = sum(license_scan.FAMILIES[int(p.argmax())] == want for want, p in said) / len(said)
        gaps.append(sum(float(p.max()) for _, p in said) / len(said) - right)
    assert abs(sum(gaps) / 2) < 0.15, gaps
