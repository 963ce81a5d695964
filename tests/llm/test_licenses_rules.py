"""The gate, the folds, repeatable training, and the scan against a plain Python version."""

import math
import re

import pytest
import regex

from vistrack.llm import licenses


def words(t):
    return [re.sub(r"[.+-]+$", "", w) for w in regex.findall(r"[\p{L}\p{N}][\p{L}\p{N}.+-]*", t.lower())]


def grams(w, n):
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def template_grams(t):
    w = words(t)
    return set(grams(w, 3)) or {" ".join(w)}


def test_no_template_can_be_confirmed_without_a_word_of_the_gate():
    for texts in licenses.TEMPLATES.values():
        for t in texts:
            g = template_grams(t)
            assert sum(not re.search(licenses.GATE, x) for x in g) < licenses.CONFIRM * len(g), t


@pytest.fixture(scope="module")
def model(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return licenses.train(spark, docs)


def test_training_does_not_depend_on_how_rows_lie(spark, small, model):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(7, "source")
    again = licenses.train(spark, docs)
    assert [w[:2] for w in again["weights"]] == [w[:2] for w in model["weights"]]
    assert all(math.isclose(a[2], b[2], abs_tol=1e-9) for a, b in zip(again["weights"], model["weights"], strict=True))
    assert (again["temperature"], round(again["least"], 9)) == (model["temperature"], round(model["least"], 9))


def test_folds_hold_whole_templates(spark, small):
    rows = licenses.training_set(spark, spark.read.parquet(f"{small}/documents.parquet")).collect()
    for texts in licenses.TEMPLATES.values():
        for t in texts:
            assert len({r.fold for r in rows if t in r.text and r.family != licenses.UNKNOWN}) == 1
    for x in licenses.SOUNDS_LIKE:
        assert len({r.fold for r in rows if x in r.text and r.family == licenses.UNKNOWN}) == 1


def windows(text):
    out = []
    for block in re.split(r"\n\s*\n", text):
        lines = block.split("\n")
        half = licenses.WINDOW // 2
        if len(lines) > 1:
            for i in range(0, max(len(lines) - licenses.WINDOW, 0) + half, half):
                out.append(" ".join(lines[i : i + licenses.WINDOW]))
    return out


def plain_scan(text, model):
    """(families, family) of a text, paragraph by paragraph, without gate."""
    weights = {}
    for g, f, w in model["weights"]:
        weights.setdefault(g, {})[f] = w
    found = []
    for p in [*(text or "").split("\n"), *windows(text or "")]:
        w = words(p)
        own = {*w, *grams(w, 2), *grams(w, 3)}
        hit = [weights[g] for g in own if g in weights]
        z = {f: (b + sum(h.get(f, 0.0) for h in hit)) / model["temperature"] for f, b in model["intercepts"].items()}
        top = max(z, key=z.get)
        probability = 1 / sum(math.exp(v - z[top]) for v in z.values())
        if not hit or top == licenses.UNKNOWN or probability < model["least"]:
            continue
        coverage = max(len(own & g) / len(g) for g in map(template_grams, licenses.TEMPLATES[top]))
        if coverage >= licenses.CONFIRM:
            found.append((probability, coverage, top))
    return ",".join(sorted({f for _, _, f in found})), max(found)[2] if found else licenses.UNKNOWN


def test_scan_equals_the_plain_version(spark, small, model):
    from test_licenses_wrapped import NOTICES

    import textwrap

    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += ["\n".join(textwrap.wrap(t, 50)) for t in NOTICES.values()] + ["\n".join(textwrap.wrap(t, 30)) + "\n\nafter" for t in NOTICES.values()]
    texts += [" ".join(licenses.TEMPLATES["MIT"][4].split()[4:]), "", None]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in enumerate(texts)], "doc_id long, text string, words string, uid int")
    got = {r.doc_id: (r.families, r.family) for r in licenses.scan(docs, model).collect()}
    want = {i: plain_scan(t, model) for i, t in enumerate(texts)}
    assert got == want and sum(f != "" for f, _ in want.values()) >= 8


def test_repeated_rows_and_ties(spark, model):
    row = (1, "Released under the MIT License.\nReleased under the BSD 3-Clause License.", "x")
    docs = spark.createDataFrame([row, row, (None, row[1], "y")], "doc_id long, text string, hits string")
    got = licenses.scan(docs, model).collect()
    assert len(got) == 3 and {r.families for r in got} == {"BSD,MIT"} and len({(r.family, r.probability) for r in got}) == 1


IDENTIFIERS = {
    "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "LGPL-2.1-only": "LGPL", "LGPL-2.1-or-later": "LGPL", "LGPL-3.0-only": "LGPL", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0",
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD", "MPL-2.0": "MPL-2.0", "ISC": "ISC", "CC0-1.0": "CC0", "CC-BY-4.0": "CC-BY", "CC-BY-SA-4.0": "CC-BY-SA", "CC-BY-NC-4.0": "CC-BY-NC", "Unlicense": "Unlicense", "BSL-1.0": "BSL-1.0", "EPL-2.0": "EPL-2.0",
}
SHORT = {
    "Licensed under GPLv3": "GPL-3.0", "License: MIT": "MIT", "The code is MIT licensed.": "MIT", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0", "Licensed under the Eclipse Public License, version 2.0.": "EPL-2.0", "Released under the BSD 2-Clause License.": "BSD",
    "This is free and unencumbered software released into the public domain.": "Unlicense", "He studied at MIT and has a license.": "unknown", "The eclipse was seen by the public.": "unknown", "A boost to the software business": "unknown",
}


def test_identifiers_and_short_forms(spark, model):
    texts = {f"// SPDX-License-Identifier: {i}\nint main() {{}}": f for i, f in IDENTIFIERS.items()} | {f"Some words first.\n{s}\nand more": f for s, f in SHORT.items()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.family for r in licenses.scan(docs, model).collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == texts
