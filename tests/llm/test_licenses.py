import math
from collections import Counter

import pytest
from millrace.llm import licenses
from millrace.llm.license_templates import TEMPLATES
from millrace.llm.licenses import passages, scan_licenses, terms_of


def _texts(name):
    return [t for n, t in TEMPLATES if n == name]


def _comment(text, mark):
    words = text.split()
    return "\n".join(mark + " ".join(words[k : k + 11]) for k in range(0, len(words), 11))


CASES = [
    ("a/gpl3.c", "/*\n" + _comment(_texts("GPL-3.0")[2], " * ") + "\n */\nint main() { return 0; }\n", "GPL-3.0"),
    ("a/gpl2.py", _comment(_texts("GPL-2.0")[0], "# ") + "\n\nimport os\n", "GPL-2.0"),
    ("a/apache.java", "// Copyright 2020 The Authors\n//\n" + _comment(_texts("Apache-2.0")[0], "// ") + "\npackage a;", "Apache-2.0"),
    ("a/spdx.rs", "// SPDX-License-Identifier: Apache-2.0\nfn main() {}", "Apache-2.0"),
    ("a/spdx2.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
    ("a/spdx3.c", "/* SPDX-License-Identifier: Unknown-9 */", None),
    ("a/isc.c", _comment(_texts("ISC")[0], " * "), "ISC"),
    ("a/LICENSE", "Copyright (c) 2001, Somebody\n\n" + _comment(_texts("BSD-2-Clause")[0], ""), "BSD-2-Clause"),
    ("a/b/LICENSE.md", "# MIT\n\nCopyright (c) 2011 Somebody\n\n" + _comment(_texts("MIT")[1], ""), "MIT"),
    ("a/prose.txt", "The hills are green. Licensed under the Apache License, Version 2.0. The sea is far away and deep.", "Apache-2.0"),
    ("a/none.txt", "He spoke of copyright and of the long history that the law has in this town by the river.", None),
    ("a/mpl.js", "/* " + _comment(_texts("MPL-2.0")[0], "") + " */", "MPL-2.0"),
]


def _brute(rows, least=0.6):
    """Plain TF-IDF cosine of every passage with every template."""
    every = {p: [terms_of(x) for x in passages(t, p.rsplit("/")[-1].startswith("LICENSE"))] for p, t in rows}
    found, own = [c for cs in every.values() for c in cs], [terms_of(t) for _, t in TEMPLATES]
    known = {t for c in own for t in c}
    df = Counter(t for c in found for t in c)
    n = len(found) + len(own)
    weight = lambda c: {t: f * (math.log(1 + n / (1 + df[t])) if t in known else math.log(1 + n)) for t, f in c.items()}
    size = lambda w: math.sqrt(sum(x * x for x in w.values()))
    out = {}
    for path, counts in every.items():
        best = (0.0, None)
        for c in counts:
            w = weight(c)
            for (name, _), v in zip(TEMPLATES, map(weight, own)):
                cosine = round(sum(x * v.get(t, 0) for t, x in w.items()) / (size(w) * size(v)), 9)
                best = max(best, (cosine, name), key=lambda b: b[0])
        out[path] = best if best[0] >= least else (None, None)
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_headers_and_files_equal_the_plain_cosine(spark, parts):
    rows = [(p, t) for p, t, _ in CASES]
    df = spark.createDataFrame(rows, "path string, text string").repartition(parts)
    got = {r.path: r for r in scan_licenses(df).collect()}
    expect = _brute(rows)
    for path, _, name in CASES:
        assert got[path].license == name == expect[path][1], path
        assert got[path].similarity == (None if name is None else pytest.approx(expect[path][0], abs=1e-6))
    assert got["a/none.txt"].inherited == "BSD-2-Clause" and got["a/spdx3.c"].inherited_from == "a/LICENSE"


def test_ties_repeats_clashing_columns_and_long_texts(spark):
    long = "word " * 300_000 + "\n\nReleased under the MIT License.\n" + "word " * 100
    rows = [("x/LICENSE", "All rights reserved.", 1), ("x/LICENSE", "All rights reserved.", 2), ("x/COPYING", "Released under the ISC License.", 3), ("x/y/z.txt", "", 4), ("q/l.txt", long, 5)]
    df = spark.createDataFrame(rows, "path string, text string, license int").withColumnRenamed("license", "similarity")
    got = {r.path: (r.license, r.inherited, r.inherited_from) for r in scan_licenses(df).collect()}
    assert got == {
        "x/LICENSE": ("Proprietary", None, None), "x/COPYING": ("ISC", None, None), "q/l.txt": ("MIT", None, None),
        "x/y/z.txt": (None, "ISC", "x/COPYING"),
    }
    assert licenses.passages(None, True) == [] and licenses.passages("", True) == []


def test_query_of_null_and_repeated_ids(spark, tmp_path):
    from millrace.llm import queries

    said = "Licensed under the Apache License, Version 2.0."
    rows = [(None, said, "en", "web"), (None, "plain words of no licence", "en", "web"), (None, None, None, None), (7, said, "de", "web"), (7, "words", "de", "web"), (7, "words", "de", "web"), (8, "", "de", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.license, r.inherited) for r in queries.op7_license_scan(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, "Apache-2.0", None), (None, None, "Apache-2.0"), (None, None, None), (7, "Apache-2.0", None), (7, None, "Apache-2.0"), (8, None, "Apache-2.0")], key=str)
