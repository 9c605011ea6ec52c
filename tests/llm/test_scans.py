"""Personal data, licences, toxicity and the pipeline against brute force and planted cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from opsignal.llm import licenses, pii, toxicity
from opsignal.llm.queries import QUERIES

# the expressions as they are given, without the rewriting for linear time
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, expression) in enumerate(PLAIN.items()):
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),  # noqa: B023
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),  # noqa: B023
                "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def spans(df, column):
    return sorted(((r.doc_id, [tuple(s) for s in r[column]]) for r in df.collect()), key=str)


def test_base_spans(documents):
    rnd = random.Random(8)
    parts = ["a@b.c", "_x", "@", ".", "1.2.3.4", "255", "256", "007", " ", "-", "+1 (555) 123-4567", "4111 1111 1111 1111", "é😀", "x.y@z-1.co", "+", "%", "12", "(", "4111-1111-1111-1112"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "1" * 30_000 + "a" * 30_000 + " 1.1.1.1"), (None, "m@n.o"), (903, "q@r.s"), (903, "q@r.s"), (904, "1 " * 5000)]
    got = pii.personal_data(documents(*rows))
    assert spans(got, "base") == sorted(((d, brute_spans(t)) for d, t in rows), key=str)
    assert pii.personal_data(documents()).collect() == []


def test_contexts_find_unseen_identifiers(documents):
    filler = ["noise here 99 words", "a plain text without any"]
    rows = [(i, f"please write to mail user{i}@site.example today and {filler[i % 2]}") for i in range(40)]
    rows += [(100 + i, f"please write to mail person{i}(at)hidden today") for i in range(3)]
    rows += [(200, "write nothing to 77x elsewhere")]
    got = {r.doc_id: r for r in pii.personal_data(documents(*rows)).collect()}
    for i in range(40):
        assert got[i].base == got[i].spans and len(got[i].base) == 1
    # no digit or sign in the masked names of the first round of words: only those with one are candidates
    for i in range(3):
        text = rows[40 + i][1]
        ((start, kind, end),) = [tuple(s) for s in got[100 + i].spans]
        assert got[100 + i].base == [] and kind == 0 and text[start:end] == f"person{i}(at)hidden"
    assert got[200].spans == []


def test_licences(spark, documents):
    files = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0"),
        ("a/x.txt", "nothing to see"),
        ("a/b/y.txt", "some words\n// Released under the MIT License.\nmore words " * 400),
        ("a/b/c/z.txt", None),
        ("a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("d/w.txt", "the licence of the work is in the source"),
        ("d/e.txt", ""),
        (None, "Licensed under CC BY-NC 4.0"),
        ("top.txt", "x"),
        ("top.txt", "x"),
    ]
    df = spark.createDataFrame([(*f, "s", 1) for f in files], "path string, text string, source string, license long")
    got = sorted(((r.path, r.license, r.source, r.license_dir) for r in licenses.scan(df).collect()), key=str)
    want = [
        ("a/LICENSE", "Apache-2.0", "own", None), ("a/x.txt", "Apache-2.0", "inherited", "a"), ("a/b/y.txt", "MIT", "own", None),
        ("a/b/c/z.txt", "GPL-3.0", "inherited", "a/b/c"), ("a/b/c/COPYING.txt", "GPL-3.0", "own", None), ("d/w.txt", None, None, None),
        ("d/e.txt", None, None, None), (None, "CC-BY-NC-4.0", "own", None), ("top.txt", None, None, None), ("top.txt", None, None, None),
    ]
    assert got == sorted(want, key=str)
    assert licenses.scan(df.limit(0)).collect() == []


def brute_licences(files):
    """(path, licence, score) by cosine of every line with every template."""
    split = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    templates = [(n, Counter(split(s))) for n, s in licenses.TEMPLATES]
    words = {w for _, t in templates for w in t}
    df = Counter(w for _, t in files for w in set(split(t or "")) & words)
    idf = {w: math.log((len(files) + 1) / (df[w] + 1)) + 1 for w in words}
    out = []
    for path, text in files:
        best = []
        for line in (text or "").split("\n"):
            v = {w: n * idf[w] for w, n in Counter(split(line)).items() if w in words}
            length = math.sqrt(sum(x * x for x in v.values()))
            for name, t in templates:
                u = {w: n * idf[w] for w, n in t.items()}
                dot = sum(x * u.get(w, 0) for w, x in v.items())
                score = dot / (length * math.sqrt(sum(x * x for x in u.values()))) if dot else 0
                if score >= licenses.THRESHOLD:
                    best.append((-round(score, 9), name))
        out.append((path, min(best)[1] if best else None))
    return sorted(out)


def test_licences_of_the_documents(spark, sf_dir):
    got = QUERIES["op8_license_scan"](spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute_licences([(r.doc_id, docs[r.doc_id]) for r in got])
    assert sorted((r.doc_id, r.license if r.license_source == "own" else None) for r in got) == want


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rnd = random.Random(6)
    words = ["tree", "house", "river", "you", "stone", "cloud", "music", "paper"]
    rows, labels = [], []
    for i in range(900):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                text.insert(rnd.randrange(len(text)), rnd.choice(["idiot", "grumbol", "grumbix", "IDIOT!!", "id1ot"]))
        rows.append((i, " ".join(text), "x"))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    rows += [(2000, None, "x"), (2001, "", "x"), (None, "you idiot idiot", "x"), (2002, "tree " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, features string")
    return docs, spark.createDataFrame([*labels, (5, 1, None)], "doc_id long, quality int, toxic int"), rows


def test_toxicity_on_held_out_texts(toxic_corpus):
    docs, labels, rows = toxic_corpus
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in range(900))
    right = [got[i].predicted == (i % 6 == 0) for i in held]
    assert sum(right) >= 0.95 * len(right)
    assert got[2001].predicted == got[2000].predicted == got[2002].predicted == 0 and got[None].predicted == 1


def test_toxicity_without_labels_of_both_classes(toxic_corpus):
    docs, labels, _ = toxic_corpus
    assert {r.score for r in toxicity.toxicity(docs.limit(5), labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).collect() == []


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf_dir).cache())
    _, calm, lined, single, mixed, last = seen
    scores = {r.doc_id: r.predicted for r in QUERIES["op9_toxicity"](spark, sf_dir).collect()}
    assert {r.doc_id for r in calm.select("doc_id").collect()} == {d for d, p in scores.items() if not p}
    assert all(df.columns == names for df in seen[:-1]) and lined.count() == calm.count()
    assert single.select("doc_id").subtract(lined.select("doc_id")).isEmpty() and single.count() <= lined.count()
    per_doc = mixed.groupBy("doc_id").count()
    assert per_doc.where("count > 2").isEmpty() and per_doc.select("doc_id").subtract(single.select("doc_id")).isEmpty()
    assert last.select("doc_id").distinct().count() == per_doc.count()
    assert last.select("sequence_id").distinct().count() == last.count()


def licence_text(name):
    return dict(licenses.licence_texts())[name]


def test_licence_texts_headers_and_windows(spark):
    filler = " ".join(f"the word {w} is in a list of" for w in "abcdefghijklmnopqrstuvwxyz")
    gpl_header = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 2 of the License, or
# (at your option) any later version."""
    files = [
        ("m/LICENSE", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + licence_text("MIT")), ("m/x.py", "x"),
        ("a/LICENSE", licence_text("Apache-2.0")), ("g/COPYING", licence_text("GPL-3.0")), ("g/two.txt", licence_text("GPL-2.0")),
        ("b/LICENSE", licence_text("BSD-2-Clause")), ("h/h.py", gpl_header), ("h/spdx.py", "// SPDX-License-Identifier: MIT"),
        ("h/plus.py", "SPDX-License-Identifier: GPL-2.0+"), ("h/later.py", "SPDX-License-Identifier: LGPL-2.1-or-later"), ("n/none.py", "SPDX-License-Identifier: Foo-2.0"),
        ("c/cc.md", "Licensed under CC BY 4.0."), ("c/nc.md", "Licensed under CC BY-NC-SA 3.0"),
        ("w/long.txt", filler + " and is Licensed under the Apache License, Version 2.0 but " + filler),
        ("w/wrapped.txt", "/* Licensed under the\n * Apache License,\n * Version 2.0 */"),
        ("o/one.txt", "Apache License, Version 7.0"),
    ]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {
        "m/LICENSE": "MIT", "m/x.py": "MIT", "a/LICENSE": "Apache-2.0", "g/COPYING": "GPL-3.0", "g/two.txt": "GPL-2.0", "b/LICENSE": "BSD-2-Clause",
        "h/h.py": "GPL-2.0-or-later", "h/spdx.py": "MIT", "h/plus.py": "GPL-2.0-or-later", "h/later.py": "LGPL-2.1-or-later", "n/none.py": None,
        "c/cc.md": "CC-BY-4.0", "c/nc.md": "CC-BY-NC-SA-3.0", "w/long.txt": "Apache-2.0", "w/wrapped.txt": "Apache-2.0", "o/one.txt": None,
    }
