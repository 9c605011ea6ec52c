"""Spelling variants against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opsignal.llm import spelling
from opsignal.llm.fm_index import Vocabulary, rotations


def edits(word, letters):
    """All texts one edit apart."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def brute(counts, ratio=10):
    """word -> (n, n_near, form, form_n, root)."""
    letters = set("".join(counts))
    near = {w: [v for v in edits(w, letters) if v in counts] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v)) for w in counts if near[w]}
    form = {w: v for w, v in best.items() if counts[v] >= ratio * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items()}


def run(spark, counts, **kw):
    rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), **kw).collect()
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


def test_rotations_are_sorted():
    rnd = random.Random(5)
    import numpy as np

    for _ in range(50):
        words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 30))}
        text = "".join("\0" + w for w in sorted(words))
        order = rotations(np.array([ord(c) for c in text]))
        turned = [text[i:] + text[:i] for i in order]
        assert turned == sorted(turned)


@pytest.mark.parametrize("letters, longest", [("ab", 6), ("abcé", 7), ("aÿz\U0001f600", 3)])
def test_both_searches_find_every_word_once(letters, longest):
    rnd = random.Random(longest)
    for _ in range(60):
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, longest))) for _ in range(rnd.randint(1, 80))})
        index = Vocabulary(words, ["b", letters])
        queries = words + [q for q in ("b", letters) if q not in words]
        for left in (True, False):
            who, what = index.one_error(queries, left)
            got = [(queries[i], index.words[j]) for i, j in zip(who, what)]
            exact = (lambda w, v: v.startswith(w[: len(w) // 2])) if left else (lambda w, v: v.endswith(w[len(w) // 2 :]))
            want = {(w, v) for w in queries for v in words if v in edits(w, set(letters)) and exact(w, v)}
            if left:
                assert sorted(got) == sorted(want)
            else:
                assert len(set(got)) == len(got) and set(got) <= want
                # what it need not find is found from the left
                assert all(v.startswith(w[: len(w) // 2]) for w, v in want - set(got))


def vocabulary(seed, size):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("abcdé") for _ in range(rnd.randint(7, 10))) for _ in range(size // 4)}
    for w in list(words):
        words |= set(rnd.sample(sorted(edits(w, "abcdé")), 3))
    return {w: int(10 ** rnd.uniform(0.4, 5)) for w in words}


@pytest.mark.parametrize("kw", [{}, {"share": 50}, {"share": 10_000, "most": 60}])
def test_against_brute_force(spark, kw):
    counts = vocabulary(12, 1200)
    got = run(spark, counts, **kw)
    assert got == brute(counts)
    assert sum(1 for v in got.values() if v[2]) > 50 and any(v[4] != v[2] for v in got.values() if v[2])


def test_chains_ties_and_long_words(spark):
    counts = {f"chained{'x' * i}": 3 * 10**i for i in range(9)}
    counts |= {"tiedword": 2, "tiedwort": 20, "tiedwore": 20, "lonesome": 7, "a" * 3000: 2, "a" * 2999: 200, "b" + "a" * 2999: 5}
    got = run(spark, counts)
    assert got == brute(counts)
    assert got["chained"][4] == "chainedxxxxxxxx" and got["tiedword"][2] == "tiedwore" and got["lonesome"] == (7, 0, None, None, "lonesome")
    assert run(spark, {}) == {}
    assert run(spark, {"onlyone": 3}) == {"onlyone": (3, 0, None, None, "onlyone")}


def test_a_group_that_holds_a_third_of_all_words(spark):
    rnd = random.Random(2)
    counts = {"same" + "".join(rnd.choice("abcdefgh") for _ in range(4)): rnd.randint(2, 900) for _ in range(700)}
    counts |= vocabulary(4, 800)
    assert run(spark, counts, share=20, most=30) == brute(counts)


def test_counted_words(documents):
    rows = [
        (1, "Wörterbuch wörterbuch WÖRTERBUCH ab"), (2, None), (3, ""), (None, "wörterbuch, short×longerÿword"), (3, "longerÿword" * 2),
        (4, "x" * 60_000 + " " + "x" * 60_000), (5, "one1seven77letters letters"),
    ]
    got = {r.word: r.n for r in spelling.counted_words(documents(*rows), 7, 1).collect()}
    # only A-Z are lower-cased; the multiplication sign lies inside the range of letters
    assert got == Counter({"wörterbuch": 3, "wÖrterbuch": 1, "short×longerÿword": 1, "longerÿword" * 2: 1, "x" * 60_000: 2, "letters": 2})
    cut = lambda doc_id, run: F.when(doc_id == 5, F.left(run, F.lit(3))).otherwise(run)
    assert {r.word: r.n for r in spelling.counted_words(documents(*rows), 7, 2, cut).collect()} == {"wörterbuch": 3, "x" * 60_000: 2}
    assert spelling.counted_words(documents(), 7, 1).collect() == []
