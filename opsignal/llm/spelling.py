"""Spelling variants of a vocabulary: words one edit apart, and the common form that a rare one belongs to."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, staged, whole_text
from .fm_index import Vocabulary

LETTERS = r"a-zÀ-ÿ"
#: Words whose halves hash to the same number share an index; beyond so many words it is cut into parts.
SHARE, MOST = 2000, 20_000


def counted_words(docs: DataFrame, least_length: int, least_count: int, spelled: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts with A-Z in lower case, and how often they occur.

    ``spelled`` may rewrite an occurrence, given (doc_id, run), to something that is not longer.
    """
    runs = F.regexp_extract_all(lower_az(whole_text()), F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0))
    each = docs.select("doc_id", F.explode(runs).alias("word"))
    if spelled:
        each = each.select(spelled(F.col("doc_id"), F.col("word")).alias("word")).where(F.char_length("word") >= least_length)
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _half(word: Column, length: Column, left: bool) -> Column:
    """The half that a query of ``length`` letters matches exactly."""
    n = F.floor(length / 2).cast("int")
    return F.left(word, n) if left else F.right(word, length - n)


def _grouped(words: DataFrame, left: bool, groups: int) -> DataFrame:
    """Each word in the group of its own half, where it asks, and in those of all halves it could be asked by."""
    length = F.char_length("word")
    group = lambda half: F.pmod(F.xxhash64(half, F.lit(left)), F.lit(groups))
    asks = group(_half(F.col("word"), length, left))
    answers = F.array_distinct(F.array(*[group(_half(F.col("word"), length + d, left)) for d in (-1, 0, 1)]))
    rows = words.select("word", "n", asks.alias("asks"), F.explode(answers).alias("group"))
    return rows.select("word", "n", F.lit(left).alias("left"), "group", (F.col("asks") == F.col("group")).alias("asks"))


def near_pairs(words: DataFrame, share: int = SHARE, most: int = MOST) -> DataFrame:
    """(word, near, near_n): every pair of words exactly one edit apart, both ways, each once.

    Two words one edit apart agree in the left or the right half of the first. So words meet by a half: those of
    a group are indexed, and the group's words search them. A group with more than ``most`` rows is cut: each part
    of its words asks each part of the index, so memory is bounded by ``most`` whatever the data.
    """
    words = staged(words, "vocabulary")
    total = words.count()
    groups = max(1, -(-total // share))
    halves = staged(_grouped(words, True, groups).unionByName(_grouped(words, False, groups)), "vocabulary-halves")
    # fewer than six rows a word in all, so at most 6 * total / most such groups
    large = halves.groupBy("left", "group").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most)
    large = large.select("left", "group", F.ceil(F.col("_rows") / most).cast("int").alias("parts"))
    halves = halves.join(F.broadcast(large), ["left", "group"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("word", F.lit("part")), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    asked = halves.select("left", "group", part.alias("held"), F.explode(every).alias("asker"), "word", "n", F.lit(False).alias("asks"))
    asking = halves.where("asks").select("left", "group", F.explode(every).alias("held"), part.alias("asker"), "word", "n", "asks")

    def rows(pairs: list[tuple[str, str]], near_n: list[int]) -> pd.DataFrame:
        columns = {"word": [w for w, _ in pairs], "near": [v for _, v in pairs], "near_n": near_n}
        return pd.DataFrame({k: pd.Series(v, dtype="int64" if k == "near_n" else object) for k, v in columns.items()})

    def search(g: pd.DataFrame) -> pd.DataFrame:
        held, left = g[~g["asks"]], bool(g["left"].iat[0])
        queries = g.loc[g["asks"], "word"].tolist()
        if held.empty or not queries:
            return rows([], [])
        index = Vocabulary(held["word"].tolist(), queries)
        count = dict(zip(held["word"], held["n"]))
        who, what = index.one_error(queries, left)
        pairs = [(queries[i], index.words[j]) for i, j in zip(who.tolist(), what.tolist())]
        if not left:
            # found by the left half already
            pairs = [(w, v) for w, v in pairs if not v.startswith(w[: len(w) // 2])]
        return rows(pairs, [count[v] for _, v in pairs])

    both = asked.unionByName(asking).groupBy("left", "group", "held", "asker")
    return both.applyInPandas(search, "word string, near string, near_n long")


def variants(words: DataFrame, ratio: int = 10, share: int = SHARE, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n, root for every row of ``words`` (word, n; words are distinct).

    Near words differ by one inserted, deleted or replaced code point. The form is the near word of largest n
    (ties: the smallest in code-point order), if that n is at least ``ratio`` times the word's; root is the end of the
    chain of forms, the word itself if it has none. A count grows ``ratio``-fold along each link, so a
    chain is at most log(largest n) long and doubling its reach ends after a few rounds.

    Cases: words without near words have n_near 0 and no form. An empty table gives an empty result.
    """
    words = staged(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = near_pairs(words, share, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("best.less") >= ratio * F.col("n")
    formed = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    formed = staged(formed, "forms")
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    top = formed.agg(F.max("n").alias("n")).first().n or 1
    longest = max(1, math.floor(math.log(top, ratio)) + 1)
    for _ in range(math.ceil(math.log2(longest))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = staged(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
