"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text

# Where the lexicon starts; it grows by what the labelled texts show.
INSULTS = ("bastard", "clown", "disgusting", "dumb", "fool", "idiot", "loser", "moron", "pathetic", "scum", "shut", "stupid", "trash", "ugly", "worthless")
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "tu", "te", "toi", "ton", "vous", "votre", "ti", "tus", "usted", "ustedes")
DISGUISES = str.maketrans("01345@$!|7", "oieasasiit")

#: Labelled rows that lexicon and trees are fitted on, at most (in expectation).
SAMPLE = 20_000
LEXICON = 400
PREFIXES = (4, 5, 6)
NEAR = 5
WORDS = 400_000
FOLDS = 4
AROUND = string.punctuation + "…«»“”„‘’¡¿–—"
NAMES = (
    "hit_rate", "hits", "weight_rate", "heaviest", "different_hits", "insult_rate", "you_rate", "near_you", "capital_rate",
    "capital_words", "call_rate", "punctuation_rate", "obfuscation_rate", "obfuscated_hits", "digit_rate", "length",
)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether labels of the document are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0


def plain(word: str) -> tuple[str, bool]:
    """The word without what surrounds it, and whether it was disguised by digits or signs inside."""
    word = word.strip(AROUND)
    if word.isalpha():
        return word, False
    bare = re.sub(r"[\W\d_]", "", word.translate(DISGUISES)) if re.search(r"[^\W\d_]", word) else ""
    return bare, len(bare) >= 3 and not re.search(r"[-'’/.@:]", word)


def terms_of(word: str) -> list[str]:
    """The word, and marked by a star what it starts with."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class Reader:
    """Features of texts with one lexicon (term to weight)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.you, self.insults = lexicon, frozenset(SECOND_PERSON), frozenset(INSULTS)
        self.codes: dict[str, int] = {}
        self.kinds: list[tuple[float, bool, bool, bool]] = [(0.0, False, False, False)]
        self.known: dict[tuple[float, bool, bool, bool], int] = {self.kinds[0]: 0}
        self.table = np.zeros((1, 4))

    def _code(self, token: str) -> int:
        word, disguised = plain(token)
        weight = max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0) if word else 0.0
        kind = (weight, word in self.you, word in self.insults, disguised)
        code = self.known.get(kind)
        if code is None:
            code = self.known[kind] = len(self.kinds)
            self.kinds.append(kind)
            self.table = np.array(self.kinds, dtype=float)
        if len(self.codes) < WORDS:
            self.codes[token] = code
        return code

    def features(self, text: str) -> list[float]:
        tokens = text.lower().split()
        codes = list(map(self.codes.get, tokens))
        if None in codes:
            codes = [self._code(t) if c is None else c for t, c in zip(tokens, codes)]
        n = max(1, len(tokens))
        weight, you, insult, disguised = self.table[np.array(codes, dtype=np.int64)].T if tokens else np.zeros((4, 0))
        hit = np.flatnonzero(weight > 0)
        near = 0
        if len(hit) and you.any():
            where = np.flatnonzero(you)
            nearest = np.searchsorted(where, hit)
            gap = np.minimum(np.abs(hit - where[np.clip(nearest, 0, len(where) - 1)]), np.abs(hit - where[np.clip(nearest - 1, 0, len(where) - 1)]))
            near = int((gap <= NEAR).sum())
        data = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=128)
        size = max(1, int(data.sum()))
        shouted = sum(map(str.isupper, text.split()))
        punctuation = int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum())
        return [
            len(hit) / n, float(np.log1p(len(hit))), float(weight.sum()) / n, float(weight.max(initial=0.0)),
            float(np.log1p(len({tokens[i] for i in hit.tolist()}))), float(insult.sum()) / n, float(you.sum()) / n, near / max(1, len(hit)),
            float(data[65:91].sum()) / size, shouted / n, float(data[33] + data[63]) / size, punctuation / size,
            float(disguised.sum()) / n, float(((weight > 0) & (disguised > 0)).sum()), float(data[48:58].sum()) / size, float(np.log1p(len(tokens))),
        ]


def features(text: Column, lexicon: dict[str, float]) -> Column:
    @F.pandas_udf("array<double>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(lexicon)
        for texts in batches:
            yield pd.Series([reader.features(t) for t in texts])

    return read(text)


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic_i, clean_i for each fold i): documents that hold the term. ``rows``: text, label, fold."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text, label, fold in zip(batch["text"], batch["label"], batch["fold"]):
                words = {plain(w)[0] for w in text.lower().split()}
                terms = {t for w in words if len(w) >= 3 for t in terms_of(w)}
                found.update((t, int(fold), int(label)) for t in terms)
        if found:
            keys = list(found)
            yield pd.DataFrame({"term": [k[0] for k in keys], "fold": [k[1] for k in keys], "label": [k[2] for k in keys], "n": list(found.values())})

    counts = rows.select("text", "label", "fold").mapInPandas(count, "term string, fold int, label int, n long")
    cells = [
        F.sum(F.when((F.col("fold") == f) & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"{'clean' if y == 0 else 'toxic'}_{f}")
        for f in range(FOLDS) for y in (0, 1)
    ]
    return counts.groupBy("term").agg(*cells)


def learned_lexicon(counts: DataFrame, totals: dict[tuple[int, int], int], folds: list[int], size: int) -> dict[str, float]:
    """The terms that tell toxic from clean texts best in these folds, by likelihood ratio; their log odds."""
    toxic, clean = (max(1, sum(totals.get((f, y), 0) for f in folds)) for y in (1, 0))
    t = sum((F.col(f"toxic_{f}") for f in folds), F.lit(0))
    c = sum((F.col(f"clean_{f}") for f in folds), F.lit(0))
    odds = F.log((t + 0.5) / (toxic + 1.0)) - F.log((c + 0.5) / (clean + 1.0))
    share = (t + c) / float(toxic + clean)
    ratio = t * F.log((t + 1e-9) / (share * toxic)) + c * F.log((c + 1e-9) / (share * clean))
    best = (
        counts.select("term", t.alias("t"), odds.alias("odds"), ratio.alias("ratio"))
        .where("t >= 3 AND odds > 1.5 AND ratio > 4")
        .orderBy(F.desc("ratio"), "term")
        .limit(size)
    )
    return {r["term"]: float(r["odds"]) for r in best.select("term", "odds").collect()}


@dataclass
class Model:
    """What fitting yields. Without both classes among the labels there are no trees, and ``base`` is the score."""

    lexicon: dict[str, float]
    base: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def score(self, docs: DataFrame, column: str = "score") -> DataFrame:
        """``docs`` with a score from 0 to 1. A column of that name is replaced; a null text is empty."""
        if self.trees is None:
            return docs.withColumn(column, F.lit(self.base))
        held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != column]).alias("_doc"))
        read = held.withColumn("features", array_to_vector(features(whole_text("_doc.text"), self.lexicon)))
        raw = self.trees.transform(read).withColumn("_p", vector_to_array("probability")[1])
        done = self.calibration.transform(raw.select("_doc", "_p"))
        # the small share of the trees' own value keeps the order inside a step of the calibration
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_calibrated") * 0.99 + F.col("_p") * 0.01))
        return done.select("_doc.*", score.alias(column))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = LEXICON, seed: int = 11) -> Model:
    """Learns from labelled documents that are not held out.

    At most ``sample`` labelled rows are used, in expectation, chosen by a hash of the doc_id, then of the text; everything
    collected is bounded by ``size``. Terms are counted per fold, and the features of a fold are read with a
    lexicon learned from the other folds, so that the trees meet terms as they will meet them in new texts.

    Cases: labels that are null or neither 0 nor 1 are ignored; of several labels of a doc_id the largest
    holds. Without labels of both classes the model gives every text the share of toxic labels (0 without any).
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    )
    n = known.count()
    spot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20))
    chosen = known.where(spot < int((1 << 20) * min(1.0, sample / max(1, n))))
    chosen = F.broadcast(staged(chosen, "toxicity-labels"))
    # a doc_id may name many rows: those are thinned by their texts, and alike ones count once
    found = docs.select("doc_id").join(chosen, "doc_id").count()
    named = lambda salt: F.xxhash64("doc_id", F.md5("text"), F.lit(salt))
    rows = docs.select("doc_id", whole_text().alias("text")).join(chosen, "doc_id")
    rows = rows.where(F.pmod(named(seed + 2), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(1, found))))
    rows = rows.dropDuplicates(["doc_id", "text"])
    rows = staged(rows.withColumn("fold", F.pmod(named(seed + 1), F.lit(FOLDS)).cast("int")), "toxicity-sample")
    totals = {(r["fold"], r["label"]): r["n"] for r in rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = (sum(v for (_, y), v in totals.items() if y == c) for c in (1, 0))
    if not toxic or not clean:
        return Model({}, float(toxic > 0))
    counts = staged(term_counts(rows), "term-counts")
    start = {w: 3.0 for w in INSULTS}
    lexicons = [start | learned_lexicon(counts, totals, [g for g in range(FOLDS) if g != f], size) for f in range(FOLDS)]
    parts = [rows.where(F.col("fold") == f).select("label", "fold", features(F.col("text"), lexicons[f]).alias("x")) for f in range(FOLDS)]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    table = staged(table, "toxicity-features").select("label", "fold", array_to_vector("x").alias("features"))
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2, minInstancesPerNode=3, seed=seed)
    last = FOLDS - 1
    enough = min(totals.get((last, 0), 0), totals.get((last, 1), 0)) >= 20
    model = trees.fit(table.where(F.col("fold") != last) if enough else table)
    seen = model.transform(table.where(F.col("fold") == last) if enough else table)
    steps = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_calibrated")
    calibration = steps.fit(seen.select(F.col("label").cast("double").alias("label"), vector_to_array("probability")[1].alias("_p")))
    return Model(start | learned_lexicon(counts, totals, list(range(FOLDS)), size), toxic / (toxic + clean), model, calibration)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from a score of 0.5).

    Cases: null and empty texts are scored like any other, by their features. Rows that repeat a doc_id are
    scored each for itself. Result columns of the same name in ``docs`` are replaced. An empty table of
    documents gives an empty result.
    """
    scored = fit(docs, labels, sample).score(docs)
    return scored.withColumns(
        {"held_out": F.coalesce(held_out(F.col("doc_id")), F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")}
    )
