"""Near-duplicates by DartMinHash signatures, banded joins and an exact check of every candidate used."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, giving_back, join_counted, packed, staged, whole_text
from .components import components, renamed

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 5 coordinates: texts of similarity 0.8 share none with probability 3 in a million.
BANDS, ROWS = 32, 5
#: Pairs whose signatures agree in a smaller share are not compared exactly. At similarity 0.8 that is more than
#: five standard deviations off.
AGREE = 0.62
#: Nodes of a group that meet in one task at most (in expectation), twice that for two blocks.
BLOCK = 512
#: Blocks with more pairs to check than so many for each node are compared in place.
DENSE = 4
#: Columns of the matrix by which a block is compared in place.
COLUMNS = 4096

u64 = np.uint64
STEP, BASE = u64(0x9E3779B97F4A7C15), 0x100000001B3
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[ord(c) for c in BLANKS]] = True
POWERS = np.ones(1, dtype=u64)
INVERSES = np.ones(1, dtype=u64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> u64(30))) * u64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u64(27))) * u64(0x94D049BB133111EB)
    return x ^ (x >> u64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global POWERS, INVERSES
    if len(POWERS) < n:
        size = max(n, 2 * len(POWERS), 1 << 16)
        one = np.full(size, BASE, dtype=u64)
        back = np.full(size, pow(BASE, -1, 1 << 64), dtype=u64)
        one[0] = back[0] = 1
        POWERS, INVERSES = np.cumprod(one, dtype=u64), np.cumprod(back, dtype=u64)
    return POWERS, INVERSES


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words, lower-cased, and how often each occurs. A text of
    fewer words is one shingle, one without words has none. Words are hashed all at once, from sums over the bytes."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.concatenate([[False], ~IS_BLANK[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=u64), np.zeros(0, dtype=np.int64)
    powers, inverses = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, dtype=u64), np.cumsum((data.astype(u64) + u64(1)) * powers[: len(data)], dtype=u64)])
    words = mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(u64) * STEP)
    span = min(size, len(words))
    runs = np.zeros(len(words) - span + 1, dtype=u64)
    for i in range(span):
        runs = mixed(runs + words[i : i + len(runs)] + u64(i + 1) * STEP)
    return np.unique(runs, return_counts=True)


def bag(elements: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Every occurrence as an element of its own, sorted: the first keeps its hash. The Jaccard index of two bags is
    the weighted one of their elements, the sum of the smaller counts over that of the larger."""
    if len(elements) == int(times.sum()):
        return elements
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    each = np.repeat(elements, times)
    return np.sort(np.where(nth == 0, each, mixed(each + nth.astype(u64) * STEP)))


def _fraction(x: np.ndarray) -> np.ndarray:
    return ((x >> u64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def darts(elements: np.ndarray, weights: np.ndarray | None, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Darts that hit a weighted set: their ranks up to ``limit``, and their names.

    Every element has regions of weight one, side by side. Darts fall on a region in the order of their rank,
    at distances that are exponentially distributed and depend on element and region only; one at weight w
    inside a region hits the set if the element's weight reaches so far. Two sets are hit by the same darts
    wherever their weights overlap.
    """
    regions = mixed(elements + STEP)
    reach = np.ones(len(elements))
    if weights is not None:
        copies = np.maximum(np.ceil(weights).astype(np.int64), 1)
        nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        first = np.repeat(regions, copies)
        # the first region is that of a set without weights
        regions = np.where(nth == 0, first, mixed(first + nth.astype(u64) * STEP))
        reach = np.minimum(1.0, np.repeat(weights, copies) - nth)
    ranks, names = [], []
    at, live, throw = np.zeros(len(regions)), np.arange(len(regions)), 0
    while len(live):
        # many throws at once where most regions are hit often
        many = 1 if limit < 4 else int(limit + 6 * limit**0.5 + 8)
        name = mixed(regions[live, None] + (np.arange(throw + 1, throw + many + 1, dtype=u64) * u64(0xD1B54A32D192ED03))[None, :])
        rank = at[live, None] + np.cumsum(-np.log(_fraction(name)), axis=1)
        hit = rank <= limit
        if weights is not None:
            hit &= _fraction(mixed(name + u64(7))) < reach[live, None]
        ranks.append(rank[hit])
        names.append(name[hit])
        at[live] = rank[:, -1]
        live = live[rank[:, -1] <= limit]
        throw += many
    return np.concatenate(ranks), np.concatenate(names)


def signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash: per coordinate the earliest dart. Two sets agree in a coordinate with the probability of
    their (weighted) Jaccard similarity. Only about k log k darts are looked at, however large the set."""
    total = float(len(elements) if weights is None else weights.sum())
    limit = k * (np.log(k) + 4) / total
    while True:
        ranks, names = darts(elements, weights, limit)
        coordinates = (mixed(names + u64(3)) % u64(k)).astype(np.int64)
        late = np.argsort(-ranks, kind="stable")
        first = np.full(k, -1, dtype=np.int64)
        first[coordinates[late]] = late
        if first.min() >= 0:
            return names[first]
        limit *= 2


def band_keys(names: np.ndarray, bands: int = BANDS) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=u64) * STEP
    for column in names.reshape(bands, -1).T:
        keys = mixed(keys + column)
    return keys.view(np.int64)


def set_name(found: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def text_digest() -> Column:
    """With the doc_id it names a document."""
    return F.unhex(F.md5(whole_text()))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), name (of the bag of shingles), n (its size), bands (keys), signature (16 bits a
    coordinate). A shingle weighs as much as it occurs."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, sizes, bands, marks = [], [], [], []
            for text in batch["text"]:
                elements, times = shingles(text)
                found = bag(elements, times)
                names.append(set_name(found))
                sizes.append(len(found))
                # without repeats all weights are one
                weights = times.astype(np.float64) if len(found) > len(elements) else None
                drawn = signature(elements, weights) if len(found) else np.zeros(0, dtype=u64)
                bands.append(band_keys(drawn) if len(found) else drawn.view(np.int64))
                marks.append((drawn >> u64(48)).astype("<u2").tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "name": names, "n": sizes, "bands": bands, "signature": marks})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), whole_text().alias("text"))
    return texts.mapInPandas(giving_back(read), "doc_id long, digest binary, name binary, n long, bands array<long>, signature binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the wanted sets. ``wanted``: id, and doc_id and digest of a text that has it.

    The join is sorted at every size: a planner that sends few wanted names to all tasks, and shuffles the texts
    where they are many, makes shuffle grow faster than the input.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                sets = [bag(*shingles(t)) for t in part["text"]]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "shingles": [s.view(np.int64) for s in sets]})

    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), text_digest().alias("_t"), whole_text().alias("text"))
    rows = texts.join(wanted.hint("merge"), F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("digest"))).select("id", "text")
    return rows.mapInPandas(giving_back(read), "id long, shingles array<long>").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, ...) that are similar, exactly."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_y"))
    # sorted at every size, as in shingle_sets
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    common = F.size(F.array_intersect("_x", "_y"))
    return both.where(common / (F.size("_x") + F.size("_y") - common) >= similarity).select(*pairs.columns)


def in_blocks(groups: DataFrame) -> DataFrame:
    """``groups`` (key, id, m, ...) with i and j: a group is cut into blocks that meet pairwise, so that a large one
    is many tasks of bounded size. Every row is repeated for each block that its own meets.

    ``main`` and ``most``, if given, are the largest component of the group and the number of its nodes. These need
    not meet each other: their blocks come after those of the others and meet only these. So where all but a few nodes
    of a group are connected, a group of twice the size has twice the rows.
    """
    blocks = lambda n: F.ceil(n / BLOCK)
    large, none = F.col("m") > BLOCK, F.lit(0).cast("long")
    known = "main" in groups.columns
    inside = large & (F.col("component") == F.col("main")) if known else F.lit(False)
    most = F.when(large, F.col("most")).otherwise(none) if known else none
    rows = groups.withColumns({"_in": inside, "_other": F.greatest(blocks(F.col("m") - most), F.lit(1)), "_main": blocks(most)})
    hashed = F.xxhash64("id")
    mine = F.when(F.col("_in"), F.col("_other") + F.pmod(hashed, F.greatest("_main", F.lit(1)))).otherwise(F.pmod(hashed, F.col("_other")))
    # a single block of others is compared in itself wherever it meets one of the largest component
    first = F.when(~F.col("_in") & (F.col("_other") == 1) & (F.col("_main") > 0), F.lit(1).cast("long")).otherwise(none)
    last = F.when(F.col("_in"), F.col("_other") - 1).otherwise(F.col("_other") + F.col("_main") - 1)
    meets = F.transform(F.sequence(first, last), lambda x: F.struct(F.least(x, F.col("_b")).alias("i"), F.greatest(x, F.col("_b")).alias("j")))
    rows = rows.withColumn("_b", mine).withColumn("_m", F.explode(meets))
    return rows.withColumns({"i": F.col("_m.i"), "j": F.col("_m.j")}).drop("_in", "_other", "_main", "_b", "_m", "m", "main", "most")


def per_block(rows: DataFrame, compare, schema: str) -> DataFrame:
    """``compare`` (pandas to pandas or None) applied to the rows of each (key, i, j). Many blocks are small, so a
    task takes them one after the other out of sorted batches."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            names = batch[["key", "i", "j"]].to_numpy()
            starts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1), len(batch)]
            for lo, hi in zip(starts, starts[1:]):
                if held and (names[lo] != last).any():
                    if (out := compare(pd.concat(held) if len(held) > 1 else held[0])) is not None:
                        yield out
                    held = []
                held.append(batch.iloc[lo:hi])
                last = names[lo]
        if held and (out := compare(pd.concat(held) if len(held) > 1 else held[0])) is not None:
            yield out

    block = ["key", "i", "j"]
    return rows.repartition(*block).sortWithinPartitions(*block).mapInPandas(giving_back(read), schema)


def screened(groups: DataFrame, similarity: float, agree: float = AGREE) -> DataFrame:
    """Pairs (a, b) of nodes of a group that are in different components (ca, cb), of sizes that allow the
    similarity, and whose signatures agree often enough. A block with more than DENSE pairs a node gives no pairs, but
    one row with its key, i and j.

    ``groups``: key, id, component, n, signature, m (nodes in the group), and main and most as for ``in_blocks``.
    """

    ends = ["a", "b", "ca", "cb"]

    def compare(part: pd.DataFrame) -> pd.DataFrame | None:
        ids, comps, sizes = (part[c].to_numpy() for c in ("id", "component", "n"))
        marks = np.stack([np.frombuffer(x, dtype="<u2") for x in part["signature"]])
        found: list[tuple] = []
        for x in range(len(ids) - 1):
            y = np.arange(x + 1, len(ids))
            near = y[(comps[y] != comps[x]) & (sizes[y] >= similarity * sizes[x]) & (sizes[x] >= similarity * sizes[y])]
            if len(near):
                near = near[(marks[near] == marks[x]).mean(axis=1) >= agree]
                found += [(ids[x], ids[y], comps[x], comps[y]) if ids[x] < ids[y] else (ids[y], ids[x], comps[y], comps[x]) for y in near]
            if len(found) > DENSE * len(ids):
                return part[["key", "i", "j"]].head(1).assign(**dict.fromkeys(ends))[[*ends, "key", "i", "j"]]
        return pd.DataFrame(found, columns=ends).assign(key=None, i=None, j=None) if found else None

    rows = in_blocks(groups).select("key", "i", "j", "id", "component", "n", "signature")
    return per_block(rows, compare, "a long, b long, ca long, cb long, key long, i long, j long").distinct()


def similar_rows(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets are similar, exactly: a square matrix. Elements of one set only are left out of the products."""
    sizes = np.array([len(s) for s in sets], dtype=np.float32)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    row = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))[shared[column]]
    column = (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held[row[part], column[part] - lo] = 1
        common += held @ held.T
    return common >= similarity * (sizes[:, None] + sizes[None, :] - common)


def links_in_place(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components that connect what the exact similarities within a block connect: at most one a
    component. ``rows``: key, i, j, id, component, shingles."""

    def compare(part: pd.DataFrame) -> pd.DataFrame | None:
        names, of = np.unique(part["component"].to_numpy(), return_inverse=True)
        x, y = np.nonzero(similar_rows([np.asarray(s, dtype=np.int64) for s in part["shingles"]], similarity))
        near = np.zeros((len(names), len(names)), dtype=bool)
        near[of[x], of[y]] = True
        left, found = np.ones(len(names), dtype=bool), []
        for start in range(len(names)):
            todo = [start] if left[start] else []
            left[start] = False
            while todo:
                x = todo.pop()
                new = np.flatnonzero(near[x] & left)
                left[new] = False
                todo += new.tolist()
                found += [(int(names[x]), int(y)) for y in names[new]]
        return pd.DataFrame(found, columns=["a", "b"]) if found else None

    return per_block(rows.select("key", "i", "j", "component", "shingles"), compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``classes`` without the digest: doc_id, class_id, class_size, kept."""
    return classes(docs, similarity).drop("digest")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document with the class it is in: documents connected by links of this similarity or more.

    Similarity is the weighted Jaccard index of the five-word shingles, each weighing as much as it occurs: that of
    the sets of occurrences, called sets below. Equal sets are one node, named by 128 bits. Nodes that
    share a band are a group. All are compared exactly with the smallest node of their group; the links make
    components. In a group that is then not all in one component, the signatures of all nodes of different
    components are compared, and exactly those pairs that may be similar; where these are many, a whole block
    of the group is compared exactly in one task, of which only the links leave that connect its components. These
    links, and those of the pairs, connect components, not nodes. So of the pairs that share a band none is cut off.
    A step sends a few rows for each member, and as many more as a group has blocks of nodes outside its largest
    component.

    Returns doc_id, digest (md5 of the text), class_id (its smallest doc_id), class_size, kept (whether it is the one
    that stays).

    Cases: null and empty texts and texts of white space have no shingles and are one class. A text of
    fewer than five words is one shingle. Rows that repeat doc_id and text are one document: each is listed
    and marked alike. The same doc_id with another text is another document. Null doc_ids count last; a
    class of them has a null class_id. Other columns are ignored. An empty table gives an empty result.
    """
    rows = staged(sketch(docs), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("w")
    alike = [F.count(F.lit(1)).alias("n_docs"), *[F.first(c).alias(c) for c in ("n", "signature", "bands")]]
    nodes = rows.groupBy("name").agg(first, *alike).select("name", "w.doc_id", "w.digest", "n_docs", "n", "signature", "bands")
    # a number for each set: written once, so it stays
    nodes = staged(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("id", "n", F.explode("bands").alias("key"))
    pivot = [F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "n")).alias("pivot")]
    groups = staged(banded.groupBy("key").agg(*pivot).where("m > 1").select("key", "m", "pivot.id", "pivot.n").toDF("key", "m", "pivot", "pivot_n"), "groups")
    total = groups.agg(F.sum("m").alias("m")).first().m or 0
    members = staged(join_counted(banded, groups, "key", "m", total, how="inner").select("key", "id", "n", "pivot", "pivot_n", "m"), "members")
    # the sets of all that may have a partner, once for all comparisons
    wanted = members.select("id").distinct().join(nodes.select("id", "doc_id", "digest"), "id")
    sets = staged(shingle_sets(docs, wanted), "shingle-sets")

    star = members.where("id != pivot").where(F.least("n", "pivot_n") >= similarity * F.greatest("n", "pivot_n"))
    star = staged(star.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    found = components(staged(verified(star, sets, similarity), "links"))
    placed = members.where("m > 2").join(found, "id", "left").select("key", "id", "m", F.coalesce("component", "id").alias("component"))
    largest = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
    split = largest.agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "component")).alias("l")).where("k > 1")
    split = split.select("key", F.col("l.component").alias("main"), F.col("l.c").alias("most"))
    open_groups = staged(placed.join(split, "key"), "open-groups")
    seen = staged(screened(open_groups.join(nodes.select("id", "n", "signature"), "id"), similarity), "screened")
    pairs = staged(seen.where("a IS NOT NULL").select("a", "b", "ca", "cb").join(star, ["a", "b"], "left_anti"), "more-pairs")
    dense = staged(seen.where("a IS NULL").select("key", "i", "j"), "dense-blocks")
    rows_of = open_groups.join(dense.select("key").distinct(), "key", "left_semi")
    in_dense = in_blocks(rows_of).join(dense, ["key", "i", "j"])
    # between components
    more = []
    if not pairs.isEmpty():
        more.append(verified(pairs, sets, similarity).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if not dense.isEmpty():
        more.append(links_in_place(in_dense.join(sets.hint("merge"), "id"), similarity))
    classed = nodes.join(found, "id", "left").select("name", "doc_id", "n_docs", F.coalesce("component", "id").alias("component"))
    if more:
        classed = renamed(classed, components(reduce(DataFrame.unionByName, more)))
    classed = classed.withColumnRenamed("component", "class")
    classed = staged(classed, "classes")
    per_class = staged(
        classed.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.sum("n_docs").alias("class_size"), F.count(F.lit(1)).alias("_nodes")),
        "class-sizes",
    )
    total = classed.count()
    by_node = join_counted(classed.select("name", "n_docs", "class"), per_class, "class", "_nodes", total)
    by_node = staged(by_node.select("name", "n_docs", "class_id", "class_size"), "node-classes")
    out = join_counted(rows.select("doc_id", "digest", "name"), by_node, "name", "n_docs", rows.count())
    return out.select("doc_id", "digest", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near-duplicates: of each class the rows with the smallest doc_id stay.

    Cases as in ``near_duplicates``; of a class in which every doc_id is null all rows stay. Each text is judged
    in its own class: a null doc_id, or one that another text bears too, does not take that text along.
    """
    named = [F.col("doc_id").cast("long").alias("_id"), text_digest().alias("_digest")]
    gone = classes(docs, similarity).where(~F.col("kept")).select(F.col("doc_id").alias("_d"), F.col("digest").alias("_t")).distinct()
    left = docs.select(packed(docs).alias("_doc"), *named)
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_digest") == F.col("_t"))
    return left.join(gone, same, "left_anti").select("_doc.*")
