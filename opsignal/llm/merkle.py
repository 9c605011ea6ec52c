"""A Merkle tree over the rows of a dataset: roots, and for every row a proof that it belongs to them.

Leaves lie in aligned blocks, one row per block. A block hashes its own levels. Above that the blocks run
a butterfly exchange: in round r, ``fanout`` blocks that stand at the same place of neighbouring subtrees
swap the subtrees' roots, and each of them hashes the parent for itself. After the last round every block
knows the root and the siblings on its way to it, so nothing is sent down the tree again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, staged

FANOUT = 3
#: Levels hashed inside a block: FANOUT ** LOCAL leaves are the most that one row holds.
LOCAL = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Before and after the own node among the children of one parent, as one text of digests each.
STEPS = "array<struct<before:string,after:string>>"


def coded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[coded(f) for f in fields]), 256)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Staged ``rows`` with ``pos`` (place inside the tree, from 0) and ``n`` (rows of the tree).

    Rows are cut into sorted ranges over all trees, so a tree with a third of the rows fills many of them.
    Equal keys are spread by a running number. Only (tree, range) counts are summed up.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [tree, *order, "_tie"]
    ranged = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    ranged = staged(ranged.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright(F.col("_at"), 33).alias("_part")
    sizes = ranged.groupBy(tree, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_here"))
    earlier = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        tree, "_part", (F.coalesce(F.sum("_here").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_here").over(Window.partitionBy(tree)).alias("n"),
    )
    placed = ranged.withColumn("_part", part).join(starts, [tree, "_part"])
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def parents(nodes: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def levels(leaves: list[str], n: int, fanout: int, local: int) -> list[list[str]]:
    """The nodes of a block from its leaves up, as far as the tree of ``n`` leaves goes on or ``local`` levels."""
    out = [leaves]
    for _ in range(local):
        if n <= 1:
            break
        out.append(parents(out[-1], fanout))
        n = -(-n // fanout)
    return out


def steps_of(up: list[list[str]], i: int, fanout: int) -> list[tuple[str, str]]:
    """What stands before and after the own node on each level of a block."""
    out = []
    for nodes in up[:-1]:
        first = i - i % fanout
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
        i //= fanout
    return out


def butterfly(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` (tree, pos, n, node, any others) with ``steps`` up to the root of the tree, and ``node`` the root.

    A round is one shuffle of all nodes by (tree, group, place in the subtree). The last subtree may be
    narrower than the others; its nodes then stand in for the places that it lacks.
    """
    top = nodes.agg(F.max("n").alias("n")).first().n or 0
    keep = [c for c in nodes.columns if c not in ("tree", "pos", "n", "node")]
    own = F.struct("pos", "n", F.struct("node", *keep).alias("rest"), "steps").alias("own")
    state = nodes.withColumn("steps", F.array().cast(STEPS))
    span = 1
    while span < top:
        width = F.lit(span)
        subtree, place = F.floor(F.col("pos") / width).cast("long"), F.col("pos") % width
        count = F.ceil(F.col("n") / width).cast("long")
        lacks = F.col("n") - (count - 1) * width
        stands_in = (subtree == count - 1) & (subtree % fanout != 0) & (lacks < width)
        places = F.when(stands_in, F.sequence(place, F.lit(span - 1).cast("long"), lacks)).otherwise(F.array(place))
        # a tree that has come to its root takes no further part
        open_ = state.where(F.col("n") > span).select(
            "tree", F.floor(subtree / fanout).alias("_group"), F.explode(places).alias("_place"), subtree.alias("_subtree"), place.alias("_home"), "node", own
        )
        said = F.struct("_subtree", "node", F.when(F.col("_home") == F.col("_place"), F.col("own")).alias("own"))
        met = open_.groupBy("tree", "_group", "_place").agg(F.array_sort(F.collect_list(said)).alias("_all"))
        heads = F.transform("_all", lambda m: m["node"])
        joined = lambda c: F.concat_ws("", c)
        met = met.withColumn("_up", F.sha2(joined(heads), 256)).select(
            "tree", "_up", heads.alias("_heads"), F.posexplode(F.transform("_all", lambda m: m["own"])).alias("_i", "own")
        )
        after = F.slice("_heads", F.col("_i") + 2, F.lit(fanout))
        step = F.struct(joined(F.slice("_heads", F.lit(1), F.col("_i"))).alias("before"), joined(after).alias("after"))
        moved = met.where("own IS NOT NULL").select(
            "tree", "own.pos", "own.n", F.col("_up").alias("node"), *[F.col(f"own.rest.{c}") for c in keep],
            F.concat("own.steps", F.array(step)).alias("steps"),
        )
        state = moved.unionByName(state.where(F.col("n") <= span))
        span *= fanout
    return state


def climbed(blocks: DataFrame, n: str, fanout: int, local: int) -> DataFrame:
    """Blocks (tree, block, n, leaves) with the steps from their top node to the root of their tree."""

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({
                "tree": b["tree"], "pos": b["block"], "n": [-(-int(x) // fanout**local) for x in b["n"]],
                "node": [levels(list(x), int(m), fanout, local)[-1][0] for x, m in zip(b["leaves"], b["n"])],
            })

    roots = blocks.select("tree", "block", n, "leaves").mapInPandas(tops, "tree string, pos long, n long, node string")
    return butterfly(roots, fanout)


def blocked(rows: DataFrame, fanout: int, local: int, keep: list[str]) -> DataFrame:
    """One row per aligned block of ``fanout ** local`` places: its leaves, and its rows' other columns, in order."""
    member = F.struct("pos", "leaf", *keep)
    by_block = rows.groupBy("tree", F.floor(F.col("pos") / fanout**local).cast("long").alias("block"))
    return by_block.agg(F.max("n").alias("n"), F.array_sort(F.collect_list(member)).alias("_members")).select(
        "tree", "block", "n", F.transform("_members", lambda m: m["leaf"]).alias("leaves"),
        F.transform("_members", lambda m: F.struct(*[m[c].alias(c) for c in keep])).alias("members"),
    )


def proven(blocks: DataFrame, fanout: int, local: int, key: str) -> DataFrame:
    """One row per member: leaf, subroot, root, proof (digest of all siblings), and the root that the leaf as
    it is found now (``found``; null: unchanged) folds to."""

    def fold(node: str, steps: list[tuple[str, str]]) -> str:
        for before, after in steps:
            node = hashlib.sha256((before + node + after).encode()).hexdigest()
        return node

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, leaves, members, upper, subroot, root in zip(b["n"], b["leaves"], b["members"], b["upper"], b["subroot"], b["root"]):
                up = levels(list(leaves), int(n), fanout, local)
                above = [(s["before"], s["after"]) for s in upper]
                for i, m in enumerate(members):
                    steps = steps_of(up, i, fanout) + above
                    proof = hashlib.sha256("".join(x + y for x, y in steps).encode()).hexdigest()
                    folded = fold(leaves[i] if m["found"] is None else m["found"], steps)
                    rows.append((m[key], leaves[i], subroot, root, proof, folded, folded == root))
            names = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({key: "Int64"})

    schema = f"{key} long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.select("n", "leaves", "members", "upper", "subroot", "root").mapInPandas(unfold, schema)


def manifest(docs: DataFrame, found: DataFrame | None = None, fanout: int = FANOUT, local: int = LOCAL) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of ``docs``.

    A leaf is the digest of the coded fields. The leaves of a source ascend by doc_id (null first); every
    ``fanout`` consecutive nodes make their parent until one node is left, the subroot. The subroots in the
    order of their sources (null first, then bytewise) make the root likewise. ``docs`` may have a column
    ``found``: the text as it is read now, where that differs from ``text``; null texts cannot differ.
    ``folded_root`` climbs from the leaf of the text found now with the siblings of the manifest;
    ``verified`` says whether it ends at the root. ``manifest(docs)`` without ``found`` verifies every row.

    Cases: a text may be null or empty. Rows with the same doc_id order by their leaf; rows alike in all fields
    have the same leaf and each has a place of its own. A lone leaf is its subroot, a lone subroot the root, and a
    proof without siblings is the digest of nothing. Columns besides the five fields are ignored. An empty table gives an empty result.
    """
    fields = {f: F.col(f) for f in FIELDS}
    now = F.col("found") if "found" in docs.columns else F.lit(None).cast("string")
    leaves = docs.select(
        "doc_id", F.md5(coded(fields["source"])).alias("tree"), "source",
        leaf(list(fields.values())).alias("leaf"),
        F.when(now.isNotNull() & fields["text"].isNotNull(), leaf([*list(fields.values())[:-1], now])).alias("found"),
    )
    placed = numbered(leaves, "tree", ["doc_id", "leaf"])
    first = F.when(F.col("pos") == 0, F.struct("source"))
    blocks = staged(
        blocked(placed.withColumn("first", first), fanout, local, ["doc_id", "found", "first"]), "merkle-blocks"
    )
    upper = staged(climbed(blocks, "n", fanout, local).withColumnsRenamed({"node": "subroot", "pos": "block"}), "merkle-subroots")

    # the sources are the leaves of one more tree; the first block of each says its name
    named = blocks.where("block = 0").select("tree", "n", F.get("members", F.lit(0))["first"]["source"].alias("source"))
    heads = named.join(upper.where("block = 0").select("tree", "subroot"), "tree")
    sources = heads.select(F.lit("").alias("tree"), "source", F.col("subroot").alias("leaf"), F.col("tree").alias("_tree"), F.col("n").alias("_rows"))
    ordered = numbered(sources, "tree", ["source"])
    groups = staged(blocked(ordered, fanout, local, ["_tree", "_rows"]), "merkle-sources")
    over = climbed(groups, "n", fanout, local).withColumnsRenamed({"node": "root", "pos": "block", "steps": "over"})
    tops = groups.join(over.drop("n", "tree"), "block").select("n", "leaves", "members", "over", "root")

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, own, members, above, root in zip(b["n"], b["leaves"], b["members"], b["over"], b["root"]):
                up = levels(list(own), int(n), fanout, local)
                for i, m in enumerate(members):
                    steps = [{"before": x, "after": y} for x, y in steps_of(up, i, fanout)]
                    rows.append((m["_tree"], -(-m["_rows"] // fanout**local), steps + list(above), root))
            yield pd.DataFrame(rows, columns=["tree", "blocks", "over", "root"])

    per_source = staged(tops.mapInPandas(apart, f"tree string, blocks long, over {STEPS}, root string"), "merkle-roots")
    total = per_source.agg(F.sum("blocks").alias("n")).first().n or 0
    full = join_counted(upper.select("tree", "block", "subroot", "steps"), per_source, "tree", "blocks", total, how="inner")
    full = full.select("tree", "block", "subroot", "root", F.concat("steps", "over").alias("upper"))
    return proven(blocks.join(full, ["tree", "block"]), fanout, local, "doc_id")
