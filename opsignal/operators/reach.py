"""How far a directed graph reaches: strong components, levels of the condensed graph, and counts by bitmaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .lookups import join_salted
from .ordering import row_numbers

#: What is left of a graph is finished by one task once it has no more arcs than this (a few MB).
LOCAL_ARCS = 200_000
#: One task walks a strip of levels with so many nodes and arcs; a level beyond that is a job of its own.
STRIP_NODES, STRIP_ARCS = 2_000, 20_000
BITS = 32_768  # fixed value: what one bitmap of the engine holds


# Small graphs ----------------------------------------------------------------------------------


def _components(arcs: pd.DataFrame) -> pd.DataFrame:
    """(node, component, level): strong components named by their least node, each a level above all it leads to.

    Depth-first with an explicit stack: a component is complete when no node of it led further back, and all
    components that it leads to have been completed by then.
    """
    after: dict[int, list[int]] = {}
    for a, b in zip(arcs["a"].tolist(), arcs["b"].tolist()):
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    entered, least, open_, path = {}, {}, [], []
    component, level = {}, {}
    for root in after:
        if root in entered:
            continue
        path.append((root, iter(after[root])))
        entered[root] = least[root] = len(entered)
        open_.append(root)
        while path:
            node, onward = path[-1]
            for b in onward:
                if b not in entered:
                    entered[b] = least[b] = len(entered)
                    open_.append(b)
                    path.append((b, iter(after[b])))
                    break
                if b not in component:
                    least[node] = min(least[node], entered[b])
            else:
                path.pop()
                if path:
                    least[path[-1][0]] = min(least[path[-1][0]], least[node])
                if least[node] == entered[node]:
                    members = [open_.pop()]
                    while members[-1] != node:
                        members.append(open_.pop())
                    name = min(members)
                    component.update(dict.fromkeys(members, name))
                    level[name] = max((level[component[b]] + 1 for m in members for b in after[m] if component[b] != name), default=0)
    return pd.DataFrame({"node": list(component), "component": list(component.values()), "level": [level[c] for c in component.values()]}, dtype="int64")


def _local(arcs: DataFrame) -> DataFrame:
    """Components and levels of at most LOCAL_ARCS arcs, by one task."""
    return arcs.select("a", "b", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(
        lambda g: _components(g), "node long, component long, level long"
    )


# Strong components -----------------------------------------------------------------------------


def _trimmed(arcs: DataFrame) -> DataFrame:
    """Arcs on which a cycle may lie: from nodes that some arc enters to nodes that some arc leaves."""
    left, entered = arcs.select(F.col("a").alias("b")).distinct(), arcs.select(F.col("b").alias("a")).distinct()
    return arcs.join(left, "b", "left_semi").join(entered, "a", "left_semi").select("a", "b")


def _spread(arcs: DataFrame, start: DataFrame, along: tuple[str, str]) -> DataFrame:
    """(node, colour): the least colour of ``start`` that reaches a node; only colours changed last travel on."""
    source, target = along
    known = changed = start
    while True:
        sent = arcs.join(changed.withColumnRenamed("node", source), source)
        offered = sent.groupBy(F.col(target).alias("node")).agg(F.min("colour").alias("offer"))
        both = known.join(offered, "node", "full").select(
            "node", F.least("colour", "offer").alias("colour"),
            (F.col("offer").isNotNull() & F.coalesce(F.col("offer") < F.col("colour"), F.lit(True))).alias("new"),
        )
        both = stored(both, "colours")
        known, changed = both.select("node", "colour"), both.where("new").select("node", "colour")
        if changed.isEmpty():
            return known


def strong_components(arcs: DataFrame, local: int = LOCAL_ARCS) -> DataFrame:
    """(node, component) of the nodes that lie on a cycle, named by one of their nodes.

    Arcs that no cycle can use are trimmed away. What is left takes the least number that reaches it as its
    colour; nodes that lead back to the node their colour comes from, inside the colour, are its component. The
    rest goes on. The last LOCAL_ARCS arcs are finished by one task.
    """
    found = []
    open_ = stored(arcs.select("a", "b"), "arcs")
    size = open_.count()
    while size > 0:
        if size <= local:
            found.append(_local(open_).select("node", "component"))
            break
        core = stored(_trimmed(open_), "arcs")
        left = core.count()
        if left < size:
            open_, size = core, left
            continue
        nodes = core.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        colour = _spread(core, nodes.withColumn("colour", F.col("node")), ("a", "b"))
        here = core.join(colour.withColumnsRenamed({"node": "a", "colour": "ca"}), "a").join(colour.withColumnsRenamed({"node": "b", "colour": "cb"}), "b")
        inside = stored(here.where("ca = cb").select("a", "b"), "arcs")
        roots = colour.where("node = colour")
        members = stored(_spread(inside, roots, ("b", "a")).withColumnRenamed("colour", "component"), "components")
        found.append(members)
        gone = members.select("node")
        rest = core.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        open_ = stored(rest.select("a", "b"), "arcs")
        size = open_.count()
    if not found:
        return arcs.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    # a component of one node adds nothing
    many = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return stored(out.join(many, "component", "left_semi").select("node", "component"), "components")


def levels(arcs: DataFrame, local: int = LOCAL_ARCS) -> DataFrame:
    """(node, level) of an acyclic graph: 0 without arcs onward, else one more than the highest that it leads to.

    A round takes the nodes whose arcs are all gone, and the arcs to them. The last LOCAL_ARCS arcs are
    finished by one task.
    """
    open_ = stored(arcs.select("a", "b"), "arcs")
    size, floor, done = open_.count(), 0, []
    ready = open_.select(F.col("b").alias("node")).distinct().join(open_.select(F.col("a").alias("node")), "node", "left_anti")
    ready = stored(ready, "level")
    while size > local:
        done.append(ready.withColumn("level", F.lit(floor)))
        marked = open_.join(ready.select(F.col("node").alias("b"), F.lit(True).alias("gone")), "b", "left")
        marked = stored(marked.select("a", "b", F.coalesce("gone", F.lit(False)).alias("gone")), "arcs")
        freed = marked.groupBy("a").agg(F.every("gone").alias("free")).where("free").select(F.col("a").alias("node"))
        open_, ready = marked.where("NOT gone").select("a", "b"), stored(freed, "level")
        size, floor = open_.count(), floor + 1
    if size:
        # nodes that are ready have no arcs onward here either, so the levels go on from this floor
        rest = _local(open_).select("node", (F.col("level") + floor).alias("level"))
        alone = ready.join(rest, "node", "left_anti")
        done += [rest, alone.withColumn("level", F.lit(floor))]
    else:
        done.append(ready.withColumn("level", F.lit(floor)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return stored(out.select("node", F.col("level").cast("long").alias("level")), "levels")


# Reach -----------------------------------------------------------------------------------------


def _strips(placed: DataFrame, arcs: DataFrame, nodes: int, most_arcs: int) -> DataFrame:
    """(level, strip, wide): runs of levels that one task walks, in order. A level too large for that is ``wide``.

    The windows run over one row a level.
    """
    onward = arcs.join(placed.select(F.col("node").alias("a"), "level"), "a").groupBy("level").agg(F.count("*").alias("arcs"))
    sizes = placed.groupBy("level").agg(F.count("*").alias("nodes")).join(onward, "level", "left").na.fill(0, ["arcs"])
    upto = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    wide = (F.col("nodes") > nodes) | (F.col("arcs") > most_arcs)
    before = lambda c: F.coalesce(F.sum(F.when(~wide, F.col(c)).otherwise(0)).over(upto), F.lit(0))
    turn = F.coalesce(F.sum(wide.cast("int")).over(upto), F.lit(0))
    cut = sizes.select("level", wide.alias("wide"), F.struct(
        turn, wide.cast("int"), F.floor(before("nodes") / nodes), F.floor(before("arcs") / most_arcs), F.when(wide, F.col("level"))
    ).alias("run"))
    return cut.select("level", "wide", (F.dense_rank().over(Window.orderBy("run")) - 1).cast("int").alias("strip"))


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """One strip within one bucket of bits: given bits of nodes and arcs by level, the bits of the strip's nodes."""
    given = rows[rows["bits"].notna()]
    bits: dict[int, np.ndarray] = {}
    for node, piece in zip(given["node"].tolist(), given["bits"]):
        own = np.frombuffer(piece, dtype=np.uint8)
        bits[node] = own | bits[node] if node in bits else own
    arcs = rows[rows["b"].notna()].sort_values("level")
    for node, b in zip(arcs["node"].tolist(), arcs["b"].astype("int64").tolist()):
        if b in bits:
            bits[node] = bits[b] | bits[node] if node in bits else bits[b]
    own = set(rows.loc[rows["level"].notna(), "node"].tolist())
    out = [(n, x.tobytes()) for n, x in bits.items() if n in own]
    return pd.DataFrame({"node": [n for n, _ in out], "bucket": int(rows["bucket"].iat[0]) if len(rows) else 0, "bits": [x for _, x in out]})


def reach_sizes(
    arcs: DataFrame, local: int = LOCAL_ARCS, strip_nodes: int = STRIP_NODES, strip_arcs: int = STRIP_ARCS
) -> DataFrame:
    """(node, n): how many other nodes can be reached from each node; ``arcs`` (a, b) name nodes by text.

    Nodes of a strong component reach the same, so the components are condensed first. Then the levels of what is
    acyclic now are taken from below: the set a component reaches is the union of its members and of the sets
    of those it leads to, kept as bitmaps of 32,768 nodes each. Levels with few nodes are walked by one
    task per bucket; a level with many is one join of its arcs with the bitmaps they lead to and one
    aggregation. Every arc is used once, and no set is joined with another.

    Cases: loops and repeated arcs count once; null ends are ignored; without arcs the result is empty.
    """
    named = arcs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    named = stored(named, "arcs")
    names = named.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    ids = stored(row_numbers(names, "id", [F.col("name")], "name"), "ids")
    count = ids.count()
    numbered = named.join(ids.select(F.col("name").alias("a"), F.col("id").alias("ia")), "a").join(
        ids.select(F.col("name").alias("b"), F.col("id").alias("ib")), "b"
    )
    plain = stored(numbered.select(F.col("ia").alias("a"), F.col("ib").alias("b")), "arcs")
    cycles = strong_components(plain, local)
    part = lambda c: F.coalesce(f"c{c}.component", c).alias(c)
    dag = (
        plain.join(cycles.alias("ca"), F.col("a") == F.col("ca.node"), "left").join(cycles.alias("cb"), F.col("b") == F.col("cb.node"), "left")
        .select(part("a"), part("b")).where("a <> b").distinct()
    )
    dag = stored(dag, "condensed")
    members = ids.join(cycles, ids["id"] == cycles["node"], "left").select("name", "id", F.coalesce("component", "id").alias("node"))
    members = stored(members, "members")
    # components without any arc to others stand on level 0
    placed = members.select("node").distinct().join(levels(dag, local), "node", "left").na.fill(0, ["level"])
    strips = stored(_strips(placed, dag, strip_nodes, strip_arcs), "strips")
    placed = stored(placed.join(strips, "level"), "placed")

    own = members.join(placed, "node").groupBy("strip", "node", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")
    )
    own = stored(own, "own-bits")
    onward = (
        dag.join(placed.select(F.col("node").alias("a"), "strip", "level"), "a")
        .join(placed.select(F.col("node").alias("b"), F.col("strip").alias("below")), "b")
    )
    onward = stored(onward, "onward")
    needed: dict[int, list[int]] = {}
    for r in onward.where("below < strip").select("strip", "below").distinct().collect():
        needed.setdefault(r.strip, []).append(r.below)

    buckets = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(-(-count // BITS)).cast("long"))).alias("bucket")
    reached: list[DataFrame] = []
    for strip, wide in sorted({(r.strip, r.wide) for r in strips.select("strip", "wide").distinct().collect()}):
        mine, out = own.where(F.col("strip") == strip), onward.where(F.col("strip") == strip)
        below = None
        for s in needed.get(strip, []):
            below = reached[s] if below is None else below.unionByName(reached[s])
        if wide:
            parts = mine.select("node", "bucket", "bits")
            if below is not None:
                to = out.select("a", F.col("b").alias("node"))
                parts = parts.unionByName(join_salted(to, below, "node").select(F.col("a").alias("node"), "bucket", "bits"))
            bits = parts.groupBy("node", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        else:
            rows = mine.select("node", "bucket", "bits", F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("level"))
            rows = rows.unionByName(out.select(F.col("a").alias("node"), buckets, F.lit(None).cast("binary").alias("bits"), "b", "level"))
            if below is not None:
                wanted = out.where("below < strip").select(F.col("b").alias("node")).distinct()
                outside = below.join(wanted, "node", "left_semi")
                rows = rows.unionByName(outside.select("node", "bucket", "bits", F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("level")))
            bits = rows.groupBy("bucket").applyInPandas(_walk, "node long, bucket long, bits binary")
        reached.append(stored(bits, "reach"))
    if not reached:
        return members.select(F.col("name").alias("node"), F.lit(0).cast("long").alias("n"))
    every = reached[0]
    for more in reached[1:]:
        every = every.unionByName(more)
    sizes = every.groupBy("node").agg((F.sum(F.bitmap_count("bits")) - 1).alias("n"))
    return members.join(sizes, "node").select(F.col("name").alias("node"), "n")
