"""Reachability, paths, weakly held objects, dominators and retained sizes: recursive jobs over the edges.

Each round joins by key and writes what it found, so a lost executor costs one round. What is worked out along a tree takes a round for
each doubling of its depth. Breadth-first levels follow each other; a deep graph that one task can hold is walked there (see kernel).
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import ROOT, HeapTables, checkpointed, dealt, shuffled
from . import kernel


def _ordered(df: DataFrame, *by: str) -> DataFrame:
    """df with pos, which rises in the order of the columns by; distributed, as ids rise along sorted partitions."""
    return df.orderBy(*by).withColumn("pos", F.monotonically_increasing_id())


def reach(edges: DataFrame, roots: DataFrame, blocked: DataFrame | None = None, max_levels: int = 100_000) -> DataFrame:
    """obj, parent (null for roots), level of everything that roots (obj) lead to.

    Breadth first, as a queue would: roots by id; the parent is the earliest object of the queue that refers to an object; within a level
    the order is that of the parents, then of the edges' ord. blocked (src, dst) holds pairs whose edges, all parallel ones, are ignored.
    """
    if blocked is not None:
        edges = checkpointed(edges.join(blocked.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("src", "dst", "ord"))
    return _walk(edges, roots, max_levels=max_levels).select("obj", "parent", "level")


def _once(edges: DataFrame) -> DataFrame:
    """Of parallel edges the first counts."""
    return edges.groupBy("src", "dst").agg(F.min("ord").alias("ord"))


def _walk(edges: DataFrame, roots: DataFrame, until: DataFrame | None = None, need: int | None = None, max_levels: int = 100_000) -> DataFrame:
    """As reach(), with pos, which rises in the order of the queue within a level. It may end with the level by which need of until (obj) are found, or all of them.

    A small frontier goes to the edges, which stay where they are. For a larger one they are dealt by source, once; then each edge is
    shuffled once, to its target, when its source is in the frontier.
    """
    edges = edges.where("src != dst").select("src", "dst", "ord")
    none = F.lit(None).cast("long")
    first = roots.select("obj").where("obj is not null").distinct()
    # pos tells an object of the frontier, so that minima of numbers do and no struct is compared.
    frontier = checkpointed(_ordered(first, "obj").select("obj", none.alias("parent"), F.lit(0).alias("level"), "pos"))
    levels, seen, parts = [frontier], [frontier], 0
    deal = lambda df: dealt(df.repartition(parts, "obj"), "obj", parts)
    if until is not None:
        until = checkpointed(until.select("obj").distinct())
        left = until.count() if need is None else min(need, until.count())
    for level in range(1, max_levels + 1):
        if until is not None:
            left -= frontier.join(until, "obj", "left_semi").count()
            if left <= 0:
                return _union(levels)
        if level == kernel.DEEP:
            edges = edges if parts else checkpointed(_once(edges))
            if kernel.fits(edges):
                return checkpointed(kernel.walk(edges, first))
        if not parts and frontier.count() > FEW:
            parts = edges.count() // PART + 1
            edges = dealt(_once(edges.repartition(parts, "src")), "src", parts)
            frontier, seen = deal(frontier), [deal(_union(seen).select("obj"))]
        at = frontier.select(F.col("obj").alias("src"), "pos")
        hits = edges.join(at, "src") if parts else edges.join(F.broadcast(at), "src").groupBy("src", "dst", "pos").agg(F.min("ord").alias("ord"))
        found = hits.groupBy(F.col("dst").alias("obj")).agg(F.min("pos").alias("at"), F.min_by("ord", "pos").alias("ord"), F.min_by("src", "pos").alias("parent"))
        for s in seen:  # one by one, as a union isn't known to be dealt
            found = found.join(s.select("obj"), "obj", "left_anti")
        rows = _ordered(found, "at", "ord", "obj").select("obj", "parent", F.lit(level).alias("level"), "pos")
        frontier = deal(rows) if parts else checkpointed(rows)
        if frontier.isEmpty():
            return _union(levels)
        levels.append(frontier)
        seen.append(frontier)
        if len(seen) > MERGED:
            ids = _union([s.select("obj") for s in seen])
            seen = [deal(ids) if parts else checkpointed(ids)]
    raise RuntimeError(f"more than {max_levels} levels")


def above(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges by which something leads to targets (obj), written; all edges where these are many, or are led to by many or from far away.

    A walk along them finds the same parents of targets, and of all that is on the ways to these, as one along all edges: whatever refers to
    such an object is one, and the others don't change the order. The edges stay where they are.
    """
    at = checkpointed(targets.select("obj").where("obj is not null").distinct())
    seen, found = [at], []
    for _ in range(kernel.DEEP):
        if at.count() > FEW:
            return edges
        found.append(checkpointed(edges.where("src != dst").join(F.broadcast(at.select(F.col("obj").alias("dst"))), "dst", "left_semi").select(edges.columns)))
        at = checkpointed(found[-1].select(F.col("src").alias("obj")).distinct().join(_union([s.select("obj") for s in seen]), "obj", "left_anti"))
        if at.isEmpty():
            return _union(found)
        seen.append(at)
    return edges


#: Objects up to which a frontier is broadcast (some 50 bytes of memory each).
FEW = 500_000
#: Edges of one part of a net.
PART = 300_000
#: Levels beyond which they are written as one table.
MERGED = 8


class Net(NamedTuple):
    """edges: src, dst of edges between different objects, each pair once, dealt by src into parts."""

    edges: DataFrame
    parts: int


def net(edges: DataFrame) -> Net:
    parts = edges.count() // PART + 1
    return Net(dealt(edges.where("src != dst").select("src", "dst").repartition(parts, "src").distinct(), "src", parts), parts)


def live(net: Net, roots: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """obj, level of everything that roots (obj) lead to, dealt by obj; what leads through objects of without (obj), dealt alike, is left out.

    As reach(), without the order: edges stay where they were dealt to, and only ids of targets are shuffled, each edge's once.
    """
    first = roots.select("obj").where("obj is not null").distinct()
    first = first if without is None else first.join(without.select("obj"), "obj", "left_anti")
    at = dealt(first.withColumn("level", F.lit(0)), "obj", net.parts)
    levels = [at]
    for level in count(1):
        if level == kernel.DEEP and kernel.fits(net.edges):
            edges = net.edges if without is None else net.edges.join(without.select(F.col("obj").alias("dst")), "dst", "left_anti")
            return dealt(kernel.walk(edges.withColumn("ord", F.lit(0).cast("long")), levels[0]).select("obj", "level").repartition(net.parts, "obj"), "obj", net.parts)
        found = net.edges.join(at.select(F.col("obj").alias("src")), "src").select(F.col("dst").alias("obj")).distinct()
        for seen in levels + ([] if without is None else [without]):  # one by one, as a union isn't known to be dealt
            found = found.join(seen.select("obj"), "obj", "left_anti")
        at = dealt(found.withColumn("level", F.lit(level)), "obj", net.parts)
        if at.isEmpty():
            return dealt(_union(levels), "obj", net.parts)
        levels.append(at)
        if len(levels) > MERGED:
            levels = [levels[0], dealt(_union(levels[1:]), "obj", net.parts)]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _hops(reached: DataFrame, targets: DataFrame) -> DataFrame:
    """target, obj, parent, level of the objects on the way from a root to each of targets (obj) along parents."""
    hop = checkpointed(targets.select(F.col("obj").alias("target"), "obj").join(reached, "obj").select("target", "obj", "parent", "level"))
    parts = [hop]
    while True:
        hop = checkpointed(hop.where("parent is not null").select("target", F.col("parent").alias("obj")).join(reached, "obj").select("target", "obj", "parent", "level"))
        if hop.isEmpty():
            return _union(parts)
        parts.append(hop)


def root_paths(edges: DataFrame, reached: DataFrame, targets: DataFrame) -> DataFrame:
    """target, step (0: the root), obj, label and elem of the first edge into it: the way from a root to each of targets (obj) along parents."""
    hops = _hops(reached, targets)
    pairs = checkpointed(hops.where("parent is not null").select(F.col("parent").alias("src"), F.col("obj").alias("dst")).distinct())
    # Far fewer objects lead on than are led to; edges of others aren't shuffled.
    on = checkpointed(pairs.select("src").distinct())
    edges = edges.join(F.broadcast(on), "src", "left_semi") if on.count() <= FEW else edges
    first = edges.join(pairs, ["src", "dst"]).groupBy("src", "dst").agg(F.min_by(F.struct("label", "elem"), "ord").alias("e"))
    return hops.join(first, (F.col("parent") == F.col("src")) & (F.col("obj") == F.col("dst")), "left").select("target", F.col("level").alias("step"), "obj", "e.label", "e.elem")


def paths_to(edges: DataFrame, roots: DataFrame, targets: DataFrame) -> DataFrame:
    """As root_paths(), by a walk among what leads to targets, which ends when it has found them."""
    edges = above(edges, targets)
    return root_paths(edges, _walk(edges, roots, targets), targets)


def k_paths(edges: DataFrame, roots: DataFrame, target: int, k: int) -> list[list[int]]:
    """Up to k ways from a root to one object; each next one avoids the last edge of those before.

    These lead through the object's first k referrers in the order of a queue: only edges into the object are avoided, which changes
    nothing before it is found. So one walk that leaves the object out finds all of them.
    """
    if not roots.where(F.col("obj") == target).isEmpty():
        return [[target]][:k]
    edges = above(edges.where(F.col("src") != target), edges.sparkSession.createDataFrame([(target,)], "obj long"))
    into = F.col("dst") == target
    refs = checkpointed(edges.where(into & (F.col("src") != target)).select(F.col("src").alias("obj")).distinct())
    reached = _walk(edges.where(~into & (F.col("src") != target)), roots, refs, k)
    last = checkpointed(reached.join(refs, "obj", "left_semi").orderBy("level", "pos").limit(k))
    ways: dict[int, list] = {r["obj"]: [] for r in last.orderBy("level", "pos").collect()}
    for r in _hops(reached, last).collect():
        ways[r["target"]].append((r["level"], r["obj"]))
    return [[*(obj for _, obj in sorted(way)), target] for way in ways.values()]


def weak_only(tables: HeapTables, net: Net, strong: DataFrame, ref_kind: str | None = None) -> DataFrame:
    """obj of what only weak references hold: their referents, from strongly reached sources (of one ref_kind), and all these lead to by any edge, but nothing strong (obj, as live() gives)."""
    weak = tables.weak_edges if ref_kind is None else tables.weak_edges.where(F.col("ref_kind") == ref_kind)
    seeds = checkpointed(weak.join(strong.select(F.col("obj").alias("src")), "src", "left_semi").select(F.col("dst").alias("obj")).distinct())
    if seeds.isEmpty():
        return seeds
    every = net.edges.union(dealt(tables.weak_edges.where("src != dst").select("src", "dst").distinct(), "src", net.parts))
    return live(Net(every, net.parts), seeds, strong).select("obj")


#: Depth up to which a node's label lists all nodes above it; deeper trees are cut into heavy chains first.
SHALLOW = 64
#: Rounds of dominators() after which a graph that one task can hold is handed to it.
PATIENCE = 12


def _doubled(nodes: DataFrame, fold: dict[str, Column], read: list[str]) -> DataFrame:
    """Pointer doubling: nodes (obj, up: a node or ROOT, columns of read) until no up is left, in as many rounds as the logarithm of the depth.

    In each round a node takes its up's up, and fold's columns, which speak of the node's own columns and of those of its up as above_<name>.
    Nodes that are done aren't written again.
    """
    done, at = [], checkpointed(nodes)
    while True:
        rest = at.where(F.col("up") != ROOT)
        done.append(at.where(F.col("up") == ROOT))
        if rest.isEmpty():
            return reduce(DataFrame.union, done)
        all_ = reduce(DataFrame.union, [*done, rest])
        above = all_.select(F.col("obj").alias("up"), F.col("up").alias("above_up"), *[F.col(c).alias(f"above_{c}") for c in read])
        at = checkpointed(rest.join(above, "up").select("obj", F.col("above_up").alias("up"), *[fold[c].alias(c) for c in read]))


def _totals(tree: DataFrame, measures: list[str]) -> DataFrame:
    """tree (obj, idom, depth, measures) with each measure summed over what a node dominates: n_<measure>. A round for each doubling of the depth; partial sums, so a node of very many children is no task's alone."""
    at = checkpointed(tree.select("obj", F.col("idom").alias("up"), *[F.col(m).alias(f"n_{m}") for m in measures]))
    sums = [f"n_{m}" for m in measures]
    while True:
        low = at.where(F.col("up") != ROOT)
        if low.isEmpty():
            return at.select("obj", *sums)
        more = low.groupBy(F.col("up").alias("obj")).agg(*[F.sum(s).alias(f"more_{s}") for s in sums])
        above = at.select(F.col("obj").alias("up"), F.col("up").alias("above"))
        at = at.join(more, "obj", "left").join(above, "up", "left").select("obj", F.coalesce("above", F.lit(ROOT).cast("long")).alias("up"), *[(F.col(s) + F.coalesce(f"more_{s}", F.lit(0).cast("long"))).alias(s) for s in sums])
        at = checkpointed(at)


def _depths(idoms: DataFrame) -> DataFrame:
    """obj, idom and depth (1 below the virtual root)."""
    return _doubled(idoms.select("obj", F.col("idom").alias("up"), "idom", F.lit(1).alias("depth")), {"idom": F.col("idom"), "depth": F.col("depth") + F.col("above_depth")}, ["idom", "depth"]).select("obj", "idom", "depth")


def _paths(idoms: DataFrame) -> DataFrame:
    """obj and label: the way of nodes from the top of a shallow tree (obj, idom) down to obj."""
    return _doubled(idoms.select("obj", F.col("idom").alias("up"), F.array("obj").alias("label")), {"label": F.concat("above_label", "label")}, ["label"]).select("obj", "label")


def _chains(idoms: DataFrame) -> DataFrame:
    """obj and label of a deep tree (obj, idom): an array of (head, depth, node), the chains of the tree from the top down to obj's, told by their topmost node, and where the way to obj leaves each.

    A node's chain goes on to the child that dominates most, so that no label is longer than the logarithm of the number of nodes.
    """
    tree = checkpointed(_depths(idoms))
    sizes = _totals(tree.withColumn("one", F.lit(1).cast("long")), ["one"])
    sized = checkpointed(tree.join(sizes, "obj"))
    heavy = sized.where(F.col("idom") != ROOT).groupBy("idom").agg(F.max_by("obj", F.struct("n_one", "obj")).alias("obj")).select("obj", F.lit(True).alias("on"))
    steps = sized.join(heavy, "obj", "left").select("obj", F.when(F.col("on"), F.col("idom")).otherwise(F.lit(ROOT).cast("long")).alias("up"), F.col("obj").alias("head"))
    heads = _doubled(steps, {"head": F.col("above_head")}, ["head"]).select("obj", "head")
    chains = checkpointed(tree.join(heads, "obj"))
    # Chains as nodes of a tree of their own: the way down to a chain is that to the one which its head hangs from, and where it leaves that.
    over = chains.select(F.col("obj").alias("idom"), F.col("head").alias("up"), F.array(F.struct("head", "depth", F.col("obj").alias("node"))).alias("way"))
    none = F.array().cast("array<struct<head:bigint,depth:int,node:bigint>>")
    ways = chains.where("obj = head").select("obj", "idom").join(over, "idom", "left").select("obj", F.coalesce("up", F.lit(ROOT).cast("long")).alias("up"), F.coalesce("way", none).alias("way"))
    ways = _doubled(ways, {"way": F.concat("above_way", "way")}, ["way"]).select(F.col("obj").alias("head"), "way")
    return chains.join(ways, "head").select("obj", F.concat("way", F.array(F.struct("head", "depth", F.col("obj").alias("node")))).alias("label"))


def _parting(lo: str, hi: str) -> Column:
    """The first place at which two labels differ; null where lo, the lesser of them, is the beginning of hi."""
    return F.array_min(F.filter(F.sequence(F.lit(0), F.least(F.size(lo), F.size(hi)) - 1), lambda i: F.get(F.col(lo), i) != F.get(F.col(hi), i)))


def _common_path(lo: str, hi: str) -> Column:
    """The way to the nearest node above both of two nodes, from the ways to these."""
    return F.slice(F.col(lo), F.lit(1), F.coalesce(_parting(lo, hi), F.size(lo)))


def _common_node(lo: str, hi: str) -> Column:
    """The nearest node above both of two labels of _chains(), ROOT if only the virtual root is."""
    at = _parting(lo, hi)
    chain = F.get(F.col(lo), at)
    # The labels of one chain are ordered by depth, so the lesser leaves it first.
    return F.when(at.isNull(), F.element_at(lo, -1)["node"]).when(chain["head"] == F.get(F.col(hi), at)["head"], chain["node"]).when(at == 0, F.lit(ROOT).cast("long")).otherwise(F.get(F.col(lo), at - 1)["node"])


def _last(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.element_at(path, -1)).otherwise(F.lit(ROOT).cast("long"))


def _settled(refs: DataFrame, several: DataFrame, top: DataFrame) -> DataFrame:
    """obj, label (its way in the dominator tree) of what can be settled in an order in which all referrers come first.

    refs: dst, a, b (the least and the greatest referrer of each object that is no root); several: dst, src of those with more than one.
    An object of one referrer is dominated by it, so such objects hang as trees from roots and from objects of several referrers (heads),
    and are settled with their head. An object of several is settled once all its referrers are but those that hang from itself.
    """
    single = checkpointed(refs.where("a = b").select(F.col("dst").alias("obj"), F.col("a").alias("up")))
    below = single.join(single.select(F.col("obj").alias("up"), F.lit(True).alias("on")), "up", "left")
    steps = below.select("obj", F.when(F.col("on"), F.col("up")).otherwise(F.lit(ROOT).cast("long")).alias("up"), F.when(F.col("on").isNull(), F.col("up")).alias("head"), F.array("obj").alias("way"))
    hung = _doubled(steps, {"head": F.col("above_head"), "way": F.concat("above_way", "way")}, ["head", "way"]).select("obj", "head", "way")
    below = lambda heads: heads.union(hung.join(heads.select(F.col("obj").alias("head"), "label"), "head").select("obj", F.concat("label", "way").alias("label")))
    found = [checkpointed(below(top.select("obj", F.array("obj").alias("label"))))]
    pending = checkpointed(several.join(hung.select(F.col("obj").alias("src"), "head"), "src", "left").where("head is null or head != dst").select("dst", "src"))
    for _ in range(PATIENCE):
        labels = reduce(DataFrame.union, found).withColumnRenamed("obj", "src")
        ends = pending.join(labels, "src", "left").groupBy("dst").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.count("label").alias("known"))
        ready = ends.where("known = n").select(F.col("dst").alias("obj"), F.concat(_common_path("lo", "hi"), F.array("dst")).alias("label"))
        new = checkpointed(below(checkpointed(ready)))
        if new.isEmpty():
            break
        found.append(new)
        pending = checkpointed(pending.join(new.select(F.col("obj").alias("dst")), "dst", "left_anti"))
        if pending.isEmpty():
            break
    return reduce(DataFrame.union, found)


def _pushed(net: Net, reached: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """obj, label (its way in the dominator tree), dealt by obj, of what can be settled in an order in which all referrers come first; and whether that is all.

    Each edge sends its source's label once, when the source is settled, to where its target is dealt to. An object is settled when all of its
    referrers are known. Where that comes to a stop, referrers that hang from an object itself, by objects of one referrer, don't count.
    """
    edges, parts = net
    top = reached.where("level = 0").select("obj")
    held = edges.join(reached.select(F.col("obj").alias("src")), "src", "left_semi")
    refs = dealt(held.groupBy(F.col("dst").alias("obj")).agg(F.count("*").alias("n"), F.min("src").alias("a")).join(top, "obj", "left_anti"), "obj", parts)
    new = dealt(top.select("obj", F.array("obj").alias("label")), "obj", parts)
    found, state, stopped = [new], None, False
    # Not known = n and dst = head, which would be keys of the joins, and what is dealt would be shuffled again.
    whole = lambda ends: dealt(ends.join(refs, "obj").where("known >= n").select("obj", F.concat(_common_path("lo", "hi"), F.array("obj")).alias("label")), "obj", parts)
    for _ in range(rounds):
        ends = edges.join(new.select(F.col("obj").alias("src"), "label"), "src").groupBy(F.col("dst").alias("obj")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("known"))
        if state is not None:
            # What is settled needs no more; least and greatest skip what is null.
            more = ends.select("obj", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("known").alias("known2"))
            zero = F.lit(0)
            ends = state.join(new.select("obj"), "obj", "left_anti").join(more, "obj", "full_outer").select("obj", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"), (F.coalesce("known", zero) + F.coalesce("known2", zero)).alias("known"))
        state = dealt(ends, "obj", parts)
        new = whole(state)
        if new.isEmpty():
            rest = refs.join(dealt(_union(found).select("obj"), "obj", parts), "obj", "left_anti")
            if stopped or rest.isEmpty():
                break
            stopped = True
            single = checkpointed(rest.where("n = 1").select("obj", F.col("a").alias("up")))
            steps = single.join(single.select(F.col("obj").alias("up"), F.lit(True).alias("on")), "up", "left")
            steps = steps.select("obj", F.when(F.col("on"), F.col("up")).otherwise(F.lit(ROOT).cast("long")).alias("up"), F.when(F.col("on").isNull(), F.col("up")).alias("head"))
            hung = dealt(_doubled(steps, {"head": F.col("above_head")}, ["head"]).select(F.col("obj").alias("src"), "head"), "src", parts)
            back = dealt(edges.join(hung, "src").where("dst - head = 0").groupBy(F.col("dst").alias("obj")).agg(F.count("*").alias("back")), "obj", parts)
            edges = edges.join(hung, "src", "left").where("head is null or dst != head").select("src", "dst")
            refs = dealt(refs.join(back, "obj", "left").select("obj", (F.col("n") - F.coalesce("back", F.lit(0))).alias("n"), "a"), "obj", parts)
            new = whole(state)
            if new.isEmpty():
                break
        found.append(new)
    settled = dealt(_union(found), "obj", parts)
    with shuffled(settled.sparkSession, parts):
        return settled, refs.join(settled.select("obj"), "obj", "left_anti").isEmpty()


def _over(label: str) -> Column:
    """The dominator at the end of a way but one."""
    return _last(F.slice(label, F.lit(1), F.size(label) - 1))


def dominators(edges: DataFrame, roots: DataFrame, reached: DataFrame, settled: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """obj, idom (ROOT for top-level objects) of each reached object; in a shallow graph label too, the way down to it in the dominator tree.

    What can be settled in order is settled (see _settled). For the rest, cycles of objects that are entered in several places, the parent
    of each object starts as its breadth-first parent, above which its dominators are in any case. In each round the parent of every object of
    several referrers becomes the nearest node above all of these, until nothing changes. That node is the one above the least and the
    greatest of their labels, so an object of very many referrers takes two partial aggregates. A graph that is slow to settle, as doubly
    linked lists are, is handed to one task if it fits (see kernel). settled: obj, label of what is known of a shallow graph.
    """
    top = checkpointed(roots.select("obj").distinct().join(reached.select("obj"), "obj", "left_semi"))
    live = edges.select("src", "dst").where("src != dst").join(reached.select(F.col("obj").alias("src")), "src", "left_semi").join(top.withColumnRenamed("obj", "dst"), "dst", "left_anti")
    refs = checkpointed(live.groupBy("dst").agg(F.min("src").alias("a"), F.max("src").alias("b")))
    several = checkpointed(live.join(refs.where("a != b").select("dst"), "dst", "left_semi"))
    shallow = (reached.agg(F.max("level")).first()[0] or 0) < SHALLOW
    start = reached.select("obj", F.coalesce("parent", F.lit(ROOT).cast("long")).alias("idom"))
    if shallow:
        settled = _settled(refs, several, top) if settled is None else settled
        rest = several.select(F.col("dst").alias("obj")).join(settled, "obj", "left_anti").limit(1)
        if rest.isEmpty():
            return settled.select("obj", _over("label").alias("idom"), "label")
        known = settled.select("obj", _over("label").alias("known"))
        start = start.join(known, "obj", "left").select("obj", F.coalesce("known", "idom").alias("idom"))
        several = checkpointed(several.join(settled.select(F.col("obj").alias("dst")), "dst", "left_anti"))
    idoms = checkpointed(start)
    # What changes matters again only below it, or where it refers to objects of several referrers.
    for turn in range(max_rounds):
        if several.isEmpty():
            break
        if turn == PATIENCE and kernel.fits(live):
            idoms = checkpointed(kernel.solve(live, top))
            break
        labels = _paths(idoms) if shallow else _chains(idoms)
        ends = several.join(labels.withColumnRenamed("obj", "src"), "src").groupBy("dst").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        new = ends.select(F.col("dst").alias("obj"), (_last(_common_path("lo", "hi")) if shallow else _common_node("lo", "hi")).alias("new"))
        changed = checkpointed(new.join(idoms, "obj").where("new != idom").select("obj", "new"))
        felt = several.select(F.col("src").alias("obj")).union(idoms.select(F.col("idom").alias("obj")))
        last = changed.join(felt, "obj", "left_semi").isEmpty()
        idoms = checkpointed(idoms.join(changed, "obj", "left").select("obj", F.coalesce("new", "idom").alias("idom")))
        if last:
            break
    else:
        raise RuntimeError(f"dominators did not settle in {max_rounds} rounds")
    return idoms.join(_paths(idoms), "obj") if shallow else idoms


def _running(df: DataFrame, value: str, *by: str) -> DataFrame:
    """df with before: the sum of value over all rows that come before in the order of the columns by. Sums of sorted partitions, then those within each."""
    rows = checkpointed(df.orderBy(*by).withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("part").agg(F.sum(value).alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("earlier"))  # a row for each partition
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long"))).join(F.broadcast(parts), "part").withColumn("before", F.col("inside") + F.col("earlier")).drop("at", "part", "inside", "earlier")


def retained(tables: HeapTables, net: Net, reached: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """obj, idom (ROOT for top-level objects), class_id, shallow, depth, retained, size (objects) of each reached object, dealt by obj; and obj, label of a shallow graph.

    Of a deep graph there are no labels, and first and last, as numbered() adds them, are in the rows. reached: as live() gives.
    """
    parts = net.parts
    sized = dealt(tables.objects.select("obj", "class_id", "shallow"), "obj", parts)
    depth = reached.agg(F.max("level")).first()[0] or 0
    settled = None
    if depth < min(SHALLOW, kernel.DEEP):
        # A way through cycles may be longer than all levels; what is left then is settled by rounds over the rest.
        settled, whole = _pushed(net, reached, 2 * kernel.DEEP)
        found = settled.withColumn("idom", _over("label"))
    if settled is None or not whole:
        found = dominators(tables.edges, tables.roots, reach(tables.edges, tables.roots), settled)
        found = dealt(found, "obj", parts)
    if "label" in found.columns:
        # A node's sums are over the ways that it is on.
        rows = found.join(sized, "obj")
        below = rows.select(F.explode(F.slice("label", F.lit(1), F.size("label") - 1)).alias("obj"), "shallow").groupBy("obj").agg(F.sum("shallow").alias("more"), F.count("*").alias("others"))
        zero = F.lit(0).cast("long")
        rows = rows.join(below, "obj", "left").select("obj", "idom", "class_id", "shallow", F.size("label").alias("depth"), (F.col("shallow") + F.coalesce("more", zero)).alias("retained"), (1 + F.coalesce("others", zero)).alias("size"))
        return dealt(rows, "obj", parts), found.select("obj", "label")
    tree = checkpointed(_depths(found).join(sized, "obj").withColumn("one", F.lit(1).cast("long")))
    tree = checkpointed(tree.join(_totals(tree, ["shallow", "one"]), "obj").select("obj", "idom", "class_id", "shallow", "depth", F.col("n_shallow").alias("retained"), F.col("n_one").alias("size")))
    siblings = _running(tree, "size", "idom", "obj")
    start = siblings.groupBy("idom").agg(F.min("before").alias("start"))
    steps = siblings.join(start, "idom").select("obj", F.col("idom").alias("up"), (F.col("before") - F.col("start") + F.when(F.col("idom") == ROOT, 0).otherwise(1)).cast("long").alias("first"))
    first = _doubled(steps, {"first": F.col("first") + F.col("above_first")}, ["first"]).select("obj", "first")
    return dealt(tree.join(first, "obj").withColumn("last", F.col("first") + F.col("size") - 1), "obj", parts), None


def numbered(tree: DataFrame, labels: DataFrame | None, parts: int) -> DataFrame:
    """The tree of retained() with first and last.

    first numbers the objects from 0 in preorder, children by id, as their ways sort; what an object dominates, itself too, is numbered from first to last.
    """
    if labels is None:
        return tree
    with shuffled(tree.sparkSession, parts):
        rows = checkpointed(tree.join(labels, "obj").orderBy("label").drop("label").withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("part").agg(F.count("*").alias("all"))
    counts = checkpointed(counts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("earlier")))  # a row for each partition
    rows = rows.join(F.broadcast(counts), "part").withColumn("first", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("earlier")).drop("at", "part", "earlier")
    return rows.withColumn("last", F.col("first") + F.col("size") - 1)


def dominator_tree(tables: HeapTables, reached: DataFrame) -> DataFrame:
    """obj, idom (ROOT for top-level objects), class_id, shallow, depth, retained, size, first and last of each reached object. reached: obj and level."""
    dealt_ = net(tables.edges)
    tree, labels = retained(tables, dealt_, dealt(reached.select("obj", "level"), "obj", dealt_.parts))
    return numbered(tree, labels, dealt_.parts)


#: Objects of one block of preorder numbers, and of one of blocks' numbers.
BLOCK = 1 << 16


def inside(rows: DataFrame, *group: str) -> DataFrame:
    """rows (first, last, mark and columns of group) with over: whether an earlier marked row of the same group holds it.

    As intervals are nested or apart, that is so where the greatest last of the marked rows before it is no less than its own first. Running
    maxima are taken within blocks of numbers, and over blocks, so that no group is one task's.
    """
    ends = F.when(F.col("mark"), F.col("last"))
    rows = rows.withColumn("block", F.floor(F.col("first") / BLOCK))
    blocks = rows.groupBy(*group, "block").agg(F.max(ends).alias("end"))
    earlier = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("carried", F.max("end").over(earlier)).drop("end")
    near = Window.partitionBy(*group, "block").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.max(ends).over(near)).join(blocks, [*group, "block"], "left")
    return rows.withColumn("over", F.coalesce(F.greatest("near", "carried") >= F.col("first"), F.lit(False))).drop("block", "near", "carried")


def children(tree: DataFrame, top: int) -> DataFrame:
    """idom, rank, obj, retained: the biggest children of each dominator, ties by id. The best of salted parts first, as one object may have very many children."""
    rows = tree.where(F.col("idom") != ROOT).select("idom", "obj", "retained")
    parts = Window.partitionBy("idom", F.pmod(F.xxhash64("obj"), F.lit(64))).orderBy(F.desc("retained"), "obj")
    w = Window.partitionBy("idom").orderBy(F.desc("retained"), "obj")
    rows = rows.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("idom", "rank", "obj", "retained")


def top_level(tree: DataFrame, top: int) -> DataFrame:
    return tree.where(F.col("idom") == ROOT).orderBy(F.desc("retained"), "obj").limit(top).select("obj", "retained")


def descend(tree: DataFrame, start: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """start (obj), obj, retained, hops: from each, down to where memory gathers: as long as the biggest child holds three quarters of what its parent does.

    folds (obj): objects whose step down from their dominator goes on a run of equal steps; a way that ends in such a run ends where the run begins.
    """
    biggest = tree.where(F.col("idom") != ROOT).groupBy("idom").agg(F.max_by("obj", F.struct("retained", -F.col("obj"))).alias("child"), F.max("retained").alias("held"))
    none = F.lit(None).cast("long")
    # Only objects with a child that holds so much have a step; what is in none of them ends a way.
    go = checkpointed(tree.select("obj", "retained").join(biggest.withColumnRenamed("idom", "obj"), "obj").where("4 * held >= 3 * retained").select("obj", "child"))
    ends = go.select(F.col("child").alias("obj")).union(start.select("obj")).distinct().join(go.select("obj"), "obj", "left_anti")
    steps = go.select("obj", F.col("child").alias("up"), F.lit(1).alias("hops")).union(ends.select("obj", F.lit(ROOT).cast("long"), F.lit(0)))
    steps = steps.join(folds.select("obj", F.lit(True).alias("on")), "obj", "left") if folds is not None else steps.withColumn("on", F.lit(None).cast("boolean"))
    # The ways of all objects at once, as doubling takes few rounds where a way is long. end: the last object on the way from here that is no run's.
    steps = steps.select("obj", "up", F.when(F.col("on").isNull(), F.col("obj")).otherwise(none).alias("end"), "hops")
    ends = _doubled(steps, {"end": F.coalesce("above_end", "end"), "hops": F.col("hops") + F.col("above_hops")}, ["end", "hops"])
    out = start.select("obj").join(ends, "obj").select(F.col("obj").alias("start"), F.coalesce("end", "obj").alias("obj"), "hops")
    return out.join(tree.select("obj", "retained"), "obj").select("start", "obj", "retained", "hops")


def folds(tables: HeapTables, tree: DataFrame) -> DataFrame:
    """obj of those whose step down from their dominator has the class and the field of the step before: both objects' classes are equal, and so are the labels of the first edges into them. Array elements are no fields."""
    pairs = tree.where(F.col("idom") != ROOT).select("obj", "idom").join(tables.objects.select("obj", "class_id"), "obj")
    first = tables.edges.join(pairs.select(F.col("idom").alias("src"), F.col("obj").alias("dst")), ["src", "dst"]).groupBy(F.col("dst").alias("obj")).agg(F.min_by(F.struct("label", "elem"), "ord").alias("e"))
    steps = checkpointed(pairs.join(first, "obj").where("e.elem is null").select("obj", "idom", "class_id", "e.label"))
    above = steps.select(F.col("obj").alias("idom"), F.col("class_id").alias("over"), F.col("label").alias("before"))
    return steps.join(above, "idom").where("class_id = over and label = before").select("obj")


def subtree(tree: DataFrame, objs: DataFrame) -> DataFrame:
    """outer, obj: what each of objs (obj) dominates, itself too; of an unreached object itself alone.

    Each interval of preorder numbers is cut into aligned blocks of powers of two, which meet the numbers by equality.
    """
    wanted = checkpointed(objs.select("obj").distinct().join(tree.select("obj", "first", "last"), "obj", "left"))
    cut = wanted.where("first is not null").select(F.col("obj").alias("outer"), F.inline(_blocks(F.col("first"), F.col("last"))))
    cut = checkpointed(cut)
    scales = sorted(r["scale"] for r in cut.select("scale").distinct().collect())  # 63 at most
    points = tree.select("obj", F.inline(F.array(*[F.struct(F.lit(s).alias("scale"), F.shiftright("first", s).alias("block")) for s in scales]))) if scales else None
    alone = wanted.where("first is null").select(F.col("obj").alias("outer"), "obj")
    return alone if points is None else cut.join(points, ["scale", "block"]).select("outer", "obj").union(alone)


def _blocks(first: Column, last: Column) -> Column:
    """The fewest aligned blocks (scale, block: numbers from block * 2^scale on) that make up first to last."""
    one = lambda s, b: F.struct(s.alias("scale"), b.alias("block"))
    right = lambda x, s: F.call_function("shiftright", x, s)

    def of(s: Column) -> Column:
        lo, hi = right(first + F.call_function("shiftleft", F.lit(1).cast("long"), s) - 1, s), right(last + 1, s)
        return F.array_compact(F.array(F.when((lo < hi) & (lo % 2 == 1), one(s, lo)), F.when((lo < hi) & (hi % 2 == 1), one(s, hi - 1))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(47)), of))
