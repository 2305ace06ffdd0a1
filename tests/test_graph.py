"""Reachability and dominators against the removal of vertices, on small graphs by hand and at random."""

import random

from pyspark.sql import functions as F

from heapsift.operators import graph
from heapsift.plans.tables import HeapTables

SHALLOW = 16


def tables(spark, adjacency, roots, shallow=SHALLOW):
    n = len(adjacency)
    objects = spark.createDataFrame([((i + 1) * 8, 1, "instance", 0, shallow) for i in range(n)], "obj long, class_id long, kind string, len long, shallow long")
    edges = spark.createDataFrame([((i + 1) * 8, k, (j + 1) * 8, "element", k) for i, out in enumerate(adjacency) for k, j in enumerate(out)], "src long, ord long, dst long, label string, elem long")
    gc = spark.createDataFrame([((r + 1) * 8, "sticky class") for r in roots], "obj long, kind string")
    classes = spark.createDataFrame([(1, "Node", None, 0)], "class_id long, name string, super_id long, loader_id long")
    return HeapTables(classes, objects, edges, gc, spark.createDataFrame([], "src long, dst long, ref_kind string"))


def queue(adjacency, roots, without=None):
    parent, order = {}, []
    for r in sorted(set(roots)):
        if r != without:
            parent[r] = None
            order.append(r)
    for v in order:
        for w in adjacency[v]:
            if w not in parent and w != without:
                parent[w] = v
                order.append(w)
    return parent


def oracle(adjacency, roots):
    reached = queue(adjacency, roots)
    gone = {v: set(reached) - set(queue(adjacency, roots, v)) for v in reached}
    idom = {}
    for v in reached:
        over = [u for u in reached if u != v and v in gone[u]]
        idom[v] = min(over, key=lambda u: len(gone[u])) if over else -1
    return reached, idom, {v: len(s) for v, s in gone.items()}


def check(spark, adjacency, roots, shallow=SHALLOW):
    t = tables(spark, adjacency, roots, shallow)
    reached = graph.reach(t.edges, t.roots)
    parent, idom, size = oracle(adjacency, roots)
    got = {r["obj"] // 8 - 1: None if r["parent"] is None else r["parent"] // 8 - 1 for r in reached.collect()}
    assert got == parent
    rows = graph.dominator_tree(t, reached).collect()
    assert {r["obj"] // 8 - 1: r["idom"] // 8 - 1 for r in rows} == idom
    assert {r["obj"] // 8 - 1: r["retained"] for r in rows} == {v: n * shallow for v, n in size.items()}


def test_no_objects_reached(spark):
    check(spark, [[1], [0], []], [])


def test_roots_given_twice(spark):
    check(spark, [[], [], []], [0, 1, 1])


def test_diamond_with_parallel_edges(spark):
    check(spark, [[1, 2, 2, 4], [3], [3], [1], [], []], [0, 4])


def test_sizes_beyond_32_bits(spark):
    check(spark, [[1, 2, 3, 4], [], [], [], []], [0], 1 << 30)


def test_random_graphs(spark):
    rng = random.Random(5)
    for case in range(2):
        check(spark, [[rng.randrange(16) for _ in range(rng.randrange(5))] for _ in range(16)], [0] if case % 2 == 0 else [0, 5, 12])


def test_children_and_blocked_edges(spark):
    t = tables(spark, [[1, 2, 3, 4], [5], [6, 7], [], [], [], [], []], [0])
    tree = graph.dominator_tree(t, graph.reach(t.edges, t.roots))
    rows = graph.children(tree, 10).where(F.col("idom") == 8).orderBy("rank").collect()
    assert [r["obj"] // 8 - 1 for r in rows] == [2, 1, 3, 4]
    blocked = spark.createDataFrame([(8, 24)], "src long, dst long")
    assert {r["obj"] // 8 - 1 for r in graph.reach(t.edges, t.roots, blocked).collect()} == {0, 1, 3, 4, 5}
    assert graph.k_paths(t.edges, t.roots, 56, 3) == [[8, 24, 56]]


def test_deep_graphs_in_one_task(spark):
    rng = random.Random(6)
    check(spark, [[i + 1 if i + 1 < 60 else 0, *(rng.randrange(60) for _ in range(i % 10 // 8))] for i in range(60)], [0, 40])


def ladder(n):
    """A chain whose objects refer to others of it, back and forth, so that neither single referrers nor an order of referrers settle it."""
    rng = random.Random(7)
    return [[*([i + 1] if i + 1 < n else []), *([rng.randrange(n)] if i % 7 == 0 else []), *([max(i - 3, 0)] if i % 5 == 0 else [])] for i in range(n)]


def test_deep_graphs_by_chains(spark, monkeypatch):
    """No graph fits one task, and paths as labels aren't used: levels one after another, labels of heavy chains."""
    monkeypatch.setattr(graph, "SHALLOW", 2)
    monkeypatch.setattr(graph.kernel, "EDGES", -1)
    check(spark, ladder(16), [0, 11])


def test_cycles_with_several_entries(spark):
    check(spark, [[1, 2], [2, 3], [1, 3], [4, 5], [5], [4, 6], []], [0])


def test_long_chain(spark):
    n = 5_000
    ids = F.col("id") * 8 + 8
    edges = spark.range(n - 1).select(ids.alias("src"), F.lit(0).cast("long").alias("ord"), (ids + 8).alias("dst"), F.lit("next").alias("label"), F.lit(None).cast("long").alias("elem"))
    objects = spark.range(n).select(ids.alias("obj"), F.lit(1).cast("long").alias("class_id"), F.lit("instance").alias("kind"), F.lit(0).cast("long").alias("len"), F.lit(16).cast("long").alias("shallow"))
    t = tables(spark, [[]], [0])
    t = HeapTables(t.classes, objects, edges, t.roots, t.weak_edges)
    tree = graph.dominator_tree(t, graph.reach(t.edges, t.roots))
    assert tree.where((F.col("idom") != F.col("obj") - 8) | (F.col("retained") != (n - (F.col("obj") / 8 - 1)) * 16) | (F.col("first") != F.col("obj") / 8 - 1) | (F.col("last") != n - 1)).isEmpty()
    assert tree.count() == n


def test_star(spark):
    n = 100_000
    ids = F.col("id") * 8 + 8
    edges = spark.range(1, n - 1).select(F.lit(8).cast("long").alias("src"), F.col("id").alias("ord"), ids.alias("dst"), F.lit("[]").alias("label"), F.col("id").alias("elem"))
    objects = spark.range(n).select(ids.alias("obj"), F.lit(1).cast("long").alias("class_id"), F.lit("instance").alias("kind"), F.lit(0).cast("long").alias("len"), F.lit(16).cast("long").alias("shallow"))
    t = tables(spark, [[]], [0])
    t = HeapTables(t.classes, objects, edges, t.roots, t.weak_edges)
    tree = graph.dominator_tree(t, graph.reach(t.edges, t.roots))
    assert tree.where("obj = 8").first()["retained"] == (n - 1) * 16 and tree.count() == n - 1


def test_subtrees(spark):
    adjacency = [[1, 2, 3, 4], [5], [6, 7], [], [], [8], [], [], [], []]
    t = tables(spark, adjacency, [0])
    tree = graph.dominator_tree(t, graph.reach(t.edges, t.roots))
    gone = {v: set(queue(adjacency, [0])) - set(queue(adjacency, [0], v)) for v in queue(adjacency, [0])}
    got = {}
    for r in graph.subtree(tree, t.objects.select("obj")).collect():
        got.setdefault(r["outer"] // 8 - 1, set()).add(r["obj"] // 8 - 1)
    assert got == gone | {9: {9}}
