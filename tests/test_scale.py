"""What larger tables would show: steps that are done once, and plans that keep to keys."""

from pyspark.sql import functions as F

from heapsift.operators import fields, graph, summary, views
from heapsift.plans.heap import Heap
from heapsift.plans.tables import HeapTables, dealt, shuffled
from heapsift.sources import relational

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_line_items_are_numbered_once(spark):
    for options in ({}, {"until": "1996-01-01"}):
        t = relational.heap(spark, SF, **options)
        assert "Window" not in plan(t.edges) and "Window" not in plan(t.objects)


def test_rounds_of_ancestors_are_not_worked_out_again(spark):
    classes = spark.range(1, 200).select(F.col("id").alias("class_id"), F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("super_id"))
    found = fields.ancestors(classes)
    assert "Join" not in plan(found)
    expected = {(i, i >> d, d) for i in range(1, 200) for d in range(8) if i >> d}
    assert {tuple(r) for r in found.select("class_id", "ancestor", "depth").collect()} == expected


def test_ways_are_worked_out_for_objects_with_a_step_only(spark, monkeypatch):
    seen = []
    doubled = graph._doubled
    monkeypatch.setattr(graph, "_doubled", lambda nodes, *a: seen.append(nodes.count()) or doubled(nodes, *a))
    # 1 holds 2 alone, and 2 many small objects.
    rows = [(1, 0, 1000), (2, 1, 990), *[(i, 2, 9) for i in range(3, 103)]]
    tree = spark.createDataFrame(rows, "obj long, idom long, retained long")
    assert [tuple(r) for r in graph.descend(tree, spark.createDataFrame([(1,), (7,)], "obj long")).orderBy("start").collect()] == [(1, 2, 990, 1), (7, 7, 9, 0)]
    assert seen == [3]


def test_dealt_tables_join_without_a_shuffle(spark):
    a, b = (dealt(spark.range(100).select(F.col("id").alias("obj"), (F.col("id") * k).alias(f"x{k}")), "obj", 3) for k in (2, 3))
    with shuffled(spark, 3):
        joined = a.join(b, "obj")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 100


def test_classes_of_the_tree_need_no_join_by_object(spark):
    tree = spark.createDataFrame([(8, 0, 1, 16), (16, 0, 2, 24), (24, 0, 2, 24)], "obj long, idom long, class_id long, retained long")
    none = spark.createDataFrame([], "obj long, class_id long, shallow long")
    classes = spark.createDataFrame([(1, "A"), (2, "B")], "class_id long, name string")
    found = summary.biggest_per_class(HeapTables(classes, none, none, none, none), tree)
    assert sorted(tuple(r) for r in found.collect()) == [("A", 8, 16), ("B", 16, 24)]


def counted(monkeypatch, *modules):
    """The numbers of rows that are written."""
    seen = []
    for name in ("checkpointed", "dealt"):
        for m in modules:
            if hasattr(m, name):
                monkeypatch.setattr(m, name, lambda df, *a, write=getattr(m, name): (out := write(df, *a), seen.append(out.count()))[0])
    return seen


def fan(spark):
    """1 leads to 2 and 3, these to 4 twice each, 4 back to 1 and to 2,000 others."""
    rows = [(1, 0, 2), (1, 1, 3), (3, 0, 4), (2, 5, 4), (2, 7, 4), (3, 1, 4), (4, 0, 1), *[(4, i, i) for i in range(10, 2010)]]
    return spark.createDataFrame([(*r, f"f{r[1]}", None) for r in rows], "src long, ord long, dst long, label string, elem long")


def test_ways_to_one_object_take_one_walk_among_what_leads_to_it(spark, monkeypatch):
    edges, roots = fan(spark), spark.createDataFrame([(1,)], "obj long")
    written = counted(monkeypatch, graph)
    assert graph.k_paths(edges, roots, 4, 3) == [[1, 2, 4], [1, 3, 4]]
    assert sum(written) < 50
    assert graph.k_paths(edges, roots, 1, 3) == [[1]] and graph.k_paths(edges, roots, 5, 3) == []
    assert graph.k_paths(edges, roots, 10, 3) == [[1, 2, 4, 10]]


def test_large_frontiers_stay_with_dealt_edges(spark, monkeypatch):
    """The same walk, all of it and with an end, where no frontier is small."""
    monkeypatch.setattr(graph, "FEW", -1)
    monkeypatch.setattr(graph, "PART", 1000)
    edges, roots = fan(spark), spark.createDataFrame([(1,), (1,)], "obj long")
    found = {r.obj: (r.parent, r.level) for r in graph.reach(edges, roots).collect()}
    assert found == {1: (None, 0), 2: (1, 1), 3: (1, 1), 4: (2, 2)} | {i: (4, 3) for i in range(10, 2010)}
    assert graph.k_paths(edges, roots, 4, 1) == [[1, 2, 4]]
    assert graph.k_paths(edges, roots, 4, 2) == [[1, 2, 4], [1, 3, 4]]


def test_ways_to_many_objects_take_no_walk_over_all(spark, monkeypatch):
    edges, roots = fan(spark), spark.createDataFrame([(1,)], "obj long")
    objects = spark.createDataFrame([(i, 1, "instance", 0, 16) for i in (1, 2, 3, 4)], "obj long, class_id long, kind string, len long, shallow long")
    classes = spark.createDataFrame([(1, "N", None, 0)], "class_id long, name string, super_id long, loader_id long")
    h = Heap(HeapTables(classes, objects, edges, roots, spark.createDataFrame([], "src long, dst long, ref_kind string")))
    targets = spark.createDataFrame([(4,), (3,), (5,)], "obj long")
    expected = [(3, 0, 1, None), (3, 1, 3, "f1"), (4, 0, 1, None), (4, 1, 2, "f0"), (4, 2, 4, "f5")]
    rows = lambda df: sorted((r.target, r.step, r.obj, r.label) for r in df.collect())
    written = counted(monkeypatch, graph)
    paths = h.paths(targets)
    assert rows(paths) == expected and sum(written) < 60
    assert {r.target: r.key for r in views.path_keys(h.tables, paths).collect()} == {3: "N .f1 N", 4: "N .f0 N .f5 N"}
    # Many targets: the walk goes on from the roots until it has found them, and no further.
    written.clear()
    monkeypatch.setattr(graph, "FEW", 2)
    two = targets.where("obj > 2 and obj < 5").union(roots)
    assert rows(h.paths(two)) == [(1, 0, 1, None), *expected] and sum(written) < 60
