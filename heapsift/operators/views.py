"""What a closer look at classes, objects and searches asks for: selections, rankings, parts of the dominator tree, stack frames, buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.tables import HeapTables


def parse_where(text: str) -> tuple[str, str, str]:
    """Class pattern, field and value of `CLASS.FIELD=VALUE`: split at the last = and the last dot before it."""
    head, equals, value = text.rpartition("=")
    name, dot, field = head.rpartition(".")
    if not (equals and dot and name and field):
        raise ValueError(f"not CLASS.FIELD=VALUE: {text}")
    return name.strip(), field.strip(), value.strip()


def where(values: DataFrame, condition: str) -> DataFrame:
    """obj of the objects whose field has exactly that value, as text. values: obj, class, field, depth (0: declared by the object's own class), text.

    Of fields of one name the one of the least depth counts. It is an error if no object of a class that matches has the field.
    """
    pattern, field, value = parse_where(condition)
    held = values.where(X.class_matches(F.col("class"), pattern) & (F.col("field") == field))
    if held.isEmpty():
        raise ValueError(f"no class that matches {pattern} has a field {field}")
    return held.groupBy("obj").agg(F.min_by("text", "depth").alias("text")).where(F.col("text") == value).select("obj")


def by_retained(objs: DataFrame, tree: DataFrame, top: int) -> DataFrame:
    """obj, retained of the objects (obj) that keep most, ties by id; what isn't reached keeps 0. As a top-k, so no task sorts them all."""
    rows = objs.select("obj").distinct().join(tree.select("obj", "retained"), "obj", "left").na.fill(0, ["retained"])
    return rows.orderBy(F.desc("retained"), "obj").limit(top)


def instances_by_retained(tables: HeapTables, tree: DataFrame, name: str, top: int) -> DataFrame:
    """obj, retained of a class's own instances, unreached ones too."""
    cls = tables.classes.where(F.col("name") == name).select("class_id")
    return by_retained(tables.objects.where("kind != 'class'").join(F.broadcast(cls), "class_id", "left_semi"), tree, top)


def referrer_objects(tables: HeapTables, tree: DataFrame, obj: int, top: int) -> DataFrame:
    """src, label, elem (of its first edge to obj), retained of the reached objects that refer to obj, the biggest first, ties by id."""
    first = tables.edges.where(F.col("dst") == obj).groupBy("src").agg(F.min_by(F.struct("label", "elem"), "ord").alias("e"))
    held = first.join(tree.select(F.col("obj").alias("src"), "retained"), "src")
    return held.select("src", "e.label", "e.elem", "retained").orderBy(F.desc("retained"), "src").limit(top)


def largest(rows: DataFrame, measure: str, top: int = 100) -> DataFrame:
    """The rows (obj and others) of the greatest measure, ties by obj."""
    return rows.orderBy(F.desc(measure), "obj").limit(top)


def sparse_arrays(tables: HeapTables, tree: DataFrame, collections: DataFrame, reference: int = 8, least: int = 1024) -> DataFrame:
    """obj, filled, capacity, wasted of reached object arrays of at least `least` slots, less than half of them filled, that no collection (obj) dominates directly."""
    arrays = tables.objects.where((F.col("kind") == "object_array") & (F.col("len") >= least)).select("obj", F.col("len").alias("capacity"))
    arrays = arrays.join(tree.select("obj", "idom"), "obj").join(collections.select(F.col("obj").alias("idom")).distinct(), "idom", "left_anti")
    filled = tables.edges.where("elem is not null").select(F.col("src").alias("obj")).join(arrays.select("obj"), "obj", "left_semi").groupBy("obj").agg(F.count("*").alias("filled"))
    rows = arrays.join(filled, "obj", "left").na.fill(0, ["filled"]).where("2 * filled < capacity")
    return rows.select("obj", "filled", "capacity", ((F.col("capacity") - F.col("filled")) * reference).alias("wasted"))


def tree_part(tree: DataFrame, obj: int, levels: int, floor: int = 1) -> DataFrame:
    """obj, idom, level (0: obj), retained, hidden, hidden_bytes of what obj dominates within levels and with floor bytes at least; hidden counts a shown object's other children.

    What an object keeps is no more than what its dominator does, so that size and depth alone tell what is shown, and no walk is needed.
    """
    floor = max(floor, 1)
    top = tree.where(F.col("obj") == obj).select(F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("depth").alias("base"))
    below = tree.join(F.broadcast(top), F.col("first").between(F.col("lo"), F.col("hi"))).withColumn("level", F.col("depth") - F.col("base")).where(F.col("level") <= levels)  # top is one row
    shown = (F.col("level") == 0) | ((F.col("level") < levels) & (F.col("retained") >= floor))
    hidden = below.where(~shown).groupBy(F.col("idom").alias("obj")).agg(F.count("*").alias("hidden"), F.sum("retained").alias("hidden_bytes"))
    return below.where(shown).select("obj", "idom", "level", "retained").join(hidden, "obj", "left").na.fill(0, ["hidden", "hidden_bytes"])


def hashable_arrays(tables: HeapTables, reached: DataFrame, strings: DataFrame, header: int = 16, least: int = 16) -> DataFrame:
    """obj of the reached primitive arrays that take least bytes besides their header and that no string (array) owns."""
    arrays = tables.objects.where((F.col("kind") == "primitive_array") & (F.col("shallow") >= header + least)).select("obj")
    return arrays.join(reached.select("obj"), "obj", "left_semi").join(strings.select(F.col("array").alias("obj")), "obj", "left_anti")


def direct_buffers(buffers: DataFrame, edges: DataFrame) -> DataFrame:
    """obj, capacity, mapped, view of direct byte buffers (obj, capacity): one with a field att is a view of another and has no memory of its own, one with a field fd is a mapped file."""
    has = edges.where(F.col("label").isin("att", "fd")).select(F.col("src").alias("obj"), "label").groupBy("obj").agg(F.max(F.col("label") == "att").alias("view"), F.max(F.col("label") == "fd").alias("mapped"))
    rows = buffers.join(has, "obj", "left").na.fill(False, ["view", "mapped"])
    return rows.select("obj", F.coalesce("capacity", F.lit(0)).alias("capacity"), "mapped", "view")


def direct_totals(buffers: DataFrame) -> DataFrame:
    """views, buffers, capacity, mapped, mapped_bytes of direct_buffers() in one row; views count apart."""
    own, mapped = ~F.col("view"), ~F.col("view") & F.col("mapped")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("capacity"))), F.lit(0))
    return buffers.agg(F.count_if("view").alias("views"), F.count_if(own).alias("buffers"), total(own).alias("capacity"), F.count_if(mapped).alias("mapped"), total(mapped).alias("mapped_bytes"))


def frames(frames: DataFrame, symbols: DataFrame, classes: DataFrame) -> DataFrame:
    """id, text of stack frames. frames: id, method_sym, source_sym, class_serial, line; symbols: id, text; classes: serial, name. What is missing there is shown as unknown."""
    named = lambda column, out: symbols.select(F.col("id").alias(column), F.col("text").alias(out))
    rows = frames.join(named("method_sym", "method"), "method_sym", "left").join(named("source_sym", "source"), "source_sym", "left")
    rows = rows.join(classes.select(F.col("serial").alias("class_serial"), F.col("name").alias("class")), "class_serial", "left")
    return rows.select("id", X.frame_text(*[F.col(c) for c in ("class", "method", "source", "line")]).alias("text"))


def stacks(traces: DataFrame, texts: DataFrame) -> DataFrame:
    """serial, depth (0: the top frame), text of the stacks of traces (serial, frames). texts: id, text. A frame that is missing there is shown by its id."""
    at = traces.select("serial", F.posexplode("frames").alias("depth", "id"))
    unknown = F.concat(F.lit("<frame 0x"), F.lower(F.hex("id")), F.lit(">"))
    return at.join(texts, "id", "left").select("serial", "depth", F.coalesce("text", unknown).alias("text"))


def path_keys(tables: HeapTables, paths: DataFrame, threads: DataFrame | None = None) -> DataFrame:
    """target, key: the way from a root as text without addresses and indices, so that dumps can be compared. paths: as root_paths() gives; threads: obj, name."""
    rows = paths.join(tables.objects.select("obj", "class_id", "kind"), "obj").join(tables.classes.select("class_id", "name"), "class_id")
    rows = rows.withColumn("what", X.kind_text(F.col("kind"), F.col("name"))).drop("class_id", "kind", "name")
    what: Column = F.col("what")
    if threads is not None:
        rows = rows.join(threads.where("name != ''").select("obj", F.col("name").alias("thread")), "obj", "left")
        what = F.concat(what, F.coalesce(F.concat(F.lit(' "'), "thread", F.lit('"')), F.lit("")))
    # Statics hang from class objects; the owner's name is that of the step before.
    before = rows.select("target", (F.col("step") + 1).alias("step"), F.regexp_extract("what", "^class (.*)$", 1).alias("owner"))
    rows = rows.join(before, ["target", "step"], "left")
    owner = F.when(F.col("owner") != "", F.col("owner"))
    hop = F.when(F.col("label").isNull() & F.col("elem").isNull(), what).otherwise(F.concat_ws(" ", X.edge_text(F.col("label"), F.col("elem"), owner), what))
    steps = rows.select("target", "step", hop.alias("hop")).groupBy("target").agg(F.sort_array(F.collect_list(F.struct("step", "hop"))).alias("hops"))
    return steps.select("target", F.array_join("hops.hop", " ").alias("key"))


def ranked_changes(changes: DataFrame, key: str, measures: list[str], top: int) -> DataFrame:
    """The rows of contents.changes() that changed most: by the size of each measure's change in turn, then by key."""
    return changes.orderBy(*[F.abs(f"{m}_change").desc() for m in measures], key).limit(top)
