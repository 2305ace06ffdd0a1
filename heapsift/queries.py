"""The queries of the engine over the tables of a folder, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import contents, fields, graph, loaders, summary, views
from .oracles import TABLES, TREE, grouped
from .plans.heap import Heap
from .sources import relational
from .sources.relational import SCALE, read

_HEAPS: dict = {}
_UNTIL = "1996-01-01"


def heap(spark: SparkSession, sf_dir: str, **options) -> Heap:
    """One loaded heap for each session, folder and options, as a session with a dump is used for many questions."""
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(options.items()))
    if key not in _HEAPS:
        _HEAPS[key] = Heap(relational.heap(spark, sf_dir, **options))
    return _HEAPS[key]


QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Graph


@query(grouped("class", "name"))
def class_histogram(spark, sf):
    h = heap(spark, sf)
    return summary.histogram(h.tables, h.tree)


@query(grouped("package", "regexp_replace(name, '\\.[^.]*$', '')"))
def packages(spark, sf):
    h = heap(spark, sf)
    return summary.packages(h.tables, h.tree)


_REACH = f"with recursive {TABLES}, r as (select {SCALE} + r_regionkey obj from region where r_regionkey < 3 union select dst from r join e on e.src = r.obj)"


@query(f"""{_REACH} select scope, count(*) objects, sum(shallow)::bigint bytes from (
 select shallow, 'all' scope from oc union all select shallow, case when obj in (select obj from r) then 'live' else 'unreachable' end from oc) group by scope""")
def heap_totals(spark, sf):
    h = heap(spark, sf, root_regions=3)
    return summary.totals(h.tables, h.live, graph.weak_only(h.tables, h.net, h.live))


@query(f"{_REACH} select name as class, count(*) objects, sum(shallow)::bigint shallow from oc anti join r using (obj) group by name")
def garbage_by_class(spark, sf):
    h = heap(spark, sf, root_regions=3)
    return summary.garbage(h.tables, h.live, graph.weak_only(h.tables, h.net, h.live))


_LEVELS = f"""with recursive {TABLES}, l as (select {SCALE} + r_regionkey obj, 0 level from region union select dst, level + 1 from l join e on e.src = l.obj where level < 12),
m as (select obj, min(level) level from l group by obj)"""


@query(f"{_LEVELS} select level::int \"level\", count(*) objects from m group by level")
def reach_levels(spark, sf):
    return heap(spark, sf).live.groupBy("level").agg(F.count("*").alias("objects"))


@query(f"""with {TABLES},
l0 as (select obj, null::bigint parent, row_number() over (order by obj) pos from (select {SCALE} + r_regionkey obj from region)),
c1 as (select dst obj, min((pos, ord, src)) x from e join l0 on src = obj group by dst), l1 as (select obj, x[3] parent, row_number() over (order by x[1], x[2], obj) pos from c1 where obj not in (select obj from l0)),
c2 as (select dst obj, min((pos, ord, src)) x from e join l1 on src = obj group by dst), l2 as (select obj, x[3] parent, row_number() over (order by x[1], x[2], obj) pos from c2),
c3 as (select dst obj, min((pos, ord, src)) x from e join l2 on src = obj group by dst), l3 as (select obj, x[3] parent, row_number() over (order by x[1], x[2], obj) pos from c3),
c4 as (select dst obj, min((pos, ord, src)) x from e join l3 on src = obj group by dst), l4 as (select obj, x[3] parent, row_number() over (order by x[1], x[2], obj) pos from c4 where obj not in (select obj from l3)),
c5 as (select dst obj, min((pos, ord, src)) x from e join l4 on src = obj group by dst), l5 as (select obj, x[3] parent from c5 where obj not in (select obj from l4))
select obj, parent, 0 "level" from l0 union all select obj, parent, 1 from l1 union all select obj, parent, 2 from l2 union all select obj, parent, 3 from l3 union all select obj, parent, 4 from l4 where obj not in (select obj from l3)
 union all select obj, parent, 5 from l5 where obj not in (select obj from l3) and obj not in (select obj from l4)""")
def bfs_parent(spark, sf):
    return heap(spark, sf).reached.select("obj", "parent", "level")


@query(f"with recursive {TREE} select obj, idom from d")
def idoms(spark, sf):
    return heap(spark, sf).sizes.select("obj", "idom")


@query(f"with recursive {TREE} select obj, idom from d")
def idoms_with_cycles(spark, sf):
    return heap(spark, sf, cycles=True).sizes.select("obj", "idom")


@query(f"with recursive {TREE} select obj, retained from ret")
def retained_sizes(spark, sf):
    return heap(spark, sf).sizes.select("obj", "retained")


@query(f"with recursive {TREE} select obj, retained from d join ret using (obj) where idom = 0 order by retained desc, obj limit 20")
def biggest_objects(spark, sf):
    return graph.top_level(heap(spark, sf).sizes, 20)


@query(f"""with recursive {TREE} select idom, "rank", obj, retained from (select idom, obj, retained, row_number() over (partition by idom order by retained desc, obj)::int "rank" from d join ret using (obj) where idom != 0) where "rank" <= 3""")
def children_ranked(spark, sf):
    return graph.children(heap(spark, sf).sizes, 3)


@query(f"with recursive {TREE} select name as class, obj, retained from (select *, row_number() over (partition by name order by retained desc, obj) n from oc join ret using (obj)) where n = 1")
def biggest_per_class(spark, sf):
    h = heap(spark, sf)
    return summary.biggest_per_class(h.tables, h.sizes)


@query(f"with recursive {TREE} select name as class, count(*) live from oc join d using (obj) group by name")
def live_per_class(spark, sf):
    h = heap(spark, sf)
    return summary.live_per_class(h.tables, h.live)


@query(f"""with {TABLES} select t.name target, s.name as class, label, count(*) refs from e join oc t on t.obj = dst join oc s on s.obj = src group by all""")
def referrers_by_field(spark, sf):
    h = heap(spark, sf)
    found = summary.referrers(h.tables, h.live, h.tables.objects.select("obj", F.col("class_id").alias("target")), h.net.parts)
    return found.join(h.tables.classes.select(F.col("class_id").alias("target"), "name"), "target").select(F.col("name").alias("target"), "class", "label", "refs")


@query(f"with recursive {TREE} select anc as \"outer\", name as class, count(*) objects, sum(shallow)::bigint bytes from up join oc on oc.obj = up.obj where anc // {SCALE} in (1, 2) group by all")
def retained_set(spark, sf):
    h = heap(spark, sf)
    return summary.retained_set(h.tables, h.tree, h.tree.where(F.floor(F.col("obj") / SCALE).isin(1, 2)).select("obj"))


@query(f"with recursive {TREE}, k as (select distinct obj from up where anc // {SCALE} = 3) select name as class, count(*) objects, sum(shallow)::bigint bytes from k join oc using (obj) group by name")
def keeps_of_class(spark, sf):
    h = heap(spark, sf)
    return summary.keeps_of_class(h.tables, h.tree, "trade.Customer")


@query(f"""with recursive {TREE}, x as (select d.obj, d.idom, r.retained, c.name, p.name over_ from d join ret r on r.obj = d.obj join oc c on c.obj = d.obj left join oc p on p.obj = d.idom),
a1 as (select obj from x where name = 'trade.Order'), u1 as (select x.* from x join a1 using (obj)), b1 as (select over_, sum(retained)::bigint bytes from u1 group by over_ order by bytes desc, over_ desc nulls first limit 1),
a2 as (select distinct idom obj from u1 where over_ = (select over_ from b1)), u2 as (select x.* from x join a2 using (obj)), b2 as (select over_, sum(retained)::bigint bytes from u2 group by over_ order by bytes desc, over_ desc nulls first limit 1),
a3 as (select distinct idom obj from u2 where over_ = (select over_ from b2)), u3 as (select x.* from x join a3 using (obj)), b3 as (select over_, sum(retained)::bigint bytes from u3 group by over_ order by bytes desc, over_ desc nulls first limit 1),
a4 as (select distinct idom obj from u3 where over_ = (select over_ from b3)), u4 as (select x.* from x join a4 using (obj)), b4 as (select over_, sum(retained)::bigint bytes from u4 group by over_ order by bytes desc, over_ desc nulls first limit 1)
select 1 "level", over_ owner, bytes from b1 union all select 2, * from b2 union all select 3, * from b3 union all select 4, * from b4""")
def owners_of_class(spark, sf):
    h = heap(spark, sf)
    found = summary.owners(h.tables, h.sizes, "trade.Order")
    return spark.createDataFrame([(i + 1, *x) for i, x in enumerate(found)], "level int, owner string, bytes long")


@query()
def suspects(spark, sf):
    h = heap(spark, sf)
    return summary.suspects(h.tables, h.live, h.tree, 10.0)


@query(f"""with recursive {TREE}, big as materialized (select idom, obj child, retained held from (select d.idom, d.obj, retained, row_number() over (partition by d.idom order by retained desc, d.obj) n from d join ret using (obj) where d.idom != 0) where n = 1),
tops as materialized (select obj, retained from d join ret using (obj) where idom = 0 order by retained desc, obj limit 5),
w as (select obj as "start", obj, retained, 0::int hops from tops union all select w."start", child, held, hops + 1 from w join big on big.idom = w.obj where 4 * held >= 3 * w.retained)
select "start", obj, retained, hops from (select *, row_number() over (partition by "start" order by hops desc) n from w) where n = 1""")
def descents(spark, sf):
    h = heap(spark, sf)
    return graph.descend(h.sizes, graph.top_level(h.sizes, 5).select("obj"))


@query(f"""with {TABLES} select 3 * {SCALE} + c_custkey target, unnest([0, 1, 2])::int step, unnest([{SCALE} + n_regionkey, {2 * SCALE} + n_nationkey, {3 * SCALE} + c_custkey]) obj, unnest([null, 'nations', 'customers']) label, null::bigint elem from customer join nation on n_nationkey = c_nationkey""")
def root_paths(spark, sf):
    h = heap(spark, sf)
    targets = h.tables.objects.where(F.col("class_id") == 3).select("obj")
    return h.paths(targets)


@query()
def k_root_paths(spark, sf):
    h = heap(spark, sf)
    target = h.tables.objects.where(F.col("class_id") == 6).agg(F.min("obj")).first()[0]
    return spark.createDataFrame([(i, j, o) for i, p in enumerate(graph.k_paths(h.tables.edges, h.tables.roots, target, 3)) for j, o in enumerate(p)], "path int, step int, obj long")


@query(f"select {4 * SCALE} + s_suppkey obj from supplier")
def weakly_held(spark, sf):
    h = heap(spark, sf, weak_suppliers=True)
    return graph.weak_only(h.tables, h.net, h.live, "weak")


@query(f"with recursive {TREE} select loader::bigint loader, count(distinct name) classes, count(*) instances, count(d.obj) live, sum(shallow)::bigint shallow, 0::bigint duplicates from oc left join d using (obj) group by loader")
def class_loaders(spark, sf):
    h = heap(spark, sf)
    return loaders.loaders(h.tables, h.live, h.tree).drop("owns")


@query(grouped("loader", "loader::bigint").replace("count(*) instances, sum(shallow)::bigint shallow, coalesce(max(retained), 0)::bigint retained", "coalesce(max(retained), 0)::bigint owns"))
def loader_owns(spark, sf):
    h = heap(spark, sf)
    return loaders.loaders(h.tables, h.live, h.tree).select("loader", "owns")


@query("""with c as (select o_custkey * 10 + ascii(left(o_orderstatus, 1)) % 10 class_id, o_orderpriority || o_custkey % 50 as name, o_custkey % 40 loader, count(*) live from orders group by all),
s as (select *, count(*) over (partition by name) same, first_value(class_id) over (partition by name order by live desc, class_id desc) best from c qualify same > 1),
t as (select loader, count(*) filter (best != class_id) lost, count(*) duplicates from s group by loader)
select loader, lost, duplicates from t where loader != 0 and lost > 0 and 2 * lost >= duplicates""")
def stale_loaders(spark, sf):
    o = read(spark, sf, "orders")
    key = (F.col("o_custkey") * 10 + F.ascii(F.substring("o_orderstatus", 1, 1)) % 10).alias("class_id")
    c = o.groupBy(key, F.concat("o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("name"), (F.col("o_custkey") % 40).alias("loader")).agg(F.count("*").alias("live"))
    return loaders.stale_loaders(c)


# Contents


def strings(spark, sf):
    """Documents as strings, each with an array of its own behind it."""
    d = read(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("obj"), F.col("doc_id").alias("array"), "text", (24 + F.ceil((F.octet_length("text") + 16) / 8) * 8).cast("long").alias("bytes"))


@query("""with s as (select doc_id, text, 24 + ((strlen(text) + 16 + 7) // 8) * 8 bytes from documents)
select md5(text) text_md5, count(*) copies, (sum(bytes) - arg_min(bytes, doc_id))::bigint wasted from s group by text having count(*) > 1""")
def duplicate_strings(spark, sf):
    return contents.duplicate_strings(strings(spark, sf)).select(F.md5("text").alias("text_md5"), "copies", "wasted")


@query("""with a as (select page_id array_, md5(html) content, strlen(html)::bigint bytes from pages union all select 1000000000 + doc_id, md5(text), strlen(text)::bigint from documents where text is not null)
select content, count(*) copies, (sum(bytes) - arg_min(bytes, array_))::bigint wasted from a group by content having count(*) > 1""")
def duplicate_arrays(spark, sf):
    """Arrays by their contents: the bytes of pages and of documents."""
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("array"), F.col("html").alias("body"))
    rows = pages.union(read(spark, sf, "documents").where("text is not null").select(F.col("doc_id") + 1_000_000_000, "text"))
    return contents.duplicate_arrays(rows.select("array", F.md5("body").alias("content"), F.octet_length("body").cast("long").alias("bytes")))


@query("""with b as (select p_brand as class, p_size bits from part), t as (select class, bits, count(*) n from b group by all),
r as (select *, row_number() over (partition by class order by n desc, bits) k from t)
select class, sum(n)::bigint instances, count(*) distinct_values, (sum(n - 1) * 16)::bigint wasted, string_agg(bits || ':' || n, ' ' order by k) filter (k <= 5) top_values from r group by class having sum(n - 1) > 0""")
def boxed_values(spark, sf):
    return contents.boxed_values(read(spark, sf, "part").select(F.col("p_brand").alias("class"), F.col("p_size").alias("bits"), F.lit(16).cast("long").alias("shallow")))


@query("select doc_id obj, md5(text) text_md5 from documents where contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'mit license')")
def find_text(spark, sf):
    return contents.find_text(strings(spark, sf), "MIT License").select("obj", F.md5("text").alias("text_md5"))


@query("select p_partkey obj from part where p_size = 7")
def where_field(spark, sf):
    """Parts as objects with a field size, which a superclass declares too."""
    part = read(spark, sf, "part")
    field = lambda depth, n: part.select(F.col("p_partkey").alias("obj"), F.lit("goods.Part").alias("class"), F.lit("size").alias("field"), F.lit(depth).alias("depth"), X.value_text("int", n).alias("text"))
    return views.where(field(0, F.col("p_size")).union(field(1, F.lit(7))), "=Part.size= 7")


@query("select distinct p_type as name from part where regexp_full_match(lower(p_type), '.*s.{1}.*') or lower(p_type) = 'small'")
def class_patterns(spark, sf):
    t = read(spark, sf, "part").select(F.col("p_type").alias("name"))
    return t.where(X.class_matches(F.col("name"), "*s?*") | X.class_matches(F.col("name"), "=SMALL")).distinct()


_COLLECTIONS = """c as (select c_mktsegment as class, count(o_orderkey) entries, 16 capacity, count(distinct o_orderdate::date) used from customer left join orders on o_custkey = c_custkey group by c_custkey, c_mktsegment)"""


@query(f"""with {_COLLECTIONS}, u as (select *, case when used > 0 then used else least(entries, capacity) end us from c)
select class, count(*) collections, count(*) filter (entries = 0) empty, sum(entries)::bigint entries, sum(capacity)::bigint capacity, (sum(capacity - us) * 8)::bigint wasted,
 count(*) filter (capacity >= 16 and 2 * us < capacity) sparse, count(*) filter (entries >= 12 and used > 0 and 2 * used < entries) colliding from u group by class""")
def collection_fill(spark, sf):
    c = read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    c = c.groupBy("c_custkey", F.col("c_mktsegment").alias("class")).agg(F.count("o_orderkey").alias("entries"), F.countDistinct(F.to_date("o_orderdate")).alias("used_buckets")).withColumn("capacity", F.lit(16).cast("long"))
    return contents.collection_fill(c, sparse=16, colliding=12)


@query(f"""with {TABLES},
n as (select name as class, count(*) instances, sum(shallow)::bigint shallow from oc group by name),
late as (select {5 * SCALE} + o_orderkey obj from orders where o_orderdate >= timestamp '{_UNTIL}'),
b as (select name as class, count(*) instances, sum(shallow)::bigint shallow from oc anti join late using (obj) anti join (select li.obj from li semi join late on late.obj = li.ord) x using (obj) group by name)
select class, coalesce(b.instances, 0)::bigint instances_before, coalesce(n.instances, 0)::bigint instances_now, coalesce(b.shallow, 0)::bigint shallow_before, coalesce(n.shallow, 0)::bigint shallow_now,
 (coalesce(n.instances, 0) - coalesce(b.instances, 0))::bigint instances_change, (coalesce(n.shallow, 0) - coalesce(b.shallow, 0))::bigint shallow_change
from n full join b using (class) where coalesce(n.instances, 0) != coalesce(b.instances, 0) or coalesce(n.shallow, 0) != coalesce(b.shallow, 0)""")
def baseline_classes(spark, sf):
    side = lambda h: h.tables.objects.join(h.tables.classes, "class_id").groupBy(F.col("name").alias("class")).agg(F.count("*").alias("instances"), F.sum("shallow").alias("shallow"))
    return contents.changes(side(heap(spark, sf, until=_UNTIL)), side(heap(spark, sf)), ["class"], ["instances", "shallow"])


# Scalar functions


@query("""with t as (select user_id, event_type from events), r as (select distinct case user_id % 6 when 0 then 'java/lang/' || event_type when 1 then '[I' when 2 then '[[J' when 3 then '[Ljava/util/' || event_type || ';' when 4 then '[Q' else event_type end raw from t)
select raw, case when raw = '[I' then 'int[]' when raw = '[[J' then 'long[][]' when raw = '[Q' then '?[]' when raw like '[L%' then replace(raw[3:-2], '/', '.') || '[]' else replace(raw, '/', '.') end pretty,
 case when raw = '[I' then 'int' when raw like '[%' then 'object' end element, case when raw like 'java/%' then 'java.lang' else '' end package from r""")
def class_names(spark, sf):
    u, t = F.col("user_id") % 6, F.col("event_type")
    raw = F.when(u == 0, F.concat(F.lit("java/lang/"), t)).when(u == 1, "[I").when(u == 2, "[[J").when(u == 3, F.concat(F.lit("[Ljava/util/"), t, F.lit(";"))).when(u == 4, "[Q").otherwise(t)
    p = X.pretty_class_name(F.col("raw"))
    return read(spark, sf, "events").select(raw.alias("raw")).distinct().select("raw", p.alias("pretty"), X.array_element_type(p).alias("element"), X.package_of(p).alias("package"))


@query("""select o_orderkey, case when n >= 1048576 then printf('%.1fMB', n / 1048576.0) when n >= 1024 then printf('%.1fKB', n / 1024.0) else n || 'B' end human, printf('%,d', n) commas
from (select o_orderkey, (o_orderkey * o_orderkey % 5000011)::bigint n from orders)""")
def human_sizes(spark, sf):
    n = (F.col("o_orderkey") * F.col("o_orderkey") % 5000011).cast("long")
    return read(spark, sf, "orders").select("o_orderkey", X.human_bytes(n).alias("human"), X.commas(n).alias("commas"))


@query("""select doc_id, replace(replace(replace(left(text, 80), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || case when length(text) > 80 then '…' else '' end preview from documents""")
def text_previews(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.preview(F.col("text"), 80).alias("preview"))


# Roots, references, threads, ancestry


@query("select 'system class' kind, count(*) records, count(distinct r_regionkey) objects from region")
def root_kinds(spark, sf):
    return fields.root_kinds(heap(spark, sf).tables.roots)


@query("select 'weak' ref_kind, count(*) refs, count(distinct s_suppkey) referents, 'trade.Supplier:' || count(*) top_classes from supplier")
def references_by_kind(spark, sf):
    h = heap(spark, sf, weak_suppliers=True)
    return fields.references_by_kind(h.tables, h.live)


@query(f"""with recursive {TREE} select n_regionkey::bigint thread_serial, count(*) locals, 0::bigint pinned from nation group by n_regionkey""")
def stack_locals(spark, sf):
    h = heap(spark, sf)
    frames = read(spark, sf, "nation").select(relational.ident(2, F.col("n_nationkey")).alias("obj"), F.lit("Java frame").alias("kind"), F.col("n_regionkey").cast("long").alias("thread_serial"))
    return fields.stack_locals(h.tables, frames.union(frames), h.sizes)


@query(f"select {SCALE} + n_regionkey src, min({2 * SCALE} + n_nationkey) dst from nation group by n_regionkey")
def first_fields(spark, sf):
    return fields.field(heap(spark, sf).tables.edges, "nations")


@query("""with recursive c as (select p_partkey class_id, case when p_partkey > 1 then p_partkey // 3 end super_id from part), a as (select class_id, class_id ancestor, 0 depth from c
 union all select a.class_id, super_id, depth + 1 from a join c on c.class_id = a.ancestor where super_id is not null and super_id > 0) select class_id, ancestor, depth from a""")
def class_ancestors(spark, sf):
    up = F.floor(F.col("p_partkey") / 3).cast("long")
    return fields.ancestors(read(spark, sf, "part").select(F.col("p_partkey").alias("class_id"), F.when((F.col("p_partkey") > 1) & (up > 0), up).alias("super_id")))


@query()
def report_json(spark, sf):
    from .plans.report import View, as_json

    return spark.createDataFrame([(as_json(heap(spark, sf), View()),)], "report string")


# Closer looks


@query(f"with recursive {TREE} select obj, coalesce(retained, 0)::bigint retained from oc left join ret using (obj) where name = 'trade.Customer' order by 2 desc, 1 limit 50")
def instances_by_retained(spark, sf):
    h = heap(spark, sf)
    return views.instances_by_retained(h.tables, h.sizes, "trade.Customer", 50)


@query(f"with recursive {TREE}, x as (select src, min(label) label from e where dst = {7 * SCALE} + 1 group by src) select src, label, null::bigint elem, retained from x join ret on ret.obj = src order by retained desc, src limit 10")
def referrer_objects(spark, sf):
    h = heap(spark, sf)
    return views.referrer_objects(h.tables, h.sizes, 7 * SCALE + 1, 10)


@query(f"""with recursive {TREE}, part_ as (select {SCALE} + 1 obj, 0::bigint idom, 0 "level" union all select d.obj, d.idom, "level" + 1 from part_ join d on d.idom = part_.obj where "level" < 3),
x as (select *, "level" = 0 or "level" < 3 and retained >= 5000 shown from part_ join ret using (obj)),
hid as (select idom obj, count(*) hidden, sum(retained)::bigint hidden_bytes from x where not shown group by idom)
select obj, case when "level" = 0 then 0 else idom end idom, "level", retained, coalesce(hidden, 0)::bigint hidden, coalesce(hidden_bytes, 0)::bigint hidden_bytes from x left join hid using (obj) where shown""")
def dominator_part(spark, sf):
    return views.tree_part(heap(spark, sf).tree, SCALE + 1, 3, 5000)


@query(f"""select {2 * SCALE} + n_nationkey target, 'geo.Region .nations geo.Nation' as "key" from nation union all select {3 * SCALE} + c_custkey, 'geo.Region .nations geo.Nation .customers trade.Customer' from customer""")
def path_keys(spark, sf):
    h = heap(spark, sf)
    targets = h.tables.objects.where("class_id in (2, 3)").select("obj")
    return views.path_keys(h.tables, h.paths(targets))


@query(f"""with x as (select c_custkey k, c_nationkey, count(o_orderkey) filled, (1000 + c_custkey % 50)::bigint capacity from customer left join orders on o_custkey = c_custkey group by all)
select {3 * SCALE} + k obj, filled, capacity, ((capacity - filled) * 8)::bigint wasted from x where capacity >= 1024 and 2 * filled < capacity and c_nationkey % 3 != 0""")
def sparse_arrays(spark, sf):
    """Customers as arrays of their orders, with more slots; every third nation is a collection."""
    h = heap(spark, sf)
    key = F.col("obj") % SCALE
    arrays = h.tables.objects.where("class_id = 3").withColumn("kind", F.lit("object_array")).withColumn("len", 1000 + key % 50)
    edges = h.tables.edges.where("label = 'orders'").withColumn("elem", F.col("ord"))
    return views.sparse_arrays(replace(h.tables, objects=arrays, edges=edges), h.sizes, h.tables.objects.where((F.col("class_id") == 2) & (key % 3 == 0)))


@query("select doc_id obj from documents where text is not null and doc_id % 2 = 1 and doc_id % 5 != 0 and ((strlen(text) + 16 + 7) // 8) * 8 >= 32")
def hashable_arrays(spark, sf):
    """Documents as byte arrays; strings own those of even ids, and every fifth isn't reached."""
    h, s = heap(spark, sf), strings(spark, sf).where("text is not null")
    arrays = s.select("obj", F.lit("primitive_array").alias("kind"), (F.col("bytes") - 24).alias("shallow"))
    return views.hashable_arrays(replace(h.tables, objects=arrays), s.where("obj % 5 != 0").select("obj"), s.where("obj % 2 = 0").select("array"))


@query("""with b as (select s_suppkey k, s_nationkey * 1024 capacity, s_suppkey % 4 = 0 v, s_suppkey % 3 = 0 m from supplier)
select count(*) filter (v) views, count(*) filter (not v) buffers, coalesce(sum(capacity) filter (not v), 0)::bigint capacity, count(*) filter (not v and m) mapped, coalesce(sum(capacity) filter (not v and m), 0)::bigint mapped_bytes from b""")
def direct_buffers(spark, sf):
    """Suppliers as buffers: every fourth is a view, every third a mapped file."""
    b = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("obj"), (F.col("s_nationkey") * 1024).cast("long").alias("capacity"))
    edges = b.where("obj % 4 = 0").select(F.col("obj").alias("src"), F.lit("att").alias("label")).union(b.where("obj % 3 = 0").select("obj", F.lit("fd")))
    return views.direct_totals(views.direct_buffers(b, edges))


@query("""select p_partkey id, case when p_partkey % 11 = 0 then '?' else 'goods.' || p_size end || '.' || p_name || case when p_partkey % 7 = 0 then '' else '(' || p_brand ||
 case p_partkey % 4 when 0 then ':' || p_size when 1 then ' compiled' when 2 then ' native' else '' end || ')' end as text from part""")
def stack_frames(spark, sf):
    """Parts as frames: classes by size, of which some are unknown, methods by name, sources by brand."""
    part = read(spark, sf, "part")
    k = F.col("p_partkey").cast("long")
    rows = part.select(k.alias("id"), k.alias("method_sym"), F.when(k % 7 != 0, SCALE + k).alias("source_sym"), F.when(k % 11 != 0, F.col("p_size")).cast("long").alias("class_serial"), F.when(k % 4 == 0, F.col("p_size")).when(k % 4 == 1, -2).when(k % 4 == 2, -3).otherwise(0).alias("line"))
    symbols = part.select(k.alias("id"), F.col("p_name").alias("text")).union(part.select(SCALE + k, "p_brand"))
    classes = part.select(F.col("p_size").cast("long").alias("serial"), F.concat(F.lit("goods."), F.col("p_size").cast("string")).alias("name")).distinct()
    return views.frames(rows, symbols, classes)


@query("""with x as (select o_orderkey, o_orderkey::bigint n from orders) select o_orderkey, case when n between 1 and 2047 then n end id from x""")
def parsed_ids(spark, sf):
    """Keys in all spellings; beyond 2047 what is no id."""
    n = F.col("o_orderkey").cast("long")
    hexed = F.lower(F.hex(n))
    good = F.when(n % 4 == 0, n.cast("string")).when(n % 4 == 1, F.concat(F.lit(" 0x00"), hexed)).when(n % 4 == 2, F.concat(F.lit("@0X"), hexed, F.lit(" "))).otherwise(F.concat(F.lit("@@"), n.cast("string")))
    bad = F.when(n % 4 == 0, F.concat(F.lit("0x"), F.repeat(F.lit("f"), 17))).when(n % 4 == 1, "0").when(n % 4 == 2, F.concat(F.lit("-"), n.cast("string"))).otherwise("18446744073709551616")
    return read(spark, sf, "orders").select("o_orderkey", X.parse_id(F.when(n < 2048, good).otherwise(bad)).alias("id"))


@query("""with x as (select o_orderkey, (o_orderkey * 250 * (o_orderkey % 40))::bigint ms, (o_orderkey - 5000)::bigint d from orders), y as (select *, (ms + 500) // 1000 s from x)
select o_orderkey, case when ms < 1000 then ms || 'ms' when ms < 60000 then printf('%.1fs', ms / 1000.0) when s < 3600 then printf('%dm%02ds', s // 60, s % 60) else printf('%dh%02dm%02ds', s // 3600, s // 60 % 60, s % 60) end took,
 case when d < 0 then '-' else '+' end || printf('%,d', abs(d)) change from y""")
def durations(spark, sf):
    n = F.col("o_orderkey").cast("long")
    return read(spark, sf, "orders").select("o_orderkey", X.duration(n * 250 * (n % 40)).alias("took"), X.signed_count(n - 5000).alias("change"))


@query("""select distinct case when user_id % 3 = 0 then '[]' when user_id % 3 = 1 then 'static Log.' || event_type else '.' || event_type end edge, case when user_id % 2 = 0 then 'class app.Log' else 'app.Log' end what from events""")
def edge_texts(spark, sf):
    u = F.col("user_id")
    edge = X.edge_text(F.col("event_type"), F.when(u % 3 == 0, u), F.when(u % 3 == 1, "app.Log"))
    return read(spark, sf, "events").select(edge.alias("edge"), X.kind_text(F.when(u % 2 == 0, "class").otherwise("instance"), F.lit("app.Log")).alias("what")).distinct()


@query(ORACLES["baseline_classes"] + " order by abs(shallow_change) desc, abs(instances_change) desc, class limit 2")
def baseline_ranked(spark, sf):
    return views.ranked_changes(baseline_classes(spark, sf), "class", ["shallow", "instances"], 2)
