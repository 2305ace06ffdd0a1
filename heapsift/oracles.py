"""The graph of the relational adapter in SQL, where its dominators have a closed form, as common table expressions for the oracles."""

from __future__ import annotations

from .sources.relational import CLASSES, SCALE, shallow

_ITEMS = f"""
li as materialized (select {6 * SCALE} + l_orderkey * 10000 + l_linenumber * 100 + row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as obj,
 {5 * SCALE} + l_orderkey as ord, {4 * SCALE} + l_suppkey as sup, {7 * SCALE} + l_partkey as prt from lineitem)"""
_NAMES = " union all ".join(f"select {k} cls, '{name}' as name, {shallow(k)}::bigint shallow, {loader} loader" for k, (name, loader, _) in CLASSES.items())

#: names, li, o (obj, cls), oc (obj, name, shallow, loader), e (src, ord, dst, label).
TABLES = f"""
names as ({_NAMES}),{_ITEMS},
o as (select {SCALE} + r_regionkey obj, 1 cls from region union all select {2 * SCALE} + n_nationkey, 2 from nation union all select {3 * SCALE} + c_custkey, 3 from customer
 union all select {4 * SCALE} + s_suppkey, 4 from supplier union all select {5 * SCALE} + o_orderkey, 5 from orders union all select obj, 6 from li union all select {7 * SCALE} + p_partkey, 7 from part),
oc as materialized (select obj, name, shallow, loader, cls from o join names using (cls)),
e as materialized (select {SCALE} + n_regionkey src, n_nationkey::bigint ord, {2 * SCALE} + n_nationkey dst, 'nations' label from nation
 union all select {2 * SCALE} + c_nationkey, c_custkey, {3 * SCALE} + c_custkey, 'customers' from customer
 union all select {2 * SCALE} + s_nationkey, {SCALE} + s_suppkey, {4 * SCALE} + s_suppkey, 'suppliers' from supplier
 union all select {3 * SCALE} + o_custkey, o_orderkey, {5 * SCALE} + o_orderkey, 'orders' from orders
 union all select ord, obj, obj, 'items' from li union all select sup, obj, obj, 'items' from li union all select obj, 0, prt, 'part' from li)"""

#: TABLES, and d (obj, idom; 0 is the virtual root) of reached objects, up (obj, anc): each object with itself and its dominators, ret (obj, retained).
TREE = (
    TABLES
    + f""",
lx as materialized (select li.*, {3 * SCALE} + o_custkey cus, {2 * SCALE} + c_nationkey cn, {2 * SCALE} + s_nationkey sn, {SCALE} + a.n_regionkey cr, {SCALE} + b.n_regionkey sr
 from li join orders on {5 * SCALE} + o_orderkey = ord join customer on c_custkey = o_custkey join supplier on {4 * SCALE} + s_suppkey = sup
 join nation a on a.n_nationkey = c_nationkey join nation b on b.n_nationkey = s_nationkey),
ld as materialized (select *, case when cn = sn then cn when cr = sr then cr else 0 end idom, case when cn = sn then cn else 0 end dn, case when cr = sr then cr else 0 end dr from lx),
d as materialized (select {SCALE} + r_regionkey obj, 0::bigint idom from region union all select {2 * SCALE} + n_nationkey, {SCALE} + n_regionkey from nation
 union all select {3 * SCALE} + c_custkey, {2 * SCALE} + c_nationkey from customer union all select {4 * SCALE} + s_suppkey, {2 * SCALE} + s_nationkey from supplier
 union all select {5 * SCALE} + o_orderkey, {3 * SCALE} + o_custkey from orders union all select obj, idom from ld
 union all select prt, case when count(*) = 1 then max(obj) when min(dn) = max(dn) and max(dn) > 0 then max(dn) when min(dr) = max(dr) then max(dr) else 0 end from ld group by prt),
up as (select obj, obj anc from d union all select up.obj, d.idom from up join d on d.obj = up.anc where d.idom != 0),
ret as materialized (select anc obj, sum(shallow)::bigint retained from up join oc on oc.obj = up.obj group by anc)"""
)


def grouped(label: str, of: str) -> str:
    """SQL of a histogram by an expression over oc."""
    return f"""with recursive {TREE},
g as materialized (select obj, shallow, {of} grp from oc),
pairs as materialized (select up.obj, up.anc, g.grp from up join g using (obj) where up.obj != up.anc),
inner_ as materialized (select distinct p.obj from pairs p join g y on y.obj = p.anc and y.grp = p.grp),
h as (select grp, sum(retained)::bigint retained from g join ret using (obj) anti join inner_ using (obj) group by grp)
select g.grp {label}, count(*) instances, sum(shallow)::bigint shallow, coalesce(max(retained), 0)::bigint retained from g left join h on h.grp = g.grp group by g.grp"""
