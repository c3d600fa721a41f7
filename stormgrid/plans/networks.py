"""Clusters, neighbour graphs, paths, components, centralities, attacks and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.operators import centrality as E
from stormgrid.operators import delaunay as V
from stormgrid.operators import networks as N
from stormgrid.operators import regions as Q
from stormgrid.operators import removal as R
from stormgrid.operators import sites as X
from stormgrid.operators import spatial as S
from stormgrid.operators import windows as W
from stormgrid.operators.disks import disk_sums
from stormgrid.operators.filters import by
from stormgrid.operators.spectrum import algebraic_connectivity
from stormgrid.plans.registry import Tables, query
from stormgrid.plans.scalars import _HAV, _OVERLAP

HAV = _HAV.format

_BOTH = "both_ways as (select graph_id, src, dst, weight from fx_edges union all select graph_id, dst, src, weight from fx_edges)"


def _paths(w: str) -> str:
    """Shortest distances between different nodes (dist); a distance that improves replaces the known one."""
    return f"""with recursive {_BOTH}, bw as (select src, dst, {w} as w from both_ways),
dist(src, dst, d) using key (src, dst) as (select src, dst, min(w) from bw group by 1, 2 union select q.src, q.dst, q.d
  from (select x.src, b.dst, min(x.d + b.w) as d from dist x join bw b on b.src = x.dst where x.src <> b.dst group by 1, 2) q left join recurring.dist r on r.src = q.src and r.dst = q.dst where r.d is null or q.d < r.d),
hops as (select n.graph_id, src, dst, d from dist join fx_nodes n on n.node_id = src)"""


# Whole tenths, so that equal lengths are equal numbers.
_TENTHS = "round(weight * 10)::bigint"
_HOPS, _LONG = _paths("1"), _paths(_TENTHS)

# Numbers of shortest paths by their number of edges, then shares of pairs s, t that pass v.
_BETWEEN = """, dd as (select src, dst, d from hops union all select node_id, node_id, 0 from fx_nodes),
cnt(src, dst, k, c) as (select node_id, node_id, 0, 1.0::double from fx_nodes union all
  select x.src, b.dst, x.k + 1, sum(x.c) from cnt x join bw b on b.src = x.dst join dd p on p.src = x.src and p.dst = x.dst join dd q on q.src = x.src and q.dst = b.dst where p.d + b.w = q.d group by 1, 2, 3),
sig as (select x.src, x.dst, d, sum(c) as c from cnt x join dd using (src, dst) where x.src <> x.dst group by 1, 2, 3),
raw as (select a.dst as node_id, sum(a.c * b.c / c.c) as raw from sig a join sig b on a.dst = b.src join sig c on c.src = a.src and c.dst = b.dst where a.src <> b.dst and a.d + b.d = c.d group by 1),
size as (select graph_id, count(*) as n from fx_nodes group by 1),
betw as (select n.graph_id, n.node_id, case when s.n > 2 then coalesce(raw, 0) / ((s.n - 1) * (s.n - 2)) else 0 end as betweenness from fx_nodes n join size s using (graph_id) left join raw using (node_id))"""

# Cube roots of the weights of each node's triangles, over the largest weight of the graph.
_TRIANGLES = """tw as (select graph_id, src, dst, weight / max(weight) over (partition by graph_id) as x from both_ways), dg as (select src as node_id, count(*) as k from both_ways group by 1),
tri as (select a.src as node_id, sum(cbrt(a.x * b.x * c.x)) as t from tw a join tw b on a.src = b.src and a.dst < b.dst join tw c on c.src = a.dst and c.dst = b.dst group by 1),
wcl as (select n.graph_id, n.node_id, case when k > 1 then coalesce(t, 0) / (k * (k - 1) / 2.0) else 0 end as clustering, coalesce(k, 0) as degree from fx_nodes n left join dg using (node_id) left join tri using (node_id))"""
_PARTS = """reach0 as (select node_id as a, node_id as b from fx_nodes union select src, dst from hops), roots as (select n.graph_id, n.node_id, min(b) as root from fx_nodes n join reach0 on a = node_id group by 1, 2),
parts as (select graph_id, count(distinct root) as n_components from roots group by 1)"""


# Station by station in their order, with the list of the kept ones of each state.
@query("g01_cluster_radius", f"""with recursive seq as materialized (select *, row_number() over (partition by state order by station_id) as k from fx_stations),
near as materialized (select a.state, a.station_id as a, b.station_id as b from seq a join seq b on a.state = b.state and a.station_id < b.station_id and abs(a.lat - b.lat) < 0.1 and {HAV(a='a.', b='b.')} <= 5), ties as materialized (select b, list(a) as earlier from near group by 1),
g(state, k, kept) as (select distinct state, 0::bigint, []::bigint[] from seq union all select g.state, g.k + 1, case when coalesce(len(list_intersect(kept, earlier)), 0) = 0 then list_append(kept, station_id) else kept end from g join seq on seq.state = g.state and seq.k = g.k + 1 left join ties on b = station_id),
heads as materialized (select state, unnest(arg_max(kept, k)) as head from g group by 1), owners as (select b, min(a) as owner from near join heads on head = a group by 1)
select s.state, coalesce(head, owner) as owner, avg(lat) as lat, avg(lon) as lon, sum(5 * n_l1 + 25 * n_l2 + 300 * n_dc) as capacity, count(*) as n_stations from fx_stations s left join heads on head = station_id left join owners on b = station_id group by 1, 2""", "lat lon capacity")
def g01(t: Tables):
    points = t.fx_stations.withColumnRenamed("station_id", "ord")
    return N.cluster_radius(points, 5.0).select("state", "owner", "lat", "lon", "capacity", "n_stations")


def plane(t: Tables):
    x, y = C.mercator_m(F.col("lat"), F.col("lon"))
    return t.fx_nodes.select("graph_id", "node_id", (x / 1000).alias("x"), (y / 1000).alias("y"))


@query("g02_voronoi_edges", """with p as (select graph_id, node_id, radians(lon) * 6378.137 as x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378.137 as y from fx_nodes),
c as (select graph_id, count(*) as n from p group by 1),
s as (select p.graph_id, p.node_id as src, q.node_id as dst, (p.x - r.x) * (q.x - r.x) + (p.y - r.y) * (q.y - r.y) as d, (p.x - r.x) * (q.y - r.y) - (p.y - r.y) * (q.x - r.x) as k
  from p join p q on p.graph_id = q.graph_id and p.node_id < q.node_id left join p r on r.graph_id = p.graph_id and r.node_id <> p.node_id and r.node_id <> q.node_id),
m as (select graph_id, src, dst, min(case when k > 0 then d / k end) as l, min(case when k < 0 then -d / k end) as r from s group by 1, 2, 3)
select graph_id, src, dst from m join c using (graph_id) where n < 4 or l is null or r is null or l + r > 1e-12""")
def g02(t: Tables):
    return V.voronoi_edges(plane(t))


@query("g02_states", """with p as (select split_part(graph_id, '_', 1) as graph_id, node_id, radians(lon) * 6378.137 as x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378.137 as y from fx_nodes where node_id % 2 = 0),
s as (select p.graph_id, p.node_id as src, q.node_id as dst, (p.x - r.x) * (q.x - r.x) + (p.y - r.y) * (q.y - r.y) as d, (p.x - r.x) * (q.y - r.y) - (p.y - r.y) * (q.x - r.x) as k
  from p join p q on p.graph_id = q.graph_id and p.node_id < q.node_id left join p r on r.graph_id = p.graph_id and r.node_id <> p.node_id and r.node_id <> q.node_id),
m as (select graph_id, src, dst, min(case when k > 0 then d / k end) as l, min(case when k < 0 then -d / k end) as r from s group by 1, 2, 3)
select graph_id, src, dst from m where l is null or r is null or l + r > 1e-12""")
def g02_states(t: Tables):
    """The same for whole states, by near witnesses."""
    nodes = plane(t).where("node_id % 2 = 0").withColumn("graph_id", F.split_part("graph_id", F.lit("_"), F.lit(1)))
    return V.voronoi_edges(nodes, small=16)


@query("g03_edge_weights", f"with m as (select a.graph_id, max({HAV(a='a.', b='b.')}) as d_max from fx_nodes a join fx_nodes b on a.graph_id = b.graph_id and a.node_id < b.node_id group by 1) select e.graph_id, src, dst, {HAV(a='a.', b='b.')} as km, {HAV(a='a.', b='b.')} / d_max as weight from fx_edges e join fx_nodes a on a.node_id = e.src join fx_nodes b on b.node_id = e.dst join m on m.graph_id = e.graph_id", "km weight")
def g03(t: Tables):
    return N.edge_weights(t.fx_edges, t.fx_nodes)


_XY = "p as (select graph_id, node_id, capacity, radians(lon) * 6378.137 as x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378.137 as y from fx_nodes), m as (select a.graph_id, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as d, max(a.capacity) as c from p a join p b on a.graph_id = b.graph_id group by 1), w as (select e.graph_id, src, dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as km, case when a.capacity > 0 then a.capacity / c else 1 end * case when b.capacity > 0 then b.capacity / c else 1 end as cc, d from fx_edges e join p a on a.node_id = src join p b on b.node_id = dst join m on m.graph_id = e.graph_id)"


@query("g03_planar_weights", f"with {_XY} select graph_id, src, dst, km, km / d as weight from w", "km weight")
def g03_planar(t: Tables):
    return X.edge_weights_planar(t.fx_edges, t.fx_nodes)


@query("g03_capacity_weights", f"with {_XY} select graph_id, src, dst, km, (km / d + 1e-6) / sqrt(cc) as weight from w", "km weight")
def g03_capacity(t: Tables):
    return X.edge_weights_planar(t.fx_edges, t.fx_nodes, "capacity")


@query("g04_shortest_paths", f"{_HOPS} select graph_id, src, dst, d::double as d from hops", "d")
def g04(t: Tables):
    return N.shortest_paths(t.fx_edges)


@query("g04_weighted_paths", f"{_LONG} select graph_id, src, dst, d / 10.0 as d from hops", "d")
def g04w(t: Tables):
    return N.shortest_paths(t.fx_edges, "weight")


_EFFICIENCY = "select n.graph_id, n.n, case when n.n > 1 then coalesce(s, 0) / (n.n * (n.n - 1)) else 0 end as efficiency from (select graph_id, count(*) as n from fx_nodes group by 1) n left join (select graph_id, sum({}) as s from hops group by 1) h using (graph_id)"


@query("g05_global_efficiency", f"{_HOPS} {_EFFICIENCY.format('1.0 / d')}", "efficiency")
def g05(t: Tables):
    return N.global_efficiency(t.fx_nodes, t.fx_edges)


@query("g05_weighted_efficiency", f"{_LONG} {_EFFICIENCY.format('10.0 / d')}", "efficiency")
def g05w(t: Tables):
    return N.global_efficiency(t.fx_nodes, t.fx_edges, "weight")


def grouped(t: Tables):
    """Nodes with the state of their graph."""
    return t.fx_nodes.withColumn("group", F.split_part("graph_id", F.lit("_"), F.lit(1)))


def state_events(t: Tables):
    return t.fx_epicenters.select(F.col("event_id").alias("case_id"), F.col("graph_id").alias("group"), "lat", "lon", "radius_km")


def _variants(gone: str, w: str = "1", hours: str = "") -> str:
    """For each set of removed nodes (gone: graph_id, vid, node_id) the efficiency and largest component of what is left, by a whole search."""
    return f"""with recursive {_BOTH}, gone as materialized ({gone}), vid as materialized (select distinct graph_id, vid from gone),
live as materialized (select vid, n.graph_id, n.node_id, n.capacity from vid join fx_nodes n using (graph_id) where not exists (select 1 from gone g where g.vid = vid.vid and g.graph_id = n.graph_id and g.node_id = n.node_id)),
bw as materialized (select a.vid, src, dst, {w} as w from both_ways join live a on a.node_id = src join live b on b.node_id = dst and a.vid = b.vid and a.graph_id = b.graph_id),
dist(vid, src, dst, d) using key (vid, src, dst) as (select vid, src, dst, min(w) from bw group by 1, 2, 3 union select q.vid, q.src, q.dst, q.d
  from (select x.vid, x.src, b.dst, min(x.d + b.w) as d from dist x join bw b on b.src = x.dst and b.vid = x.vid where x.src <> b.dst group by 1, 2, 3) q left join recurring.dist r on r.vid = q.vid and r.src = q.src and r.dst = q.dst where r.d is null or q.d < r.d),
zero as (select graph_id, '' as vid, src, dst, {w} as w from both_ways),
dist0(src, dst, d) using key (src, dst) as (select src, dst, min(w) from zero group by 1, 2 union select q.src, q.dst, q.d
  from (select x.src, b.dst, min(x.d + b.w) as d from dist0 x join zero b on b.src = x.dst where x.src <> b.dst group by 1, 2) q left join recurring.dist0 r on r.src = q.src and r.dst = q.dst where r.d is null or q.d < r.d),
base as materialized (select n.graph_id, n.n, case when n.n > 1 then coalesce(s, 0) / (n.n * (n.n - 1)) else 0 end as before from (select graph_id, count(*) as n from fx_nodes group by 1) n
  left join (select graph_id, sum(1.0 / d) as s from dist0 join fx_nodes on node_id = src group by 1) q using (graph_id)),
own as (select l.vid, l.graph_id, l.node_id, coalesce(sum(1.0 / d), 0) as s, count(d) as r from live l left join dist x on x.vid = l.vid and x.src = l.node_id group by 1, 2, 3),
eff as materialized (select vid, graph_id, sum(s) / nullif(count(*) * (count(*) - 1), 0) as after, max(r) + 1 as largest from own group by 1, 2),
cap as materialized (select g.vid, g.graph_id, count(*) as n_removed, sum(capacity) as capacity_removed from gone g join fx_nodes using (graph_id, node_id) group by 1, 2),
lost as materialized (select v.vid, v.graph_id, greatest(0, before - coalesce(after, 0)) as loss, case when before > 0 then greatest(0, before - coalesce(after, 0)) / before else 0 end as relative, coalesce(largest, 0) / n as lcc, n_removed, capacity_removed
  from vid v join base using (graph_id) left join eff e on e.vid = v.vid and e.graph_id = v.graph_id left join cap c on c.vid = v.vid and c.graph_id = v.graph_id)"""


_STATE = "split_part({}graph_id, '_', 1)"
_HIT = f"hit as materialized (select n.graph_id, e.event_id as case_id, n.node_id from fx_epicenters e join fx_nodes n on {_STATE.format('n.')} = e.graph_id and abs(n.lat - e.lat) < 1 and {HAV(a='e.', b='n.')} <= e.radius_km), named as materialized (select graph_id, case_id, string_agg(node_id, ',' order by node_id) as vid from hit group by 1, 2)"
_HIT_SETS = "select distinct h.graph_id, s.vid, h.node_id from hit h join named s on s.graph_id = h.graph_id and s.case_id = h.case_id"


@query("g06_outage_loss", _variants(_HIT_SETS).replace("with recursive", f"with recursive {_HIT},", 1) + f"""
select g.graph_id, e.event_id as case_id, coalesce(loss, 0) as loss, coalesce(relative, 0) as relative, coalesce(lcc, 1) as lcc, coalesce(n_removed, 0) as n_removed, coalesce(capacity_removed, 0) as capacity_removed
from (select distinct graph_id from fx_nodes) g join fx_epicenters e on {_STATE.format('g.')} = e.graph_id left join named s on s.graph_id = g.graph_id and s.case_id = e.event_id left join lost l on l.graph_id = s.graph_id and l.vid = s.vid""", "loss relative lcc capacity_removed", 5)
def g06(t: Tables):
    out = R.event_loss(grouped(t), t.fx_edges, state_events(t))
    return out.select("graph_id", "case_id", "loss", "relative", "lcc", "n_removed", "capacity_removed")


@query("g07_components", "with recursive b as (select graph_id, src, dst from fx_edges union all select graph_id, dst, src from fx_edges), r(graph_id, node_id, root) as (select graph_id, node_id, node_id from fx_nodes union select r.graph_id, b.dst, r.root from r join b on b.src = r.node_id), m as (select graph_id, node_id, min(root) as root from r group by 1, 2), s as (select graph_id, root, count(*) as size from m group by 1, 2) select graph_id, count(*) as n_components, max(size)::bigint as largest, sum(size)::bigint as n, max(size) / sum(size) as lcc from s group by 1", "lcc")
def g07(t: Tables):
    return N.largest_share(t.fx_nodes, t.fx_edges)


@query("g08_degree", "with e as (select src as node_id from fx_edges union all select dst from fx_edges) select graph_id, n.node_id, count(e.node_id) as degree from fx_nodes n left join e using (node_id) group by 1, 2")
def g08d(t: Tables):
    return N.degree(t.fx_nodes, t.fx_edges)


_CLOSENESS = ", s as (select graph_id, src as node_id, sum(d{0}) as s, count(*) as c from hops group by 1, 2), n as (select graph_id, count(*) as n from fx_nodes group by 1) select f.graph_id, f.node_id, case when s > 0 then c / s * c / (n - 1) else 0 end as closeness from fx_nodes f join n using (graph_id) left join s on s.node_id = f.node_id"


@query("g08_closeness", _HOPS + _CLOSENESS.format(""), "closeness")
def g08c(t: Tables):
    return N.closeness(t.fx_nodes, t.fx_edges)


@query("g08_weighted_closeness", _LONG + _CLOSENESS.format(" / 10.0"), "closeness")
def g08cw(t: Tables):
    return N.closeness(t.fx_nodes, t.fx_edges, "weight")


@query("g08_betweenness", f"{_HOPS}{_BETWEEN} select * from betw", "betweenness")
def g08b(t: Tables):
    return E.betweenness(t.fx_nodes, t.fx_edges)


@query("g08_weighted_betweenness", f"{_LONG}{_BETWEEN} select * from betw", "betweenness")
def g08bw(t: Tables):
    return E.betweenness(t.fx_nodes, t.fx_edges, "weight")


@query("g09_attack_order", "select graph_id, node_id, row_number() over (partition by graph_id order by capacity desc, node_id) as place from fx_nodes")
def g09(t: Tables):
    return N.attack_order(t.fx_nodes, F.col("capacity")).select("graph_id", "node_id", F.col("place").cast("long").alias("place"))


LEVELS = [0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8]
REPLICATES = 10
_ORDERS = f"""dg as (select n.graph_id, n.node_id, count(b.src) as k from fx_nodes n left join both_ways b on b.src = n.node_id group by 1, 2),
orders as materialized (select graph_id, 'capacity' as strategy, 0 as replicate, node_id, row_number() over (partition by graph_id order by capacity desc, node_id) as place from fx_nodes
  union all select graph_id, 'degree', 0, node_id, row_number() over (partition by graph_id order by k desc, node_id) from dg
  union all select graph_id, 'random', r::int, node_id, row_number() over (partition by graph_id, r order by cast('0x' || substr(md5(concat_ws('|', 'attack', graph_id, r, node_id)), 1, 8) as bigint), node_id) from fx_nodes, range({REPLICATES}) q(r)),
sized as (select *, count(*) over (partition by graph_id, strategy, replicate) as n from orders),
taken as materialized (select graph_id, strategy, replicate, pct, n, greatest(1, round_even(n * pct, 0)::int) as k, node_id from sized, (select unnest({LEVELS}) as pct) p where place <= greatest(1, round_even(n * pct, 0)::int)),
named as materialized (select graph_id, strategy, replicate, pct, any_value(n) as n, any_value(k) as k, string_agg(node_id, ',' order by node_id) as vid from taken group by 1, 2, 3, 4)"""
_ORDER_SETS = "select distinct t.graph_id, s.vid, t.node_id from taken t join named s using (graph_id, strategy, replicate, pct)"


@query("g10_attack_curve", _variants(_ORDER_SETS, "round(weight * 10)::bigint").replace(f"{_BOTH},", f"{_BOTH}, {_ORDERS},", 1) + """
select graph_id, strategy, pct, avg(x) as loss_pct, case when count(*) > 1 then stddev_pop(x) end as std, count(*) as n_sims
from (select s.graph_id, strategy, pct, case when k >= n then 100.0 else 100 * relative end as x from named s join lost l on l.graph_id = s.graph_id and l.vid = s.vid) q group by 1, 2, 3""", "pct loss_pct std", 4)
def g10(t: Tables):
    """Seventeen levels of two targeted attacks and of ten random orders, by weighted efficiency."""
    targeted = [
        N.attack_order(E.attack_scores(t.fx_nodes, t.fx_edges, s), F.col("score")).select("graph_id", F.lit(s).alias("strategy"), F.lit(0).alias("replicate"), "node_id", "place")
        for s in ("capacity", "degree")
    ]
    chance = E.random_orders(t.fx_nodes, REPLICATES, "attack").select("graph_id", F.lit("random").alias("strategy"), "replicate", "node_id", "place")
    return R.attack_curve(t.fx_nodes, t.fx_edges, targeted[0].unionByName(targeted[1]).unionByName(chance), LEVELS)


@query("g11_single_node_loss", _variants("select graph_id, node_id::varchar as vid, node_id from fx_nodes") + " select graph_id, vid::bigint as node_id, loss, lcc from lost", "loss lcc")
def g11(t: Tables):
    alone = t.fx_nodes.select("graph_id", F.col("node_id").alias("case_id"), "node_id")
    out = R.removal_loss(t.fx_nodes, t.fx_edges, alone)
    return out.select("graph_id", F.col("case_id").alias("node_id"), "loss", "lcc")


@query("g12_network_characteristics", f"""{_LONG}, {_TRIANGLES}, {_PARTS}, eff as ({_EFFICIENCY.format('10.0 / d')})
select w.graph_id, count(*) as num_nodes, (sum(degree) / 2)::bigint as num_edges, avg(degree) as avg_degree, max(degree) as max_degree, min(degree) as min_degree, any_value(n_components) = 1 as is_connected,
  any_value(n_components) as num_components, avg(clustering) as avg_clustering, any_value(efficiency) as global_efficiency, case when count(*) > 1 then sum(degree) / (count(*) * (count(*) - 1.0)) else 0 end as density
from wcl w join parts using (graph_id) join eff using (graph_id) group by 1""", "avg_degree avg_clustering global_efficiency density")
def g12(t: Tables):
    return E.network_characteristics(t.fx_nodes, t.fx_edges)


@query("g13_weighted_clustering", f"with {_BOTH}, {_TRIANGLES} select graph_id, node_id, clustering from wcl", "clustering")
def g13w(t: Tables):
    return E.weighted_clustering(t.fx_nodes, t.fx_edges)


@query("g13_clustering", f"with {_BOTH}, d as (select src as node_id, count(*) as k from both_ways group by 1), t as (select a.src as node_id, count(*) as t from both_ways a join both_ways b on a.src = b.src and a.dst < b.dst join both_ways c on c.src = a.dst and c.dst = b.dst group by 1) select n.graph_id, n.node_id, case when k > 1 then coalesce(t, 0) / (k * (k - 1) / 2.0) else 0 end as clustering from fx_nodes n left join d using (node_id) left join t using (node_id)", "clustering")
def g13(t: Tables):
    return N.clustering(t.fx_nodes, t.fx_edges)


@query("g14_diameter", f"{_HOPS} select graph_id, max(d)::double as diameter, avg(d) as avg_path from hops group by 1", "diameter avg_path")
def g14(t: Tables):
    return N.diameter(t.fx_edges)


@query("g15_algebraic_connectivity")
def g15(t: Tables):
    return algebraic_connectivity(t.fx_nodes, t.fx_edges).withColumn("lambda2", F.round("lambda2", 4))


_CAPS = "caps as (select graph_id, count(*)::double as n_nodes, sum(capacity) as total_capacity, avg(capacity) as mean_capacity, stddev_pop(capacity) as std_capacity, max(capacity) as max_capacity from fx_nodes group by 1)"


@query("g16_global_features", f"""{_LONG}{_BETWEEN}, {_TRIANGLES}, {_PARTS}, {_CAPS},
hop(src, dst, d) using key (src, dst) as (select src, dst, 1 from bw union select q.src, q.dst, q.d from (select x.src, b.dst, min(x.d + 1) as d from hop x join bw b on b.src = x.dst where x.src <> b.dst group by 1, 2) q left join recurring.hop r on r.src = q.src and r.dst = q.dst where r.d is null or q.d < r.d),
far as (select graph_id, sum(1.0 / d) as reach, max(d)::double as diameter from hop join fx_nodes on node_id = src group by 1),
deg as (select graph_id, sum(degree) / 2.0 as n_edges, avg(degree) as avg_degree, max(degree)::double as max_degree, avg(clustering) as avg_clustering from wcl group by 1), bt as (select graph_id, max(betweenness) as max_betweenness, avg(betweenness) as mean_betweenness from betw group by 1)
select graph_id, n_nodes, n_edges, case when n_nodes > 1 then 2 * n_edges / (n_nodes * (n_nodes - 1)) else 0 end as density, total_capacity, mean_capacity, std_capacity, max_capacity, avg_degree, max_degree, avg_clustering, max_betweenness, mean_betweenness,
  case when n_nodes > 1 then coalesce(reach, 0) / (n_nodes * (n_nodes - 1)) else 0 end as global_efficiency, coalesce(diameter, 0) as diameter, case when n_edges > 0 then n_components::double else 0 end as n_components
from caps join deg using (graph_id) join bt using (graph_id) join parts using (graph_id) left join far using (graph_id)""", " ".join(E.BASE_FEATURES))
def g16(t: Tables):
    return E.global_features(t.fx_nodes, t.fx_edges)


@query("g16_fast_features", f"""with {_CAPS}, {_BOTH}, dg as (select n.graph_id, n.node_id, count(b.src) as k from fx_nodes n left join both_ways b on b.src = n.node_id group by 1, 2), deg as (select graph_id, sum(k) / 2.0 as m, avg(k) as a, max(k)::double as x from dg group by 1)
select graph_id, n_nodes, m as n_edges, case when n_nodes > 1 then 2 * m / (n_nodes * (n_nodes - 1)) else 0 end as density, total_capacity, mean_capacity, std_capacity, max_capacity, a as avg_degree, x as max_degree,
  0.0 as avg_clustering, 0.0 as max_betweenness, 0.0 as mean_betweenness, 0.0 as global_efficiency, 0.0 as diameter, 1.0 as n_components from caps join deg using (graph_id)""", " ".join(E.BASE_FEATURES))
def g16_fast(t: Tables):
    return E.global_features(t.fx_nodes, t.fx_edges, fast=True)


@query("g16_extended_features")
def g16_extended(t: Tables):
    out = E.global_features(t.fx_nodes, t.fx_edges, extended=True)
    return out.select("graph_id", *(F.round(c, 4).alias(c) for c in E.BASE_FEATURES + E.MORE_FEATURES))


_GINI = "case when sum(greatest(c, 0)) > 0 then 2.0 * sum(i * greatest(c, 0)) / (count(*) * sum(greatest(c, 0))) - (count(*) + 1.0) / count(*) else 0 end"


@query("g17_hypernode_features", f"""{_LONG}{_BETWEEN}, dg as (select src as node_id, count(*) as k from both_ways group by 1),
tri as (select a.src as node_id, count(*) as t from both_ways a join both_ways b on a.src = b.src and a.dst < b.dst join both_ways c on c.src = a.dst and c.dst = b.dst group by 1),
near as (select a.node_id, min({HAV(a='a.', b='b.')}) as km from fx_nodes a join fx_nodes b on a.graph_id = b.graph_id and a.node_id <> b.node_id group by 1),
around as (select src as node_id, n.capacity as c, coalesce(k, 0) as k, row_number() over (partition by src order by n.capacity) as i from both_ways join fx_nodes n on n.node_id = dst left join dg on dg.node_id = dst),
means as (select node_id, avg(c) as neighbor_mean_capacity, avg(k) as neighbor_mean_degree, {_GINI} as neighbor_capacity_gini from around group by 1),
whole as (select graph_id, count(*) as graph_n_nodes, avg(c) as graph_mean_capacity, {_GINI} as graph_capacity_gini from (select graph_id, capacity as c, row_number() over (partition by graph_id order by capacity) as i from fx_nodes) q group by 1)
select n.graph_id, n.node_id, n.capacity, coalesce(k, 0) as degree, betweenness, case when k > 1 then coalesce(t, 0) / (k * (k - 1) / 2.0) else 0 end as clustering, km as nearest_neighbor_km, neighbor_mean_capacity, neighbor_mean_degree,
  coalesce(neighbor_capacity_gini, 0) as neighbor_capacity_gini, graph_n_nodes, graph_mean_capacity, graph_capacity_gini
from fx_nodes n join betw using (node_id) left join dg using (node_id) left join tri using (node_id) left join near using (node_id) left join means using (node_id) join whole on whole.graph_id = n.graph_id""",
"capacity betweenness clustering nearest_neighbor_km neighbor_mean_capacity neighbor_mean_degree neighbor_capacity_gini graph_mean_capacity graph_capacity_gini")
def g17(t: Tables):
    return E.hypernode_features(t.fx_nodes, t.fx_edges)


@query("g18_window_members", f"with m as (select w.window_id, count(*) as n from fx_windows w join fx_stations s on abs(s.lat - w.center_lat) < 1 and {HAV(a='w.center_', b='s.')} <= w.radius_km group by 1) select window_id, n from m where n >= 15")
def g18(t: Tables):
    centers = t.fx_windows.select("window_id", F.col("radius_km").alias("radius"), F.col("center_lat").alias("clat"), F.col("center_lon").alias("clon"))
    return disk_sums(t.fx_stations, centers, "window_id").where("n >= 15")


TIERS = [("urban", 10.0, 12), ("suburban", 30.0, 25), ("rural", 80.0, 20)]
_U = "cast('0x' || substr(md5(concat_ws('|', {})), 1, 8) as bigint) / 4294967296.0"
_NODES = "case station_id % 3 when 0 then 'urban' when 1 then 'suburban' else 'rural' end as stratum"
# The greedy pass seed by seed: the accepted ones are a list that grows.
_SEEDS = f"""with recursive tiers(stratum, radius_km, target) as (values {', '.join(map(str, TIERS))}), nodes as materialized (select station_id as node_id, lat, lon, {_NODES} from fx_stations),
pool as materialized (select a.node_id, a.stratum, a.lat, a.lon, radius_km, target, count(*) as n_raw from nodes a join tiers using (stratum) join nodes b on abs(a.lat - b.lat) < 1 and {HAV(a='a.', b='b.')} <= radius_km group by all having count(*) >= 15),
seq as materialized (select *, row_number() over (partition by stratum order by pass, u, node_id) as k from (select *, 1 as pass, 0.5 as share, {_U.format("'spaced-0', node_id")} as u from pool union all select *, 2, 0.35, {_U.format("'spaced-1', node_id")} from pool) q),
g(stratum, k, acc) as (select stratum, 0::bigint, []::struct(node_id bigint, lat double, lon double, n_raw bigint, pass int)[] from tiers
  union all select g.stratum, g.k + 1, case when len(acc) < target and len(list_filter(acc, lambda o: {HAV(a='o.', b='seq.')} <= radius_km * share)) = 0 then list_append(acc, {{'node_id': node_id, 'lat': lat, 'lon': lon, 'n_raw': n_raw, 'pass': pass}}) else acc end from g join seq on seq.stratum = g.stratum and seq.k = g.k + 1),
best as materialized (select stratum, arg_max(acc, k) as acc from g group by 1), chosen as materialized (select stratum, unnest(acc) as s, generate_subscripts(acc, 1) as place from best)"""


def tiers_of(t: Tables):
    return t.spark.createDataFrame(TIERS, "stratum string, radius_km double, target int")


def strata_nodes(t: Tables):
    stratum = F.element_at(F.array(F.lit("urban"), F.lit("suburban"), F.lit("rural")), (F.col("station_id") % 3 + 1).cast("int"))
    return t.fx_stations.select(F.col("station_id").alias("node_id"), "lat", "lon", stratum.alias("stratum"))


@query("g18_spaced_seeds", f"{_SEEDS} select stratum, s.node_id as node_id, s.n_raw as n_raw, s.pass as pass, place::int as place from chosen")
def g18_seeds(t: Tables):
    return W.spaced_seeds(strata_nodes(t), tiers_of(t), "spaced").select("stratum", "node_id", "n_raw", "pass", "place")


@query("g18_random_windows", f"""{_SEEDS}, named as (select format('w_{{}}_{{:05d}}', stratum, place - 1) as window_id, stratum as window_stratum, radius_km, s.node_id as seed_node_id, s.lat as lat, s.lon as lon, s.n_raw as n_raw, s.pass as pass from chosen join tiers using (stratum)),
inside as (select w.*, n.stratum, row_number() over (partition by window_id order by {_U.format("'spaced-member', window_id, n.node_id")}, n.node_id) as k from named w join nodes n on abs(w.lat - n.lat) < 1 and {HAV(a='w.', b='n.')} <= radius_km)
select window_id, window_stratum, radius_km, seed_node_id, n_raw, pass, count(*) as n_nodes, avg((stratum = 'urban')::int) as frac_urban, avg((stratum = 'suburban')::int) as frac_suburban, avg((stratum = 'rural')::int) as frac_rural from inside where k <= 40 group by all""", "frac_urban frac_suburban frac_rural")
def g18_windows(t: Tables):
    windows, _ = W.random_windows(strata_nodes(t), tiers_of(t), "spaced", most=40)
    return windows.select("window_id", "window_stratum", "radius_km", "seed_node_id", "n_raw", "pass", "n_nodes", "frac_urban", "frac_suburban", "frac_rural")


# Window by window in their order, with the list of the kept.
_GREEDY = f"""with recursive seq as materialized (select *, row_number() over (order by ord) as k from fx_windows),
near as materialized (select a.k as a, b.k as b, a.window_stratum = b.window_stratum as own from seq a join seq b on a.k < b.k and abs(a.center_lat - b.center_lat) < 2 join lateral (select a.radius_km as r1, b.radius_km as r2, {HAV(a='a.center_', b='b.center_')} as d) q on true where d < r1 + r2 and {_OVERLAP} > 0.25),
ties as materialized (select b, list(a) filter (own or not {{own}}) as earlier from near group by 1),
g(k, kept) as (select 0::bigint, []::bigint[] union all select g.k + 1, case when coalesce(len(list_intersect(kept, earlier)), 0) = 0 then list_append(kept, g.k + 1) else kept end from g join seq on seq.k = g.k + 1 left join ties on b = g.k + 1),
best as (select arg_max(kept, k) as kept from g)"""


@query("g19_dedupe_windows", f"{_GREEDY.format(own='false')} select window_id from seq, best where list_contains(kept, k)")
def g19(t: Tables):
    return W.spaced_windows(t.fx_windows, 0.25).select("window_id")


@query("g19_quota_dedupe", f"{_GREEDY.format(own='true')} select window_id from (select *, row_number() over (partition by window_stratum order by k) as r from seq, best where list_contains(kept, k)) q where r <= 10")
def g19_quota(t: Tables):
    quotas = t.spark.createDataFrame([(s, 10) for s, _, _ in TIERS], "window_stratum string, quota int")
    return W.spaced_windows(t.fx_windows, 0.25, quotas).select("window_id")


@query("g20_rebuild_members", f"with m as (select w.window_id, s.station_id, row_number() over (partition by w.window_id order by cast('0x' || substr(md5(concat_ws('|', 'g20', s.station_id)), 1, 8) as bigint), s.station_id) as k from fx_windows w join fx_stations s on abs(s.lat - w.center_lat) < 1 and {HAV(a='w.center_', b='s.')} <= w.radius_km) select window_id, station_id from m where k <= 10")
def g20(t: Tables):
    centers = t.fx_windows.select("window_id", "radius_km", F.col("center_lat").alias("clat"), F.col("center_lon").alias("clon"))
    return W.first_members(t.fx_stations, centers, 10, "g20", "station_id").select("window_id", "station_id")


@query("g22_points_along", f"""with l as (select graph_id as line_id, rn, lat as from_lat, lon as from_lon, lead(lat) over w as to_lat, lead(lon) over w as to_lon from fx_nodes window w as (partition by graph_id order by rn)),
d as (select *, {HAV(a='from_', b='to_')} as km from l where to_lat is not null),
s as (select *, sum(km) over (partition by line_id order by rn) as upto, sum(km) over (partition by line_id order by rn) - km as start from d),
k as (select *, unnest(range(ceil(start / 80)::bigint, ceil(upto / 80)::bigint)) as k from s)
select line_id, k::int as k, from_lat + (k * 80 - start) / km * (to_lat - from_lat) as lat, from_lon + (k * 80 - start) / km * (to_lon - from_lon) as lon from k""", "lat lon")
def g22(t: Tables):
    lines = t.fx_nodes.select(F.col("graph_id").alias("line_id"), F.col("rn").alias("seq"), "lat", "lon")
    return S.points_along(lines, 80.0).select("line_id", "k", "lat", "lon")


@query("g24_grid_heatmap", f"with g as (select i, j, 30 + i * 0.5 as lat, -120 + j * 1.0 as lon from (select unnest(range(0, 29)) as i) a, (select unnest(range(0, 40)) as j) b) select cast(i as int) as i, cast(j as int) as j, count(*) as n from g join fx_stations s on abs(s.lat - g.lat) < 1 and {HAV(a='g.', b='s.')} <= 30 group by 1, 2 having count(*) >= 2")
def g24(t: Tables):
    grid = t.spark.range(29).select(F.col("id").cast("int").alias("i")).crossJoin(t.spark.range(40).select(F.col("id").cast("int").alias("j")))
    centers = grid.select("i", "j", (F.col("i") * 0.5 + 30).alias("clat"), (F.col("j") * 1.0 - 120).alias("clon"))
    near = S.within_radius(t.fx_stations.select("station_id", "lat", "lon"), centers, F.lit(30.0))
    return near.groupBy("i", "j").agg(F.count("*").alias("n")).where("n >= 2")


@query("g25_region_summary", f"select count(*) as n, count(distinct state) as n_states, avg(lat) as lat, avg(lon) as lon from fx_stations s where {HAV(a='c.', b='s.')} <= 200".replace("c.lat", "35.0").replace("c.lon", "-108.0"), "lat lon")
def g25(t: Tables):
    inside = C.haversine_km(F.lit(35.0), F.lit(-108.0), F.col("lat"), F.col("lon")) <= 200
    return t.fx_stations.where(inside).agg(F.count("*").alias("n"), F.countDistinct("state").alias("n_states"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


BOX, STEP, REACH = (30.0, -120.0, 45.0, -80.0), 0.75, 60.0
#: Graphs of regions: the nodes inside (window_id, node_id, capacity) and the edges between them.
_INDUCED = """ie as (select a.window_id, src, dst from fx_edges e join inside a on a.node_id = e.src join inside b on b.node_id = e.dst and a.window_id = b.window_id),
dg as (select i.window_id, i.node_id, count(e.x) as k from inside i left join (select window_id, src as x from ie union all select window_id, dst from ie) e on e.window_id = i.window_id and e.x = i.node_id group by 1, 2),
deg as (select window_id, sum(k) / 2.0 as m, avg(k) as a, max(k)::double as x from dg group by 1),
feat as (select window_id, count(*)::double as n_nodes, m as n_edges, case when count(*) > 1 then 2 * m / (count(*) * (count(*) - 1)) else 0 end as density, sum(capacity) as total_capacity, avg(capacity) as mean_capacity, stddev_pop(capacity) as std_capacity, max(capacity) as max_capacity,
  a as avg_degree, x as max_degree, 0.0 as avg_clustering, 0.0 as max_betweenness, 0.0 as mean_betweenness, 0.0 as global_efficiency, 0.0 as diameter, 1.0 as n_components from inside join deg using (window_id) group by window_id, m, a, x)"""
_CELLS = f"""cells as (select i * 54 + j as window_id, 30 + i * 0.75 as lat, -120 + j * 0.75 as lon from range(21) a(i), range(54) b(j)),
hits as (select window_id, n.node_id, capacity from cells c join fx_nodes n on abs(c.lat - n.lat) < 1 and {HAV(a='c.', b='n.')} <= {REACH}), inside as materialized (select * from hits where window_id in (select window_id from hits group by 1 having count(*) >= 2))"""


def heatmap(t: Tables):
    score = F.col("total_capacity") / (1 + F.col("n_edges"))
    return Q.grid_heatmap(t.fx_nodes, t.fx_edges, BOX, STEP, REACH, score)


@query("g24_grid_features", f"with {_CELLS}, {_INDUCED} select window_id, lat as clat, lon as clon, n_nodes::bigint as n, {', '.join(E.BASE_FEATURES)}, total_capacity / (1 + n_edges) as score from feat join cells using (window_id)", " ".join(["clat clon score", *E.BASE_FEATURES]))
def g24_features(t: Tables):
    return heatmap(t)[0].select("window_id", "clat", "clon", "n", *E.BASE_FEATURES, "score")


@query("g24_grid_summary", f"with {_CELLS}, {_INDUCED} select count(*) as n_cells, (select count(*) from cells) - count(*) as skipped, min(total_capacity / (1 + n_edges)) as lowest, max(total_capacity / (1 + n_edges)) as highest from feat", "lowest highest")
def g24_summary(t: Tables):
    return heatmap(t)[1]


_REGION = "select count(*) as n_stations, array_to_string(list_sort(list(distinct state)), ',') as states, {} from members"
_NODE_STATES = "nodes as (select *, split_part(graph_id, '_', 1) as state from fx_nodes)"


def stated(t: Tables):
    return t.fx_nodes.withColumn("state", F.split_part("graph_id", F.lit("_"), F.lit(1)))


@query("g25_circle", f"with {_NODE_STATES}, members as (select * from nodes s where {HAV(a='c.', b='s.')} <= 400), inside as (select 'region' as window_id, node_id, capacity from members), {_INDUCED} select r.*, {', '.join(E.BASE_FEATURES)} from ({_REGION.format('35.0 as center_lat, -108.0 as center_lon, 400.0 as radius_km')}) r, feat".replace("c.lat", "35.0").replace("c.lon", "-108.0"), " ".join(["center_lat center_lon radius_km", *E.BASE_FEATURES]))
def g25_circle(t: Tables):
    out = Q.region_summary(stated(t), t.fx_edges, circle=(35.0, -108.0, 400.0))
    return out.withColumn("states", F.array_join("states", ","))


@query("g25_ring", f"with {_NODE_STATES}, members as (select * from nodes where lat > 31 and lat < 40 and lon > -118 and lon < -90 and lat - 31 < (lon + 118)), inside as (select 'region' as window_id, node_id, capacity from members), {_INDUCED} select r.*, {', '.join(E.BASE_FEATURES)} from ({_REGION.format('avg(lat) as center_lat, avg(lon) as center_lon')}) r, feat", " ".join(["center_lat center_lon", *E.BASE_FEATURES]))
def g25_ring(t: Tables):
    out = Q.region_summary(stated(t), t.fx_edges, ring=[(-118, 31), (-109, 40), (-90, 40), (-90, 31)])
    return out.withColumn("states", F.array_join("states", ",")).drop("radius_km")


@query("g26_dc_ratio", f"select n.node_id, sum(300 * n_dc) / nullif(sum(5 * n_l1 + 25 * n_l2 + 300 * n_dc), 0) as dc_ratio from fx_nodes n join fx_stations s on abs(s.lat - n.lat) < 0.2 and {HAV(a='n.', b='s.')} <= 10 group by 1", "dc_ratio")
def g26(t: Tables):
    centers = t.fx_nodes.select("node_id", F.col("lat").alias("clat"), F.col("lon").alias("clon"), F.lit(10.0).alias("radius"))
    caps = t.fx_stations.select("lat", "lon", (300.0 * F.col("n_dc")).alias("dc"), C.capacity(F.col("n_l1"), F.col("n_l2"), F.col("n_dc")).alias("cap"))
    near = disk_sums(caps, centers, "node_id", ["dc", "cap"])
    return near.select("node_id", F.try_divide("dc", F.nullif("cap", F.lit(0.0))).alias("dc_ratio"))


@query("g27_node_matrix", "with m as (select avg(lat) as a, stddev_pop(lat) as b, avg(lon) as c, stddev_pop(lon) as d, avg(capacity) as e, stddev_pop(capacity) as f from fx_nodes) select node_id, (lat - a) / b as lat, (lon - c) / d as lon, (capacity - e) / f as capacity from fx_nodes, m", "lat lon capacity")
def g27(t: Tables):
    from stormgrid.operators.filters import zscore

    return zscore(t.fx_nodes, ["lat", "lon", "capacity"], ddof=0).select("node_id", "lat", "lon", "capacity")


@query("g29_county_geometry", "select o_orderkey as id, abs(radians(1.0) * (sin(radians(30 + o_orderkey % 10 + 1.0)) - sin(radians(30 + o_orderkey % 10 * 1.0)))) * 6371.0 * 6371.0 as area_km2 from orders", "area_km2", 4)
def g29(t: Tables):
    k = (F.col("o_orderkey") % 10).cast("double") + 30
    corners = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    ring = F.array(*(F.struct((F.lit(-100.0) + x).alias("lon"), (k + y).alias("lat")) for x, y in corners))
    return S.ring_area_centroid(t.orders.select(F.col("o_orderkey").alias("id"), ring.alias("ring"))).select("id", "area_km2")


# Candidate by candidate in their order, with the list of the kept.
@query("g21_expand_sites", f"""with recursive old as materialized (select state, lat, lon from fx_stations where station_id % 3 <> 0), free as materialized (select station_id, state, lat, lon, row_number() over (order by station_id) as k from fx_stations c where station_id % 3 = 0
  and not exists (select 1 from old o where abs(o.lat - c.lat) < 0.1 and {HAV(a='o.', b='c.')} <= 5)),
ties as materialized (select b.k, list(a.k) as earlier from free a join free b on a.k < b.k and abs(a.lat - b.lat) < 0.1 and {HAV(a='a.', b='b.')} <= 5 group by 1),
g(k, kept) as (select 0::bigint, []::bigint[] union all select g.k + 1, case when coalesce(len(list_intersect(kept, earlier)), 0) = 0 then list_append(kept, g.k + 1) else kept end from g join free on free.k = g.k + 1 left join ties on ties.k = g.k + 1),
best as (select arg_max(kept, k) as kept from g), target as (select state, ceil(count(*) * 0.1) as target from old group by 1),
added as (select state, lat, lon, row_number() over (partition by state order by k) as place from free, best where list_contains(kept, k))
select state, lat, lon, false as is_added from old union all select state, lat, lon, true from added join target using (state) where place <= target""", "lat lon")
def g21(t: Tables):
    sites = t.fx_stations.where("station_id % 3 <> 0").select("state", "lat", "lon")
    candidates = t.fx_stations.where("station_id % 3 = 0").select(F.col("station_id").alias("ord"), "state", "lat", "lon")
    out = N.expand_sites(sites, candidates, 0.1, 5.0)
    return out.select("state", "lat", "lon", "is_added")


def site_areas(t: Tables):
    """Sites of each state, and a square for each of its counties."""
    sites = t.fx_nodes.select(F.concat(F.lit("n"), F.col("node_id").cast("string")).alias("id"), F.split_part("graph_id", F.lit("_"), F.lit(1)).alias("state"), "lat", "lon", "capacity").where("substring(id, -1) = '7'")
    south, west = F.col("centroid_lat"), F.col("centroid_lon")
    corners = ((0.0, 0.0), (1.4, 0.0), (1.4, 1.4), (0.0, 1.4))
    ring = F.array(*(F.struct((west + x).alias("lon"), (south + y).alias("lat")) for x, y in corners))
    return sites, t.fx_county.select("state", F.col("fips").alias("area_id"), "population", "area_km2", ring.alias("ring"))


def corridor_case(t: Tables):
    """Sites of each state, corridors through some of its counties, and spare points drawn in squares."""
    sites, areas = site_areas(t)
    lines = t.fx_stations.where("station_id % 50 = 3").select("state", F.lit("road").alias("line_id"), F.col("station_id").alias("seq"), "lat", "lon")
    counts = sites.groupBy("state").agg((F.count("*") * 5).alias("n"))
    return sites, lines, X.drawn_points(areas, counts, "population", "fill")


@query("g21_within", f"""select station_id, state, case when place <= greatest(1, ceil(n * 0.1::double)) then n_stations + 1 else n_stations end as n_stations, case when place <= greatest(1, ceil(n * 0.1::double)) then 'within_diagnostic' end as densify_mode
from (select station_id, state, cast(n_l1 + n_l2 + n_dc as bigint) as n_stations, count(*) over (partition by state) as n, row_number() over (partition by state order by cast('0x' || substr(md5(concat_ws('|', 'within', station_id)), 1, 8) as bigint), station_id) as place from fx_stations) q""")
def g21_within(t: Tables):
    sites = t.fx_stations.select(F.col("station_id").alias("id"), "state", (F.col("n_l1") + F.col("n_l2") + F.col("n_dc")).cast("long").alias("n_stations"))
    return X.tag_within(sites, 0.1, "within").withColumnRenamed("id", "station_id")


@query("g21_by_population")
def g21_population(t: Tables):
    """Sites drawn by population in the squares of the counties."""
    sites, areas = site_areas(t)
    out = X.expand_drawn(sites, areas, "population", 0.5, "people", "population")
    return out.select("state", "id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "rule", "is_cf_added")


@query("g21_by_area")
def g21_area(t: Tables):
    """Sites drawn evenly in space, the control of the two above."""
    sites, areas = site_areas(t)
    out = X.expand_drawn(sites, areas, "area_km2", 0.5, "space", "uniform")
    return out.select("state", "id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "rule", "is_cf_added")


@query("g21_corridors")
def g21_corridors(t: Tables):
    out = X.expand_corridors(*corridor_case(t), 0.5)
    return out.select("state", "id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "rule", "is_cf_added")


@query("g21_rebuilt_edges")
def g21_rebuilt(t: Tables):
    out = X.rebuilt(X.expand_corridors(*corridor_case(t), 0.5))
    return out.select("graph_id", "src", "dst", F.round("km", 4).alias("km"), F.round("weight", 6).alias("weight"))


_ACTIVE = """active as materialized (select g.graph_id, e.sim_id, e.event_id as case_id, unnest(range(ceil(e.event_id % 6)::bigint, ceil(e.event_id % 6 + e.duration_hours)::bigint)) as hour from fx_epicenters e join (select distinct graph_id, split_part(graph_id, '_', 1) as state from fx_nodes) g on g.state = e.graph_id),
named as materialized (select graph_id, sim_id, hour, string_agg(distinct node_id, ',' order by node_id) as vid from active left join hit using (graph_id, case_id) group by 1, 2, 3)"""
_ACTIVE_SETS = "select distinct a.graph_id, n.vid, h.node_id from active a join hit h using (graph_id, case_id) join named n on n.graph_id = a.graph_id and n.sim_id = a.sim_id and n.hour = a.hour"


@query("g23_union_timeline", _variants(_ACTIVE_SETS).replace("with recursive", f"with recursive {_HIT.split(', named as')[0]}, {_ACTIVE},", 1) + """, busy as (select graph_id, sim_id, hour, count(distinct case_id) as events from active group by 1, 2, 3)
select n.sim_id, n.graph_id, sum(coalesce(relative, 0)) as loss, count(*) as hours, max(events) as max_simultaneous from named n join busy using (graph_id, sim_id, hour) left join lost l on l.graph_id = n.graph_id and l.vid = n.vid group by 1, 2""", "loss", 4)
def g23(t: Tables):
    from stormgrid.operators.outages import active_hours

    start = (F.col("event_id") % 6).cast("double")
    hours = active_hours(t.fx_epicenters, start, start + F.col("duration_hours"))
    hours = hours.select(F.col("event_id").alias("case_id"), "sim_id", "hour")
    return R.event_timeline_loss(grouped(t), t.fx_edges, state_events(t), hours)


# Tracts are the lower halves of squares, areas upper halves; halves meet iff their boxes do and the corners lie on
# the right sides of the diagonals.
@query("g28_tract_classes", """with t as (select o_orderkey as id, 30 + o_orderkey % 130 / 10.0 as south, -120 + o_custkey % 380 / 10.0 as west, 0.05 + o_orderkey % 7 / 20.0 as side from orders),
b as (select n_nationkey, 30.037 + n_nationkey % 10 * 1.5 as south, -119.981 + n_nationkey % 10 * 4.0 as west, 0.9 as wide from nation),
m as (select t.id, bool_or(n_nationkey < 5) as metro, bool_or(n_nationkey >= 5) as micro from t join b on t.south <= b.south + wide and t.south + side >= b.south and t.west <= b.west + wide and t.west + side >= b.west
  and greatest(t.south, b.south) + greatest(t.west, b.west) <= t.south + t.west + side and least(t.south + side, b.south + wide) + least(t.west + side, b.west + wide) >= b.south + b.west + wide and b.south + b.west + wide <= t.south + t.west + side group by 1),
c as (select quantile_cont(side * side, 0.35) as edge from t join m using (id) where metro)
select t.id, case when coalesce(metro, false) and side * side <= edge then 'urban' when coalesce(metro, false) or coalesce(micro, false) then 'suburban' else 'rural' end as class from t left join m using (id), c""")
def g28(t: Tables):
    def ring(south, west, side, lower: bool):
        corners = [(0, 0), (0, side), (side, 0)] if lower else [(side, side), (0, side), (side, 0)]
        return F.array(*(F.struct((west + x).alias("lon"), (south + y).alias("lat")) for y, x in corners)).alias("ring")

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    side = (k % 7) / 20.0 + 0.05
    tracts = t.orders.select(k.alias("id"), ring((k % 130) / 10.0 + 30, (c % 380) / 10.0 - 120, side, True), (side * side).alias("area_km2"))
    n = (F.col("n_nationkey") % 10).cast("double")
    areas = t.nation.select(F.col("n_nationkey").alias("id"), ring(n * 1.5 + 30.037, n * 4.0 - 119.981, F.lit(0.9), False))
    return N.tract_classes(tracts, areas.where("id < 5"), areas.where("id >= 5")).select("id", "class")


@query("g30_tract_population", "select concat(fips, '1') as tract, case when state <> 'S2' then population else 0 end as population, fips from fx_county", "population")
def g30(t: Tables):
    tracts = t.fx_county.select(F.concat("fips", F.lit("1")).alias("tract"), F.col("centroid_lat").alias("south"))
    population = t.fx_county.where("state <> 'S2'").select(F.concat("fips", F.lit("1")).alias("tract"), "population")
    return N.tract_population(tracts, population).select("tract", "population", "fips")
