"""Views that give the stored tables the shapes of outage, network and scenario data.

The text runs in Spark (tables in braces) and, without braces, in any SQL engine.
"""

FIXTURES = {
    "fx_outages": """
select lpad(cast(1001 + user_id as varchar(20)),5,'0') as fips, concat('S', cast(user_id % 10 as varchar(20))) as state,
  concat(' County  ', cast(user_id as varchar(20)), ' ') as county, ts as start_time, round(value * cast(6 as double), 2) as duration_min,
  value as mean_customers, value / cast(2 as double) as min_customers, value * cast(2 as double) as max_customers,
  cast(2018 + event_id % 6 as int) as year, event_id
from {events}
""",
    "fx_county": """
select lpad(cast(1001 + u as varchar(20)),5,'0') as fips, concat('S', cast(u % 10 as varchar(20))) as state,
  cast(500 + (u * 7919) % 4000 as double) as area_km2, cast(200 + (u * 104729) % 9000 as double) as customers,
  cast(2500 + (u * 15485863) % 20000 as double) as population,
  cast(30 as double) + cast(u % 10 as double) * cast('1.5' as double) as centroid_lat, cast(-120 as double) + cast(u % 10 as double) * cast(4 as double) as centroid_lon
from (select distinct user_id as u from {events}) q
""",
    "fx_coverage": """
select distinct concat('S', cast(user_id % 10 as varchar(20))) as state, cast(2018 + event_id % 6 as int) as year,
  cast(40 + ((user_id % 10) * 7 + (event_id % 6) * 5) % 70 as double) / cast(100 as double) as theta from {events} where user_id % 10 < 9
""",
    "fx_stations": """
select c_custkey as station_id, concat('S', cast(c_nationkey % 10 as varchar(20))) as state,
  cast(30 as double) + cast(c_nationkey % 10 as double) * cast('1.5' as double) + cast((c_custkey * 7919) % 10007 as double) / cast(10007 as double) * cast('1.4' as double) as lat,
  cast(-120 as double) + cast(c_nationkey % 10 as double) * cast(4 as double) + cast((c_custkey * 104729) % 10009 as double) / cast(10009 as double) * cast('3.6' as double) as lon,
  cast(c_custkey % 3 as double) as n_l1, cast(c_custkey % 7 as double) as n_l2, cast(c_custkey % 5 as double) as n_dc
from {customer}
""",
    "fx_nodes": """
select concat(state, '_', cast(cast((station_id - station_id % 160) / 160 as int) as varchar(20))) as graph_id, station_id as node_id, lat, lon,
  cast(5 as double) * n_l1 + cast(25 as double) * n_l2 + cast(300 as double) * n_dc as capacity,
  row_number() over (partition by concat(state, '_', cast(cast((station_id - station_id % 160) / 160 as int) as varchar(20))) order by station_id) as rn from {fx_stations}
""",
    "fx_edges": """
select a.graph_id, a.node_id as src, b.node_id as dst, cast(1 + (a.node_id * 31 + b.node_id * 17) % 9 as double) / cast(10 as double) as weight
from {fx_nodes} a join {fx_nodes} b on a.graph_id = b.graph_id and (b.rn = a.rn + 1 or b.rn = a.rn + 5)
""",
    "fx_epicenters": """
select cast(event_id % 20 as int) as sim_id, event_id, concat('S', cast(user_id % 10 as varchar(20))) as graph_id,
  cast(30 as double) + cast(user_id % 10 as double) * cast('1.5' as double) + cast((event_id * 6007) % 9973 as double) / cast(9973 as double) * cast('1.4' as double) as lat,
  cast(-120 as double) + cast(user_id % 10 as double) * cast(4 as double) + cast((event_id * 3001) % 9967 as double) / cast(9967 as double) * cast('3.6' as double) as lon,
  cast(5 + event_id % 60 as double) as radius_km, value / cast(10 as double) as duration_hours from {events}
""",
    "fx_windows": """
select concat('w_', cast(station_id as varchar(20))) as window_id, case station_id % 3 when 0 then 'urban' when 1 then 'suburban' else 'rural' end as window_stratum,
  case station_id % 3 when 0 then cast(10 as double) when 1 then cast(30 as double) else cast(80 as double) end as radius_km, lat as center_lat, lon as center_lon, state, station_id as ord
from {fx_stations}
""",
    "fx_curves": """
select w.window_id, w.window_stratum, w.radius_km, w.center_lon, a.attack, p.pct,
  cast((w.ord * 13 + p.pct * 7) % 101 as double) / cast(101 as double) as y_true, cast((w.ord * 13 + p.pct * 7 + w.ord % 5) % 101 as double) / cast(101 as double) as y_pred
from {fx_windows} w cross join (select 'betweenness' as attack union all select 'capacity' union all select 'random') a
cross join (select 5 as pct union all select 10 union all select 20 union all select 30 union all select 40 union all select 50 union all select 60 union all select 70 union all select 80 union all select 90) p
""",
    "fx_sims": """
select concat('U', cast(l_suppkey % 12 as varchar(20))) as unit, case l_linenumber % 3 when 0 then 'A' when 1 then 'B' else 'C' end as family,
  cast(2018 + l_partkey % 6 as int) as year, cast(l_orderkey % 40 as int) as sim_id, cast(sum(cast(round(l_extendedprice * l_discount * 100) as bigint)) as double) / cast(100 as double) as loss, count(*) as n_events,
  cast(sum(case when l_quantity > 25 then 1 else 0 end) as bigint) as n_hit from {lineitem} group by 1, 2, 3, 4
""",
}
