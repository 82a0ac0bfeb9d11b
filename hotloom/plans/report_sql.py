"""DuckDB statements with the results of the report queries."""

from hotloom.functions.planar import to_latlon_sql, to_utm_sql
from hotloom.operators.sweeps import EPS_METRES, MIN_SAMPLES
from hotloom.plans.problem_sql import _WARD, _distance

_X, _Y = to_utm_sql("lat", "lon")
_CENTRE = "(select 12.9716 lat, 77.5946 lon)"

#: CTE of the clean complaints.
I = """i as (select rowid_, run_id, request_id, case when regexp_full_match(month, '\\d{4}-\\d{2}') then month end as month, coalesce(lower(trim(issue_type)),'unknown') category,
  coalesce(lower(trim(sub_issue_type)),'unknown') sub_category, coalesce(lower(trim(status)),'unknown') status, ward_id, source_ward_id, latitude lat, longitude lon,
  coalesce(is_pothole=1,false) is_target, coalesce(in_boundary=1,false) in_boundary, coalesce(usable=1,false) usable, coalesce(suspect_fallback_pin=1,false) pin, coord_multiplicity mult,
  (case when regexp_full_match(replace(trim(created_at),'/','-'),'\\d{1,2}-\\d{1,2}-\\d{4} \\d{1,2}:\\d{2}') then try_strptime(replace(trim(created_at),'/','-'),'%m-%d-%Y %H:%M') end)::date::varchar reported from complaints)"""  # noqa: E741
P = "p as (select rowid_::bigint pid, lat, lon from i where usable and is_target and not pin)"
PINS = "p as (select rowid_::bigint pid, lat, lon from i where usable and is_target)"


def _labels(eps: float = 250, least: int = 5, name: str = "labels") -> str:
    """CTEs up to labels(pid, lat, lon, label) from p; the leading recursive keyword is the caller's."""
    s = "" if name == "labels" else name
    deg = eps / 100_000
    return f"""
b{s} as (select *, floor(lat/{deg})::bigint g from p), q{s} as (select *, unnest([g-1,g,g+1]) h from b{s}),
near{s} as (select p.pid a, q.pid b from b{s} p join q{s} q on p.g=q.h where abs(p.lon-q.lon)<{deg * 1.3} and {_distance('p', 'q')} <= {eps}),
core{s} as (select a from near{s} group by a having count(*)>={least}),
link{s} as (select a, b from near{s} where a in (select a from core{s}) and b in (select a from core{s})),
walk{s} as (select a, a root from core{s} union select l.a, w.root from walk{s} w join link{s} l on l.b=w.a where w.root<l.a),
named{s} as (select a, dense_rank() over (order by root) - 1 l from (select a, min(root) root from walk{s} group by a)),
edge{s} as (select near{s}.a, min(l) l from near{s} join named{s} n on near{s}.b=n.a where near{s}.a not in (select a from core{s}) group by 1),
{name} as (select pid, lat, lon, coalesce(n.l, e.l, -1)::int label from p left join named{s} n on p.pid=n.a left join edge{s} e on p.pid=e.a)"""


L = _labels()
WITH_L = f"with recursive {I}, {P}, {L}"
MONTHS = "months as (select strftime(unnest(generate_series(strptime(a||'-01','%Y-%m-%d'), strptime(b||'-01','%Y-%m-%d'), interval 1 month)),'%Y-%m') as month from (select min(month) a, max(month) b from i))"
SERIES = f"""{MONTHS}, g as (select ward_id, month, count(*) filter (is_target) t, count(*) n from i where usable and not pin group by all),
s as (select w.ward_id unit, m.month, coalesce(t,0) target_reports, coalesce(n,0) all_reports, t/n share from wards w cross join months m left join g on g.ward_id=w.ward_id and g.month=m.month)"""
KNN = f"k as (select a.pid, {_distance('a', 'b')} metres, row_number() over (partition by a.pid order by {_distance('a', 'b')}) r from p a cross join p b), kd as (select pid, r::int k, metres from k where r in (4,5,6,8))"
OUTER = """a as (select ward_id, count(*) n from i where is_target and ward_id>=1 and run_id=1 group by 1), c as (select ward_id, count(*) n from i where is_target and ward_id>=1 and run_id=2 group by 1),
both_ as (select coalesce(a.ward_id,c.ward_id) ward_id, coalesce(a.n,0) main, coalesce(c.n,0) later from a full join c on a.ward_id=c.ward_id)"""
_D = lambda c: f"coalesce(length(rtrim(split_part(split_part({c}::varchar,'e',1),'.',2),'0')),0)"
DECIMALS = f"least(case when lat is null then 0 else {_D('lat')} end, case when lon is null then 0 else {_D('lon')} end)"
FLAGS = f"""(lat is null or lon is null) null_coord, not coalesce(lat between -90 and 90 and lon between -180 and 180, false) out_of_range, coalesce(lat=0 and lon=0, false) zero_zero,
  coalesce(lat between 77 and 78 and lon between 12 and 14, false) swapped, {DECIMALS}::int decimals, {DECIMALS}<=3 coarse"""
RING = f"""ring as (select ward_id, r, rings[r] ring from (select ward_id, rings, unnest(range(1,len(rings)+1)) r from wards)),
pt as (select ward_id, r, k, ring[k].lat lat, ring[k].lon lon from (select ward_id, r, ring, unnest(range(1,len(ring)+1)) k from ring)),
xy as (select ward_id, r, k, {_X} x, {_Y} y from pt),
sized as (select a.ward_id, a.r, abs(sum(a.x*b.y-b.x*a.y))/2e6 a from xy a join xy b on a.ward_id=b.ward_id and a.r=b.r and b.k=a.k+1 group by all),
cross_ as (select f.ward_id, f.r, o.r o, count(*) n from pt f join pt o on f.ward_id=o.ward_id and f.r<>o.r and f.k=1 join pt o2 on o2.ward_id=o.ward_id and o2.r=o.r and o2.k=o.k+1
  where (o.lat>f.lat)<>(o2.lat>f.lat) and f.lon < (o2.lon-o.lon)*(f.lat-o.lat)/(o2.lat-o.lat)+o.lon group by all),
depth as (select ward_id, r, sum(n%2) d from cross_ group by all),
areas as (select s.ward_id, sum(case when coalesce(d,0)%2=1 then -a else a end) area_km2 from sized s left join depth using (ward_id, r) group by all)"""
RATED = f"""{RING}, rated as (select ward_id unit, area_km2 * (select count(*) from i where is_target and usable and not pin) / ((select sum(area_km2) from areas)*(select count(*) from months)) expected from areas),
pm as (select unit, expected, j, exp(-expected + j*ln(expected) - lgamma(j+1)) p from rated, range(0, 60) t(j)),
tl as (select unit, j+1 t, 1-sum(p) over (partition by unit order by j) tail from pm),
th as (select unit, min(t)::int active_threshold, max_by(tail, -t) p0 from tl where tail<=0.05 group by 1)"""
METRICS = f"""{RATED},
mm as (select s.unit, active_threshold, p0, count(*) filter (target_reports>=active_threshold) active_months, count(*) as months, sum(target_reports)::bigint total_reports from s join th using (unit) group by all),
bn as (select unit, k, 1-coalesce(sum(exp(lgamma(months+1)-lgamma(k+1)-lgamma(months-k+1)+k*ln(p0)+(months-k)*ln(1-p0))) over (partition by unit order by k rows between unbounded preceding and 1 preceding),0) tail from mm, range(0, 44) t(k) where k<=months),
nd as (select mm.unit, coalesce(min(k),max(months)+1)::int needed from mm left join bn on bn.unit=mm.unit and tail<=0.01 group by 1),
um as (select mm.unit, active_threshold, active_months, months, total_reports, case when months>=24 then needed end needed_months, case when months>=24 then active_months/months end persistence, case when months>=24 then active_months>=needed end persistent from mm join nd using (unit))"""
TREND = """n as (select unit, month, target_reports y, row_number() over (partition by unit order by month)-1 i from s),
tot as (select unit, count(*) m, sum(y) y, min(y)=max(y) flat from n group by 1),
pr as (select a.unit, sum(sign(b.y-a.y)) s, median((b.y-a.y)/(b.i-a.i)) slope from n a join n b on a.unit=b.unit and b.i>a.i group by 1),
ti as (select unit, sum(c*(c-1)) t2 from (select unit, y, count(*) c from n group by all) group by 1),
tr as (select unit, m>=12 and y>=10 as valid, flat, s, slope, 2*s/sqrt(m*(m-1)*(m*(m-1)-t2)) tau from tot join pr using (unit) join ti using (unit))"""
#: lt(unit, tau, slope, p, q, trend) from tr2: two-sided normal p-values of Kendall's score with ties, by Simpson's rule.
LABELS = """tv as (select n.unit, m, sum(c*(c-1)*(2*c+5)) t5 from (select unit, y, count(*) c from n group by all) n join tot using (unit) group by all),
z as (select tr.unit, valid, flat, tau, slope, case when flat then 0.0 else abs(s)/sqrt((m*(m-1)*(2*m+5)-t5)/18) end z from tr join tv using (unit)),
pv as (select unit, valid, flat, tau, slope, case when flat then 1.0 else greatest(0.0, 1-2*z/4000/3*sum((case when k in (0,4000) then 1 when k%2=1 then 4 else 2 end)*exp(-pow(z*k/4000,2)/2))/sqrt(2*pi())) end p from z, range(0,4001) r(k) where valid group by unit, valid, flat, tau, slope, z),
rk as (select *, row_number() over (order by p) k, count(*) over () nn from pv), qv as (select *, least(1.0, min(p*nn/k) over (order by k rows between current row and unbounded following)) q from rk),
lt as (select z.unit, case when z.valid and z.flat then 0.0 when z.valid then z.tau end tau, case when z.valid and z.flat then 0.0 when z.valid then z.slope end slope, p, q,
  case when not z.valid then 'Insufficient data' when q<0.05 and z.tau>0 and not z.flat then 'Increasing' when q<0.05 and z.tau<0 and not z.flat then 'Decreasing' else 'Stable' end trend from z left join qv using (unit))"""
_CHECKS = {
    "null_coordinates": "null_coord", "out_of_global_range": "out_of_range", "zero_zero": "zero_zero", "swapped_lat_lon": "swapped", "coarse_rounded": "coarse", "outside_boundary": "not in_boundary",
    "suspect_fallback_pin": "pin", "ward_disagrees": "source_ward_id is distinct from ward_id and in_boundary", "usable": "usable",
}
_A, _B = to_latlon_sql("((gx+0.5)*250)", "((gy+0.5)*250)")
_CA, _CB = to_latlon_sql("x", "y")
CENTRES = f"(select {{by}}, {_CA} clat, {_CB} clon from (select {{by}}, avg({_X}) x, avg({_Y}) y from {{src}} group by all))"

#: inside(label, is_target, month): complaints in a cluster's hull, which has them on the inner side of all its edges, or
#: within 50 m of a line between two of its members.
FOOT = f"""mem as (select distinct label, lat, lon from labels where label>=0), mxy as (select label, {_X} x, {_Y} y from mem), bx as (select label, min(x)-51 x0, max(x)+51 x1, min(y)-51 y0, max(y)+51 y1 from mxy group by 1),
cand as (select rowid_, is_target, month, {_X} x, {_Y} y from i where usable and not pin), boxed as (select label, rowid_, is_target, month, x, y from cand join bx on x between x0 and x1 and y between y0 and y1),
seg as (select p.label, p.x px, p.y py, q.x qx, q.y qy from mxy p join mxy q on p.label=q.label),
edge_ as (select s.* from seg s where (px, py)<>(qx, qy) and not exists (select 1 from mxy r where r.label=s.label and (qx-px)*(r.y-py)-(qy-py)*(r.x-px)<0)),
near50 as (select distinct b.label, rowid_ from boxed b join seg s on b.label=s.label where pow(b.x-px-(qx-px)*greatest(0.0,least(1.0,coalesce(((b.x-px)*(qx-px)+(b.y-py)*(qy-py))/nullif(pow(qx-px,2)+pow(qy-py,2),0),0))),2)+pow(b.y-py-(qy-py)*greatest(0.0,least(1.0,coalesce(((b.x-px)*(qx-px)+(b.y-py)*(qy-py))/nullif(pow(qx-px,2)+pow(qy-py,2),0),0))),2)<=2500),
inner_ as (select b.label, rowid_ from boxed b join edge_ e on b.label=e.label group by all having min((qx-px)*(b.y-py)-(qy-py)*(b.x-px))>=0),
inside as (select label, rowid_, is_target, month from boxed where (label, rowid_) in (select (label, rowid_) from near50) or (label, rowid_) in (select (label, rowid_) from inner_))"""

#: lab(eps, least, pid, lat, lon, label) of every configuration of the swept grid.
GRID = f"""eps_ as (select unnest({[float(e) for e in EPS_METRES]}) eps), least_ as (select unnest({MIN_SAMPLES}) least),
pairs as (select p.pid a, q.pid b, {_distance('p', 'q')} d from p, p q where abs(p.lat-q.lat)<0.0095), near as (select eps, a, b from pairs join eps_ on d<=eps),
core as (select eps, least, a from (select eps, a, count(*) n from near group by all) join least_ on n>=least),
link as (select c.eps, c.least, near.a, near.b from near join core c on c.eps=near.eps and c.a=near.a join core k on k.eps=near.eps and k.a=near.b and k.least=c.least),
walk(eps, least, a, root) using key (eps, least, a) as (select eps, least, a, a root from core union select l.eps, l.least, l.a, min(w.root) from walk w join link l on l.eps=w.eps and l.least=w.least and l.b=w.a
  join recurring.walk r on r.eps=l.eps and r.least=l.least and r.a=l.a where w.root<r.root group by all),
named as (select eps, least, a, dense_rank() over (partition by eps, least order by root)-1 l from walk),
edge as (select n.eps, n.least, near.a, min(l) l from near join named n on n.eps=near.eps and n.a=near.b group by all),
lab as (select eps_.eps, least_.least, pid, lat, lon, coalesce(n.l, e.l, -1)::int label from p cross join eps_ cross join least_ left join named n on n.eps=eps_.eps and n.least=least_.least and n.a=pid left join edge e on e.eps=eps_.eps and e.least=least_.least and e.a=pid)"""

ORACLE = {
    "scan_project": "select rowid_, request_id, issue_type, status, latitude, longitude from complaints",
    "load_where": "select rowid_, latitude, longitude from complaints where run_id=1 and usable=1 and latitude>13.0",
    "roundtrip_parquet": "select rowid_, status, ward_id, latitude from complaints",
    "artifact_json": "select to_json({run_id: run_id, cluster_id: cluster_id, report_count: report_count, observed_trend: observed_trend})::varchar payload from cluster_summary",
    "geojson_features": """with c as (select *, {cluster_id: cluster_id, report_count: report_count, "rank": "rank"} props, round_even(bbox_min_lon*1000,0)/1000 w, round_even(bbox_max_lon*1000,0)/1000 e, round_even(bbox_min_lat*1000,0)/1000 s, round_even(bbox_max_lat*1000,0)/1000 n from cluster_summary where centroid_latitude is not null and centroid_longitude is not null)
select run_id, cluster_id, 'polygon' kind, to_json({type: 'Feature', geometry: {type: 'Polygon', coordinates: [[[w,s],[e,s],[e,n],[w,n],[w,s]]]}, properties: props})::varchar feature from c
union all select run_id, cluster_id, 'centroid', to_json({type: 'Feature', geometry: {type: 'Point', coordinates: [round_even(centroid_longitude*10000,0)/10000, round_even(centroid_latitude*10000,0)/10000]}, properties: {cluster_id: cluster_id, report_count: report_count, "rank": "rank", feature: 'centroid'}})::varchar from c""",
    "nan_to_null": "select event_id, case when event_id%7=0 or event_id%11=0 then null else value end as value from events",
    "json_extract": "select event_id, (props->>'$.k')::int k from events",
    "parse_ts": """select rowid_, strftime(case when regexp_full_match(replace(trim(created_at),'/','-'),'\\d{1,2}-\\d{1,2}-\\d{4} \\d{1,2}:\\d{2}') then try_strptime(replace(trim(created_at),'/','-'),'%m-%d-%Y %H:%M') end,'%Y-%m-%d %H:%M') local_time from complaints""",
    "taxonomy_filter": f"with {I} select category, sub_category, count(*) complaints, count(*) filter (not is_target) not_target from i where sub_category in ('pothole on carriageway','pothole patch requested') group by all",
    "surrogate_key": "select rowid_, 'rec-'||substr(sha1(coalesce(created_at,'nan')||'|'||coalesce(ward_id::varchar,'nan')||'|'||coalesce(issue_type,'nan')||'|'||coalesce(sub_issue_type,'nan')),1,12) as key from complaints",
    "coord_flags": f"with {I} select rowid_, {FLAGS} from i",
    "normalise": f"""
with {_WARD}, m as (select latitude, longitude, count(*) n from complaints where latitude is not null and longitude is not null group by all),
c as (select x.*, latitude lat, longitude lon, coalesce(w,-1)::int w, m.n from complaints x left join inside i on x.latitude=i.lat and x.longitude=i.lon left join m using (latitude, longitude)),
f as (select *, {FLAGS}, case when regexp_full_match(replace(trim(created_at),'/','-'),'\\d{{1,2}}-\\d{{1,2}}-\\d{{4}} \\d{{1,2}}:\\d{{2}}') then try_strptime(replace(trim(created_at),'/','-'),'%m-%d-%Y %H:%M') end ts from c),
v as (select *, not (null_coord or out_of_range or zero_zero or swapped) valid_coord from f)
select rowid_, 'rec-'||substr(sha1(coalesce(created_at,'nan')||'|'||coalesce(issue_type,'nan')||'|'||coalesce(sub_issue_type,'nan')),1,12) request_id, coalesce(issue_type,'Unknown') issue_type, w ward_id, source_ward_id,
  coalesce(is_pothole=1,false) is_target, null_coord, coarse, w<>-1 in_boundary, n coord_multiplicity, coalesce(n>=8,false) suspect_fallback_pin, valid_coord, valid_coord and w<>-1 and ts is not null usable from v""",
    "coord_multiplicity": "select rowid_, latitude, longitude, case when latitude is not null and longitude is not null then count(*) over (partition by latitude, longitude) end n from complaints",
    "coarsen": "select rowid_, round_even(latitude*1000,0)/1000 lat3, round_even(longitude*1000,0)/1000 lon3 from complaints",
    "analysis_set": f"with {I}, {P} select * from p",
    "null_counts": "unpivot (select count(*) - count(columns(*)) from complaints) on columns(*) into name \"column\" value nulls",
    "dim_lookup": "select rowid_, c.ward_id, w.name official_name, zone from complaints c left join wards w on c.ward_id=w.ward_id",
    "string_date_ops": "select o_orderkey, strftime(o_orderdate,'%Y-%m') as month, left(o_orderpriority,1) as level, replace(trim(o_orderpriority),'-',' ') priority, starts_with(o_orderpriority,'1') urgent from orders",
    "tz_month": "select strftime(ts + interval 330 minute,'%Y-%m-%d') as day, count(*) events from events group by 1",
    "month_spine": f"with {I}, {MONTHS} select month from months",
    "dense_unit_month": f"with {I}, {SERIES} select unit, month, target_reports, all_reports, share from s",
    "monthly_quality": f"with {I}, {MONTHS}, c as (select month, count(*) a, count(*) filter (is_target) b, count(*) filter (is_target and usable and not pin) c from i group by all) select months.month, coalesce(a,0) complaints, coalesce(b,0) targets, coalesce(c,0) usable_targets, b/nullif(a,0) target_share from months left join c on months.month=c.month",
    "month_gaps": f"with {I}, {MONTHS} select month from months where month not in (select month from i where month is not null)",
    "membership_inner": f"{WITH_L} select label, status, count(*) reports from labels join i on pid=rowid_ where label>=0 group by all",
    "membership_left": f"{WITH_L} select rowid_, coalesce(label<>-1,false) clustered from i left join labels on pid=rowid_ where is_target",
    "full_outer_counts": f"with {I}, {OUTER} select * from both_",
    "spearman": f"with {I}, {OUTER}, r as (select rank() over (order by main) + (count(*) over (partition by main)-1)/2 a, rank() over (order by later) + (count(*) over (partition by later)-1)/2 b from both_) select count(*) n, case when count(*)>=10 then corr(a,b) end rho from r",
    "top20_overlap": f"with {I}, {OUTER} (select ward_id from both_ order by main desc, ward_id limit 20) intersect (select ward_id from both_ order by later desc, ward_id limit 20)",
    "semi_join": "select rowid_, ward_id from complaints where ward_id in (select unit_id from spatial_unit_monthly where unit_type='ward' and pothole_reports>=10)",
    "union_units": f"{WITH_L} select 'ward' unit_type, ward_id::bigint unit_id, month, count(*) reports from i where is_target and month is not null and ward_id>=1 group by all union all select 'cluster', label::bigint, month, count(*) from i join labels on pid=rowid_ where is_target and month is not null and label>=0 group by all",
    "haversine_centre": f"with {I}, {P} select pid, {_distance('p', 'z')} metres from p, {_CENTRE} z",
    "near_duplicates": f"""with {I}, p as (select lat, lon from i where is_target and lat between -90 and 90 and lon between -180 and 180 and not (lat=0 and lon=0) and not (lat between 77 and 78 and lon between 12 and 14)), c as (select lat, lon, count(*) w, floor(lat/0.001)::bigint g from p group by all), h as (select *, unnest([g-1,g,g+1]) k from c),
near as (select distinct a.lat, a.lon from c a join h b on a.g=b.k where (a.lat<>b.lat or a.lon<>b.lon) and {_distance('a', 'b')}<=10)
select coalesce(sum(w),0)::bigint reports, count(*) places from c where w>1 or (lat, lon) in (select (lat, lon) from near)""",
    "utm_project": f"with {I}, {P} select pid, floor({_X}*100+0.5)/100 x, floor({_Y}*100+0.5)/100 y from p",
    "utm_roundtrip": f"with {I}, {P} select count(*) points, 0::bigint off from p",
    "centroid": f"with {I}, w as (select * from i where usable and ward_id>=1) select ward_id, round_even(clat*1e6,0) lat_e6, round_even(clon*1e6,0) lon_e6 from {CENTRES.format(by='ward_id', src='w')}",
    "cluster_radius": f"{WITH_L}, m as (select * from labels where label>=0), c as (select label, clat lat, clon lon from {CENTRES.format(by='label', src='m')}) select m.label, round_even(max({_distance('m', 'c')})*10,0) radius_dm from m join c on m.label=c.label group by 1",
    "point_in_polygon": f"with {_WARD} select rowid_, coalesce(w,-1) ward from complaints c left join inside i on c.latitude=i.lat and c.longitude=i.lon",
    "polygon_area": f"with {RING} select ward_id, round_even(area_km2*1e6,0) area_m2 from areas",
    "grid_250m": f"{WITH_L}, c as (select floor({_X}/250)::bigint gx, floor({_Y}/250)::bigint gy, label from labels), d as (select gx, gy, count(*) points, count(*) filter (label>=0) clustered, count(*) filter (label<0) noise from c group by all) select *, round_even({_A}*10000,0)/10000 cell_lat, round_even({_B}*10000,0)/10000 cell_lon from d",
    "k_distance": f"with {I}, {P}, {KNN} select pid, k, metres from kd where k=5",
    "kdist_percentiles": f"with {I}, {P}, {KNN} select k, quantile_cont(metres,0.1) p10, quantile_cont(metres,0.25) p25, quantile_cont(metres,0.5) p50, quantile_cont(metres,0.75) p75, quantile_cont(metres,0.9) p90, quantile_cont(metres,0.95) p95 from kd group by 1",
    "knee": f"with {I}, {P}, {KNN}, o as (select metres, row_number() over (order by metres)-1 i, count(*) over () n, min(metres) over () a, max(metres) over () b from kd where k=5) select n, metres from o order by i/greatest(n-1,1)-(metres-a)/greatest(b-a,1e-12) desc, i limit 1",
    "dbscan_labels": f"{WITH_L} select pid, label from labels",
    "sweep_metrics": f"""{WITH_L}, m as (select * from labels where label>=0), spot as (select label, lat, lon, count(*) n from m group by all), c as (select label, clat lat, clon lon from {CENTRES.format(by='label', src='m')}),
rad as (select m.label, max({_distance('m', 'c')}) r from m join c on m.label=c.label group by 1), z as (select label, sum(n) reports, max(n) most from spot group by 1), y as (select * from z join rad using (label))
select 250.0::double eps, 5 least, (select count(*) from labels) points, count(*) cluster_count, (select count(*) from labels where label<0) noise_count, 100.0*(select count(*) from labels where label<0)/(select count(*) from labels) noise_percentage,
  coalesce(max(reports),0)::bigint largest_cluster, coalesce(max(reports)/sum(reports),0) largest_cluster_share, coalesce(median(reports),0) median_cluster, round_even(coalesce(max(r),0)*10,0) max_cluster_radius_m, coalesce(avg((most>=0.9*reports)::int),0) single_coordinate_cluster_share,
  concat_ws(' | ', case when count(*)=0 or 100.0*(select count(*) from labels where label<0)/(select count(*) from labels)>85 then 'almost everything is noise' end, case when max(reports)/sum(reports)>0.5 then 'one cluster holds most reports' end,
  case when count(*) between 1 and 2 and 100.0*(select count(*) from labels where label<0)/(select count(*) from labels)<10 then 'almost everything is merged' end, case when round_even(max(r)*10,0)>4000 then 'geographically huge' end, case when avg((most>=0.9*reports)::int)>0.25 then 'mostly repeated coordinates' end) warnings from y""",
    "sweep": f"""with recursive {I}, {P}, {GRID}, m as (select eps, least, label, pid, lat, lon, {_X} x, {_Y} y from lab where label>=0), spot as (select eps, least, label, lat, lon, count(*) n from m group by all),
c as (select eps, least, label, clat lat, clon lon from {CENTRES.format(by='eps, least, label', src='m')}), rad as (select m.eps, m.least, m.label, max({_distance('m', 'c')}) r from m join c on m.label=c.label and m.eps=c.eps and m.least=c.least group by all),
y as (select * from (select eps, least, label, sum(n)::bigint reports, max(n) most from spot group by all) join rad using (eps, least, label)),
g as (select eps, least, count(*) k, max(reports) big, sum(reports) s, median(reports) mid, max(r) r, avg((most>=0.9*reports)::int) single from y group by all),
t as (select eps, least, count(*) points, count(*) filter (label<0) noise from lab group by all),
nx as (select eps, lead(eps) over (order by eps) e2 from eps_), j as (select a.eps, a.least, e2, a.label la, b.label lb from lab a join nx on nx.eps=a.eps join lab b on b.eps=e2 and b.least=a.least and b.pid=a.pid),
cell as (select eps, least, e2, la, lb, count(*) n from j group by all), w as (select eps, least, e2, sum(n*(n-1)/2) i, sum(n)*(sum(n)-1)/2 a from cell group by all),
xx as (select eps, least, e2, sum(q*(q-1)/2) v from (select eps, least, e2, la, sum(n) q from cell group by all) group by all), yy as (select eps, least, e2, sum(q*(q-1)/2) v from (select eps, least, e2, lb, sum(n) q from cell group by all) group by all),
ari as (select eps, least, e2, coalesce((i-xx.v*yy.v/a)/nullif((xx.v+yy.v)/2-xx.v*yy.v/a,0),1) ari from w join xx using (eps, least, e2) join yy using (eps, least, e2)),
st as (select eps, least, avg(ari) stability_ari from (select eps, least, ari from ari union all select e2, least, ari from ari) group by all),
d as (select a.eps, a.least, a.pid, a.label, b.label o, avg(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) d from m a join m b on a.eps=b.eps and a.least=b.least group by all),
e as (select d.eps, d.least, pid, z.reports n, max(case when d.label=o then d*z.reports/nullif(z.reports-1,0) end) a, min(case when d.label<>o then d end) b from d join y z on z.eps=d.eps and z.least=d.least and z.label=d.label group by all),
si as (select e.eps, e.least, case when max(g.k)>=2 and max(g.s)>max(g.k) then round_even(avg(case when n=1 then 0 else coalesce((b-a)/nullif(greatest(a,b),0),0) end)*1e6,0) end silhouette from e join g on g.eps=e.eps and g.least=e.least group by all),
v as (select t.eps, t.least, points, coalesce(k,0) cluster_count, noise noise_count, 100.0*noise/points noise_percentage, coalesce(big,0) largest_cluster, coalesce(big/s,0) largest_cluster_share, coalesce(mid,0) median_cluster, round_even(coalesce(r,0)*10,0) max_cluster_radius_m, coalesce(single,0) single_coordinate_cluster_share
  from t left join g on g.eps=t.eps and g.least=t.least)
select v.*, stability_ari, silhouette, concat_ws(' | ', case when cluster_count=0 or noise_percentage>85 then 'almost everything is noise' end, case when cluster_count>0 and largest_cluster_share>0.5 then 'one cluster holds most reports' end,
  case when cluster_count between 1 and 2 and noise_percentage<10 then 'almost everything is merged' end, case when max_cluster_radius_m>40000 then 'geographically huge' end, case when single_coordinate_cluster_share>0.25 then 'mostly repeated coordinates' end) warnings
from v left join st on st.eps=v.eps and st.least=v.least left join si on si.eps=v.eps and si.least=v.least""",
    "sanity_warnings": f"""with {I}, n as (select run_id, count(*) n from i where usable and is_target and not pin group by 1), m as (select run_id, count(*) k, 100.0*(max(n)-sum(report_count))/max(n) noise, max(report_count)/sum(report_count) share, max(approx_radius_meters) r, avg(single_coordinate_cluster::int) single from cluster_summary join n using (run_id) group by 1)
select run_id, concat_ws(' | ', case when noise>85 then 'almost everything is noise' end, case when share>0.5 then 'one cluster holds most reports' end, case when k<=2 and noise<10 then 'almost everything is merged' end,
  case when r>4000 then 'geographically huge' end, case when single>0.25 then 'mostly repeated coordinates' end) warnings from m""",
    "silhouette": f"""{WITH_L}, c as (select pid, label, {_X} x, {_Y} y from labels where label>=0), z as (select label, count(*) n from c group by 1),
d as (select a.pid, a.label, b.label o, avg(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) d from c a cross join c b group by all),
e as (select pid, z.n, max(case when d.label=o then d*z.n/nullif(z.n-1,0) end) a, min(case when d.label<>o then d end) b from d join z using (label) group by all)
select count(*) n, case when (select count(*) from z)>=2 and count(*)>(select count(*) from z) then round_even(avg(case when n=1 then 0 else coalesce((b-a)/nullif(greatest(a,b),0),0) end)*1e6,0) end score_e6 from e""",
    "ari": f"""with recursive {I}, {P}, {L}, {_labels(300, 5, 'other')}, j as (select a.label la, b.label lb from labels a join other b on a.pid=b.pid),
cell as (select la, lb, count(*) n from j group by all), x as (select sum(m*(m-1)/2) v from (select sum(n) m from cell group by la)), y as (select sum(m*(m-1)/2) v from (select sum(n) m from cell group by lb)), w as (select sum(n*(n-1)/2) i, sum(n)*(sum(n)-1)/2 t from cell)
select 5 least, coalesce((i-x.v*y.v/t)/nullif((x.v+y.v)/2-x.v*y.v/t,0),1) ari from w, x, y""",
    "cluster_table": f"""{WITH_L}, spot as (select label, lat, lon, count(*) n, min(month) a, max(month) b from labels join (select rowid_, month from i) on pid=rowid_ where label>=0 group by all)
select label, sum(n)::bigint report_count, count(*) distinct_coordinates, max(n)>=0.9*sum(n) single_coordinate, min(a) first_month, max(b) last_month, min(lat) bbox_min_lat, min(lon) bbox_min_lon, max(lat) bbox_max_lat, max(lon) bbox_max_lon from spot group by 1""",
    "pin_sensitivity": f"with recursive {I}, {PINS}, {L} select max(label)+1 clusters, count(*) filter (label<0) noise, count(*) points, (select max(n) from (select count(*) n from i where usable and is_target and pin group by lat, lon)) largest_pin from labels",
    "size_summary": f"""{WITH_L}, m as (select * from labels where label>=0), spot as (select label, lat, lon, count(*) n from m group by all), z as (select label, sum(n)::bigint reports, max(n) most from spot group by 1),
c as (select label, clat lat, clon lon from {CENTRES.format(by='label', src='m')}), rad as (select m.label, round_even(max({_distance('m', 'c')})*10,0) r from m join c on m.label=c.label group by 1)
select min(reports) least, median(reports) median, count(*) filter (reports<=7) small, count(*) filter (most>=0.9*reports) single_coordinate, max(reports)/sum(reports) largest_share, min(r) radius_min, max(r) radius_max, median(r) radius_median from z join rad using (label)""",
    "hotspot_rank": "select run_id, cluster_id, row_number() over (partition by run_id order by report_count desc nulls last, density_reports_per_km2 desc nulls last, cluster_id)::int as position from cluster_summary",
    "category_distribution": f"with {I} select category, sub_category, is_target, count(*) complaints, 100.0*count(*)/sum(count(*)) over () pct from i group by all",
    "top_categories": f"with {I} select category, count(*) complaints, 100.0*count(*)/sum(count(*)) over () pct from i group by all order by complaints desc, category limit 5",
    "status_counts": f"with {I} select status, count(*) complaints from i where is_target group by all",
    "coordinate_quality": f"with {I}, f as (select *, {FLAGS} from i) " + " union all ".join(f"select '{scope}' as scope, '{name}' as \"check\", count(*) filter ({mask}) complaints, coalesce(100.0*count(*) filter ({mask})/nullif(count(*),0),0) pct from f{where}" for scope, where in (("all", ""), ("target", " where is_target")) for name, mask in _CHECKS.items()),
    "dup_stats": f"""with {I}, r as (select request_id, count(*) n, count(*) filter (is_target) t from i group by 1), a as (select lat, lon, count(*) n, count(*) filter (is_target) t from i where lat is not null and lon is not null group by all)
select (select sum(n-1)::bigint from r) repeated_all, (select sum(greatest(t-1,0))::bigint from r) repeated_target, count(*) places_all, count(*) filter (t>0) places_target, coalesce(sum(n) filter (n>1),0)::bigint sharing_all, coalesce(sum(t) filter (t>1),0)::bigint sharing_target,
  max(n) most_all, max(t) most_target, {', '.join(f'coalesce(sum(t) filter (n>={k}),0)::bigint target_at_{k}' for k in (3, 5, 8, 15, 30))} from a""",
    "dup_coordinates": f"""with {I} select run_id, round_even(lat*1000,0)/1000 lat, round_even(lon*1000,0)/1000 lon, complaints, targets, kinds, months, first_report, last_report, pin from (
select run_id, lat, lon, count(*) complaints, count(*) filter (is_target) targets, count(distinct sub_category) kinds, count(distinct month) as months, min(reported) first_report, max(reported) last_report, bool_and(pin) pin
from i where lat is not null and lon is not null group by all having count(*)>=2 and count(*) filter (is_target)>=1)""",
    "multiplicity_hist": "select multiplicity, count(*) places from (select count(*) multiplicity from complaints where latitude is not null and longitude is not null group by latitude, longitude) group by 1 order by 1 limit 12",
    "exact_dups": "select (count(*)-(select count(*) from (select distinct * from lineitem)))::bigint copies from lineitem union all select (count(*)-(select count(*) from (select distinct * from spatial_unit_monthly)))::bigint from spatial_unit_monthly",
    "repeat_marks": "select rowid_, row_number() over (partition by request_id order by run_id, rowid_)>1 is_repeat, count(*) over (partition by request_id)>1 has_copy from complaints",
    "data_gate": f"""with {I}, f as (select *, {FLAGS} from i), v as (select *, not (null_coord or out_of_range or zero_zero or swapped) valid from f)
select count(*) complaints, count(*) filter (is_target and usable and not pin) usable_targets, count(distinct month) filter (is_target and usable and not pin) as months, count(*) filter (month is null) undated, count(distinct month) months_with_data,
  min(month) first_month, max(month) last_month, count(*) filter (in_boundary) inside_boundary, 100.0*count(*) filter (in_boundary)/count(*) inside_boundary_pct, min(lat) lat_min, max(lat) lat_max, min(lon) lon_min, max(lon) lon_max,
  count(*) filter (null_coord) missing_coordinates, 100.0*count(*) filter (null_coord)/count(*) missing_coordinates_pct, count(*) filter (valid) valid_coordinates, count(*) filter (is_target) targets, count(*) filter (is_target and valid) valid_targets,
  count(*) filter (is_target and usable) targets_inside, count(*) filter (is_target and usable and pin) target_pins_inside, min(month) filter (is_target) first_target_month, max(month) filter (is_target) last_target_month,
  count(*) filter (is_target and usable and not pin)>=500 and count(distinct month) filter (is_target and usable and not pin)>=24 passed from v""",
    "yearly_totals": f"with {I} select left(month,4) as year, count(*) complaints, count(*) filter (is_target) targets from i where month is not null group by 1",
    "distance_bands": f"""{WITH_L}, m as (select label, {_distance('labels', 'z')}/1000 km from labels, {_CENTRE} z), bands as (select label, case when km<=0 then null when km<=5 then '0-5' when km<=10 then '5-10' when km<=15 then '10-15' when km<=100 then '15-100' end band from m)
select band, count(*) points, count(*) filter (label<0) noise from bands where band is not null group by 1""",
    "density_terciles": f"""{WITH_L}, {KNN}, o as (select pid, row_number() over (order by metres, pid) r, count(*) over () n from kd where k=5), t as (select pid, case when r<=1+(n-1)/3 then 1 when r<=1+(n-1)*2/3 then 2 else 3 end third from o)
select third, count(*) points, count(*) filter (label<0) noise from t join labels using (pid) group by 1""",
    "zone_rollup": f"{WITH_L} select zone, count(*) points, count(*) filter (label>=0) clustered from labels join i on pid=rowid_ join wards w on i.ward_id=w.ward_id group by 1 order by points desc, zone limit 5",
    "summary": f"""with {I}, a as (select run_id, count(*) complaints, count(*) filter (is_target) targets, count(*) filter (is_target and usable and not pin) analysed, min(month) first_month, max(month) last_month from i group by 1), b as (select run_id, count(*) hotspots, max(report_count) largest from cluster_summary group by 1)
select a.*, coalesce(hotspots,0) hotspots, coalesce(largest,0) largest from a left join b on a.run_id=b.run_id""",
    "city_timeline": f"with {I}, {SERIES} select month, sum(target_reports)::bigint target_reports, sum(all_reports)::bigint all_reports from s group by 1",
    "null_rate": f"with {I}, {MONTHS}, {RING} select round_even((select count(*) from i where is_target and usable and not pin)/((select sum(area_km2) from areas)*(select count(*) from months))*1e9,0) rate_e9",
    "poisson_threshold": f"with {I}, {MONTHS}, {RATED} select unit, active_threshold from th",
    "threshold_hist": f"with {I}, {MONTHS}, {RATED} select active_threshold, count(*) wards from th group by 1",
    "binomial_threshold": f"with {I}, {SERIES}, {METRICS} select unit ward_id, needed_months as months from um",
    "active_flag": f"with {I}, {SERIES}, {RATED} select s.unit, month, (target_reports>=active_threshold)::int active from s join th on s.unit=th.unit",
    "unit_metrics": f"with {I}, {SERIES}, {METRICS} select * from um",
    "persistent_count": f"with {I}, {SERIES}, {METRICS} select case when count(persistent)>0 then count(*) filter (persistent) end persistent from um",
    "early_share": f"with {I}, {SERIES}, {METRICS} select coalesce(sum(target_reports) filter (month<'2021-01'),0)/greatest(coalesce(sum(target_reports),0),1) share from s where unit in (select unit from um where persistent)",
    "recent_activity": f"""with {I}, {SERIES}, r as (select *, row_number() over (partition by unit order by month desc) r from s), h as (select unit, count(*) n, sum(target_reports) filter (r<=3) recent, coalesce(sum(target_reports) filter (r>3),0) older from r group by 1)
select unit, case when n>=15 then recent::bigint end recent_count, case when n>=15 then older/(n-3) end historical_average, case when n>=15 and older>0 then (recent/3-older/(n-3))/(older/(n-3)) end change, case when n<15 then 'Insufficient data' when older=0 then 'No historical activity' else 'ok' end status from h""",
    "unit_share": f"with {I}, {SERIES} select unit, sum(target_reports)/nullif(sum(all_reports),0) share from s group by 1",
    "kendall_tau": f"with {I}, {SERIES}, {TREND} select unit, valid, case when valid and flat then 0 when valid then tau end tau, case when valid and flat then 0 when valid then s end s from tr",
    "theil_sen": f"with {I}, {SERIES}, {TREND} select unit, case when valid and flat then 0 when valid then slope end slope from tr",
    "trend_labels": f"with {I}, {SERIES}, {TREND}, {LABELS} select unit, tau, round_even(p*1e6,0)/1e6 p_value, round_even(q*1e6,0)/1e6 q_value, trend from lt",
    "city_trend": f"""with {I}, {SERIES}, ct as (select month, sum(target_reports) t, sum(all_reports) a from s group by 1), cs as (select 'count' unit, month, t::double y from ct union all select 'share', month, round_even(coalesce(t/nullif(a,0),0)*1000,0) from ct),
{TREND.replace("row_number() over (partition by unit order by month)-1 i from s)", "row_number() over (partition by unit order by month)-1 i from cs)").replace("target_reports y", "y")}, {LABELS} select unit, tau, slope, round_even(p*1e6,0)/1e6 p_value, trend from lt""",
    "bh_adjust": """with r as (select run_id, cluster_id, complaint_share p, row_number() over (order by complaint_share) k, count(*) over () n from cluster_summary where complaint_share is not null)
select run_id, cluster_id, p, least(1.0, min(p*n/k) over (order by k rows between current row and unbounded following)) q from r union all select run_id, cluster_id, complaint_share, null from cluster_summary where complaint_share is null""",
    "cluster_monthly": f"""{WITH_L}, {MONTHS}, {FOOT}, g as (select label, month, count(*) filter (is_target) t from labels join i on pid=rowid_ where label>=0 group by all), h as (select label, month, count(*) n from inside group by all), u as (select distinct label from labels where label>=0)
select u.label unit, m.month, coalesce(t,0) target_reports, coalesce(n,0) all_reports, coalesce(t,0)/nullif(coalesce(n,0),0) share from u cross join months m left join g on g.label=u.label and g.month=m.month left join h on h.label=u.label and h.month=m.month""",
    "cluster_denominators": f"{WITH_L}, {FOOT} select label, count(*) complaints, count(*) filter (is_target) targets from inside group by 1",
    "hotspots_query": """with k as (select *, count(*) over () matched, try_cast(recent_3_month_count as double) x from cluster_summary where report_count>=10 and observed_trend='Stable')
select run_id, cluster_id, recent_3_month_count, report_count, matched from k order by x is null desc, coalesce(x,0) desc, run_id, cluster_id limit 50""",
    "unit_timeline": "select run_id, month, pothole_reports, all_complaints from (select distinct * from spatial_unit_monthly) where unit_type='ward' and unit_id=68",
    "stored_city_timeline": "select run_id, month, sum(pothole_reports)::bigint pothole_reports, sum(all_complaints)::bigint all_complaints from (select distinct * from spatial_unit_monthly) where unit_type='ward' group by all",
    "top15_share": f"with {I} select ward_id, count(*) complaints, count(*) filter (is_target) targets, count(*) filter (is_target)/count(*) share from i where ward_id>=1 group by 1 having count(*)>=50 order by share desc, ward_id limit 15",
    "top15_count": f"with {I} select ward_id, count(*) targets from i where is_target and ward_id>=1 group by 1 order by targets desc, ward_id limit 15",
    "secondary_counts": f"""with {_WARD}, {I}, a as (select w ward_id, count(*) n from i join inside x on i.lat=x.lat and i.lon=x.lon where run_id=2 group by 1), b as (select ward_id, count(*) n from i where run_id=1 and is_target and usable and ward_id>=0 group by 1)
select coalesce(a.ward_id,b.ward_id) ward_id, coalesce(a.n,0) as second, coalesce(b.n,0) as first from a full join b on a.ward_id=b.ward_id""",
    "secondary_comparison": f"""with {I}, {_WARD}, second as (select w ward_id, count(*) n from i join inside x on i.lat=x.lat and i.lon=x.lon where run_id=2 group by 1), prim as (select ward_id, count(*) n from i where run_id=1 and is_target and usable and ward_id>=0 group by 1),
j as (select coalesce(a.ward_id,b.ward_id) ward_id, coalesce(a.n,0) s, coalesce(b.n,0) f from second a full join prim b on a.ward_id=b.ward_id), r as (select rank() over (order by s) + (count(*) over (partition by s)-1)/2 a, rank() over (order by f) + (count(*) over (partition by f)-1)/2 b from j),
c as (select count(*) n, corr(a,b) rho from r), t as (select n-2 v, rho*sqrt((n-2)/(1-rho*rho)) t from c),
simpson as (select v, t, sum((case when k in (0,20000) then 1 when k%2=1 then 4 else 2 end)*pow(1+pow(t*k/20000,2)/v,-(v+1)/2))*abs(t)/20000/3*exp(lgamma((v+1)/2)-lgamma(v/2))/sqrt(pi()*v) area from t, range(0,20001) q(k) group by v, t)
select (select n from c) wards, (select sum(s)::bigint from j) second_inside, (select sum(f)::bigint from j) as "first", round_even((select sum(s) from j)/greatest((select sum(f) from j),1)*10,0)/10 ratio, round_even((select rho from c)*1e9,0)/1e9 rho, round_even((1-2*area)*1e6,0)/1e6 p_value,
  (select count(*) from ((select ward_id from j order by s desc, ward_id limit 20) intersect (select ward_id from j order by f desc, ward_id limit 20))) top_overlap from simpson""",
    "choropleth_breaks": """with o as (select density_reports_per_km2 v, row_number() over (order by density_reports_per_km2)-1 i, count(*) over () n from cluster_summary where density_reports_per_km2 is not null)
select x as level, v as value from o, (select unnest([0.2,0.4,0.6,0.8,0.95])::double x) where i=least(floor(x*n),n-1)""",
    "map_metric": "select run_id, cluster_id, complaint_share as value from cluster_summary",
    "ward_search": "select ward_id, name from wards where contains(lower(name),'nagar')",
}
