"""DuckDB statements with the results of the general problems' queries."""

_R = "6371008.8"


def _distance(a: str, b: str) -> str:
    """Great-circle metres between aliases a and b with columns lat, lon."""
    return (
        f"2*{_R}*asin(sqrt(least(1.0, pow(sin((radians({b}.lat)-radians({a}.lat))/2),2)"
        f" + cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin((radians({b}.lon)-radians({a}.lon))/2),2))))"
    )


_BLANK = r"regexp_replace(created_at, '^\s+|\s+$', '', 'g')"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?"
_ISO = rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_CLOCK}\s*([+-]\d{{2}}(?::?\d{{2}})?)?\s*\[?([A-Za-z][A-Za-z_/]*)?\]?$"
_BASIC = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$"
_FIRST = rf"^(\d{{1,2}})[-/](\d{{1,2}})[-/](\d{{4}}|\d{{2}}) {_CLOCK}$"
_NAMED = rf"^(?:[A-Z][a-z]{{2}}, )?(\d{{1,2}}) ([A-Z][a-z]{{2}}) (\d{{4}}) {_CLOCK} ?([AP]M)?(GMT|[+-]\d{{4}})?$"

#: CTEs up to stamps(rowid_, utc_micros, local_month, local_day); for stamps as they occur in the tables.
STAMPS = rf"""
t as (select distinct created_at raw, {_BLANK} t from complaints where created_at is not null),
f as (
  select raw, t, regexp_extract(t,'{_ISO}',1) y, regexp_extract(t,'{_ISO}',2) m, regexp_extract(t,'{_ISO}',3) d,
    regexp_extract(t,'{_ISO}',4) h, regexp_extract(t,'{_ISO}',5) i, regexp_extract(t,'{_ISO}',6) s, regexp_extract(t,'{_ISO}',7) u,
    regexp_extract(t,'{_ISO}',8) o, regexp_extract(t,'{_ISO}',9) z, '' ap from t where regexp_matches(t,'{_ISO}')
  union all select raw, t, regexp_extract(t,'{_BASIC}',1), regexp_extract(t,'{_BASIC}',2), regexp_extract(t,'{_BASIC}',3),
    regexp_extract(t,'{_BASIC}',4), regexp_extract(t,'{_BASIC}',5), regexp_extract(t,'{_BASIC}',6), '', '', 'Z', '' from t where regexp_matches(t,'{_BASIC}')
  union all select raw, t, right('20'||regexp_extract(t,'{_FIRST}',3),4), regexp_extract(t,'{_FIRST}',1), regexp_extract(t,'{_FIRST}',2),
    regexp_extract(t,'{_FIRST}',4), regexp_extract(t,'{_FIRST}',5), regexp_extract(t,'{_FIRST}',6), regexp_extract(t,'{_FIRST}',7), '', '', '' from t where regexp_matches(t,'{_FIRST}')
  union all select raw, t, regexp_extract(t,'{_NAMED}',3), ((instr('JanFebMarAprMayJunJulAugSepOctNovDec', regexp_extract(t,'{_NAMED}',2))+2)//3)::varchar, regexp_extract(t,'{_NAMED}',1),
    regexp_extract(t,'{_NAMED}',4), regexp_extract(t,'{_NAMED}',5), regexp_extract(t,'{_NAMED}',6), regexp_extract(t,'{_NAMED}',7),
    replace(regexp_extract(t,'{_NAMED}',9),'GMT','+0000'), '', regexp_extract(t,'{_NAMED}',8) from t where regexp_matches(t,'{_NAMED}')),
g as (select raw, t, o, z, try_strptime(y||'-'||lpad(m,2,'0')||'-'||lpad(d,2,'0')||' '||
    lpad(case ap when '' then h when 'AM' then (h::int%12)::varchar else (h::int%12+12)::varchar end,2,'0')||':'||i||':'||
    case s when '' then '00' else s end, '%Y-%m-%d %H:%M:%S') c, coalesce(try_cast(left(rpad(u,6,'0'),6) as bigint),0) us from f),
k as (select raw, o, z, epoch_us(c)+us c, case when length(o)>0 then (left(o,1)||'1')::int*(substr(o,2,2)::int*60+coalesce(try_cast(right(replace(o,':',''),2) as int),0)*(length(o)>3)::int)
    when z in ('Z','GMT','UTC') then 0 when z in ('','IST','Asia/Kolkata') then 330 when z='EST' then -300 when z='EDT' then -240 end east from g where c is not null),
w as (select raw, list_distinct(list_filter([epoch_us(timezone(z, make_timestamp(c - 86400000000))) + 86400000000, epoch_us(timezone(z, make_timestamp(c + 86400000000))) - 86400000000],
      lambda u: epoch_us(timezone(z, make_timestamptz(u))) = c)) us from k where east is null),
e as (select raw, c-east::bigint*60000000 us from k where east is not null union all select raw, us[1] from w where len(us)=1
  union all select raw, t::bigint*case length(t) when 10 then 1000000 else 1000 end from t where regexp_matches(t,'^(\d{{10}}|\d{{13}})$')),
stamps as (select c.rowid_, e.us utc_micros, strftime(make_timestamp(e.us+19800000000),'%Y-%m') local_month, make_timestamp(e.us+19800000000)::date local_day
  from complaints c join e on c.created_at=e.raw)"""

_PLACES = "select run_id, latitude, longitude, count(*) n from complaints where latitude is not null and longitude is not null group by all"

_WARD = """
edges as (select ward_id, r[i].lon x1, r[i].lat y1, r[i+1].lon x2, r[i+1].lat y2 from (select ward_id, r, unnest(range(1,len(r))) i from (select ward_id, unnest(rings) r from wards))),
spots as (select distinct latitude lat, longitude lon from complaints where latitude is not null and longitude is not null),
hit as (select lat, lon, ward_id from spots join edges on (y1>lat)<>(y2>lat) and lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 group by all having count(*)%2=1),
inside as (select lat, lon, max(ward_id) w from hit group by all)"""

ORACLE = {
    "p1_found": f"with {STAMPS} select rowid_, utc_micros, local_month from stamps",
    "p1_month_conflicts": f"with {STAMPS} select month, local_month, count(*) complaints from stamps join complaints using (rowid_) where month is distinct from local_month group by all",
    "p2_found": f"""
with n as ({_PLACES})
select 'complaint' kind, rowid_::bigint key_id from complaints c join n using (run_id, latitude, longitude)
  where coord_multiplicity is distinct from n or suspect_fallback_pin is distinct from (n>=8)::int
union select 'pin', pin_id from duplicate_coordinate_analysis d left join n using (run_id, latitude, longitude) where reports_all_categories is distinct from coalesce(n,0)""",
    "p2_profile": """
with c as (select * from complaints where latitude is not null and longitude is not null),
s as (select run_id, latitude, longitude, sub_issue_type v, count(*) w from c where v is not null group by all),
m as (select run_id, latitude, longitude, month v, count(*) w from c where v is not null group by all)
select run_id, latitude, longitude, total, coalesce(sub_issue_type_distinct,0) sub_issue_type_distinct, sub_issue_type_mode, coalesce(month_distinct,0) month_distinct, month_mode, ward_id_p50
from (select run_id, latitude, longitude, count(*) total, quantile_cont(ward_id::double, 0.5) ward_id_p50 from c group by all)
left join (select run_id, latitude, longitude, count(*) sub_issue_type_distinct, first(v order by w desc, v) sub_issue_type_mode from s group by all) using (run_id, latitude, longitude)
left join (select run_id, latitude, longitude, count(*) month_distinct, first(v order by w desc, v) month_mode from m group by all) using (run_id, latitude, longitude)""",
    "p3_found": f"""
with {_WARD},
p as (select rowid_, run_id, latitude lat, longitude lon, floor(latitude/0.0003)::bigint g from complaints where latitude between -90 and 90 and longitude between -180 and 180),
q as (select *, unnest([g-1,g,g+1]) h from p)
select 'near' kind, p.rowid_::bigint id_lo, q.rowid_::bigint id_hi from p join q on p.run_id=q.run_id and p.g=q.h and p.rowid_<q.rowid_
  where abs(p.lon-q.lon)<0.01 and (p.lat<>q.lat or p.lon<>q.lon) and {_distance('p', 'q')} <= 25
union all select 'ward', coalesce(w,-1)::bigint, rowid_::bigint from complaints c left join inside i on c.latitude=i.lat and c.longitude=i.lon
  where c.latitude is not null and c.longitude is not null and coalesce(ward_id,-1)<>coalesce(w,-1)""",
    "p5_found": f"""
with {STAMPS},
dated as (select run_id, ward_id, local_day as day, request_id from stamps join complaints using (rowid_)),
daily as (select run_id, ward_id, day, count(distinct request_id) x from dated where ward_id>=1 group by all),
lasts as (select run_id, max(day) z from dated group by all),
span as (select run_id, ward_id, min(day) a from daily group by all),
days as (select run_id, ward_id, a, unnest(generate_series(a, z, interval 1 day))::date as day from span join lasts using (run_id)),
roll as (select run_id, ward_id, a, day, sum(coalesce(x,0)) over (partition by run_id, ward_id order by day rows between 6 preceding and current row) t7,
  sum(coalesce(x,0)) over (partition by run_id, ward_id order by day rows between 29 preceding and current row) t30 from days left join daily using (run_id, ward_id, day)),
m as (select distinct * from spatial_unit_monthly), l as (select run_id, max(month) z from m group by all),
r as (select run_id, unit_id, sum(pothole_reports) x from m join l using (run_id) where unit_type='cluster'
  and month>=strftime(strptime(z||'-01','%Y-%m-%d') - interval 2 month,'%Y-%m') group by all)
select 'ward' kind, run_id, ward_id unit_id, strftime(day,'%Y-%m-%d') period from roll where day>=a+29 and t7>=6 and 10*t7>=7*t30
union all select 'cluster', c.run_id, c.cluster_id, l.z from cluster_summary c join l using (run_id) left join r on r.run_id=c.run_id and r.unit_id=c.cluster_id
  where try_cast(recent_3_month_count as double)<>coalesce(x,0)""",
    "p5_ward_days": f"""
with {STAMPS},
dated as (select run_id, ward_id, local_day as day, request_id from stamps join complaints using (rowid_)),
daily as (select run_id, ward_id, day, count(distinct request_id) x from dated where ward_id>=1 group by all),
lasts as (select run_id, max(day) z from dated group by all),
span as (select run_id, ward_id, min(day) a from daily group by all),
days as (select run_id, ward_id, unnest(generate_series(a, z, interval 1 day))::date as day from span join lasts using (run_id)),
roll as (select run_id, ward_id, day, sum(coalesce(x,0)) over (partition by run_id, ward_id order by day rows between 6 preceding and current row)::bigint t7,
  sum(coalesce(x,0)) over (partition by run_id, ward_id order by day rows between 29 preceding and current row)::bigint t30 from days left join daily using (run_id, ward_id, day))
select run_id, ward_id, strftime(day,'%Y-%m-%d') as day, t7, t30, t7/7 avg7, t30/30 avg30 from roll""",
}
