"""Shared WITH clauses of the DuckDB twins. ``q(tail, *names)`` prefixes only what a query needs."""

EPOCH = "date '1995-01-02'"
W = "over (partition by mws_id order by date"
CTE: dict[str, tuple[list[str], str]] = {}


def cte(name, sql, *deps):
    CTE[name] = (list(deps), sql)


def q(tail: str, *names: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTE[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "with " + ",\n".join(f"{n} as materialized ({CTE[n][1]})" for n in order) + "\n" + tail


def r(expr, digits=6):
    """Rounded like the Spark side (same nudge); + 0.0 turns a negative zero into zero."""
    return f"(round(({expr}) + 1e-9, {digits}) + 0.0)"


def rs(cols, digits=6):
    return ", ".join(f'{r(c, digits)} as "{c}"' for c in cols)


cte("loc", """
select cast(s_suppkey as varchar) mws_id, s_suppkey loc_no,
  8.0 + ((s_suppkey*37) % 1000)*0.028::double latitude, 68.0 + ((s_suppkey*91) % 1000)*0.029::double longitude,
  cast(n_regionkey as varchar) state, cast(s_nationkey as varchar) district,
  s_nationkey || '-' || (s_suppkey % 3) tehsil, (s_suppkey % 17)/17.0::double sensitivity_spei3
from supplier join nation on s_nationkey = n_nationkey""")

cte("obs", f"""
select *, cast(floor(dd/14.0::double) as int) step, cast(dd % 14 as int) day_in_step from (
select cast(l_suppkey as varchar) mws_id, cast(l_shipdate as date) obs_date,
  date_diff('day', {EPOCH}, cast(l_shipdate as date)) dd,
  cast(round(l_discount*100000) as int) "NDVI_raw",
  l_quantity*0.001::double total_precipitation_m, l_quantity*l_tax*0.001::double runoff_m,
  -(l_quantity*l_discount)*0.001::double evaporation_m,
  280.0::double + l_tax*250.0::double temperature_2m,
  270.0::double + l_tax*200.0::double + l_discount*10.0::double dewpoint_temperature_2m,
  l_linenumber - 3.5::double u_component_of_wind_10m, l_quantity/10.0::double - 2.5::double v_component_of_wind_10m,
  l_extendedprice surface_solar_radiation_downwards_sum,
  l_tax - l_extendedprice/10.0::double surface_net_thermal_radiation_sum,
  0.05::double + l_tax sm_surface, 0.1::double + l_discount sm_rootzone, (l_linenumber-1) % 4 "SummaryQA"
from lineitem)""")

cte("grid", f"""
select mws_id, cast(step as int) step, {EPOCH} + cast(step as int)*14 as date from loc, (
  select unnest(range(lo, hi + 1)) step from (select min(step) lo, max(step) hi from obs))""", "loc", "obs")
cte("years", "select unnest(range(lo + 1, hi + 1)) y from (select year(min(obs_date)) lo, year(max(obs_date)) hi from obs)", "obs")

cte("src", f"""
select c.*, b.baseline_ndvi_mean, b.baseline_ndvi_std from (
 select l.mws_id, g.step, g.date, l.latitude, l.longitude, l.state, l.district, l.tehsil, l.sensitivity_spei3,
  a.n_obs, a."NDVI", a.total_precipitation_sum, a.runoff_sum, a.total_evaporation_sum, a.temperature_2m,
  a.dewpoint_temperature_2m, a.u_component_of_wind_10m, a.v_component_of_wind_10m,
  a.surface_solar_radiation_downwards_sum, a.surface_net_thermal_radiation_sum,
  case when l.loc_no % 10 = 0 or l.district = '3' or l.state = '4' then null else a.sm_surface end sm_surface,
  a.sm_rootzone, a."SummaryQA"
 from loc l join grid g on l.mws_id = g.mws_id left join (
  select mws_id, step, count(*) n_obs, median("NDVI_raw")*0.0001::double "NDVI",
   sum(total_precipitation_m*1000) total_precipitation_sum, sum(runoff_m*1000) runoff_sum,
   case when count(*)=1 then -9999.0::double else sum(evaporation_m*-1000) end total_evaporation_sum,
   avg(temperature_2m) temperature_2m, avg(dewpoint_temperature_2m) dewpoint_temperature_2m,
   avg(u_component_of_wind_10m) u_component_of_wind_10m, avg(v_component_of_wind_10m) v_component_of_wind_10m,
   avg(surface_solar_radiation_downwards_sum) surface_solar_radiation_downwards_sum,
   avg(surface_net_thermal_radiation_sum) surface_net_thermal_radiation_sum,
   avg(sm_surface) sm_surface, avg(sm_rootzone) sm_rootzone, median("SummaryQA") "SummaryQA"
  from obs group by 1,2) a on a.mws_id = g.mws_id and a.step = g.step) c
join (select mws_id, avg("NDVI") baseline_ndvi_mean, stddev_samp("NDVI") baseline_ndvi_std from (
  select mws_id, step, median("NDVI_raw")*0.0001::double "NDVI" from obs group by 1,2) group by 1) b
on b.mws_id = c.mws_id""", "loc", "grid", "obs")

cte("tiles", """
select mws_id, cast(y as int) tile_year, 'Q' || qq period,
  ((loc_no*7 + y*13 + qq*29) % 100)/100.0::double coverage
from loc, years, range(1,5) u(qq) where (loc_no+y+qq) % 5 <> 0""", "loc", "years")

cte("plots", """
select *, 'd' || cast(floor(lat*2) as int) || '_t' || cast(floor(lon*2) as int) tile from (
select c_custkey plot_id, 19.0::double + ((c_custkey*7919)%2800)*0.001::double + case when c_custkey % 50 = 7 then 5.0::double else 0 end lat,
 76.0::double + ((c_custkey*104729)%2900)*0.001::double lon,
 case c_custkey % 3 when 0 then 'rain-fed' when 1 then 'irrigated' end regime from customer)""")
