from oracle.base import cte, q, r, rs

WEATHER = ["NDVI", "et", "runoff", "precipitation", "temperature_2m", "dewpoint_temperature_2m",
           "surface_solar_radiation_downwards_sum", "surface_net_thermal_radiation_sum", "sm_surface", "sm_rootzone"]

_RAW = {"et": "total_evaporation_sum", "runoff": "runoff_sum", "precipitation": "total_precipitation_sum"}
cte("renamed", "select mws_id, step, date, latitude, longitude, state, district, tehsil, sensitivity_spei3, "
    'baseline_ndvi_mean, baseline_ndvi_std, n_obs, "SummaryQA", u_component_of_wind_10m, v_component_of_wind_10m, '
    + ", ".join(f'nullif({_RAW.get(c, chr(34) + c + chr(34))}, -9999) as "{c}"' for c in WEATHER) + " from src", "src")
cte("clean", 'select * from renamed where "NDVI" is not null and temperature_2m is not null', "renamed")
cte("split", """select * exclude (rn, n), case when rn <= floor(n * 0.7::double) then 'train'
  when rn <= floor(n * (0.7::double + 0.2::double)) then 'val' else 'test' end as split
  from (select *, row_number() over (partition by mws_id order by date) rn, count(*) over (partition by mws_id) n from clean)""",
    "clean")
cte("dreq", """select o_orderkey request_id, o_custkey plot_id, case o_orderkey % 10 when 0 then null
  when 1 then strftime(o_orderdate, '%Y') || '/01/01'
  when 2 then strftime(cast(o_orderdate as date) + 1500, '%Y-%m-%d')
  when 3 then strftime(o_orderdate, '%Y') || '-02-30' else strftime(o_orderdate, '%Y-%m-%d') end as_of_text from orders""")
SNAP = "({d} - cast(((date_diff('day', date '{e}', {d}) % 14) + 14) % 14 as int))"
CAL = """cast(year(date) as int) as year, cast(month(date) as int) as month, cast(dayofyear(date) as int) day_of_year, cast(quarter(date) as int) as quarter,
 case when month(date) in (12,1,2) then 1 when month(date) in (3,4,5) then 2 when month(date) in (6,7,8) then 3 else 4 end season"""

ORACLE = {
    "b01_rename_columns": q("select mws_id, step, " + ", ".join(
        f"{r(_RAW[c])} as {c}" for c in ("precipitation", "runoff", "et")) + " from src", "src"),
    "b02_sentinel_to_null": q(f"select mws_id, step, {rs(WEATHER)} from renamed", "renamed"),
    "b03_drop_unobserved": q(f"select mws_id, step, {rs(['NDVI', 'temperature_2m', 'et'])} from clean", "clean"),
    "b04_parse_dates": q("select mws_id, date from src", "src"),
    "b05_temporal_split": q("select mws_id, date, split from split", "split"),
    "b06_snap_to_grid": "select o_orderkey, d, " + SNAP.format(d="d", e="2017-07-01")
    + " as snapped from (select o_orderkey, cast(o_orderdate as date) d from orders)",
    "b07_resolve_forecast_dates": q(
        "select *, cast(anchor + 98 as date) target from (select *, " + SNAP.format(d="as_of", e="2017-07-01")
        + """ as anchor from (select request_id, plot_id, as_of_text, date_status, case when date_status='OK' then d end as_of
        from (select *, case when d is null then 'INVALID_DATE' when d > date '2001-06-01' then 'FUTURE_DATE' else 'OK' end date_status
        from (select *, case when as_of_text is null then date '2001-06-01'
          else cast(try_strptime(as_of_text, '%Y-%m-%d') as date) end d from dreq))))""", "dreq"),
    "b08_quarter_window": """select o_orderkey, 'Q' || quarter(o_orderdate) as quarter,
        cast(date_trunc('quarter', o_orderdate) as date) quarter_start,
        cast(date_trunc('quarter', o_orderdate) + interval 3 month as date) quarter_end from orders""",
    "b09_half_year": "select o_orderkey, case when month(o_orderdate) <= 6 then 'H1' else 'H2' end half from orders",
    "b10_calendar_features": q(f"select mws_id, date, {CAL} from grid", "grid"),
    "b11_days_since_start": q("""select mws_id, date, cast(date_diff('day', (select min(date) from clean), date) as int)
        days_since_start from clean""", "clean"),
    "b12_cyclic_features": q(f"""select mws_id, date, {r('sin(2*pi()*month(date)/12)')} month_sin,
        {r('cos(2*pi()*month(date)/12)')} month_cos, {r('sin(2*pi()*dayofyear(date)/365)')} doy_sin,
        {r('cos(2*pi()*dayofyear(date)/365)')} doy_cos from grid""", "grid"),
    "b13_location_key": q("select plot_id, printf('%.4f_%.4f', lat, lon) loc_key from plots", "plots"),
    "b14_utm_zone": q("""select plot_id, 'EPSG:' || (case when plot_id % 2 = 0 then 32700 else 32600 end
        + cast(floor((lon + 180)/6) as int) + 1) epsg from plots""", "plots"),
    "b15_days_ahead_mode": """select o_orderkey, target, cast(days_ahead as int) days_ahead, case when days_ahead <= 0 then 'historical'
        when days_ahead <= 98 then 'near_future' else 'far_future' end as mode, target - 98 as data_cutoff,
        case when days_ahead <= 0 then target else date '2000-06-01' end fetch_anchor,
        cast(case when days_ahead <= 0 then 267 else greatest(267 - floor(days_ahead/14), 1) end as int) fetch_steps
        from (select o_orderkey, cast(o_orderdate as date) target,
         date_diff('day', date '2000-06-01', cast(o_orderdate as date)) days_ahead from orders)""",
}
