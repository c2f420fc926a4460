from oracle.base import EPOCH, cte, q, r, rs

STATE = ["temperature_2m", "dewpoint_temperature_2m", "u_component_of_wind_10m", "v_component_of_wind_10m",
         "surface_solar_radiation_downwards_sum", "surface_net_thermal_radiation_sum"]
FLUX = ["precipitation", "runoff", "et"]
SOIL = ["sm_surface", "sm_rootzone"]
VALUES = [*STATE, *FLUX, *SOIL, "NDVI", "SummaryQA"]
GAP = ["NDVI", "precipitation", "temperature_2m", "sm_rootzone", "sm_surface", "et", "runoff"]
COMPL = ["NDVI", "precipitation", "temperature_2m", "sm_rootzone", "et"]
BANDS = ["blue", "green", "red", "nir", "swir1", "swir2"]

# one aggregate per source, joined on (mws_id, step)
cte("own", "select mws_id, step, " + ", ".join(f"avg({c}) {c}" for c in STATE) + """,
  sum(total_precipitation_m*1000) precipitation, sum(runoff_m*1000) runoff, sum(evaporation_m*-1000) et
  from obs group by 1,2""", "obs")
cte("soil", "select mws_id, step, avg(sm_surface) sm_surface, avg(sm_rootzone) sm_rootzone from obs where day_in_step < 3 group by 1,2", "obs")
cte("comp16", """select mws_id, s step, median("NDVI_raw")*0.0001::double "NDVI", median("SummaryQA") "SummaryQA" from (
  select *, step s from obs union all select *, step - 1 s from obs where day_in_step < 2 and step > 0) group by 1,2""", "obs")
cte("wide", """select m.mws_id, m.step, m."NDVI", m."SummaryQA", o.* exclude (mws_id, step), s.* exclude (mws_id, step),
  (o.mws_id is not null) has_own, (s.mws_id is not null) has_soil
  from comp16 m left join own o using (mws_id, step) left join soil s using (mws_id, step)""", "own", "soil", "comp16")
cte("hist", f"""select g.mws_id, g.step, g.date, w.* exclude (mws_id, step, "SummaryQA", has_own, has_soil),
  coalesce(w."SummaryQA", 3) "SummaryQA",
  case when w."NDVI" is not null then 1 else 0 end is_real_ndvi, case when has_soil then 1 else 0 end is_real_smap,
  case when has_own then 1 else 0 end is_real_era5, case when has_own then 1 else 0 end is_real_chirps,
  case when w."NDVI" is not null then 0.4::double else 0 end + case when has_own then 0.2::double else 0 end
  + case when has_soil then 0.2::double else 0 end + case when has_own then 0.2::double else 0 end coverage_fraction
  from grid g left join wide w on g.mws_id = w.mws_id and g.step = w.step""", "grid", "wide")
cte("targets", """select distinct cast(o_custkey as varchar) mws_id, cast(o_orderdate as date) target
  from orders join supplier on o_custkey = s_suppkey""")
FILL = {**{c: -9999 for c in STATE + FLUX}, "sm_surface": 0.2, "sm_rootzone": 0.2, "NDVI": 0.00004}
W = "over (partition by mws_id order by date"


def since(c, name):
    return (f'cast(rn - coalesce(max(case when {c} then rn end) {W} rows unbounded preceding), 0) as int) "{name}"')


cte("filled1", "select *, " + ", ".join(
    f'coalesce("{c}", lag("{c}",1) {W}), lag("{c}",2) {W})) as "f_{c}"' for c in GAP[1:]) + " from hist", "hist")
cte("filled", "select mws_id, step, date, is_real_ndvi, \"NDVI\", " + ", ".join(f'"{c}" as "o_{c}"' for c in GAP) + ", " + ", ".join(
    f'coalesce("f_{c}", lead("f_{c}",1) {W})) as "v_{c}"' for c in GAP[1:]) + " from filled1", "filled1")
cte("fresh", f"""select mws_id, step, date, {since('"NDVI" is not null', 'NDVI_steps_since_observed')},
  {since('precipitation is not null', 'precipitation_steps_since_observed')},
  {since('sm_rootzone is not null', 'sm_rootzone_steps_since_observed')}, ("NDVI" is null) miss
  from (select *, row_number() {W}) rn from hist)""", "hist")
LOST = """((cast(mws_id as bigint) % 4 = 1 and step between 60 and 75) or (cast(mws_id as bigint) % 11 = 2 and step > 30)
  or (cast(mws_id as bigint) % 13 = 3 and step > 70))"""
cte("patchy", "select mws_id, step, date, " + ", ".join(
    f'case when not {LOST} then "{c}" end as "{c}"' for c in COMPL[1:]) + f""",
  case when not {LOST} then case when cast(mws_id as bigint) % 17 = 4 then "NDVI"*0.2::double else "NDVI" end end "NDVI",
  case when {LOST} then 0.0::double else coverage_fraction end coverage_fraction from hist""", "hist")
cte("audit", f"""select mws_id, """ + ", ".join(
    f'avg(case when "{c}" is not null then 1.0::double else 0 end)*100 as "p_{c}"' for c in COMPL) + f""",
  round_even(avg(coverage_fraction)*100, 1) coverage_pct,
  count(*) filter (where coverage_fraction >= 0.5) valid_steps, max(gap) max_gap,
  count(*) filter (where back <= 18 and ("NDVI" is null or "NDVI" = 0)) recent_empty, avg("NDVI") mean_ndvi
  from (select *, {since('coverage_fraction >= 0.5', 'gap')} from (
    select *, row_number() {W}) rn, row_number() over (partition by mws_id order by date desc) back
    from patchy where date <= date '2001-06-01')) group by 1""", "patchy")
cte("daily", """select mws_id, loc_no, day_no, case when loc_no % 9 = 0 and day_no = 50 then null
    else cast((day_no*7 + loc_no) % 20 as double) end rain, case when loc_no % 11 = 0 then 99.0::double
    else cast(day_no % 15 + 15 as double) end temp
  from loc, range(0,100) t(day_no) where day_no < case when loc_no % 7 = 0 then 90 else 100 end""", "loc")
cte("dayagg", """select mws_id, count(*) as n_days, count(rain) rain_n, sum(rain) rain, avg(temp + 273.15::double) temp,
   count(*) >= 98 and count(rain) = count(*) rain_ok, count(*) >= 98 and count(temp) = count(*) temp_full
   from daily group by 1""", "daily")
FMT = "coalesce(printf('%.3f', round({x}, 4) + 0.00003::double), 'null')"
cte("daysteps", """select mws_id, string_agg(""" + FMT.format(x="p") + """, ',' order by b) ps, string_agg("""
    + FMT.format(x="t") + """, ',' order by b) ts from (select mws_id, day_no // 14 b, sum(rain) p, avg(temp + 273.15::double) t
   from daily where day_no < 98 group by 1,2) group by 1""", "daily")
cte("api", """select *, rain_ok and true p_ok, temp_full and temp > 250 and temp < 330 t_ok,
  concat_ws(',', case when not rain_ok then 'PRECIP_INCOMPLETE' end, case when temp_full and not (temp > 250 and temp < 330)
  then 'TEMP_IMPLAUSIBLE' end, case when not temp_full then 'TEMP_INCOMPLETE' end) reasons
  from dayagg join daysteps using (mws_id)""", "dayagg", "daysteps")
cte("wreq", "select mws_id, date '2001-11-05' + cast(loc_no % 60 as int) - 20 as target from loc", "loc")


def clim_hist(req):
    return f"""select q.mws_id, q.target, case when cnt = 7 and date_diff('day', e, q.target) <= 30 then ps end ps,
      case when cnt = 7 and date_diff('day', e, q.target) <= 30 then ts end ts,
      case when cnt = 7 and date_diff('day', e, q.target) <= 30 then psum end psum,
      case when cnt = 7 and date_diff('day', e, q.target) <= 30 then tmean end tmean
     from {req} q left join (select mws_id, target, count(*) cnt, any_value(e) e,
       coalesce(string_agg({FMT.format(x='precipitation')}, ',' order by date), '') ps,
       coalesce(string_agg({FMT.format(x='temperature_2m')}, ',' order by date), '') ts,
       sum(precipitation) psum, avg(temperature_2m) tmean from (
       select q.mws_id, q.target, h.date, precipitation, temperature_2m, e,
        row_number() over (partition by q.mws_id, q.target order by h.date desc) k
       from {req} q join (select *, max(date) over (partition by mws_id) e from hist) h
        on h.mws_id = q.mws_id and h.date <= q.target) where k <= 7 group by 1,2) c
     on c.mws_id = q.mws_id and c.target = q.target"""


cte("climw", clim_hist("wreq"), "wreq", "hist")
cte("weather", """select mws_id, target, 'P:' || case when p_ok then 'API' else 'CLIMATOLOGY' end || '|T:'
   || case when t_ok then 'API' else 'CLIMATOLOGY' end || case when reasons <> '' then '|REASONS:' || reasons else '' end forecast_source,
   case when p_ok then rain else coalesce(psum, 0) end precip_sum, case when t_ok then temp else coalesce(tmean, 298) end temp_mean
   from climw join api using (mws_id)""", "climw", "api")
cte("pix", """select cast(l_suppkey as varchar) mws_id, cast(year(l_shipdate) as int) tile_year, 'Q' || quarter(l_shipdate) period,
  cast(l_partkey % 4 as int) "row", l_linenumber % 4 col,
  ((l_orderkey + l_linenumber) % 16) & 14 = 0 clear, l_discount*2 blue, l_discount*3 green, l_tax*2 red,
  case when l_quantity < 5 then 0 else l_quantity*0.01::double end nir, l_tax*4 swir1, l_tax*3 + l_discount swir2 from lineitem""")
cte("cmp", 'select mws_id, tile_year, period, "row", col, ' + ", ".join(
    f"cast(coalesce(round(median(case when clear then {b} end)*10000), 0) as smallint) {b}" for b in BANDS)
    + " from pix group by 1,2,3,4,5", "pix")
cte("stale", """select t.mws_id, t.target anchor, max(h.date) last_obs from targets t left join patchy h
  on h.mws_id = t.mws_id and h.date <= t.target and h."NDVI" is not null group by 1,2""", "targets", "patchy")
STALE = "cast(case when last_obs is not null then greatest(round_even(date_diff('day', last_obs, anchor)/14.0::double, 0), 0) end as int)"
cte("flog", """select *, case when status = 'OK' then 'ok' when terminal then 'terminal'
  when regexp_matches(low, '429|too many requests|rate limit|quota|resource exhausted|rate_limit_exceeded') then 'rate_limit'
  when regexp_matches(low, 'coverage_fraction|missing columns|permission|quota|rate limit|ratelimit|429|500|502|503|504|timed out|timeout|deadline|temporarily|unavailable|connection|reset by peer|eof occurred|all-nan|returned no data|returned zero rows|partial fetch|access was denied|denied mid-batch|access denied|no satellite coverage')
   then 'transient' else 'other' end failure_class
 from (select *, lower(status) low, contains(status, 'no actual NDVI at target') or contains(status, 'no quarterly tile') terminal from (
  select event_id, ts, cast(user_id as varchar) mws_id, cast(ts as date) target, cast(event_id % 3 as int) + 1 sweep_no,
   cast(event_id % 4 as int) + 1 attempts, value query_time_s,
   case when event_type = 'error' then case when value < 5 then 'ERROR: HTTP 429 Too Many Requests'
   when value < 10 then 'ERROR: fetch returned no data (no satellite coverage)'
   when value < 20 then 'ERROR: no actual NDVI at target'
   when value < 30 then 'ERROR: HTTPSConnectionPool: Read timed out'
   when value < 40 then 'ERROR: HTTP Error 404: Not Found'
   when value < 50 then 'ERROR: no quarterly tile >= 0.75 coverage'
   when value < 60 then 'ERROR: date 2035-06-15 is in the future; it must be today or earlier'
   when value < 70 then 'ERROR: HTTP Error 401: Unauthorized'
   when value < 80 then 'ERROR: RESOURCE_EXHAUSTED: quota exceeded'
   when value < 90 then 'ERROR: plot forecast unavailable (no usable data at the plot)'
   else 'ERROR: boom' end else 'OK' end status from events))""")
LATEST = """select mws_id, target, sweep_no, status, attempts, query_time_s from flog
  qualify row_number() over (partition by mws_id, target order by sweep_no desc, event_id desc) = 1"""


def reduced(cols):
    return q(f"select mws_id, step, {rs(cols)} from hist", "hist")


CASES = ", ".join(f"""case when "p_{c}" < 70 then 'LOW_{c.upper()}_COMPLETENESS:' || round_even("p_{c}", 1)::varchar || '%' end""" for c in COMPL)
ORACLE = {
    "c01_step_grid": q("""select mws_id, cutoff, cast(s as int) step, cast(cutoff - 14*(99 - cast(s as int)) as date) date from (
       select mws_id, date '2001-06-01' - cast(loc_no % 14 as int) as cutoff from loc), range(0,100) t(s)""", "loc"),
    "c02_state_means": reduced(STATE), "c03_flux_sums": reduced(FLUX), "c04_soil_means": reduced(SOIL),
    "c05_ndvi_overlapping_median": reduced(["NDVI"]), "c06_quality_median": reduced(["SummaryQA"]),
    "c07_missing_constants": q("select mws_id, step, " + ", ".join(
        f"""{r(f'coalesce("{c}", {FILL[c]}::double)' if c in FILL else f'"{c}"')} as "{c}" """ for c in VALUES) + " from hist", "hist"),
    "c08_wide_panel": q(f"select mws_id, step, {rs(VALUES)} from wide", "wide"),
    "c09_coverage": q(f"select mws_id, step, is_real_ndvi, is_real_smap, is_real_era5, is_real_chirps, {r('coverage_fraction')} coverage_fraction from hist", "hist"),
    "c10_reassemble_batches": q(f"""select mws_id, step, case when ok then date end date, {r('case when ok then "NDVI" end')} as "NDVI",
        {r('case when ok and step < 100 then sm_surface end')} sm_surface, {r('case when ok then coverage_fraction end')} coverage_fraction,
        """ + ", ".join(f"null::double as {c}" for c in [*FLUX, "sm_rootzone", *STATE]) + " from (select *, step % 50 <> 49 ok from hist)", "hist"),
    "c11_input_status": q("""select mws_id, n_rows, n_dates, n_coverage, n_critical, case when n_rows = 0 then 'EMPTY' when n_dates = 0 then 'NO_DATE'
        when n_coverage = 0 then 'NO_COVERAGE' when n_critical = 0 then 'ALL_MISSING' else 'OK' end input_status from (
        select l.mws_id, count(h.mws_id) n_rows, count(case when l.loc_no % 10 <> 9 then h.date end) n_dates,
        count(case when l.loc_no % 10 <> 7 then coverage_fraction end) n_coverage,
        count(case when l.loc_no % 10 <> 3 then "NDVI" end) + count(case when l.loc_no % 10 <> 3 then precipitation end)
        + count(case when l.loc_no % 10 <> 3 then temperature_2m end) n_critical
        from loc l left join hist h on h.mws_id = l.mws_id and l.loc_no % 10 <> 5 group by 1)""", "loc", "hist"),
    "c12_missing_flags": q("select mws_id, step, " + ", ".join(
        f'cast("{c}" is null as int) as "{c}_is_missing"' for c in GAP) + " from hist", "hist"),
    "c13_provenance": q("""select mws_id, step, case when "NDVI" is not null then 'observed' else 'missing' end as "NDVI_source", """ + ", ".join(
        f"""case when "o_{c}" is not null then 'observed' when "v_{c}" is not null then 'forward_fill' else 'missing' end as "{c}_source" """
        for c in GAP[1:]) + " from filled", "filled"),
    "c14_steps_since_observed": q("""select mws_id, step, "NDVI_steps_since_observed", precipitation_steps_since_observed,
        sm_rootzone_steps_since_observed from fresh""", "fresh"),
    "c15_ndvi_gap_length": q('select mws_id, step, "NDVI_steps_since_observed" ndvi_gap_length from fresh', "fresh"),
    "c16_days_since_previous": q(f"""select mws_id, date, cast(coalesce(date_diff('day', lag(date) {W}), date), 0) as int) days_since_last_obs
        from hist where "NDVI" is not null""", "hist"),
    "c17_limited_fill": q('select mws_id, step, ' + r('"NDVI"') + ' as "NDVI", ' + ", ".join(
        f'{r(chr(34) + "v_" + c + chr(34))} as "{c}"' for c in GAP[1:]) + " from filled", "filled"),
    "c18_flatlines": q("select mws_id, step, " + ", ".join(
        f"""cast(coalesce(case when count("{c}") {W} rows 5 preceding) >= 4 then stddev_samp("{c}") {W} rows 5 preceding) < 1e-5 end, false) as int)
        as "{c}_is_flatlined" """ for c in ("NDVI", "sm_rootzone", "et")) + " from (select mws_id, step, date, " + ", ".join(
        f"""case when cast(mws_id as bigint) % 3 = 0 and step between 40 and 66 and "{c}" is not null then 0.5::double else "{c}" end as "{c}" """
        for c in ("NDVI", "sm_rootzone", "et")) + " from hist)", "hist"),
    "c19_sensor_reliability": q(f"""select mws_id, step, {r('''greatest(0, least(1, 1.0::double - case when miss then 0.3 else 0 end
        - case when "NDVI_steps_since_observed" > 2 then 0.3 else 0 end - case when "NDVI_steps_since_observed" > 3 then 0.2 else 0 end))''')}
        sensor_reliability from fresh""", "fresh"),
    "c20_completeness": q("select mws_id, " + ", ".join(f'round_even("p_{c}", 1) as "{c}_completeness"' for c in COMPL) + " from audit", "audit"),
    "c21_coverage_summary": q("select mws_id, coverage_pct, valid_steps from audit", "audit"),
    "c22_quality_flags": q(f"""select mws_id, concat_ws(chr(10), {CASES},
        case when coverage_pct < 40 then 'CRITICAL: Historical coverage extremely low (<40%).' end,
        case when recent_empty > 9 then 'WARNING: >50% of recent LSTM window missing.' end,
        case when mean_ndvi < 0.12 then 'NOTICE: Low biomass — may be water, urban, or fallow.' end,
        case when coverage_pct < 20 then 'ERROR: Only ' || coverage_pct || '% coverage. Minimum 20% required.' end,
        case when coverage_pct >= 20 and max_gap >= 8 then 'CRITICAL: Long temporal gap detected (' || max_gap || ' windows)' end) quality_issues
        from audit""", "audit"),
    "c23_longest_gap": q("select mws_id, max_gap from audit", "audit"),
    "c24_forecast_buckets": q(f"""select mws_id, {r('case when p_ok then rain end')} api_precip_sum, {r('case when t_ok then temp end')} api_temp_mean,
        coalesce(case when p_ok then ps end, '') api_precip_steps, coalesce(case when t_ok then ts end, '') api_temp_steps, reasons from api""", "api"),
    "c25_weather_source": q(f"select mws_id, target, forecast_source, {r('precip_sum')} precip_sum from weather", "weather"),
    "c26_climatology_historical": q(f"""select mws_id, target, coalesce(ps,'') clim_precip_steps, coalesce(ts,'') clim_temp_steps
        from ({clim_hist('targets')})""", "targets", "hist"),
    "c27_climatology_future": q(f"""select t.mws_id, t.target, coalesce(ps,'') clim_precip_steps, coalesce(ts,'') clim_temp_steps from targets t left join (
        select mws_id, target, string_agg({FMT.format(x='precipitation')}, ',' order by date) ps,
         string_agg({FMT.format(x='temperature_2m')}, ',' order by date) ts from (
        select w.mws_id, w.target, h.date, h.precipitation, h.temperature_2m from (
         select * from (select *, row_number() over (partition by mws_id, target, y order by gap, date) k from (
          select t.mws_id, t.target, year(h.date) y, h.date, least(abs(dayofyear(h.date)-dayofyear(t.target)), 365-abs(dayofyear(h.date)-dayofyear(t.target))) gap,
           row_number() over (partition by t.mws_id, t.target, year(h.date) order by h.date) pos
          from targets t join hist h on h.mws_id = t.mws_id and year(h.date) < year(t.target))) where k = 1 and pos >= 7
         qualify row_number() over (partition by mws_id, target order by gap, y) = 1) w
        join hist h on h.mws_id = w.mws_id and h.date <= w.date and h.date > w.date - 98) group by 1,2) c
        on c.mws_id = t.mws_id and c.target = t.target""", "targets", "hist"),
    "c28_weather_sanity": q(f"""select mws_id, {r('coalesce(precip_sum,0)')} precip_sum, {r('fixed', 4)} temp_mean, concat_ws(',',
        case when bad then 'FORECAST_TEMP_IMPLAUSIBLE:' || round_even(temp_mean, 2) || 'K' end,
        case when fixed < 294 then 'FORECAST_TEMP_FALLBACK_APPLIED' end) forecast_issues
        from (select *, not (temp_mean between 240 and 330) bad, case when temp_mean between 240 and 330 then temp_mean else 298 end fixed from weather)""", "weather"),
    "c29_actual_ndvi": q(f"""select t.mws_id, t.target, {r('case when v > -0.999 then v end')} actual_ndvi from targets t left join (
        select t.mws_id, t.target, median("NDVI_raw")*0.0001::double v from targets t join obs o on o.mws_id = t.mws_id
        and o.obs_date >= t.target and o.obs_date < t.target + 16 group by 1,2) a on a.mws_id = t.mws_id and a.target = t.target""", "targets", "obs"),
    "c30_cloud_masked_composite": q("select * from cmp", "cmp"),
    "c31_tile_coverage": q(f"select mws_id, tile_year, period, {r('avg(case when nir > 0 then 1.0::double else 0 end)')} coverage from cmp group by 1,2,3", "cmp"),
    "c32_pixel_normalisation": q('select mws_id, tile_year, period, "row", col, ' + ", ".join(
        f"{r(f'case when {b} = 0 then 0.0::double else ({b} - {b}_m)/{b}_s end')} {b}" for b in BANDS) + " from cmp, (select "
        + ", ".join(f"avg({b}) filter (where {b} <> 0) {b}_m, stddev_pop({b}) filter (where {b} <> 0) {b}_s" for b in BANDS) + " from cmp)", "cmp"),
    "c33_anchor_staleness": q(f"select mws_id, anchor, last_obs, {STALE} stale_fortnights from stale", "stale"),
    "c34_clear_view": q("""select mws_id, cutoff, round_even(coalesce(case when n = 0 then null when nq > 0 then clear else avail end, (cast(mws_id as bigint) % 100)/100.0::double), 3) clear_view
        from (select t.mws_id, t.target cutoff, count(h.mws_id) n, count("SummaryQA") nq, avg(case when "SummaryQA" <= 1 then 1.0::double else 0 end) clear,
         avg(is_real_ndvi) avail from targets t left join (select t.mws_id, t.target, h.is_real_ndvi,
          case when cast(h.mws_id as bigint) % 5 <> 2 then h."SummaryQA" end "SummaryQA", row_number() over (partition by t.mws_id, t.target order by h.date desc) k
          from targets t join hist h on h.mws_id = t.mws_id and h.date <= t.target) h
         on h.mws_id = t.mws_id and h.target = t.target and h.k <= 24 group by 1,2)""", "targets", "hist"),
    "c35_clear_view_estimate": q(f"""select mws_id, anchor, case when stale is null then prior else round_even(greatest(prior - 0.12::double*stale, 0), 3) end clear_estimate
        from (select mws_id, anchor, {STALE} stale, list_value(0.90, 0.90, 0.88, 0.85, 0.80, 0.55, 0.45, 0.45, 0.55, 0.65, 0.65, 0.85)[month(anchor)]::double prior from stale)""", "stale"),
    "c36_failure_classes": q("select failure_class, count(*) n, count(*) filter (where attempts > 1) n_retried from flog group by 1", "flog"),
    "c37_latest_attempt_requeue": q(f"""select * from ({LATEST}) where status <> 'OK' and not contains(status, 'no actual NDVI at target')
        and not contains(status, 'no quarterly tile')""", "flog"),
}
