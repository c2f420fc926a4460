from oracle.base import cte, q, r, rs
from oracle.features import QM, QS

PANEL = ["latitude", "longitude", "NDVI", "total_precipitation_sum", "runoff_sum", "total_evaporation_sum", "temperature_2m", "dewpoint_temperature_2m",
         "u_component_of_wind_10m", "v_component_of_wind_10m", "surface_solar_radiation_downwards_sum", "surface_net_thermal_radiation_sum",
         "sm_surface", "sm_rootzone", "baseline_ndvi_mean", "baseline_ndvi_std", "sensitivity_spei3"]
PROF = ["latitude", "longitude", *QM, *QS, "historical_max_ndvi", "peak_month", "baseline_ndvi_mean", "baseline_ndvi_std", "sensitivity_spei3"]
cte("names", """select 'composite_' || mws_id || '_' || tile_year || case when coverage < 0.1 then '' else '_' || period end || '.tif' as name from tiles
  union all select 'composite_' || mws_id || '_draft.tif' from loc union all select 'mosaic_' || mws_id || '_1999_Q1.tif' from loc
  union all select 'composite_a_b_' || mws_id || '_1999_H2.tif' from loc""", "tiles", "loc")
RE = r"'^composite_(.+)_(\d{4})(?:_(H[12]|Q[1-4]))?\.tif$'"
cte("parsed", f"""select name, regexp_matches(name, {RE}) ok, regexp_extract(name, {RE}, 1) mws_id, try_cast(regexp_extract(name, {RE}, 2) as int) tile_year,
  coalesce(nullif(regexp_extract(name, {RE}, 3), ''), 'ANNUAL') period from names""", "names")
ORACLE = {
    "a01_panel_from_csv": q(f"select mws_id, date, state, district, tehsil, {rs(PANEL)} from src", "src"),
    "a02_static_lookup_from_tsv": q(f"""select mws_id, {rs(PROF)} from (select s.*, qd.* exclude (mws_id), ph.* exclude (mws_id) from (
        select * from split qualify row_number() over (partition by mws_id order by date) = 1) s join quarterly qd using (mws_id) join pheno ph using (mws_id))""",
                                    "split", "quarterly", "pheno"),
    "a03_manifest": q(f"select mws_id, {r('latitude')} lat, {r('longitude')} lon from loc order by mws_id limit 40", "loc"),
    "a04_embeddings_from_wide": q(f"""select cast(e.vec_id as varchar) mws_id, 2000 + label as year, case when e.vec_id % 3 = 0 then 'H1' else 'ANNUAL' end half,
        cast(pos as int) pos, round(x + 1e-9, 5) + 0.0 x from e join embeddings b on b.vec_id = e.vec_id""", "e"),
    "a05_tile_registry_from_names": q("""select * from (select distinct mws_id, tile_year, period from parsed where ok), (select cast(sum(n) as bigint) n_files,
        cast(sum(case when not ok then n else 0 end) as bigint) n_bad, cast(sum(case when ok then n - 1 else 0 end) as bigint) n_dup from (
        select ok, mws_id, tile_year, period, count(*) n from parsed group by 1,2,3,4))""", "parsed"),
    "a07_static_profiles": q(f"select mws_id, {rs(PROF, 5)} from scaled qualify row_number() over (partition by mws_id order by date) = 1", "scaled"),
    "a08_first_test_predictions": q(f"""select s.mws_id, target_date, {r('actual')} actual, {r('forecast')} forecast, {r('latitude')} latitude, {r('longitude')} longitude
        from scored s join loc l using (mws_id) where split = 'test' order by s.mws_id, target_date limit 200""", "scored", "loc"),
    "a09_evaluation_rows": q(f"""select g.mws_id, g.date target_date, {rs(['actual', 'forecast', 'current', 'clim'])}, {r('abs(forecast - actual)')} abs_error,
        case when actual is null then 'ERROR: no actual NDVI at target' else 'OK' end status from grid g left join scored s on s.mws_id = g.mws_id and s.target_date = g.date""", "grid", "scored").replace('(current)', '("current")'),
    "a10_tile_jobs": q("select mws_id, cast(y as int) tile_year, 'Q' || qq period from loc, years, range(1,5) u(qq)", "loc", "years"),
    "a11_job_outcomes": q("""select case when t.mws_id is null then 'failed' when coverage < 0.75 and coverage >= 0.05 then 'low_coverage' else 'ok' end outcome, count(*) n
        from loc l cross join years cross join range(1,5) u(qq) left join tiles t on t.mws_id = l.mws_id and t.tile_year = y and t.period = 'Q' || qq group by 1""", "loc", "years", "tiles"),
    "a12_request_list": q(f"select {r('lat')} lat, {r('lon')} lon, case when plot_id % 2 = 0 then '2001-06-01' end date from plots", "plots"),
}
ORACLE["a09_evaluation_summary"] = q("""select count(*) n_samples, printf('paired n=%d | R2 %.4f | MAE %.4f | RMSE %.4f | bias %+.4f | corr %.3f', count(*),
   1 - sum((actual-forecast)*(actual-forecast))/(var_pop(actual)*count(*)), avg(abs(forecast-actual)), sqrt(avg((forecast-actual)*(forecast-actual))),
   avg(forecast-actual), corr(actual, forecast)) summary from scored""", "scored")
