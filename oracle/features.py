from oracle.base import cte, q, r, rs
from oracle.panel import FMT  # noqa: F401
from oracle.structure import CAL, WEATHER

RAD = ["surface_solar_radiation_downwards_sum", "surface_net_thermal_radiation_sum"]
WIND = ["u_component_of_wind_10m", "v_component_of_wind_10m"]
QM = [f"q{k}_mean_ndvi" for k in (1, 2, 3, 4)]
QS = [f"q{k}_std_ndvi" for k in (1, 2, 3, 4)]
DYNAMIC = ["NDVI", "ndvi_q_deviation", "month_sin", "month_cos", "et", "runoff", "precipitation", "dewpoint_temperature_2m",
           "sm_rootzone", "sm_surface", RAD[1], RAD[0], "temperature_2m", *WIND, "precip_et_ratio", "months_from_peak",
           "temp_precip_idx", "evap_stress", "precip_cum_3"]
STATIC = ["latitude", "longitude", "baseline_ndvi_mean", "baseline_ndvi_std", "sensitivity_spei3", *QM, *QS, "historical_max_ndvi", "peak_month"]
SCALED = ["NDVI", "et", "runoff", "precipitation", "dewpoint_temperature_2m", "sm_rootzone", "sm_surface", RAD[1], RAD[0],
          "temperature_2m", *WIND, "precip_et_ratio", "latitude", "longitude", "baseline_ndvi_mean", "baseline_ndvi_std", *QM, *QS,
          "historical_max_ndvi", "peak_month", "months_from_peak", "temp_precip_idx", "evap_stress", "precip_cum_3", "sensitivity_spei3"]
W = "over (partition by mws_id order by date"
CRIT = list(dict.fromkeys([*DYNAMIC, *STATIC]))


def level(prev, key):
    meds = ", ".join(f'median("{c}") as "{c}"' for c in WEATHER)
    on = f"m.{key} = p.{key}" if key else "true"
    sel = f"select {key}, {meds} from {prev} group by 1" if key else f"select {meds} from {prev}"
    return (f"select p.* replace (" + ", ".join(f'coalesce(p."{c}", m."{c}") as "{c}"' for c in WEATHER)
            + f") from {prev} p left join ({sel}) m on {on}")


cte("imp1", level("split", "mws_id"), "split")
cte("imp2", level("imp1", "district"), "imp1")
cte("imp3", level("imp2", "state"), "imp2")
cte("imp", level("imp3", None), "imp3")
cte("caps", "select " + ", ".join(f"quantile_cont({c}, 0.99) {c}_cap" for c in RAD) + " from split where split = 'train'", "split")
cte("quarterly", "select mws_id, " + ", ".join(
    [f'avg("NDVI") filter (where quarter(date) = {k}) q{k}_mean_ndvi' for k in (1, 2, 3, 4)]
    + [f'stddev_samp("NDVI") filter (where quarter(date) = {k}) q{k}_std_ndvi' for k in (1, 2, 3, 4)])
    + " from split where split = 'train' group by 1", "split")
cte("pheno", """select mws_id, "NDVI" historical_max_ndvi, cast(month(date) as int) peak_month from split where split = 'train'
  qualify row_number() over (partition by mws_id order by "NDVI" desc, date) = 1""", "split")


def ratio(top, bottom, high):
    return (f"case when {bottom} + 0.01::double = 0 then case when {top} > 0 then {high}::double when {top} < 0 then 0::double end "
            f"when {top} is null or {bottom} is null then null else greatest(0, least({high}, {top} / ({bottom} + 0.01::double))) end")


def eng(src):
    return f"""select i.* replace ({", ".join(f"case when i.{c} is not null then least(i.{c}, {c}_cap) end as {c}" for c in RAD)}),
  {CAL.replace('(date)', '(i.date)')}, sin(2*pi()*month(i.date)/12) month_sin, cos(2*pi()*month(i.date)/12) month_cos,
  precipitation - runoff precip_runoff_diff,
  lag(precipitation) {W.replace('mws_id', 'i.mws_id')}) precipitation_prev, lag(et) {W.replace('mws_id', 'i.mws_id')}) et_prev,
  lag("NDVI") {W.replace('mws_id', 'i.mws_id')}) "NDVI_prev", lag("NDVI", 2) {W.replace('mws_id', 'i.mws_id')}) "NDVI_prev2",
  {ratio('precipitation', 'et', 50)} precip_et_ratio, temperature_2m*precipitation temp_precip_idx,
  {ratio('temperature_2m', 'sm_rootzone', 1000)} evap_stress,
  avg("NDVI") {W.replace('mws_id', 'i.mws_id')} rows between 3 preceding and 1 preceding) "NDVI_rolling_mean",
  coalesce(stddev_samp("NDVI") {W.replace('mws_id', 'i.mws_id')} rows between 3 preceding and 1 preceding), 0) "NDVI_rolling_std",
  case when count(precipitation) {W.replace('mws_id', 'i.mws_id')} rows 2 preceding) = 3
   then sum(precipitation) {W.replace('mws_id', 'i.mws_id')} rows 2 preceding) else 0 end precip_cum_3,
  qd.* exclude (mws_id), ph.* exclude (mws_id), month(i.date) - ph.peak_month months_from_peak,
  coalesce("NDVI" - case quarter(i.date) when 1 then q1_mean_ndvi when 2 then q2_mean_ndvi when 3 then q3_mean_ndvi else q4_mean_ndvi end, 0) ndvi_q_deviation
  from {src} i cross join caps left join quarterly qd on qd.mws_id = i.mws_id left join pheno ph on ph.mws_id = i.mws_id"""


NOTNULL = " and ".join(f'"{c}" is not null' for c in CRIT)
cte("eng", eng("imp"), "imp", "caps", "quarterly", "pheno")
cte("engraw", eng("split"), "split", "caps", "quarterly", "pheno")
cte("feat", f"select * from eng where {NOTNULL}", "eng")
cte("scaler", "select " + ", ".join(f'avg("{c}") "{c}_mu"' for c in SCALED) + ", " + ", ".join(
    f'case when stddev_pop("{c}") > 0 then stddev_pop("{c}") else 1 end "{c}_sd"' for c in SCALED) + " from feat where split = 'train'", "feat")
cte("scaled", "select f.* replace (" + ", ".join(f'(f."{c}" - "{c}_mu")/"{c}_sd" as "{c}"' for c in SCALED)
    + ") from feat f, scaler", "feat", "scaler")


def fromtab(tab, cols):
    return q(f"select mws_id, date, {rs(cols)} from {tab}", tab)


CODE = "select '{c}' as \"column\", {c} as value, cast(dense_rank() over (order by {c}) - 1 as int) code from (select distinct {c} from {src})"
cte("e", """select vec_id, unnest(range(0, len(embedding))) pos, unnest(embedding)::double x from embeddings""")
ORACLE = {
    "d01_hierarchical_imputation": fromtab("imp", WEATHER),
    "d02_location_imputation": q("select h.mws_id, h.step, " + ", ".join(
        f'{r(f"coalesce(h.{c}, m.{c})")} as "{c}"' for c in [*WEATHER[1:], *WIND]) + " from hist h join (select mws_id, "
        + ", ".join(f"median({c}) {c}" for c in [*WEATHER[1:], *WIND]) + " from hist group by 1) m using (mws_id)", "hist"),
    "d03_ndvi_neighbour_fill": q(f"""select mws_id, step, {r(f'''coalesce(last_value("NDVI" ignore nulls) {W} rows unbounded preceding),
        first_value("NDVI" ignore nulls) {W} rows between current row and unbounded following))''')} as "NDVI" from patchy""", "patchy"),
    "d04_radiation_caps": q("select " + ", ".join(f"{r(c + '_cap')} {c}_cap" for c in RAD) + " from caps", "caps"),
    "d05_radiation_clip": q("select mws_id, date, " + ", ".join(
        f"{r(f'case when {c} is not null then least({c}, {c}_cap) end')} {c}" for c in RAD) + " from split, caps", "split", "caps"),
    "d06_precip_minus_runoff": fromtab("eng", ["precip_runoff_diff"]),
    "d07_lags": q(f"""select mws_id, date, {rs(["precipitation_prev", "et_prev", "NDVI_prev", "NDVI_prev2"])},
        {r('"NDVI_prev" - "NDVI_prev2"')} as "NDVI_change_prev" from eng""", "eng"),
    "d08_ratios": fromtab("eng", ["precip_et_ratio", "temp_precip_idx", "evap_stress"]),
    "d09_rolling_ndvi": fromtab("eng", ["NDVI_rolling_mean", "NDVI_rolling_std"]),
    "d10_precip_cum_3": fromtab("eng", ["precip_cum_3"]),
    "d11_fit_label_codes": q(" union all ".join(CODE.format(c=c, src="split") for c in ("state", "district", "tehsil", "mws_id")), "split"),
    "d12_apply_label_codes": q("select l.mws_id, " + ", ".join(
        f"coalesce({c}_c.code, 0) {c}_encoded" for c in ("state", "district", "tehsil", "mws_id")) + " from loc l " + " ".join(
        f"left join ({CODE.format(c=c, src='(select * from loc where loc_no % 2 = 1)')}) {c}_c on {c}_c.value = l.{c}"
        for c in ("state", "district", "tehsil", "mws_id")), "loc"),
    "d13_quarterly_baselines": q(f"select mws_id, {rs(QM + QS)} from quarterly", "quarterly"),
    "d14_phenology": q(f"select mws_id, {r('historical_max_ndvi')} historical_max_ndvi, peak_month from pheno", "pheno"),
    "d15_static_baselines_joined": q(f"""select mws_id, date, {rs(["q1_mean_ndvi", "q4_std_ndvi", "historical_max_ndvi"])}, cast(months_from_peak as int) months_from_peak
        from engraw""", "engraw"),
    "d16_quarter_deviation": fromtab("feat", ["ndvi_q_deviation"]),
    "d17_critical_nulls_dropped": q(f"select mws_id, date, split, {rs(CRIT)} from engraw where {NOTNULL}", "engraw"),
    "d18_fit_scaler": q(f"select {rs([f'{c}_mu' for c in SCALED] + [f'{c}_sd' for c in SCALED])} from scaler", "scaler"),
    "d19_apply_scaler": fromtab("scaled", SCALED),
    "d20_inverse_ndvi": q(f"""select mws_id, date, {r('greatest(0, least(1, s."NDVI"*1.5*"NDVI_sd" + "NDVI_mu"))')} stretched_ndvi,
        {r('greatest(0, least(1, s."NDVI"*"NDVI_sd" + "NDVI_mu"))')} as "NDVI" from scaled s, scaler""", "scaled", "scaler"),
    "d21_scaled_forecast_aggregates": q(f"""select mws_id, {r('ps')} forecast_precip_sum, {r('ts')} forecast_temp_mean from (
        select w.mws_id, case when p_ok then ap when c.n = 7 then cp else 0 end ps, case when t_ok then at_ when c.n = 7 then ct else 0 end ts
        from climw w join api using (mws_id)
        left join (select mws_id, sum((p - precipitation_mu)/precipitation_sd) ap, avg((t - temperature_2m_mu)/temperature_2m_sd) at_ from (
          select mws_id, day_no // 14 b, sum(rain) p, avg(temp + 273.15::double) t from daily where day_no < 98 group by 1,2), scaler group by 1) a using (mws_id)
        left join (select mws_id, count(*) n, case when count(*) = 7 and count(p) = 7 then sum(p) end cp, case when count(*) = 7 and count(t) = 7 then avg(t) end ct from (
          select q.mws_id, (precipitation - precipitation_mu)/precipitation_sd p, (temperature_2m - temperature_2m_mu)/temperature_2m_sd t,
            date_diff('day', max(h.date) over (partition by q.mws_id), q.target) gap,
            row_number() over (partition by q.mws_id order by h.date desc) k from wreq q join hist h on h.mws_id = q.mws_id and h.date <= q.target, scaler)
          where k <= 7 and gap <= 30 group by 1) c using (mws_id))""", "climw", "api", "daily", "scaler", "hist", "wreq"),
    "d22_split_summary": q("""select split, count(*) n_rows, count(distinct mws_id) n_locations, min(date) first_date, max(date) last_date
        from split group by 1""", "split"),
    "d23_embedding_standardised": q(f"""select e.vec_id, cast(e.pos as int) pos, {r('case when e.vec_id % 50 = 49 then 0 else (x - m)/s end', 5)} z from e join (
        select pos, avg(x) m, stddev_pop(x) + 1e-6 s from e where vec_id % 10 < 7 and vec_id % 50 <> 49 group by 1) st using (pos)""", "e"),
}
