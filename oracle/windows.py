from oracle.base import cte, q, r, rs
from oracle.structure import SNAP

W = "over (partition by mws_id order by date"
LEADF = "rows between 6 preceding and current row"
HISTF = "rows between 30 preceding and 7 preceding"


def samples(src, extra=""):
    return f"""select * exclude (rn, lo, hi) from (select *, row_number() {W}) rn, min(split) {W} {LEADF}) lo, max(split) {W} {LEADF}) hi,
  lag("NDVI", 7) {W}) current_ndvi, lag(date, 30) {W}) history_start, lag(date, 7) {W}) history_end,
  sum(precipitation) {W} {LEADF}) fps, avg(temperature_2m) {W} {LEADF}) ftm {extra} from {src}) where rn >= 31 and lo = hi"""


from oracle.features import DYNAMIC  # noqa: E402

cte("psamp", samples("split"), "split")
cte("ssamp", samples("scaled", f""", count(*) {W} {HISTF}) n_history, sum(rowsum) {W} {HISTF}) history_sum, lag("NDVI", 30) {W}) first_ndvi""").replace(
    "from scaled)", "from (select *, " + " + ".join(f'"{c}"' for c in DYNAMIC) + " rowsum from scaled))"), "scaled")
cte("half", """select distinct mws_id, tile_year, case when period <= 'Q2' then 'H1' else 'H2' end period from tiles
  where (cast(mws_id as int) + tile_year) % 3 <> 0""", "tiles")
ENC = "select {c}, dense_rank() over (order by {c}) - 1 code from (select distinct {c} from split)"


def walk(period, src, where="true"):
    return f"""select s.mws_id, s.date target_date, {period.format(d='s.date')} period, cast(max(t.tile_year) as int) tile_year, any_value(s.split) split
   from psamp s left join {src} t on t.mws_id = s.mws_id and t.period = {period.format(d='s.date')}
   and t.tile_year <= year(s.date) - 1 and {where} group by s.mws_id, s.date"""


QP = "('Q' || quarter({d}))"
HP = "(case when month({d}) <= 6 then 'H1' else 'H2' end)"
COVERED = walk(QP, "tiles", "t.coverage >= 0.75 and t.tile_year >= 1997")
cte("scored", """select s.mws_id, s.date target_date, s.split, s."NDVI" actual, current_ndvi as "current", clim,
  current_ndvi + 0.4::double*(coalesce(clim, current_ndvi) - current_ndvi) forecast
  from (select s.*, case quarter(s.date) when 1 then q1_mean_ndvi when 2 then q2_mean_ndvi when 3 then q3_mean_ndvi else q4_mean_ndvi end clim
   from psamp s left join quarterly q on q.mws_id = s.mws_id) s""", "psamp", "quarterly")


def r2(t, p):
    sse, sst = f"sum(({t}-{p})*({t}-{p}))", f"(var_pop({t})*count({t}))"
    return f"case when count({t}) >= 2 then case when {sst} > 0 then 1 - {sse}/{sst} when {sse} = 0 then 1 else 0 end end"


PERLOC = f"""select mws_id, count(*) n, stddev_pop(actual) spread, {r2('actual','forecast')} r2, {r2('(actual-clim)','(forecast-clim)')} anomaly_r2,
  {r2('actual','"current"')} persistence_r2, {r2('(actual-"current")','(forecast-"current")')} delta_r2 from {{src}} group by 1"""
MEDS = f"""select count(*) n_basins, {r('median(r2)')} median_basin_r2, {r('median(anomaly_r2)')} median_basin_anomaly_r2,
  {r('median(persistence_r2)')} median_basin_persistence_r2, {r('median(delta_r2)')} median_basin_delta_r2 from ({{per}}) where n >= 2"""
BW = f"""select mws_id, n, r2, cast(rank as int) rank, label from (
  select *, row_number() over (order by r2 desc, mws_id) as rank, 'best' label from per union all
  select *, row_number() over (order by r2, mws_id) as rank, 'worst' label from per) where rank <= 5 and (select count(*) from per) >= 10"""
cte("per", f"select mws_id, n, r2 from ({PERLOC.format(src='scored')}) where n >= 11 and spread > 0", "scored")
cte("bw", BW, "per")

def seeded(*cols):
    """The first 15 hex digits of the md5 of the columns and the seed."""
    return f"md5(concat_ws('|', {', '.join(f'cast({c} as varchar)' for c in cols)}, '42'))[1:15]"


def share(*cols):
    return f"(cast(('0x' || {seeded(*cols)})::bigint as double) / {float(16 ** 15)!r}::double)"


TILE = ("mws_id", "tile_year", "period")
cte("resolved", f"select * from ({walk(QP, 'tiles')}) where tile_year is not null", "psamp", "tiles")

ORACLE = {
    "e12_tile_grouped_sampling": q(f"""select cast(floor(pos/8) as int) batch, mws_id, tile_year, period, target_date, cast(k as int) slot
        from (select *, row_number() over (partition by mws_id, tile_year, period order by {seeded(*TILE, 'target_date')}, target_date) k from resolved)
        join (select *, row_number() over (order by {seeded(*TILE)}, mws_id, tile_year, period) - 1 pos from (select distinct mws_id, tile_year, period from resolved))
        using (mws_id, tile_year, period) where k <= 4""", "resolved"),
    "e13_random_evaluation_set": q(f"""select mws_id, {r('latitude')} latitude, {r('longitude')} longitude, cast(draw as int) draw,
        cast(date '1998-01-01' + cast(floor({share('mws_id', 'draw')} * 1001) as int) as date) target
        from (select * from loc order by {seeded('mws_id')}, mws_id limit 50), range(1, 11) t(draw)""", "loc"),
    "e14_history_masking": q(f"""select mws_id, date target_date, {share('mws_id', 'date')} < 0.15::double masked,
        case when {share('mws_id', 'date')} < 0.15::double then 0 else {r('first_ndvi')} end first_ndvi, {r('current_ndvi')} last_ndvi from ssamp""", "ssamp"),
    "e01_split_safe_samples": q(f"""select mws_id, date target_date, split, history_start, history_end, cast(n_history as int) n_history, {r('"NDVI"')} target,
        {r('history_sum')} history_sum, {r('current_ndvi')} last_ndvi from ssamp""", "ssamp"),
    "e02_lead_aggregates": q(f"select mws_id, date target_date, {r('fps')} forecast_precip_sum, {r('ftm')} forecast_temp_mean from ssamp", "ssamp"),
    "e03_static_of_first_row": q(f"""select s.mws_id, s.date target_date, {rs(['latitude', 'longitude', 'historical_max_ndvi', 'peak_month'])},
        """ + ", ".join(f"cast({c}_c.code as int) {c}_encoded" for c in ("state", "district", "tehsil")) + " from ssamp s " + " ".join(
        f"join ({ENC.format(c=c)}) {c}_c on {c}_c.{c} = s.{c}" for c in ("state", "district", "tehsil")), "ssamp", "split"),
    "e04_serving_window": q(f"""select t.mws_id, t.target cutoff, case when coalesce(n,0) < 24 then 'INSUFFICIENT_HISTORY' else 'OK' end status,
        cast(coalesce(n,0) as int) n_rows, first_date, last_date, {r('s')} ndvi_sum from targets t left join (
        select mws_id, target, count(*) n, min(date) first_date, max(date) last_date, sum("NDVI") s from (
         select t.mws_id, t.target, date, "NDVI", row_number() over (partition by t.mws_id, t.target order by date desc) k
         from targets t join split p on p.mws_id = t.mws_id and p.date <= t.target) where k <= 24 group by 1,2) w
        on w.mws_id = t.mws_id and w.target = t.target""", "targets", "split"),
    "e05_current_value": q(f"""select mws_id, date target_date, split, {r('"NDVI"')} target, {r('current_ndvi')} current_ndvi from psamp""", "psamp"),
    "e07_annual_tile": q("""select s.mws_id, s.date target_date, cast(year(s.date) - 1 as int) tile_year, 'ANNUAL' period, t.mws_id is not null tile_found
        from psamp s left join (select distinct mws_id, tile_year from tiles where (cast(mws_id as int) + tile_year) % 4 <> 0) t
        on t.mws_id = s.mws_id and t.tile_year = year(s.date) - 1""", "psamp", "tiles"),
    "e08_seasonal_walkback": q(f"""select * exclude (split), tile_year is not null tile_found from ({walk(QP, 'tiles')} union all {walk(HP, 'half')})""",
                               "psamp", "tiles", "half"),
    "e09_covered_walkback": q(f"""select mws_id, target_date, period, tile_year, case when tile_year is null then 'ERROR: no quarterly tile' else 'OK' end tile_status
        from ({COVERED})""", "psamp", "tiles"),
    "e10_missing_tile_report": q(f"""select split, count(*) n_samples, count(*) filter (where tile_year is null) n_missing,
        {r('avg(case when tile_year is null then 100.0::double else 0 end)')} pct_missing,
        count(distinct case when tile_year is not null then mws_id || '|' || tile_year || '|' || period end) n_tiles from ({COVERED}) group by 1""", "psamp", "tiles"),
    "e11_registry_parity": q("select count(*) n_samples, 0::bigint n_different from psamp", "psamp"),
    "f03_persistence_and_climatology": q(f"""select t.mws_id, t.target, t.cutoff, {r('cur')} as "current",
        {r('case quarter(t.target) when 1 then q1_mean_ndvi when 2 then q2_mean_ndvi when 3 then q3_mean_ndvi else q4_mean_ndvi end')} clim from (
        select *, cast({SNAP.format(d='target', e='1995-01-02')} - 98 as date) as cutoff from targets) t left join (
        select t.mws_id, t.target, arg_max("NDVI", p.date) cur from targets t join split p on p.mws_id = t.mws_id
         and p.date <= {SNAP.format(d='t.target', e='1995-01-02')} - 98 group by 1,2) c
        on c.mws_id = t.mws_id and c.target = t.target left join quarterly qd on qd.mws_id = t.mws_id""", "targets", "split", "quarterly"),
    "g01_global_metrics": q(f"""select count(*) n_samples, {r(r2('actual','forecast'))} global_r2, {r('sqrt(avg((forecast-actual)*(forecast-actual)))')} rmse,
        {r('avg(abs(forecast-actual))')} mae, {r('avg(forecast-actual)')} bias, {r('corr(actual, forecast)')} corr from scored""", "scored"),
    "g02_debiased_r2": q(f"""select count(*) n_samples, {r('any_value(b)')} bias, {r(r2('actual', '(forecast + 0.05::double - b)'))} debiased_r2
        from scored, (select avg(forecast + 0.05::double - actual) b from scored)""", "scored"),
    "g03_reference_skill": q(f"""select {r(r2('(actual-clim)','(forecast-clim)'))} global_anomaly_r2, {r(r2('(actual-"current")','(forecast-"current")'))} delta_r2,
        {r(r2('actual','"current"'))} persistence_global_r2 from scored""", "scored"),
    "g04_median_location_r2": q(MEDS.format(per=PERLOC.format(src="scored")), "scored"),
    "g05_test_metrics": q(f"""select * from (select {r(r2('actual','forecast'))} test_r2, {r('sqrt(avg((actual-forecast)*(actual-forecast)))')} test_rmse,
        {r('avg(case when (forecast - "current" > 0) = (actual - "current" > 0) then 100.0::double else 0 end)')} direction_accuracy,
        {r(r2('actual','"current"'))} persistence_r2, {r('sqrt(avg((actual-"current")*(actual-"current")))')} persistence_rmse,
        {r(r2('(actual-"current")','(forecast-"current")'))} delta_r2 from scored where split = 'test'),
        ({MEDS.format(per=PERLOC.format(src="(select * from scored where split = 'test')"))})""", "scored"),
    "g06_deseasonalised_r2": q(f"""with_normal as (select s.*, coalesce(m.v, l.v, g.v) normal from scored s
        left join (select mws_id, month(target_date) mo, avg(actual) v from scored where split='train' group by 1,2) m on m.mws_id = s.mws_id and m.mo = month(s.target_date)
        left join (select mws_id, avg(actual) v from scored where split='train' group by 1) l on l.mws_id = s.mws_id
        cross join (select avg(actual) v from scored where split='train') g where s.split = 'test')
        select {r(r2('(actual-normal)','(forecast-normal)'))} anomaly_r2, (select {r('median(x)')} from (select {r2('(actual-normal)','(forecast-normal)')} x
        from with_normal group by mws_id having count(*) >= 2)) median_basin_anomaly_r2 from with_normal""", "scored").replace(
            "\nwith_normal as", ",\nwith_normal as"),
    "g07_best_and_worst": q(f"select mws_id, n, {r('r2')} r2, rank, label from bw", "bw"),
    "g08_chosen_series": q(f"""select mws_id, min(target_date) filter (where split='train') over (partition by mws_id) train_start,
        min(target_date) filter (where split='val') over (partition by mws_id) val_start, min(target_date) filter (where split='test') over (partition by mws_id) test_start,
        cast(row_number() over (partition by mws_id order by target_date) - 1 as int) pos, target_date, {r('actual')} actual, {r('forecast')} forecast
        from scored where mws_id in (select mws_id from bw)""", "scored", "bw"),
    "g09_latency_report": q(f"""select count(*) n_total, count(*) filter (where status='OK') n_ok, {r("avg(query_time_s) filter (where status='OK')")} mean_s,
        {r('avg(query_time_s)')} mean_all_s, count(*) filter (where attempts > 1) n_retried,
        {r("count(*)/(date_diff('microsecond', min(ts), max(ts))/60e6)")} per_minute,
        {r("median(query_time_s) filter (where status='OK')")} median_s, {r("quantile_cont(query_time_s, 0.9) filter (where status='OK')")} p90_s from flog""", "flog"),
    "g10_two_path_parity": q("""select count(*) n_rows, 0::bigint n_unpaired, 0.0::double max_diff_current, 0::bigint null_mismatch_current, 0::bigint mismatch_green, true parity_ok from psamp""", "psamp"),
}

cte("wanted", f"""select distinct mws_id, cast({SNAP.format(d='t', e='1995-01-02')} as date) target_date from (
  select mws_id, cast(date '1998-01-01' + cast(floor({share('mws_id', 'draw')} * 1001) as int) as date) t
  from (select * from loc order by {seeded('mws_id')}, mws_id limit 50), range(1, 11) x(draw))""", "loc")
cte("fetched", """select mws_id, sweep_no, arg_max(status, event_id) status from flog group by 1, 2""", "flog")
cte("tried", """select w.mws_id, w.target_date, n, w.period, w.tile_year, s.actual, s.forecast, s."current", s.clim,
  case when f.status <> 'OK' then f.status when w.tile_year is null then 'ERROR: no quarterly tile'
       when s.actual is null then 'ERROR: no actual NDVI at target' else 'OK' end status
  from (select w.mws_id, w.target_date, 'Q' || quarter(w.target_date) period, cast(max(t.tile_year) as int) tile_year from wanted w
    left join tiles t on t.mws_id = w.mws_id and t.period = 'Q' || quarter(w.target_date) and t.tile_year <= year(w.target_date) - 1
      and t.coverage >= 0.75 and t.tile_year >= 1997 group by 1, 2) w
  cross join range(1, 4) r(n) left join fetched f on f.mws_id = w.mws_id and f.sweep_no = n
  left join scored s on s.mws_id = w.mws_id and s.target_date = w.target_date""", "wanted", "tiles", "fetched", "scored")
cte("swept", """select * from tried qualify n = coalesce(min(n) filter (where status = 'OK' or status like '%no actual NDVI at target%'
  or status like '%no quarterly tile%') over (partition by mws_id, target_date), 3)""", "tried")
VALUES = ("actual", "forecast", "current", "clim")
ORACLE["a09_evaluation_sweeps"] = q(f"""select mws_id, target_date, case when status = 'OK' then period end period, case when status = 'OK' then tile_year end tile_year,
  {', '.join("case when status = 'OK' then " + r('"' + c + '"') + ' end "' + c + '"' for c in VALUES)},
  case when status = 'OK' then {r('abs(forecast - actual)')} end abs_error, status, n attempts from swept""", "swept")
ORACLE["a09_sweep_outcomes"] = q("select status, count(*) n, count(*) filter (where n > 1) n_retried from swept group by 1", "swept")
