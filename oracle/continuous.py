from oracle.base import q, r
from oracle.outlook import COND, base
from oracle.base import cte
from oracle.structure import SNAP

cte("rq", f"""select p.plot_id request_id, h.mws_id, {SNAP.format(d="(date '2000-01-10' + cast(p.plot_id % 3 as int)*100)", e='1995-01-02')} anchor,
  cast({SNAP.format(d="(date '2000-01-10' + cast(p.plot_id % 3 as int)*100)", e='1995-01-02')} + 98 as date) target from plots p join home h using (plot_id)""", "plots", "home")
ORACLE = {
    "k01_streaming_fortnights": f"""select cast(user_id as varchar) mws_id, date '2024-01-01' + cast(14*(date_diff('day', date '2024-01-01', cast(ts as date)) // 14) as int) step_start,
        count(*) n, {r('avg(value)')} mean_value, {r('sum(value*1000)')} sum_value from events group by 1,2""",
    "k01_late_observations": f"""select cast(user_id as varchar) mws_id, date '2024-01-01' + cast(14*(date_diff('day', date '2024-01-01', cast(ts as date)) // 14) as int) step_start,
        count(*) n, {r('avg(value)')} mean_value, {r('sum(value)*1000')} sum_value from events where ts is not null group by 1,2""",
    "k02_streaming_requests": q(f"""select request_id, t.mws_id, t.anchor, t.target, round_even(cur, 3) forecast_ndvi, round_even(z, 2) z, {COND.format(z='z')} as "condition" from (
        select t.*, c.cur, (c.cur - b.m)/greatest(coalesce(b.s, 0.05::double), 0.05::double) z from rq t
        left join ({base('rq')}) b on b.mws_id = t.mws_id and b.target = t.target
        left join (select q.mws_id, q.anchor, arg_max("NDVI", p.date) cur from (select distinct mws_id, anchor from rq) q join clean p
          on p.mws_id = q.mws_id and p.date <= q.anchor group by 1,2) c on c.mws_id = t.mws_id and c.anchor = t.anchor) t""", "rq", "clean"),
    "k03_streaming_reliability": q(f"""select mws_id, step, "NDVI_steps_since_observed" ndvi_gap_length,
        {r('1.0::double - case when g > 0 then 0.3 else 0 end - case when g > 2 then 0.3 else 0 end - case when g > 3 then 0.2 else 0 end')} sensor_reliability
        from (select *, "NDVI_steps_since_observed" g from fresh)""", "fresh"),
}
