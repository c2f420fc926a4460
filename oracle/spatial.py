from oracle.base import cte, q, r


def km(a, b, c, d):
    h = (f"(power(sin(radians({c}-{a})/2),2) + cos(radians({a}))*cos(radians({c}))*power(sin(radians({d}-{b})/2),2))")
    return f"(2*6371.0*asin(sqrt(least(1.0::double, {h}))))"


cte("cells", """select *, 'd' || cast(floor(clat*2) as int) || '_t' || cast(floor(clon*2) as int) tile from (
 select o_orderkey cell_id, 19.0::double + ((o_orderkey*7927)%2800)*0.001::double clat, 76.0::double + ((o_orderkey*6841)%2900)*0.001::double clon,
 (o_orderkey % 100)/100.0::double fraction from orders) where (floor(clat*2) + floor(clon*2)) % 3 <> 0""")
cte("elig", "select * from cells where fraction >= 0.5", "cells")
cte("cat", "select tile, (min(clat)+max(clat))/2 tile_lat, (min(clon)+max(clon))/2 tile_lon from cells group by 1", "cells")
cte("veg", """select p_partkey veg_id, 19.0::double + ((p_partkey*3571)%2800)*0.001::double vlat, 76.0::double + ((p_partkey*5101)%2900)*0.001::double vlon
  from part where (p_partkey % 10 + 1)*10 in (10,20,30,40,90,95)""")
cte("vill", """select s_suppkey village_no, 'village ' || s_suppkey village, 19.0::double + ((s_suppkey*137)%2800)*0.001::double y,
  76.0::double + ((s_suppkey*211)%2900)*0.001::double x from supplier""")


def inside(px, py, w, h):
    """Even-odd crossings of a ray with the quadrilateral (x,y) (x+w,y) (x+w+0.02,y+h) (x,y+h)."""
    pts = [("x", "y"), (f"(x+{w})", "y"), (f"(x+{w}+0.02::double)", f"(y+{h})"), ("x", f"(y+{h})"), ("x", "y")]
    parts = []
    for (ax, ay), (bx, by) in zip(pts[1:], pts[:-1]):
        parts.append(f"case when ({ay} > {py}) <> ({by} > {py}) and {px} < ({bx}-{ax})*({py}-{ay})/({by}-{ay}) + {ax} then 1 else 0 end")
    return "(" + " + ".join(parts) + ")"


def in_village(px, py):
    return (f"(({inside(px, py, '0.15::double', '0.12::double')} + case when village_no % 4 = 0 then "
            f"{inside(px, py, '0.05::double', '0.04::double')} else 0 end) % 2 = 1)")


cte("pv", f"""select p.*, v.village_no, v.village from plots p left join (
   select plot_id, min(village_no) village_no from plots, vill where {in_village('lon', 'lat')} group by 1) m using (plot_id)
  left join vill v on v.village_no = m.village_no""", "plots", "vill")
cte("cv", f"select cell_id, tile, clat, clon, fraction, village_no from elig, vill where {in_village('clon', 'clat')}", "elig", "vill")
cte("t1", f"""select plot_id, ord, cell_id ref_id, km from (select *, row_number() over (partition by plot_id order by tier, o, cell_id) ord from (
  select plot_id, cell_id, min(tier) tier, arg_min(o, tier) o, min(km) km from (
   select plot_id, cell_id, 0 tier, row_number() over (partition by plot_id order by fraction desc, cell_id)::double o, {km('lat','lon','clat','clon')} km
   from pv join cv on cv.village_no = pv.village_no and cv.tile = pv.tile
   union all select plot_id, cell_id, 1, km, km from (select plot_id, cell_id, {km('lat','lon','clat','clon')} km from pv join elig using (tile)) where km <= 5)
  group by 1,2)) where ord <= 12""", "pv", "cv", "elig")
cte("t2", f"""select plot_id, ord, kind, ref_id, km, ref_tile from (select *, row_number() over (partition by plot_id order by eff, kind, ref_id) ord from (
  select plot_id, 'cropland' kind, cell_id ref_id, km, tile ref_tile, km eff from (
    select p.plot_id, e.cell_id, e.tile, {km('lat','lon','clat','clon')} km from lost p join elig e on e.tile <> p.tile join cat c on c.tile = e.tile
    where {km('lat','lon','tile_lat','tile_lon')} <= 110) where km <= 50
  union all select plot_id, 'vegetation', veg_id, km, null, km + 20 from (select plot_id, veg_id, {km('lat','lon','vlat','vlon')} km from lost, veg) where km <= 10))
  where ord <= 12""", "lost", "elig", "cat", "veg")
cte("lost", "select * from pv where plot_id not in (select plot_id from t1)", "pv", "t1")
cte("sloc", "select * exclude (latitude, longitude), 19.0::double + ((loc_no*37)%1000)*0.0028::double latitude, 76.0::double + ((loc_no*91)%1000)*0.0029::double longitude from loc", "loc")
cte("home", f"""select plot_id, mws_id, district, km from (select plot_id, mws_id, district, {km('lat','lon','latitude','longitude')} km from plots, sloc)
  qualify row_number() over (partition by plot_id order by km, mws_id) = 1""", "plots", "sloc")
cte("pts", """select plot_id, ord, clat, clon from t1 join cells on cell_id = ref_id
  union all select plot_id, ord, clat, clon from t2 join cells on cell_id = ref_id where kind = 'cropland'
  union all select plot_id, ord, vlat, vlon from t2 join veg on veg_id = ref_id where kind = 'vegetation'""", "t1", "t2", "cells", "veg")
cte("seen", 'select distinct mws_id from obs where "NDVI_raw" is not null', "obs")
cte("tasks", f"""select h.plot_id, 0 ord, h.mws_id from home h where h.mws_id in (select mws_id from seen) union all
  select plot_id, ord, mws_id from (select plot_id, ord, mws_id from (select plot_id, ord, mws_id, {km('clat','clon','latitude','longitude')} d from pts, sloc)
   qualify row_number() over (partition by plot_id, ord order by d, mws_id) = 1) where mws_id in (select mws_id from seen)
   and plot_id in (select plot_id from home where mws_id in (select mws_id from seen))""", "home", "pts", "sloc", "seen")
cte("samp", f"""select p.plot_id, p.lat, p.lon, p.regime, case when n1 > 0 then 'own tile' when n2 > 0 and nveg = 0 then 'proxy' when n2 > 0 then 'vegetation' else 'out of coverage' end coverage,
  coalesce(n1, n2, 0) n_points, case when n1 > 0 then village end village, coalesce(n1, n2, 0) < 12 small_sample,
  case when n1 is null and nveg = 0 then ftile end proxy_tile, case when n1 is null and nveg = 0 then round_even(fkm, 1) end proxy_km,
  case when n1 is null and nveg > 0 then round_even(mkm, 1) end veg_km, case when n1 is null and n2 is null then round_even(nk, 1) end nearest_km
  from pv p left join (select plot_id, count(*) n1 from t1 group by 1) a using (plot_id)
  left join (select plot_id, count(*) n2, count(*) filter (where kind = 'vegetation') nveg, max(km) mkm, arg_min(km, ord) fkm, arg_min(ref_tile, ord) ftile from t2 group by 1) b using (plot_id)
  left join (select plot_id, min({km('lat','lon','tile_lat','tile_lon')}) nk from plots, cat group by 1) c using (plot_id)""", "pv", "t1", "t2", "cat", "plots")

ORACLE = {
    "f01_great_circle_distance": q(f"select plot_id, {r(km('lat', 'lon', '20.17', '78.32'))} km from plots", "plots"),
    "f02_nearest_profile": q(f"select plot_id, mws_id, district, {r('km', 4)} profile_km from home", "home"),
    "f06_village_of_point": q("select plot_id, village from pv", "pv"),
    "f07_cell_centre": q(f"select cell_id, {r('(clon-0.0004::double + clon+0.0004::double + clon+0.0004::double + clon-0.0004::double)/4')} lon, {r('clat')} lat from cells", "cells"),
    "f08_admin_names": q("""select l.mws_id, coalesce(s, 'Unknown') state, coalesce(d, 'Unknown') district, coalesce(t, 'Unknown') tehsil,
        lower(replace(coalesce(d, 'Unknown'), ' ', '_')) || '_' || lower(replace(coalesce(t, 'Unknown'), ' ', '_')) tile_key from loc l left join (
        select l.mws_id, title(r_name) s, title(n_name || ' east') d, title('block ' || l.tehsil) t from loc l
         join nation on cast(n_nationkey as varchar) = l.district join region on r_regionkey = n_regionkey where l.loc_no % 6 <> 5) a using (mws_id)""".replace(
        "title(r_name)", "array_to_string([upper(x[1]) || x[2:] for x in string_split(lower(r_name), ' ')], ' ')").replace(
        "title(n_name || ' east')", "array_to_string([upper(x[1]) || x[2:] for x in string_split(lower(n_name || ' east'), ' ')], ' ')").replace(
        "title('block ' || l.tehsil)", "'Block ' || l.tehsil"), "loc"),
    "f09_sampling_own_tile": q(f"select plot_id, cast(ord as int) ord, ref_id, {r('km', 4)} km from t1", "t1"),
    "f10_sampling_stand_ins": q(f"select plot_id, cast(ord as int) ord, kind, ref_id, {r('km', 4)} km, ref_tile from t2", "t2"),
    "f11_sampling_summary": q("select plot_id, coverage, n_points, village, small_sample, proxy_tile, proxy_km, veg_km, nearest_km from samp", "samp"),
    "f12_vegetation_sample": q(f"select plot_id, veg_id, {r('km', 4)} km from (select plot_id, veg_id, {km('lat','lon','vlat','vlon')} km from plots, veg) where km <= 10", "plots", "veg"),
    "f13_forecast_work_table": q("select plot_id, cast(ord as int) ord, mws_id from tasks", "tasks"),
}
