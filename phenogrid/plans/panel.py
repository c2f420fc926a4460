"""Named queries: observations to panel, gaps, quality, weather, composites, fetch log."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.functions.columns import round_cols, rounded
from phenogrid.operators import composites as comp
from phenogrid.operators import fetchlog, gaps, grid, quality, weather
from phenogrid.plans.registry import query
from phenogrid.schema import BANDS, COMPLETENESS_COLUMNS, FLATLINE_COLUMNS, GAP_COLUMNS
from phenogrid.session import materialise
from phenogrid.sources import tables as t

TODAY = "2001-06-01"
VALUES = [*grid.STATE, *grid.FLUX, *grid.SOIL, "NDVI", "SummaryQA"]


def history(spark, d):
    """The reduced panel on the whole calendar, missing values as NULL."""
    return grid.fortnight_panel(t.grid(spark, d), t.observations(spark, d))


def stored_history(spark, d, cols):
    """The given columns of the history as a stored table, for steps that scan it several times."""
    with t.sized(spark, d):
        return materialise(history(spark, d).select("mws_id", "step", *cols), "history", bucket="mws_id")


def targets(spark, d):
    """Forecast requests per location: distinct order dates of the customer with its number."""
    return (
        t.table(spark, d, "orders").select(F.col("o_custkey").alias("loc_no"), F.to_date("o_orderdate").alias("target"))
        .join(t.locations(spark, d).select("loc_no", "mws_id"), "loc_no").select("mws_id", "target").distinct())


@query("c01_step_grid")
def c01(spark, d):
    pts = t.locations(spark, d).select("mws_id", F.expr("date_sub(date'2001-06-01', cast(loc_no % 14 as int))").alias("cutoff"))
    return grid.step_grid(pts, "cutoff", 100)


def _reduced(spark, d, cols):
    return round_cols(history(spark, d).select("mws_id", "step", *cols), cols)


@query("c02_state_means")
def c02(spark, d):
    return _reduced(spark, d, grid.STATE)


@query("c03_flux_sums")
def c03(spark, d):
    return _reduced(spark, d, list(grid.FLUX))


@query("c04_soil_means")
def c04(spark, d):
    return _reduced(spark, d, grid.SOIL)


@query("c05_ndvi_overlapping_median")
def c05(spark, d):
    return _reduced(spark, d, ["NDVI"])


@query("c06_quality_median")
def c06(spark, d):
    return _reduced(spark, d, ["SummaryQA"])


@query("c07_missing_constants")
def c07(spark, d):
    out = grid.fortnight_panel(t.grid(spark, d), t.observations(spark, d), compat=True)
    return round_cols(out.select("mws_id", "step", *VALUES), VALUES)


@query("c08_wide_panel")
def c08(spark, d):
    return round_cols(grid.reduce_observations(t.observations(spark, d)).select("mws_id", "step", *VALUES), VALUES)


@query("c09_coverage")
def c09(spark, d):
    return round_cols(history(spark, d).select(
        "mws_id", "step", "is_real_ndvi", "is_real_smap", "is_real_era5", "is_real_chirps", "coverage_fraction"), ["coverage_fraction"])


@query("c10_reassemble_batches")
def c10(spark, d):
    cols = ["date", "NDVI", "sm_surface", "coverage_fraction"]
    h = history(spark, d).select("mws_id", "step", *cols)
    batches = [h.where("step < 100 and step % 50 <> 49"), h.where("step >= 100 and step % 50 <> 49").drop("sm_surface")]
    out = grid.reassemble(t.grid(spark, d), batches)
    return round_cols(out.select("mws_id", "step", *cols, *[c for c in grid.REQUIRED if c not in cols]), cols[1:])


@query("c11_input_status")
def c11(spark, d):
    n = F.col("mws_id").cast("long") % 10
    h = history(spark, d).where(n != 5)
    h = h.withColumns({c: F.when(n != 3, F.col(c)) for c in ("NDVI", "precipitation", "temperature_2m")})
    h = h.withColumns({"coverage_fraction": F.when(n != 7, F.col("coverage_fraction")), "date": F.when(n != 9, F.col("date"))})
    return grid.input_status(t.locations(spark, d), h)


@query("c12_missing_flags")
def c12(spark, d):
    return gaps.missing_flags(history(spark, d)).select("mws_id", "step", *[f"{c}_is_missing" for c in GAP_COLUMNS])


@query("c13_provenance")
def c13(spark, d):
    return gaps.enrich(history(spark, d)).select("mws_id", "step", *[f"{c}_source" for c in GAP_COLUMNS])


@query("c14_steps_since_observed")
def c14(spark, d):
    return gaps.freshness(history(spark, d)).select(
        "mws_id", "step", *[f"{c}_steps_since_observed" for c in ("NDVI", "precipitation", "sm_rootzone")])


@query("c15_ndvi_gap_length")
def c15(spark, d):
    return gaps.freshness(history(spark, d)).select("mws_id", "step", "ndvi_gap_length")


@query("c16_days_since_previous")
def c16(spark, d):
    return gaps.days_since_previous(history(spark, d).where("NDVI is not null")).select("mws_id", "date", "days_since_last_obs")


@query("c17_limited_fill")
def c17(spark, d):
    return round_cols(gaps.limited_fill(history(spark, d)).select("mws_id", "step", *GAP_COLUMNS), GAP_COLUMNS)


@query("c18_flatlines")
def c18(spark, d):
    # readings of every third location are held constant for a year, as a stuck sensor would
    stuck = (F.col("mws_id").cast("long") % 3 == 0) & F.col("step").between(40, 66)
    h = history(spark, d).withColumns({c: F.when(stuck & F.col(c).isNotNull(), 0.5).otherwise(F.col(c)) for c in FLATLINE_COLUMNS})
    return gaps.flatlines(h).select("mws_id", "step", *[f"{c}_is_flatlined" for c in FLATLINE_COLUMNS])


@query("c19_sensor_reliability")
def c19(spark, d):
    return round_cols(gaps.enrich(history(spark, d)).select("mws_id", "step", "sensor_reliability"), ["sensor_reliability"])


def patchy(spark, d):
    """History with long uncovered stretches in some locations, so that every flag occurs."""
    n = F.col("mws_id").cast("long")
    lost = ((n % 4 == 1) & F.col("step").between(60, 75)) | ((n % 11 == 2) & (F.col("step") > 30)) | ((n % 13 == 3) & (F.col("step") > 70))
    h = history(spark, d)
    dim = n % 17 == 4
    return h.withColumns({
        **{c: F.when(~lost, F.col(c)) for c in COMPLETENESS_COLUMNS if c != "NDVI"},
        "NDVI": F.when(~lost, F.when(dim, F.col("NDVI") * 0.2).otherwise(F.col("NDVI"))),
        "coverage_fraction": F.when(lost, 0.0).otherwise(F.col("coverage_fraction"))})


def _audit(spark, d):
    return quality.audit(patchy(spark, d), TODAY)


@query("c20_completeness")
def c20(spark, d):
    return _audit(spark, d).select("mws_id", *[f"{c}_completeness" for c in COMPLETENESS_COLUMNS])


@query("c21_coverage_summary")
def c21(spark, d):
    return _audit(spark, d).select("mws_id", "coverage_pct", "valid_steps")


@query("c22_quality_flags")
def c22(spark, d):
    return _audit(spark, d).select("mws_id", F.concat_ws("\n", "quality_issues").alias("quality_issues"))


@query("c23_longest_gap")
def c23(spark, d):
    return _audit(spark, d).select("mws_id", "max_gap")


def _steps_text(c):
    return F.concat_ws(",", F.transform(c, lambda x: F.when(x.isNull(), "null").otherwise(
        F.format_string("%.3f", F.round(x, 4) + 0.00003)))).alias(c)


@query("c24_forecast_buckets")
def c24(spark, d):
    out = weather.forecast_steps(t.daily_weather(spark, d))
    return out.select("mws_id", rounded("api_precip_sum", 6).alias("api_precip_sum"), rounded("api_temp_mean", 6).alias("api_temp_mean"),
                      _steps_text("api_precip_steps"), _steps_text("api_temp_steps"), F.concat_ws(",", "reasons").alias("reasons"))


def _weather(spark, d):
    """Lead weather per location; stored, as its shuffles grow with the locations' steps and days."""
    req = t.locations(spark, d).select("mws_id", F.expr("date_add(date'2001-11-05', cast(loc_no % 60 as int) - 20)").alias("target"))
    api = weather.forecast_steps(t.daily_weather(spark, d))
    clim = weather.climatology_historical(req, history(spark, d))
    with t.sized(spark, d):
        return materialise(weather.choose_source(clim.join(api, "mws_id")), "weather")


@query("c25_weather_source")
def c25(spark, d):
    return round_cols(_weather(spark, d).select("mws_id", "target", "forecast_source", "precip_sum"), ["precip_sum"])


@query("c26_climatology_historical")
def c26(spark, d):
    out = weather.climatology_historical(targets(spark, d), history(spark, d))
    return out.select("mws_id", "target", _steps_text("clim_precip_steps"), _steps_text("clim_temp_steps"))


@query("c27_climatology_future")
def c27(spark, d):
    out = weather.climatology_future(targets(spark, d), history(spark, d))
    return out.select("mws_id", "target", _steps_text("clim_precip_steps"), _steps_text("clim_temp_steps"))


@query("c28_weather_sanity")
def c28(spark, d):
    out = weather.sanity(_weather(spark, d))
    return out.select("mws_id", rounded("precip_sum", 6).alias("precip_sum"), rounded("temp_mean", 4).alias("temp_mean"),
                      F.concat_ws(",", "forecast_issues").alias("forecast_issues"))


@query("c29_actual_ndvi")
def c29(spark, d):
    return round_cols(grid.actual_ndvi(targets(spark, d), t.observations(spark, d), "target", t.EPOCH), ["actual_ndvi"])


def _composites(spark, d):
    px = t.pixels(spark, d)
    native = [f"b{i}" for i in range(1, 7)]
    sensors = []
    for no, names in enumerate((comp.LANDSAT_BANDS, comp.SENTINEL_BANDS)):
        named = [F.col(n).alias(b) for n, b in zip(native, names)]
        sensors.append((px.where(F.col("sensor") == no).select(*comp.TILE, "row", "col", "fmask", *named), names))
    return comp.composite(comp.harmonise(sensors))


@query("c30_cloud_masked_composite")
def c30(spark, d):
    return _composites(spark, d)


@query("c31_tile_coverage")
def c31(spark, d):
    return round_cols(comp.tile_coverage(_composites(spark, d)), ["coverage"])


@query("c32_pixel_normalisation")
def c32(spark, d):
    c = _composites(spark, d)
    return round_cols(comp.normalise(c, comp.fit_band_stats(c)), BANDS)


@query("c33_anchor_staleness")
def c33(spark, d):
    req = targets(spark, d).withColumnRenamed("target", "anchor")
    return quality.anchor_staleness(req, patchy(spark, d))


@query("c34_clear_view")
def c34(spark, d):
    n = F.col("mws_id").cast("long")
    h = history(spark, d).withColumn("SummaryQA", F.when(n % 5 != 2, F.col("SummaryQA")))
    req = targets(spark, d).withColumnRenamed("target", "cutoff").withColumn("coverage_pct", (F.col("mws_id").cast("long") % 100).cast("double"))
    return quality.clear_view(req, h, "cutoff", "coverage_pct").select("mws_id", "cutoff", "clear_view")


@query("c35_clear_view_estimate")
def c35(spark, d):
    out = quality.anchor_staleness(targets(spark, d).withColumnRenamed("target", "anchor"), patchy(spark, d))
    return out.select("mws_id", "anchor", quality.estimate_clear_view(F.month("anchor"), F.col("stale_fortnights")).alias("clear_estimate"))


@query("c36_failure_classes")
def c36(spark, d):
    return fetchlog.failure_counts(t.fetch_log(spark, d))


@query("c37_latest_attempt_requeue")
def c37(spark, d):
    return fetchlog.requeue(t.fetch_log(spark, d))


