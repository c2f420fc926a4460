"""Named queries: samples, tile lookup, sampling and forecasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.functions.columns import round_cols, seeded_hash, seeded_share
from phenogrid.functions.dates import snap_to_grid
from phenogrid.operators import features, forecast, metrics, scaling, tiles, windows
from phenogrid.plans import features as fplan
from phenogrid.plans import panel as pplan
from phenogrid.plans.registry import query
from phenogrid.session import cut_lineage, densely_written, materialise
from phenogrid.sources import tables as t

STATIC_USED = ["latitude", "longitude", "historical_max_ndvi", "peak_month"]


def plain_samples(spark, d, panel=None):
    """Sample scalars on the cleaned panel (unscaled, before imputation), stored or built here."""
    return windows.split_samples((fplan.split_panel(spark, d) if panel is None else panel).withColumns({
        c: F.coalesce(c, F.lit(0.0)) for c in ("precipitation", "temperature_2m")}), dynamic=["NDVI"], static=[], arrays=False)


def scaled_samples(spark, d, arrays=True):
    return windows.split_samples(fplan.scaled_features(spark, d), arrays=arrays)


SCALARS = ["target", "current_ndvi", "forecast_precip_sum", "forecast_temp_mean"]


@query("e01_split_safe_samples")
def e01(spark, d):
    s = scaled_samples(spark, d)
    flat = F.flatten("history")
    out = s.select("mws_id", "target_date", "split", "history_start", "history_end", F.size("history").alias("n_history"),
                   "target", F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).alias("history_sum"), F.element_at("history", -1)[0].alias("last_ndvi"))
    return round_cols(out, ["target", "history_sum", "last_ndvi"])


@query("e02_lead_aggregates")
def e02(spark, d):
    s = scaled_samples(spark, d, arrays=False)
    return round_cols(s.select("mws_id", "target_date", "forecast_precip_sum", "forecast_temp_mean"), SCALARS[2:])


@query("e03_static_of_first_row")
def e03(spark, d):
    s = scaled_samples(spark, d, arrays=False)
    return round_cols(s.select("mws_id", "target_date", *STATIC_USED, "state_encoded", "district_encoded", "tehsil_encoded"), STATIC_USED)


@query("e04_serving_window")
def e04(spark, d):
    out = windows.serving_windows(pplan.targets(spark, d).withColumnRenamed("target", "cutoff"), fplan.split_panel(spark, d), "cutoff", ["NDVI"])
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x["NDVI"])
    return round_cols(out.select("mws_id", "cutoff", "status", "n_rows", F.try_element_at("window", F.lit(1))["date"].alias("first_date"),
                                 F.try_element_at("window", F.lit(-1))["date"].alias("last_date"), total.alias("ndvi_sum")), ["ndvi_sum"])


@query("e05_current_value")
def e05(spark, d):
    return round_cols(plain_samples(spark, d).select("mws_id", "target_date", "split", "target", "current_ndvi"), ["target", "current_ndvi"])


@query("e06_sample_debug_records")
def e06(spark, d):
    # a record repeats 23 of the 24 history rows of the one before
    densely_written(spark)
    return windows.debug_records(scaled_samples(spark, d))


def annual_tiles(spark, d):
    return t.tiles(spark, d).where("(cast(mws_id as int) + tile_year) % 4 <> 0").select(
        "mws_id", "tile_year", F.lit("ANNUAL").alias("period")).distinct()


@query("e07_annual_tile")
def e07(spark, d):
    return tiles.lookup_exact(plain_samples(spark, d), annual_tiles(spark, d)).select("mws_id", "target_date", "tile_year", "period", "tile_found")


@query("e08_seasonal_walkback")
def e08(spark, d):
    quarterly = tiles.lookup_walkback(plain_samples(spark, d), t.tiles(spark, d))
    half = t.tiles(spark, d).withColumn("period", F.when(F.col("period") <= "Q2", "H1").otherwise("H2")) \
        .where("(cast(mws_id as int) + tile_year) % 3 <> 0").select("mws_id", "tile_year", "period").distinct()
    halves = tiles.lookup_walkback(plain_samples(spark, d), half, mode="halfyear")
    cols = ["mws_id", "target_date", "period", "tile_year", "tile_found"]
    return quarterly.select(*cols).unionByName(halves.select(*cols))


@query("e09_covered_walkback")
def e09(spark, d):
    out = tiles.lookup_covered(plain_samples(spark, d), t.tiles(spark, d), min_year=1997)
    return out.select("mws_id", "target_date", "period", "tile_year", "tile_status")


@query("e10_missing_tile_report")
def e10(spark, d):
    out = tiles.missing_report(tiles.lookup_covered(plain_samples(spark, d), t.tiles(spark, d), min_year=1997))
    return round_cols(out, ["pct_missing"])


def tile_names(spark, d):
    """File listing: the registry's names, some twice under another folder's suffix, some foreign."""
    base = t.tiles(spark, d).select(F.concat(
        F.lit("composite_"), "mws_id", F.lit("_"), F.col("tile_year").cast("string"),
        F.when(F.col("coverage") < 0.1, F.lit("")).otherwise(F.concat(F.lit("_"), "period")), F.lit(".tif")).alias("name"))
    other = t.locations(spark, d).select(F.explode(F.array(
        F.concat(F.lit("composite_"), "mws_id", F.lit("_draft.tif")), F.concat(F.lit("mosaic_"), "mws_id", F.lit("_1999_Q1.tif")),
        F.concat(F.lit("composite_a_b_"), "mws_id", F.lit("_1999_H2.tif")))).alias("name"))
    return base.unionByName(other)


@query("e11_registry_parity")
def e11(spark, d):
    listed = t.tiles(spark, d).select("mws_id", "tile_year", "period")
    named = tiles.registry_from_names(listed.select(F.concat(
        F.lit("composite_"), "mws_id", F.lit("_"), F.col("tile_year").cast("string"), F.lit("_"), "period", F.lit(".tif")).alias("name")))
    s = plain_samples(spark, d).select("mws_id", "target_date")
    return tiles.registry_parity(tiles.lookup_walkback(s, listed), tiles.lookup_walkback(s, named))


@query("e12_tile_grouped_sampling")
def e12(spark, d):
    resolved = tiles.lookup_walkback(plain_samples(spark, d), t.tiles(spark, d))
    return tiles.tile_grouped_batches(resolved, tiles_per_batch=8, per_tile=4)


def evaluation_pairs(locs, n, per_location, first, span_days, seed=42):
    """n seeded locations x k seeded dates; n is the size of the wanted set."""
    chosen = locs.select("mws_id", "latitude", "longitude").orderBy(seeded_hash(seed, "mws_id"), "mws_id").limit(n)
    k = chosen.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per_location))))
    offset = F.floor(seeded_share(seed, "mws_id", "draw") * (span_days + 1)).cast("int")
    return k.withColumn("target", F.date_add(F.lit(first).cast("date"), offset))


@query("e13_random_evaluation_set")
def e13(spark, d):
    return round_cols(evaluation_pairs(t.locations(spark, d), 50, 10, "1998-01-01", 1000), ["latitude", "longitude"])


@query("e14_history_masking")
def e14(spark, d):
    out = windows.mask_history(scaled_samples(spark, d))
    return round_cols(out.select("mws_id", "target_date", "masked", F.element_at("history", 1)[0].alias("first_ndvi"),
                                 F.element_at("history", -1)[0].alias("last_ndvi")), ["first_ndvi", "last_ndvi"])


@query("f03_persistence_and_climatology")
def f03(spark, d):
    req = pplan.targets(spark, d).withColumn("cutoff", F.date_sub(snap_to_grid("target", t.EPOCH), 98))
    panel = fplan.split_panel(spark, d)
    out = forecast.persistence(req, panel, "cutoff")
    out = forecast.quarter_climatology(out, features.fit_quarterly(panel.where("split = 'train'")), "target")
    return round_cols(out, ["current", "clim"])


def _learned(spark, d, kind):
    df = fplan.stored_features(spark, d)
    scaler = cut_lineage(scaling.fit_scaler(df.where("split = 'train'")))
    samples = windows.split_samples(scaling.apply_scaler(df, scaler), dynamic=["NDVI", "ndvi_q_deviation", "month_sin", "month_cos", "precipitation"])
    # the tile vector enters as the walked-back tile's coverage and age
    with_tile = tiles.lookup_walkback(samples, t.tiles(spark, d)).withColumn(
        "tile_vec", F.array(F.coalesce(F.year("target_date") - F.col("tile_year"), F.lit(0)).cast("double"), F.col("tile_found").cast("double")))
    stored = materialise(with_tile.select("mws_id", "target_date", "split", "target", "current_ndvi", "history", "forecast_precip_sum",
                                          "forecast_temp_mean", *STATIC_USED, "tile_vec"), "samples")
    model = forecast.residual_model(stored, STATIC_USED, kind, emb="tile_vec", iterations=10, depth=3)
    return forecast.predict(model, stored, STATIC_USED, scaler, emb="tile_vec")


@query("f04_learned_residual_forecast")
def f04(spark, d):
    return _learned(spark, d, "linear")


@query("f05_validated_boosting")
def f05(spark, d):
    out = _learned(spark, d, "gbt").withColumn("clim", F.col("current"))
    return metrics.global_metrics(out.where("split = 'test'"))
