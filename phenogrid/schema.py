"""The data contract: schemas, column lists and thresholds.

Fixed values. They must equal the published contract for results to agree, so they are
written out plainly here and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- window geometry and date grid -------------------------------------------------------
WINDOW = 24
LEAD = 7
FORECAST_HORIZON = 7
STEP_DAYS = 14
COMPOSITE_DAYS = 16
SOIL_DAYS = 3
GRID_EPOCH = "2017-07-01"
SPLIT_TRAIN = 0.70
SPLIT_VAL = 0.20

# --- column lists ------------------------------------------------------------------------
SENTINEL = -9999.0
RENAMES = {
    "total_precipitation_sum": "precipitation",
    "runoff_sum": "runoff",
    "total_evaporation_sum": "et",
}
WEATHER = [
    "NDVI", "et", "runoff", "precipitation", "temperature_2m", "dewpoint_temperature_2m",
    "surface_solar_radiation_downwards_sum", "surface_net_thermal_radiation_sum",
    "sm_surface", "sm_rootzone",
]
WIND = ["u_component_of_wind_10m", "v_component_of_wind_10m"]
RADIATION = ["surface_solar_radiation_downwards_sum", "surface_net_thermal_radiation_sum"]
DYNAMIC = [
    "NDVI", "ndvi_q_deviation", "month_sin", "month_cos", "et", "runoff", "precipitation",
    "dewpoint_temperature_2m", "sm_rootzone", "sm_surface",
    "surface_net_thermal_radiation_sum", "surface_solar_radiation_downwards_sum",
    "temperature_2m", "u_component_of_wind_10m", "v_component_of_wind_10m",
    "precip_et_ratio", "months_from_peak", "temp_precip_idx", "evap_stress", "precip_cum_3",
]
QUARTER_MEANS = [f"q{q}_mean_ndvi" for q in (1, 2, 3, 4)]
QUARTER_STDS = [f"q{q}_std_ndvi" for q in (1, 2, 3, 4)]
STATIC = [
    "latitude", "longitude", "baseline_ndvi_mean", "baseline_ndvi_std", "sensitivity_spei3",
    *QUARTER_MEANS, *QUARTER_STDS, "historical_max_ndvi", "peak_month",
]
FORECAST_AGGREGATES = ["forecast_precip_sum", "forecast_temp_mean"]
CATEGORICAL = ["state", "district", "tehsil", "mws_id"]
SCALED = [
    "NDVI", "et", "runoff", "precipitation", "dewpoint_temperature_2m", "sm_rootzone",
    "sm_surface", "surface_net_thermal_radiation_sum", "surface_solar_radiation_downwards_sum",
    "temperature_2m", "u_component_of_wind_10m", "v_component_of_wind_10m", "precip_et_ratio",
    "latitude", "longitude", "baseline_ndvi_mean", "baseline_ndvi_std",
    *QUARTER_MEANS, *QUARTER_STDS, "historical_max_ndvi", "peak_month", "months_from_peak",
    "temp_precip_idx", "evap_stress", "precip_cum_3", "sensitivity_spei3",
]
PROFILE = [
    "mws_id", "latitude", "longitude", *QUARTER_MEANS, *QUARTER_STDS,
    "historical_max_ndvi", "peak_month", "baseline_ndvi_mean", "baseline_ndvi_std",
    "sensitivity_spei3",
]

# --- gap handling and quality audit ------------------------------------------------------
GAP_COLUMNS = ["NDVI", "precipitation", "temperature_2m", "sm_rootzone", "sm_surface", "et", "runoff"]
FRESHNESS_COLUMNS = ["NDVI", "precipitation", "sm_rootzone"]
FLATLINE_COLUMNS = ["NDVI", "sm_rootzone", "et"]
COMPLETENESS_COLUMNS = ["NDVI", "precipitation", "temperature_2m", "sm_rootzone", "et"]
CRITICAL_COLUMNS = ["NDVI", "precipitation", "temperature_2m"]

# --- anomaly and area thresholds ---------------------------------------------------------
MAD_TO_STD = 1.4826
MIN_BASELINE = 6
SPREAD_FLOOR = 0.05
SEVERITY_WELL_BELOW, SEVERITY_BELOW, SEVERITY_ABOVE = -2.0, -1.0, 1.0
SD_HIGH, SD_LOW = 0.5, 1.0
CLEAR_GOOD, CLEAR_FAIR = 0.75, 0.50
ATTRIBUTION_Z, ATTRIBUTION_PCT = -1.0, 50
POINT_BELOW_Z = -1.0
CONFIDENCE = ["low", "medium", "high"]
QUALITY_TO_CONFIDENCE = {"good": "high", "fair": "medium", "poor": "low"}
TREND_DELTA = 0.03
CLEAR_PRIOR = {1: 0.90, 2: 0.90, 3: 0.88, 4: 0.85, 5: 0.80, 6: 0.55,
               7: 0.45, 8: 0.45, 9: 0.55, 10: 0.65, 11: 0.65, 12: 0.85}
CLEAR_PRIOR_DEFAULT = 0.7
CLEAR_STALE_COST = 0.12

# --- sampling around a plot --------------------------------------------------------------
MIN_POINTS = 12
CELL_FRACTION = 0.5
BUFFER_KM = 5.0
PROXY_KM = 50.0
PROXY_TILE_KM = 110.0
VEGETATION_KM = 10.0
VEGETATION_PENALTY_KM = 20.0
VEGETATION_CAP = 400
VEGETATED_CLASSES = [10, 20, 30, 40, 90, 95]
VEGETATION_CONFIDENCE_CAP = "medium"
EARTH_KM = 6371.0

# --- tiles -------------------------------------------------------------------------------
TILE_MIN_COVERAGE = 0.75
TILE_MIN_YEAR = 2016
BANDS = ["blue", "green", "red", "nir", "swir1", "swir2"]
REFLECTANCE_SCALE = 10000

_D = T.DoubleType()
PANEL_SCHEMA = T.StructType(
    [T.StructField("mws_id", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, _D) for c in ("latitude", "longitude")]
    + [T.StructField(c, T.StringType()) for c in ("state", "district", "tehsil")]
    + [T.StructField(c, _D) for c in (
        "NDVI", "total_precipitation_sum", "runoff_sum", "total_evaporation_sum",
        "temperature_2m", "dewpoint_temperature_2m", *WIND, *RADIATION,
        "sm_surface", "sm_rootzone", "baseline_ndvi_mean", "baseline_ndvi_std",
        "sensitivity_spei3")]
)
MANIFEST_SCHEMA = T.StructType([
    T.StructField("mws_id", T.StringType()), T.StructField("lat", _D), T.StructField("lon", _D)])
REQUEST_SCHEMA = T.StructType([
    T.StructField("lat", _D), T.StructField("lon", _D), T.StructField("date", T.StringType())])
