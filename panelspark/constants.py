"""Fixed values of the data model (names, thresholds, coordinates)."""

# Market metrics kept in the hourly market table.
MARKET_METRICS = [
    "price_day_ahead",
    "actual_load",
    "forecast_load",
    "actual_solar",
    "forecast_solar",
    "actual_wind_onshore",
    "forecast_wind_onshore",
    "actual_wind_offshore",
    "forecast_wind_offshore",
    "actual_renewable_share_of_load",
    "actual_residual_load",
]

# Weather variable -> (forecast column, observed column).
WEATHER_VARIABLES = {
    "temperature": ("temperature_forecast_c", "temperature_2m_c"),
    "wind_speed": ("wind_speed_forecast_kmh", "wind_speed_10m_kmh"),
    "shortwave_radiation": (
        "shortwave_radiation_forecast_w_m2",
        "shortwave_radiation_w_m2",
    ),
    "precipitation": ("precipitation_forecast_mm", "precipitation_mm"),
}

# Printed label of each weather variable.
VARIABLE_LABELS = {
    "temperature": "Temperature",
    "wind_speed": "Wind speed",
    "shortwave_radiation": "Shortwave radiation",
    "precipitation": "Precipitation",
}

# Provider field name -> Silver column of the weather payloads.
OBSERVED_FIELDS = {
    "temperature_2m": "temperature_2m_c",
    "relative_humidity_2m": "relative_humidity_2m_pct",
    "precipitation": "precipitation_mm",
    "wind_speed_10m": "wind_speed_10m_kmh",
    "shortwave_radiation": "shortwave_radiation_w_m2",
    "weather_code": "weather_code",
}
FORECAST_FIELDS = {
    "temperature_2m": "temperature_forecast_c",
    "wind_speed_10m": "wind_speed_forecast_kmh",
    "shortwave_radiation": "shortwave_radiation_forecast_w_m2",
    "precipitation": "precipitation_forecast_mm",
}

# Bidding zone -> representative weather point.
ZONE_LOCATION = {"DE-LU": "frankfurt", "FR": "paris", "AT": "vienna"}

# Weather point -> (latitude, longitude).
LOCATION_COORDINATES = {
    "frankfurt": (50.1109, 8.6821),
    "luxembourg": (49.6116, 6.1319),
    "paris": (48.8566, 2.3522),
    "vienna": (48.2082, 16.3738),
}

# Forecast-run rules.
RUN_HOURS = (0, 6, 12, 18)
RUN_INTERVALS = (6, 12, 24)
FIRST_RUN_YEAR = 2024

# Metric names of the wide time-series source.
LOAD_ACTUAL = "load_actual_entsoe_transparency"
LOAD_FORECAST = "load_forecast_entsoe_transparency"
PRICE = "price_day_ahead"
SOLAR = "solar_generation_actual"
WIND = "wind_generation_actual"
WIND_ONSHORE = "wind_onshore_generation_actual"
COMMON_METRICS = [LOAD_ACTUAL, LOAD_FORECAST, PRICE, SOLAR]
RESEARCH_METRICS = [*COMMON_METRICS, WIND]

# Thresholds of the flags.
PRICE_SPIKE = 100.0
HEAVY_RAIN_MM = 5.0
HIGH_WIND_KMH = 30.0
FREEZING_C = 0.0

# Predictors of the impact models, in model order.
IMPACT_PREDICTORS = [
    "temperature_absolute_error",
    "wind_speed_absolute_error",
    "shortwave_radiation_absolute_error",
    "precipitation_absolute_error",
    "load_forecast_error_mw",
    "solar_forecast_error_mw",
    "wind_onshore_forecast_error_mw",
    "actual_residual_load",
]

# Upstream keys copied from a batch report into the registry.
LINEAGE_KEYS = [
    "bronze_batch",
    "bronze_run",
    "silver_batch",
    "silver_output",
    "forecast_silver_batch",
    "actual_weather_silver_batch",
    "energy_batch",
    "weather_batch",
]

WEATHER_ERRORS = [
    f"{name}_{kind}" for name in WEATHER_VARIABLES for kind in ("error", "absolute_error")
]
