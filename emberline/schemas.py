"""Schemas of the data model as DDL texts. Days are UTC dates; missing values are NULL, never NaN."""

DETECTION = (
    "latitude double, longitude double, detected_at timestamp, frp double, "
    "confidence string, satellite string, instrument string")
QUERY_LOG = (
    "query_start date, query_end date, west double, south double, east double, north double, "
    "sensor string, downloaded_at timestamp, row_count bigint")
EVENT = (
    "event_id bigint, start_date date, end_date date, n_detections bigint, "
    "west double, south double, east double, north double")
CELL = ("layer string, day date, row int, col int, value double")
PREDICTION = ("model string, event_id bigint, day_idx int, row int, col int, p double")
FOOTPRINT = (
    "event_id bigint, west double, south double, east double, north double, first_day date, last_day date")

REQUIRED_FIRMS_COLUMNS = ("latitude", "longitude", "acq_date", "acq_time", "confidence", "satellite", "instrument")

# Channel order of an event data set.
CHANNELS = ("elevation", "slope_deg", "aspect_deg", "wind_u", "wind_v", "temperature",
            "relative_humidity", "precipitation", "ndvi", "fuel_type", "fire_mask")

# Default study area (west, south, east, north) and working resolution.
STUDY_AREA = (-73.7, -39.3, -71.0, -36.5)
RESOLUTION_M = 250.0
