"""Fixed names, thresholds and row types of the archive's tables."""

from __future__ import annotations

#: Form of a recording's file name: date, team, player (a fixed value).
FILE_NAME = r"^(\d{4}-\d{2}-\d{2})-(Team[A-Za-z0-9]+)-(.+)\.parquet$"
#: Value columns of a recording, in file order (fixed values).
SENSOR_VALUES = [
    "lat", "lon", "speed", "heart_rate", "hacc", "hdop", "signal_quality", "num_satellites",
    "inst_acc_impulse", "accl_x", "accl_y", "accl_z", "gyro_x", "gyro_y", "gyro_z",
]
SENSOR_TEXTS = ["player_name", "time"]
SENSOR_COLUMNS = [*SENSOR_TEXTS, *SENSOR_VALUES]
#: Texts that a CSV reader takes as missing (fixed values).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Types that a text column may have, the narrowest first; text if none fits.
KINDS = "bigint", "double", "boolean", "date", "timestamp"
#: Column names looked for, most likely first (fixed values).
PLAYER_COLUMNS = ["player_name", "player", "player_id", "athlete", "athlete_id"]
DATE_COLUMNS = ["timestamp", "date", "datetime", "time", "created_at"]
#: Limits of plausible values and of a large gap, and numbers of example rows (fixed values).
LATITUDE, LONGITUDE, TOP_SPEED, HEART_RATE = 90, 180, 15, (30, 240)
GAP_MULTIPLIER, EXAMPLE_ROWS, INTERVAL_ROWS, VALID_ROWS = 10.0, 5, 200, 100

CATALOG = "path string, filename string, team string, year int, month string, date string, player_id string, size_bytes long"
FOOTERS = "path string, row_count long, column_count long, row_groups long, schema_text string, columns array<string>, error string"
