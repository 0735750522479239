"""Constants that define semantics (fixed values)."""

EOL_AH = 1.4
EOL_CONSECUTIVE = 3
HAMPEL_WINDOW = 7
HAMPEL_K = 3.0
HAMPEL_FLOOR = 0.004
BOL_CYCLES = 5
PLAUSIBLE_AH = (0.8, 2.3)
HORIZONS = (10, 25, 50)
BAND_ALPHA = 0.10
SEED = 7
CURVE_POINTS = 60
LOADED_A = 0.1
CV_VOLT = 4.195
RUL_GRID = tuple(range(5, 601, 5))
