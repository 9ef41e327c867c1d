"""Column lists and constants of the panel data model.

Fixed values: they have to agree with the benchmark definition, otherwise
feature names, feature order and results differ.
"""

SOURCE_COLUMNS = [
    "year", "day", "t_min", "t_max", "is_rain", "target_favorable",
    "y2", "y1", "y2_y1", "precipitation", "t_avg", "cloudiness",
    "y3", "y4", "precipitation_t_gt_10", "t_gt_10",
]
LABEL = "target_favorable"
FEATURE_COLUMNS = [
    "day", "t_min", "t_max", "is_rain", "y2", "y1", "y2_y1", "precipitation",
    "t_avg", "cloudiness", "y3", "y4", "precipitation_t_gt_10", "t_gt_10",
]
TEMPORAL_SOURCES = [
    "t_min", "t_max", "is_rain", "y1", "y2", "y2_y1", "precipitation",
    "t_avg", "cloudiness", "y3", "y4", "precipitation_t_gt_10", "t_gt_10",
]
SIMPLE_FEATURES = [
    "t_min", "t_max", "is_rain", "precipitation", "t_avg", "cloudiness", "y1",
    "y2", "y2_y1", "y3", "y4", "precipitation_t_gt_10", "t_gt_10",
]
SIMPLE_ROLLING_SOURCES = ["t_avg", "precipitation", "cloudiness", "y4"]
ZERO_FILL_COLUMNS = ["is_rain", "precipitation", "precipitation_t_gt_10"]
INTERACTION_COLUMNS = ["fe_y4_cloud_interaction", "fe_cold_rain_index"]
Y_COLUMNS = ["y1", "y2", "y2_y1", "y3", "y4"]
FORMULA_COLUMNS = [*Y_COLUMNS, "precipitation_t_gt_10", "t_gt_10"]

LAG_STEPS = [2, 7]
ROLLING_ROWS = 3
ROLLING_STATS = ["mean", "std", "min", "max"]
ACCUMULATION_ROWS = [3, 5, 7, 10]
SHARE_ROWS = [3, 5, 7]
ACCUMULATION_PAIRS = [
    ("precipitation", "sum"), ("fe_wet_day", "sum"), ("fe_warm_wet_day", "sum"),
    ("fe_cool_moist_day", "sum"), ("fe_hutton_proxy_day", "sum"), ("fe_temp_8_25", "sum"),
    ("fe_temp_10_25", "sum"), ("fe_tmin_ge_10", "sum"), ("fe_high_cloud", "sum"),
    ("cloudiness", "mean"), ("cloudiness", "max"), ("t_avg", "mean"), ("t_avg", "min"),
    ("t_avg", "max"), ("t_min", "min"), ("t_max", "max"),
]

WEATHER_VARIABLES = ["t_min", "t_max", "t_avg", "precipitation", "is_rain", "cloudiness"]
RAIN = "is_rain"
LEADS = {"lead_1": 1, "lead_2": 2}
WEATHER_WINDOWS = (7, 11)
ORACLE_OFFSETS = [0, 1, 2, 3, 4]
FORBIDDEN_WEATHER_INPUTS = [
    "target_favorable", "target", "y1", "y2", "y2_y1", "y3", "y4",
    "precipitation_t_gt_10", "t_gt_10", "target_h1", "target_h2",
]

SEASON_ROWS = 92
SEASON_FIRST_DAYS = [152, 153]
MIN_PRECISION = 0.60
MAX_SCORE_CANDIDATES = 400

FEATURE_VARIANTS = {
    # name: (interaction features, temporal features, mutual-neighbour undersampling)
    "baseline": (False, False, False),
    "interaction_fe": (True, False, False),
    "temporal_fe": (False, True, False),
    "tomek_only": (False, False, True),
    "tomek_interaction_fe": (True, False, True),
    "tomek_temporal_fe": (False, True, True),
    "tomek_interaction_temporal_fe": (True, True, True),
}
