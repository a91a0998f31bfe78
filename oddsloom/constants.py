"""Fixed values shared by every module.

Everything in this file must equal the published protocol for results to agree, so it is stated
as plain text and nowhere else.
"""

# --- fixed values: leagues ------------------------------------------------------------------
TOP_LEAGUES = ("E0", "SP1", "F1")

# --- fixed values: odds column chains of the result files -------------------------------------
ODDS_1X2_CHAIN = (
    (("PSCH", "PSCD", "PSCA"), "pinnacle_close"),
    (("AvgCH", "AvgCD", "AvgCA"), "avg_close"),
    (("PSH", "PSD", "PSA"), "pinnacle_open"),
    (("AvgH", "AvgD", "AvgA"), "avg_open"),
    (("BbAvH", "BbAvD", "BbAvA"), "avg_open"),
)
ODDS_TOTAL_CHAIN = (
    ("PC>2.5", "PC<2.5"),
    ("AvgC>2.5", "AvgC<2.5"),
    ("P>2.5", "P<2.5"),
    ("Avg>2.5", "Avg<2.5"),
    ("BbAv>2.5", "BbAv<2.5"),
)
HANDICAP_LINE_CHAIN = ("AHCh", "AHh", "BbAHh")
ODDS_HANDICAP_CHAIN = (
    ("PCAHH", "PCAHA"),
    ("AvgCAHH", "AvgCAHA"),
    ("PAHH", "PAHA"),
    ("AvgAHH", "AvgAHA"),
    ("BbAvAHH", "BbAvAHA"),
)
OPENING_CHAIN = (
    ("PSH", "PSD", "PSA"),
    ("AvgH", "AvgD", "AvgA"),
    ("B365H", "B365D", "B365A"),
    ("BbAvH", "BbAvD", "BbAvA"),
)
STAT_COLUMNS = {
    "shots_h": "HS", "shots_a": "AS", "sot_h": "HST", "sot_a": "AST",
    "corners_h": "HC", "corners_a": "AC", "fouls_h": "HF", "fouls_a": "AF",
    "yellow_h": "HY", "yellow_a": "AY", "red_h": "HR", "red_a": "AR",
}
CLOSING_SOURCES = ("pinnacle_close", "avg_close")
SHARP_SOURCE = "pinnacle_close"
SHARP_BOOK = "pinnacle"
ISSUES = ("home", "draw", "away")

# --- fixed values: goal model ------------------------------------------------------------------
GRID_GOALS = 6
WIDE_GRID_GOALS = 11
RHO_BOUND = 0.2
KAPPA_DEFAULT = 2.0
TAU_FLOOR = 1e-10
XI_GRID = (0.0, 0.0005, 0.001, 0.0015, 0.002, 0.003, 0.005, 0.008)
W_GRID = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
KAPPA_GRID = (0.5, 1.0, 2.0, 4.0, 8.0)
KAPPA_MIN_GAIN = 1e-4
TEMPERATURE_BOUNDS = (0.5, 2.5)
PROB_CLIP = 1e-9
LOG_FLOOR = 1e-12
STACKING_XI = 0.002

# --- fixed values: ratings, form and rest ------------------------------------------------------
ELO_K = 20.0
ELO_HOME = 60.0
ELO_START = 1500.0
PI_RATE = 0.06
PI_TRANSFER = 0.3
FORM_WINDOWS = (3, 5, 10)
FORM_STATS = ("gf", "ga", "xgf", "xga", "sf", "sa", "sotf", "sota", "cf", "ca")
FIRST_REST_DAYS = 14

# --- fixed values: market / model blend --------------------------------------------------------
FRESH_MAX_DAYS = 1
STALE_MIN_DAYS = 5
BASE_BLEND = 0.92
STALE_FLOOR = 0.28
MARGIN_MIN = 1.0
MARGIN_MAX = 1.12
LEGACY_BLEND = 0.65
OPEN_HORIZON = 7
BLEND_AGES = (0, 1, 3, 5, 7)
BLEND_TOLERANCE = 1e-4
DECLARABLE_REASONS = ("not_yet_published", "lookup_failed", "margin_rejected")
DEFAULT_REASON = "not_provided"
LINEUP_MIN, LINEUP_MAX, LINEUP_ALERT = 0.5, 1.75, 0.3

# --- fixed values: stakes ----------------------------------------------------------------------
KELLY_FRACTION = 0.25
KELLY_CAP = 0.05
EXPOSURE_CAP = 0.15
CORRELATION_FACTOR = 1.5
EXPOSURE_TOLERANCE = 1e-9
RISK_LOW, RISK_MODERATE = 0.01, 0.025
VALUE_CLEAR_PTS, VALUE_MODERATE_PTS = 8.0, 4.0
DERBY_ODDS = 4.0

# --- fixed values: scoring, resampling and monitoring -----------------------------------------
CALIBRATION_WIDTH = 0.05
CALIBRATION_MIN_N = 300
CALIBRATION_TOLERANCE = 0.05
CLEAR_MARGIN = 0.03
LONGSHOT_BELOW = 0.15
RESAMPLES = 10000
CONFIDENCE = 0.95
SEED = 20260909
PERMUTATIONS = 999
SETTLE_TOLERANCE_DAYS = 2
BUCKET_MIN_N = 15
STALE_ALERT_PTS = 3.0
ROI_MIN_BETS = 100
CLV_MIN_BETS = 20
REAL_MIN_BETS = 20
DRAW_GAP_ALERT = 0.07
MIN_BETS_FOR_TUNE = 100
VALUE_EDGE = 0.03
TAKEN_AGE_DAYS = 2

# --- fixed values: derived markets (name, grid size, region) ----------------------------------
DERIVED_MARKETS = ("ou25", "btts", "ou05", "ou15", "ou35", "ou45", "home_ov15", "away_ov15")
HANDICAP_MARKET = "ah"
MARKET_GRID_SIZE = {
    "ou25": GRID_GOALS, "btts": GRID_GOALS,
    "ou05": WIDE_GRID_GOALS, "ou15": WIDE_GRID_GOALS, "ou35": WIDE_GRID_GOALS,
    "ou45": WIDE_GRID_GOALS, "home_ov15": WIDE_GRID_GOALS, "away_ov15": WIDE_GRID_GOALS,
}
ML_GRID = (
    {"max_leaves": 7, "step": 0.08, "rounds": 80},
    {"max_leaves": 15, "step": 0.05, "rounds": 150},
    {"max_leaves": 31, "step": 0.03, "rounds": 200},
)
