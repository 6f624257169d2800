"""Column names, types and default parameters."""

from pyspark.sql import types as T

# The canonical match table, in output order.
MATCH_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("match_id", T.StringType()),
        ("competition", T.StringType()),
        ("season", T.StringType()),
        ("datetime", T.TimestampType()),
        ("date", T.DateType()),
        ("team_home", T.StringType()),
        ("team_away", T.StringType()),
        ("goals_home", T.IntegerType()),
        ("goals_away", T.IntegerType()),
        ("result", T.StringType()),
        ("half_time_goals_home", T.IntegerType()),
        ("half_time_goals_away", T.IntegerType()),
        ("half_time_result", T.StringType()),
        ("shots_home", T.IntegerType()),
        ("shots_away", T.IntegerType()),
        ("shots_on_target_home", T.IntegerType()),
        ("shots_on_target_away", T.IntegerType()),
        ("corners_home", T.IntegerType()),
        ("corners_away", T.IntegerType()),
        ("yellow_cards_home", T.IntegerType()),
        ("yellow_cards_away", T.IntegerType()),
        ("red_cards_home", T.IntegerType()),
        ("red_cards_away", T.IntegerType()),
        ("referee", T.StringType()),
        ("odds_b365_home", T.DoubleType()),
        ("odds_b365_draw", T.DoubleType()),
        ("odds_b365_away", T.DoubleType()),
        ("odds_avg_home", T.DoubleType()),
        ("odds_avg_draw", T.DoubleType()),
        ("odds_avg_away", T.DoubleType()),
        ("odds_max_home", T.DoubleType()),
        ("odds_max_draw", T.DoubleType()),
        ("odds_max_away", T.DoubleType()),
    ]]
)

# Defaults of the operators.
TIME_DECAY = 0.0018
FORM_WINDOW = 5
MAX_GOALS = 15
MAX_CORNERS = 25
ELO_K = 20.0
ELO_HOME = 100.0
ELO_START = 1500.0
RESCALE_INTERCEPT = -469.1728
RESCALE_SLOPE = 1.0893
DATE_SPLITS = 5
MIN_TRAIN_SEASONS = 4
BOOTSTRAP_SAMPLES = 5000
SEED = 42
DECAY_GRID = (0.001, 0.0018, 0.0025, 0.0035, 0.005)
EXPOSURE_DECAY = 0.0025
REFEREE_MIN_MATCHES = 30
REFEREE_PRIOR = 30.0
REFEREE_OTHER = "other_referee"
CORNER_LINE = 9.5
YELLOW_LINE = 4.5
CLASSES = ("H", "D", "A")

# Draw share of a rating-based forecast: height at level ratings and width in rating points.
DRAW_BASE = 0.30
DRAW_WIDTH = 200.0

# Names of the features.
FEATURE_COLUMNS = (
    [f"{side}_form5_{c}" for side in ("home", "away") for c in ("played", "wins", "draws", "losses", "goal_difference")]
    + ["h2h_played", "h2h_home_wins", "h2h_draws", "h2h_away_wins"]
    + [f"{v}_{v}_{c}" for v in ("home", "away") for c in (
        "played", "wins", "draws", "losses", "points_per_game", "goal_difference_per_game")]
    + ["home_rest_days", "away_rest_days"]
    + [f"{side}_league_{c}" for side in ("home", "away") for c in ("position", "points", "played")]
    + ["is_empty_stadium"]
)
