"""Fixed values that results depend on."""

from __future__ import annotations

# Ordered outcome classes (away win, draw, home win).
CLASSES = ("A", "D", "H")

# Pitch size and zone grid.
PITCH_X, PITCH_Y = 120.0, 80.0
GRID_X, GRID_Y = 4, 5
ZONES = GRID_X * GRID_Y

# In-play cutoffs in minutes.
SNAPSHOT_STEP_MINUTES = 5
SNAPSHOT_LAST_MINUTE = 90
SNAPSHOT_MINUTES = tuple(range(0, SNAPSHOT_LAST_MINUTE + 1, SNAPSHOT_STEP_MINUTES))

# Chronological roles of the development season.
FINAL_SEASON = "2016/2017"
TRAIN_END = "2016-01-10"
VALIDATION_START, VALIDATION_END = "2016-01-11", "2016-02-14"
CALIBRATION_START, CALIBRATION_END = "2016-02-15", "2016-04-01"
PILOT_START = "2016-04-02"

# Margins are clipped to this range.
MARGIN_LOW, MARGIN_HIGH = -5, 5

# Event labels.
ON_TARGET = ("Goal", "Saved", "Saved to Post")
YELLOW = ("Yellow Card", "Second Yellow")
RED = ("Red Card", "Second Yellow")
DUEL_WON = ("Won", "Success", "Success In Play", "Success Out")
FINAL_THIRD_X = 80.0

# Metric names of the two history families.
EVENT_SUMS = (
    "shots", "shots_on_target", "xg", "passes", "completed_passes", "final_third_entries",
    "pressures", "recoveries", "interceptions", "fouls", "yellow_cards", "red_cards",
    "carries", "duels_won",
)
EVENT_METRICS = ("goals_for", "goals_against", "points", *EVENT_SUMS, "possessions")
NETWORK_METRICS = (
    "accumulated_eigenvector_centrality", "maximum_zone_centrality", "mean_zone_centrality",
    "mean_zone_leakage", "median_zone_leakage", "maximum_zone_leakage",
    "mean_zone_recovery", "median_zone_recovery", "maximum_zone_recovery",
    "completed_passes", "possession_losses", "possession_recoveries", "switching_factor",
)
SNAPSHOT_METRICS = (
    "shots", "passes", "completed_passes", "final_third_entries", "pressures", "recoveries",
    "interceptions", "fouls", "yellow_cards", "red_cards", "carries", "xg",
)

# Team names as used by the match source and by the odds source.
TEAM_ALIASES = (
    ("Athletic Club", "Ath Bilbao"),
    ("Atlético Madrid", "Ath Madrid"),
    ("Celta Vigo", "Celta"),
    ("RC Deportivo La Coruña", "La Coruna"),
    ("Eibar", "Eibar"),
    ("Espanyol", "Espanol"),
    ("Barcelona", "Barcelona"),
    ("FC Barcelona", "Barcelona"),
    ("Getafe", "Getafe"),
    ("Granada", "Granada"),
    ("Las Palmas", "Las Palmas"),
    ("Levante UD", "Levante"),
    ("Málaga", "Malaga"),
    ("Rayo Vallecano", "Vallecano"),
    ("Real Betis", "Betis"),
    ("Real Madrid", "Real Madrid"),
    ("Real Sociedad", "Sociedad"),
    ("Sevilla", "Sevilla"),
    ("Sporting Gijón", "Sp Gijon"),
    ("Valencia", "Valencia"),
    ("Villarreal", "Villarreal"),
    ("Deportivo Alavés", "Alaves"),
    ("Leganés", "Leganes"),
    ("Osasuna", "Osasuna"),
)
