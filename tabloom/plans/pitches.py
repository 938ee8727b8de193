"""The shipped column configuration: one row per pitch, 113 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.roles import FeatureGroups, column_roles, names_where

# Column names of the public pitch-tracking export.
TARGET = "description"

CONTINUOUS = (
    "release_speed", "release_pos_x", "release_pos_z", "pfx_x", "pfx_z", "plate_x", "plate_z",
    "vx0", "vy0", "vz0", "ax", "ay", "az", "sz_top", "sz_bot", "effective_speed",
    "release_spin_rate", "release_extension", "release_pos_y", "bat_speed", "swing_length",
    "api_break_z_with_gravity", "api_break_x_arm", "api_break_x_batter_in", "arm_angle",
)
DISCRETE = (
    "at_bat_number", "inning", "outs_when_up", "balls", "strikes", "pitch_number", "home_score",
    "away_score", "bat_score", "fld_score", "spin_axis", "age_pit", "age_bat",
    "n_priorpa_thisgame_player_at_bat", "pitcher_days_since_prev_game",
    "batter_days_since_prev_game", "pitcher_days_until_next_game", "batter_days_until_next_game",
)
CATEGORICAL = (
    "stand", "p_throws", "inning_topbot", "pitch_type", "home_team", "away_team", "zone",
    "pitch_name", "if_fielding_alignment", "of_fielding_alignment",
)
BASES = ("on_3b", "on_2b", "on_1b")
FIELDERS = tuple(f"fielder_{i}" for i in range(2, 10))
PLAYERS = ("batter", "pitcher", *BASES, *FIELDERS)
LEAKY = (
    "hit_distance_sc", "events", "bb_type", "hit_location", "hc_x", "hc_y", "launch_speed",
    "launch_angle", "estimated_ba_using_speedangle", "estimated_woba_using_speedangle",
    "woba_value", "woba_denom", "babip_value", "iso_value", "launch_speed_angle",
    "post_away_score", "post_home_score", "post_bat_score", "post_fld_score",
    "delta_home_win_exp", "delta_run_exp", "estimated_slg_using_speedangle",
    "delta_pitcher_run_exp", "hyper_speed", "home_score_diff", "bat_score_diff",
    "home_win_exp", "bat_win_exp", "type",
)
DEPRECATED = (
    "spin_dir", "spin_rate_deprecated", "break_angle_deprecated", "des",
    "break_length_deprecated", "tfs_deprecated", "tfs_zulu_deprecated", "umpire", "sv_id",
    "age_pit_legacy", "age_bat_legacy",
)
REDUNDANT = ("game_year", "player_name", "game_type")
GAME = ("game_date", "game_pk", "n_thruorder_pitcher")
# Known only after the game in question: kept as features, marked for the user.
KNOWN_AFTERWARDS = ("pitcher_days_until_next_game", "batter_days_until_next_game")
TEXT = (
    "pitch_type", "events", "description", "game_type", "stand", "p_throws", "home_team",
    "away_team", "type", "bb_type", "inning_topbot", "pitch_name", "if_fielding_alignment",
    "of_fielding_alignment", "player_name", "des",
)
BY_NAME = ("exp", "post", "delta", "diff", "legacy")

_LONGS = (*PLAYERS, "game_pk")
_INTS = (*DISCRETE, "zone", "game_year", "n_thruorder_pitcher")


def columns() -> list[str]:
    return [
        TARGET, *CONTINUOUS, *DISCRETE, *CATEGORICAL, *PLAYERS, *LEAKY, *DEPRECATED, *REDUNDANT, *GAME,
    ]


def schema() -> T.StructType:
    """Declared types of the 113 columns; all nullable."""

    def kind(c: str) -> T.DataType:
        if c == "game_date":
            return T.DateType()
        if c in TEXT:
            return T.StringType()
        if c in _LONGS:
            return T.LongType()
        if c in _INTS:
            return T.IntegerType()
        return T.DoubleType()

    return T.StructType([T.StructField(c, kind(c)) for c in columns()])


def hashed_groups() -> FeatureGroups:
    """Measures, counts, one-hot categories and hashed player ids: 66 features."""
    return FeatureGroups(
        target=TARGET,
        categorical=CATEGORICAL,
        discrete=DISCRETE,
        continuous=CONTINUOUS,
        hashed=PLAYERS,
        excluded=(*GAME, *LEAKY, *DEPRECATED, *REDUNDANT),
    )


def counted_groups(df: DataFrame) -> FeatureGroups:
    """Frequency-coded ids and base flags: 67 features.

    The excluded list is read off the table: names by substring, columns with
    over 20% missing, and five fixed names, less the three bases.
    """
    found = names_where(
        column_roles(df, exclude_substrings=BY_NAME, counts=False), F.col("role").startswith("excluded")
    )
    excluded = [*found, "game_year", "game_type", "des", "player_name", "type"]
    return FeatureGroups(
        target=TARGET,
        categorical=CATEGORICAL,
        identifying=("game_date", *FIELDERS, "batter", "pitcher", "game_pk"),
        id_flags=BASES,
        discrete=tuple([*DISCRETE, "n_thruorder_pitcher"]),
        continuous=tuple(c for c in CONTINUOUS if c not in ("bat_speed", "swing_length")),
        excluded=tuple(dict.fromkeys(c for c in excluded if c not in BASES)),
    )


def robust_groups() -> FeatureGroups:
    """Categories, binary categories and flags kept apart; ids by share."""
    binary = ("stand", "p_throws", "inning_topbot")
    leaky = (*LEAKY, "bat_speed", "swing_length")
    return FeatureGroups(
        target=TARGET,
        categorical=tuple(c for c in CATEGORICAL if c not in (*binary, "pitch_name")),
        identifying=("batter", "pitcher", "game_pk", *FIELDERS),
        id_flags=BASES,
        discrete=tuple([*DISCRETE, "n_thruorder_pitcher"]),
        continuous=tuple(c for c in CONTINUOUS if c not in ("bat_speed", "swing_length")),
        binary=binary,
        excluded=(*DEPRECATED, *REDUNDANT, "game_date", "pitch_name", *leaky),
    )
