"""Study constants. Every operator takes these as arguments; nothing else is hard-wired."""

from dataclasses import dataclass, field

# --- fixed values: must equal the published study for results to agree ----------------
KEPT_EVENT_TYPES = (
    "ITEM_PURCHASED",
    "ITEM_SOLD",
    "ITEM_UNDO",
    "CHAMPION_KILL",
    "BUILDING_KILL",
    "ELITE_MONSTER_KILL",
)
ITEM_EVENT_TYPES = ("ITEM_PURCHASED", "ITEM_SOLD", "ITEM_UNDO")

EPISODE_ITEM = 3041
HISTORY_ITEM = 1082

RANKED_QUEUE = 420
COMPLETE_RESULT = "GameComplete"
ABORT_RESULT = "Abort_AntiCheatExit"

PRIMARY_STATUSES = ("RETAINED", "SOLD")
EPISODE_STATUSES = ("RETAINED", "SOLD", "UNDONE", "PURCHASED_AGAIN_BEFORE_SALE")

# region -> platform prefixes of a match id
INGEST_REGIONS = {
    "sea": ("VN2_", "SG2_", "TW2_", "OC1_", "PH2_", "TH2_"),
    "asia": ("KR_", "JP1_"),
    "europe": ("EUW1_", "EUN1_", "TR1_", "RU_"),
    "americas": ("NA1_", "BR1_", "LA1_", "LA2_"),
}
RESEARCH_REGIONS = {
    "sea": ("VN", "SG", "TH", "PH", "ID", "MY"),
    "asia": ("KR", "JP", "TW", "HK"),
    "europe": ("EUW", "EUN", "TR", "RU"),
    "americas": ("NA", "BR", "LA1", "LA2", "OC"),
}

TRUE_WORDS = ("true", "1", "win", "won")
FALSE_WORDS = ("false", "0", "loss", "lost")

TEAM_STATE_EDGES = (-2000, 2000)
PLAYER_STATE_EDGES = (-1000, 1000)
STATE_LABELS = ("behind", "close", "ahead")
TIME_EDGES_MIN = (15, 25)
TIME_LABELS = ("before_15m", "15_to_25m", "after_25m")

BALANCE_COVARIATES = (
    "observation_time_minutes",
    "player_level",
    "player_total_gold",
    "player_current_gold",
    "player_xp",
    "player_minions_killed",
    "player_jungle_minions_killed",
    "player_gold_diff_vs_role_opponent",
    "player_xp_diff_vs_role_opponent",
    "rest_of_team_gold_diff",
    "rest_of_team_xp_diff",
    "team_total_gold_diff",
    "team_xp_diff",
    "team_cs_diff",
    "kills_last_5m",
    "deaths_last_5m",
    "assists_last_5m",
    "dark_seal_purchased_before_observation",
)
BALANCE_CATEGORIES = ("region", "team_position", "champion_name")
EXACT_FIELDS = ("region", "team_position", "dark_seal_purchased_before_observation")
PROFILE_PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
PLAYER_MEASURES = ("current_gold", "total_gold", "level", "xp", "minions_killed", "jungle_minions_killed")
TEAM_MEASURES = ("current_gold", "total_gold", "xp", "minions_killed", "jungle_minions_killed")
EVENT_FEATURES = ("kills_last_5m", "deaths_last_5m", "assists_last_5m")
HISTORY_FEATURE = "dark_seal_purchased_before_observation"
STATE_COLUMNS = (
    "role_opponent_participant_id",
    "role_opponent_total_gold",
    "role_opponent_xp",
    "player_gold_diff_vs_role_opponent",
    "player_xp_diff_vs_role_opponent",
    "rest_of_team_gold_diff",
    "rest_of_team_xp_diff",
    "team_total_gold",
    "enemy_total_gold",
    "team_total_gold_diff",
    "team_xp",
    "enemy_xp",
    "team_xp_diff",
    "team_cs",
    "enemy_cs",
    "team_cs_diff",
)

# what is known of the player on either side of a pair, as case_<name> and control_<name>
PAIR_STATE = (*[f"player_{measure}" for measure in PLAYER_MEASURES], *STATE_COLUMNS, *EVENT_FEATURES, HISTORY_FEATURE)


@dataclass(frozen=True)
class AsOf:
    max_age_ms: int = 60_000


@dataclass(frozen=True)
class RecentWindow:
    window_ms: int = 300_000


@dataclass(frozen=True)
class Calipers:
    """Hard limits and score weights of the candidate search."""

    max_gap_ms: int = 60_000
    level_band: int = 1
    gold_ratio: float = 0.25
    player_gold_gap: float = 2500.0
    rest_gold_gap: float = 4000.0
    level_weight: float = 0.35
    time_weight: float = 0.25
    player_xp_weight: float = 0.20
    rest_xp_weight: float = 0.20
    player_xp_scale: float = 2500.0
    rest_xp_scale: float = 4000.0
    k: int = 30


@dataclass(frozen=True)
class Matching:
    """Limits and weights of the control selection."""

    statuses: tuple = PRIMARY_STATUSES
    gold_gap: float = 750.0
    state_weight: float = 1.0
    gold_weight: float = 1.0
    event_weight: float = 2.0
    score_above_best: float = 0.75
    state_above_best: float = 0.75
    k: int = 3
    event_features: tuple = field(default=EVENT_FEATURES)
    history_feature: str = HISTORY_FEATURE


# --- end of fixed values --------------------------------------------------------------

ASOF = AsOf()
RECENT = RecentWindow()
CALIPERS = Calipers()
MATCHING = Matching()
SMD_GOOD = 0.1
SMD_POOR = 0.2
MIN_JOINT_SETS = 200
