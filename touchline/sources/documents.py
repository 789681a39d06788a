"""Nested event and lineup documents.

One file per match, named ``<match_id>.json``, holding a JSON array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import exact_clock, extract_xy
from ..operators.quality import require, require_unique

_NAMED = "struct<id:bigint,name:string>"
_POINT = "array<double>"

EVENT_DOCUMENT = f"""
id string, index bigint, period int, timestamp string, minute int, second int,
type {_NAMED}, possession bigint, possession_team {_NAMED}, play_pattern {_NAMED},
team {_NAMED}, player {_NAMED}, position {_NAMED}, location {_POINT}, duration double,
under_pressure boolean, counterpress boolean,
pass struct<recipient:{_NAMED},length:double,angle:double,height:{_NAMED},type:{_NAMED},outcome:{_NAMED},
  body_part:{_NAMED},`cross`:boolean,cut_back:boolean,switch:boolean,through_ball:boolean,shot_assist:boolean,
  goal_assist:boolean,end_location:{_POINT}>,
carry struct<end_location:{_POINT}>,
shot struct<statsbomb_xg:double,outcome:{_NAMED},type:{_NAMED},body_part:{_NAMED},technique:{_NAMED},
  first_time:boolean,one_on_one:boolean,end_location:{_POINT}>,
duel struct<type:{_NAMED},outcome:{_NAMED}>,
interception struct<outcome:{_NAMED}>,
ball_recovery struct<recovery_failure:boolean>,
clearance struct<body_part:{_NAMED}>,
block struct<deflection:boolean>,
dribble struct<outcome:{_NAMED}>,
foul_committed struct<card:{_NAMED}>,
foul_won struct<defensive:boolean>,
goalkeeper struct<type:{_NAMED},outcome:{_NAMED},position:{_NAMED},technique:{_NAMED},body_part:{_NAMED},
  end_location:{_POINT}>,
substitution struct<replacement:{_NAMED},outcome:{_NAMED}>,
bad_behaviour struct<card:{_NAMED}>
"""

LINEUP_DOCUMENT = """
team_id bigint, team_name string,
lineup array<struct<player_id:bigint,player_name:string,player_nickname:string,jersey_number:int,
  country:struct<id:bigint,name:string>,
  positions:array<struct<position_id:bigint,position:string,`from`:string,`to`:string,from_period:int,to_period:int,
    start_reason:string,end_reason:string>>,
  cards:array<struct<time:string,card_type:string,reason:string,period:int>>>>
"""


def _match_from_file() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long")


def read_event_documents(spark: SparkSession, path: str) -> DataFrame:
    """Raw nested documents plus ``match_id`` from the file name.

    A malformed file stops the read; it never turns into silent NULL rows.
    """
    return (
        spark.read.schema(EVENT_DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
        .withColumn("match_id", _match_from_file())
    )


def normalize_events(documents: DataFrame, matches: DataFrame | None = None, validate: bool = True) -> DataFrame:
    """Flat event rows in the declared column order.

    ``matches`` adds ``match_date``, ``home_team`` and ``away_team``.
    """
    n = F.col
    point = lambda path, i: extract_xy(path, i)
    cols: dict[str, Column] = {
        "match_id": n("match_id"), "id": n("id"), "index": n("index"), "period": n("period"),
        "timestamp": n("timestamp"), "minute": n("minute"), "second": n("second"),
        **exact_clock("minute", "second", "timestamp"),
        "type": n("type.name"), "team": n("team.name"), "team_id": n("team.id"),
        "player": n("player.name"), "player_id": n("player.id"), "position": n("position.name"),
        "possession": n("possession"), "possession_team": n("possession_team.name"),
        "possession_team_id": n("possession_team.id"), "play_pattern": n("play_pattern.name"),
        "under_pressure": n("under_pressure"), "counterpress": n("counterpress"), "duration": n("duration"),
        "location_x": point("location", 0), "location_y": point("location", 1),
        "pass_recipient": n("pass.recipient.name"), "pass_recipient_id": n("pass.recipient.id"),
        "pass_length": n("pass.length"), "pass_angle": n("pass.angle"), "pass_height": n("pass.height.name"),
        "pass_type": n("pass.type.name"), "pass_outcome": n("pass.outcome.name"),
        "pass_body_part": n("pass.body_part.name"), "pass_cross": n("pass.cross"),
        "pass_cut_back": n("pass.cut_back"), "pass_switch": n("pass.switch"),
        "pass_through_ball": n("pass.through_ball"), "pass_shot_assist": n("pass.shot_assist"),
        "pass_goal_assist": n("pass.goal_assist"),
        "pass_end_x": point("pass.end_location", 0), "pass_end_y": point("pass.end_location", 1),
        "carry_end_x": point("carry.end_location", 0), "carry_end_y": point("carry.end_location", 1),
        "shot_xg": n("shot.statsbomb_xg"), "shot_outcome": n("shot.outcome.name"),
        "shot_type": n("shot.type.name"), "shot_body_part": n("shot.body_part.name"),
        "shot_technique": n("shot.technique.name"), "shot_first_time": n("shot.first_time"),
        "shot_one_on_one": n("shot.one_on_one"), "shot_end_x": point("shot.end_location", 0),
        "shot_end_y": point("shot.end_location", 1), "shot_end_z": point("shot.end_location", 2),
        "duel_type": n("duel.type.name"), "duel_outcome": n("duel.outcome.name"),
        "interception_outcome": n("interception.outcome.name"),
        "ball_recovery_recovery_failure": n("ball_recovery.recovery_failure"),
        "clearance_body_part": n("clearance.body_part.name"), "block_deflection": n("block.deflection"),
        "dribble_outcome": n("dribble.outcome.name"), "foul_committed_card": n("foul_committed.card.name"),
        "foul_won_defensive": n("foul_won.defensive"), "goalkeeper_type": n("goalkeeper.type.name"),
        "goalkeeper_outcome": n("goalkeeper.outcome.name"), "goalkeeper_position": n("goalkeeper.position.name"),
        "goalkeeper_technique": n("goalkeeper.technique.name"),
        "goalkeeper_body_part": n("goalkeeper.body_part.name"),
        "goalkeeper_end_x": point("goalkeeper.end_location", 0),
        "goalkeeper_end_y": point("goalkeeper.end_location", 1),
        "substitution_replacement": n("substitution.replacement.name"),
        "substitution_outcome": n("substitution.outcome.name"),
        "bad_behaviour_card": n("bad_behaviour.card.name"),
    }
    flat = documents.select(*[v.alias(k) for k, v in cols.items()])
    if validate:
        require(flat, {"minute": F.col("minute").isNull(), "second": F.col("second").isNull()})
        require_unique(flat, ["match_id", "id"])
    if matches is None:
        return flat
    dim = matches.select("match_id", "match_date", "home_team", "away_team")
    joined = flat.join(dim, "match_id", "left")
    return joined.select("match_id", "match_date", "home_team", "away_team",
                         *[x for x in cols if x != "match_id"])


def read_events_json(spark: SparkSession, path: str, matches: DataFrame | None = None, validate: bool = True) -> DataFrame:
    return normalize_events(read_event_documents(spark, path), matches, validate)


def normalize_lineups(documents: DataFrame) -> DataFrame:
    """One row per match, team and player."""
    player = documents.select("match_id", "team_id", F.col("team_name").alias("team"), F.explode("lineup").alias("p"))
    starting = F.exists(F.coalesce("p.positions", F.array()), lambda x: x.start_reason == "Starting XI")
    return player.select(
        "match_id", "team_id", "team",
        F.col("p.player_id").alias("player_id"), F.col("p.player_name").alias("player"),
        F.col("p.player_nickname").alias("player_nickname"), F.col("p.jersey_number").alias("jersey_number"),
        F.col("p.country.id").alias("country_id"), F.col("p.country.name").alias("country"),
        F.coalesce(starting, F.lit(False)).alias("starter"),
        F.to_json(F.coalesce("p.positions", F.array())).alias("positions_json"),
        F.to_json(F.coalesce("p.cards", F.array())).alias("cards_json"),
    )


def read_lineups_json(spark: SparkSession, path: str) -> DataFrame:
    documents = (
        spark.read.schema(LINEUP_DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
        .withColumn("match_id", _match_from_file())
    )
    return normalize_lineups(documents)
