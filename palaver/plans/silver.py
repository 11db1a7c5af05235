"""The long tables that most queries start from, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.keys import bare_label, name_key
from palaver.operators.labels import label_array
from palaver.tables import first_delivery, table

LABELS = ("Accusation", "Call for Action", "Defense", "Evidence", "Identity Declaration", "Interrogation")
NO_LABEL = "No Strategy"


def games(spark: SparkSession, d: str) -> DataFrame:
    """One row for each game."""
    keep = ["source", "game_key", "game_id", "num_players", "num_turns", "player_names", "voting_outcome", "start_roles", "end_roles", "warning"]
    return first_delivery(table(spark, d, "game_index"), ["game_no"], "indexed_at", keep)


def slots(spark: SparkSession, d: str) -> DataFrame:
    """One row for each seat of a game whose parallel arrays have equal lengths."""
    g = games(spark, d).where((F.size("player_names") == F.size("start_roles")) & (F.size("player_names") == F.size("end_roles")))
    z = F.posexplode(F.arrays_zip("player_names", "start_roles", "end_roles", "voting_outcome"))
    x = g.select("game_no", "game_id", "source", F.size("player_names").alias("n_players"), z.alias("slot", "z"))
    return x.select("game_no", "game_id", "source", "n_players", "slot", F.col("z.player_names").alias("player"), F.col("z.start_roles").alias("start_role"), F.col("z.end_roles").alias("end_role"), F.col("z.voting_outcome").alias("vote"))


def spoken(spark: SparkSession, d: str, text: bool = False) -> DataFrame:
    """One row for each utterance with its labels as an array and the key ``k`` of its speaker.

    The utterance itself is there only with ``text``, so that counts shuffle no texts.
    """
    words = ["utterance"] if text else []
    u = first_delivery(table(spark, d, "utterances"), ["line_id"], "loaded_at", ["game_id", "source", "rec_id", "speaker", "annotation", *words])
    # Labels are made of what is left, and only where a query uses them.
    return u.withColumn("labels", label_array(F.col("annotation"), NO_LABEL)).withColumn("k", bare_label(F.col("speaker")))


def roster(spark: SparkSession, d: str) -> DataFrame:
    """The players of each game with the key ``k`` of their names."""
    return slots(spark, d).select("game_id", "player", name_key(F.col("player")).alias("k"))


def lines(spark: SparkSession, d: str, text: bool = False) -> DataFrame:
    """:func:`spoken` with its speaker's roster spelling."""
    words = ["utterance"] if text else []
    return spoken(spark, d, text).join(roster(spark, d), ["game_id", "k"], "left").select("line_id", "game_id", "source", "rec_id", "player", "k", "labels", *words)


def votes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each result file."""
    keep = ["result_path", "run_label", "decoding", "source", "game_id", "model_name", "status", "chosen_vote_raw", "chosen_player_name", "is_circle_vote", "is_correct", "voted_player_end_role", "voted_player_start_role", "justification"]
    return first_delivery(table(spark, d, "vote_file_level"), ["file_row_id"], "loaded_at", keep)


def valid_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes for a player or nobody with their target."""
    v = votes(spark, d).where(F.col("status").isin("player_vote", "circle_vote"))
    return v.withColumn("target", F.when(F.col("is_circle_vote"), "No Werewolf").otherwise(F.col("chosen_player_name"))).where("target is not null")


SQL = """
g as (select * from game_index qualify row_number() over (partition by game_no order by indexed_at) = 1),
slot as (select game_no, game_id, source, len(player_names) as n_players, i - 1 as slot, player_names[i] as player, start_roles[i] as start_role, end_roles[i] as end_role, voting_outcome[i] as vote
  from (select *, unnest(range(1, len(player_names) + 1)) as i from g where len(player_names) = len(start_roles) and len(player_names) = len(end_roles))),
u0 as (select * from utterances qualify row_number() over (partition by line_id order by loaded_at) = 1),
u1 as (select line_id, game_id, source, rec_id, utterance, trim(regexp_replace(lower(speaker), '\\([^)]*\\)|>>|:', '', 'g')) as k,
  case when annotation is null or trim(annotation) in ('', '[]') then ['No Strategy']
       when annotation like '[%' then list_distinct_ordered(regexp_extract_all(annotation, '"([^"]*)"', 1)) else [trim(annotation)] end as labels from u0),
line as (select line_id, u1.game_id, u1.source, rec_id, s.player, u1.k, utterance, labels from u1 left join slot s on s.game_id = u1.game_id and lower(trim(s.player)) = u1.k),
v as (select * from vote_file_level qualify row_number() over (partition by file_row_id order by loaded_at) = 1),
vv as (select *, case when is_circle_vote then 'No Werewolf' else chosen_player_name end as target from v where status in ('player_vote', 'circle_vote') and case when is_circle_vote then 'No Werewolf' else chosen_player_name end is not null)
""".replace("list_distinct_ordered(regexp_extract_all(annotation, '\"([^\"]*)\"', 1))", "(select list(x order by p) from (select x, min(p) as p from (select unnest(regexp_extract_all(annotation, '\"([^\"]*)\"', 1)) as x, generate_subscripts(regexp_extract_all(annotation, '\"([^\"]*)\"', 1), 1) as p) group by x))")


def sql(body: str) -> str:
    """A statement over the long tables."""
    return f"with {SQL.strip()}\n{body}" if not body.lstrip().startswith(",") else f"with {SQL.strip()}{body.lstrip()}"
