"""Queries on dialogue records for model training sets of the games: A69, F43-F45, P07, X14, X19."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import jsonx as J
from palaver.operators import dialogue as D
from palaver.plans.silver import games, slots, sql
from palaver.tables import first_delivery, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if statement:
            SQL[name] = sql(statement)
        return fn

    return keep


def _messages(spark, d):
    return first_delivery(table(spark, d, "messages"), ["message_id"], "sent_at", ["episode_id", "agent_name", "turn", "content", "visible_to", "strategy"])


M = "mm as (select * from messages qualify row_number() over (partition by message_id order by sent_at) = 1), vm as (select *, list_contains(list_transform(string_split(regexp_replace(lower(coalesce(visible_to, '')), '[\\[\\]\"]', '', 'g'), ','), lambda x: trim(x)), 'all') as public from mm)"


@query("P07_visible", f", {M} select message_id, public from vm")
def p07(spark, d):
    return _messages(spark, d).select("message_id", D.is_public(F.col("visible_to")).alias("public"))


@query("X14_turns", f", {M} select episode_id, message_id, row_number() over (partition by episode_id order by turn, message_id) as turn_no from vm where public and turn is not null")
def x14(spark, d):
    m = _messages(spark, d).where(D.is_public(F.col("visible_to")) & F.col("turn").isNotNull())
    return D.numbered(m, "episode_id", ["turn", "message_id"]).select("episode_id", "message_id", "turn_no")


@query("F43_episode_check", f", {M} select episode_id, list_filter([case when count(*) < 3 then 'too_few_messages' end, case when count(turn) < count(*) then 'turn_missing' end, case when count_if(coalesce(trim(content), '') = '') > 0 then 'content_missing' end, case when count(visible_to) < count(*) then 'visibility_missing' end], lambda x: x is not null) as problems from vm group by 1")
def f43(spark, d):
    return D.episode_problems(_messages(spark, d))


@query("A69_strategies", f", {M} select coalesce(strategy, 'none') as strategy, count(*) as n from vm group by 1")
def a69(spark, d):
    return _messages(spark, d).groupBy(F.coalesce("strategy", F.lit("none")).alias("strategy")).agg(F.count("*").alias("n"))


@query("X19_drop_reasons", " , r as (select game_no, case when num_turns is null then 'no_turns' when list_contains(end_roles, 'NA') then 'na_role' when not list_contains(end_roles, 'Werewolf') then 'no_werewolf' when num_turns > 90 then 'too_long' else 'kept' end as reason from g) select reason, count(*) as n from r group by 1".lstrip())
def x19(spark, d):
    has = lambda v: F.coalesce(F.array_contains("end_roles", v), F.lit(False))
    reasons = [(F.col("num_turns").isNull(), "no_turns"), (has("NA"), "na_role"), (~has("Werewolf"), "no_werewolf"), (F.col("num_turns") > 90, "too_long")]
    return D.reasons(games(spark, d), reasons)


@query("F45_completions", " select game_id, to_json(map_from_entries(list(struct_pack(k := player, v := coalesce(end_role, '')) order by slot))) as completion from slot group by 1")
def f45(spark, d):
    g = slots(spark, d).groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("slot", "player", F.coalesce("end_role", F.lit("")).alias("r")))).alias("s"))
    return g.select("game_id", J.completion(F.col("s.player"), F.col("s.r")).alias("completion"))


@query("F44_same_map", " , m as (select game_no, to_json(map_from_entries(list(struct_pack(k := player, v := start_role) order by slot))) as a, to_json(map_from_entries(list(struct_pack(k := player, v := end_role) order by slot))) as b from slot where start_role is not null and end_role is not null group by 1) select game_no, a = b as same from m".lstrip())
def f44(spark, d):
    s = slots(spark, d).where("start_role is not null and end_role is not null")
    g = s.groupBy("game_no").agg(F.array_sort(F.collect_list(F.struct("slot", "player", "start_role", "end_role"))).alias("s"))
    return g.select("game_no", J.same_map(J.completion(F.col("s.player"), F.col("s.start_role")), J.completion(F.col("s.player"), F.col("s.end_role"))).alias("same"))
