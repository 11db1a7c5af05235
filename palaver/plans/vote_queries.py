"""Queries of the vote family: A16-A28, A46-A49, A51-A55, J03-J05, J07, J08, J15, P01-P06, W02-W05, X09-X12, X20."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palaver.functions import jsonx as J
from palaver.functions.keys import model_size, name_key
from palaver.operators import votes as V
from palaver.plans.silver import games, slots, sql, valid_votes, votes
from palaver.session import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if statement:
            SQL[name] = sql(statement)
        return fn

    return keep


DIST = "d as (select model_name, game_id, target, count(*) as n, sum(count(*)) over (partition by model_name, game_id) as total, count(*) * 1.0 / sum(count(*)) over (partition by model_name, game_id) as p from vv where decoding = 'stochastic' group by model_name, game_id, target)"
HUM = "h as (select game_id, vote as target, count(*) as n from slot where vote is not null group by all)"


def stochastic(spark, d):
    return V.distribution(valid_votes(spark, d).where("decoding = 'stochastic'"), ["model_name", "game_id"])


def human(spark, d):
    return V.distribution(slots(spark, d).where("vote is not null").select("game_id", F.col("vote").alias("target")), ["game_id"])


@query("A16_vote_distribution", f""", {DIST} select model_name, game_id, cast(sum(n) as bigint) as n_votes, sum(-p * ln(p)) as entropy, max(p) as top_share, case when max(p) > 0.5 then max_by(target, n) end as majority from d group by all""")
def a16(spark, d):
    return V.majority(stochastic(spark, d), ["model_name", "game_id"])


@query("A16_correct", " select model_name, game_id, avg(is_correct::int) as p_correct, coalesce(bool_or(is_correct), false) as at_least_one_correct, count(*) as n_votes from vv where decoding = 'stochastic' group by all")
def a16_correct(spark, d):
    """The mass of stochastic votes on the right answer, and whether any run found it."""
    ok = F.col("is_correct").cast("int")
    return valid_votes(spark, d).where("decoding = 'stochastic'").groupBy("model_name", "game_id").agg(F.avg(ok).alias("p_correct"), F.coalesce(F.max(ok) == 1, F.lit(False)).alias("at_least_one_correct"), F.count("*").alias("n_votes"))


@query("A46_matched_shares", f""", {DIST}, c as (select game_id, lower(trim(player)) as k from slot group by all), m as (select d.model_name, d.game_id, d.target, d.n, (d.target = 'No Werewolf' or c.k is not null) as known from d left join c on c.game_id = d.game_id and c.k = lower(trim(d.target)))
 select model_name, count(distinct game_id) filter (where known) as n_sets, sum(case when known then n else 0 end)::bigint as n_votes, sum(case when known then 0 else n end)::bigint as n_dropped, sum(case when known and target = 'No Werewolf' then n else 0 end) * 1.0 / nullif(sum(case when known then n else 0 end), 0) as circle_share,
 (select count(*) from (select game_id from m m2 where m2.known and m2.model_name is not distinct from m.model_name group by 1 having count(*) > 1)) * 1.0 / nullif(count(distinct game_id) filter (where known), 0) as split_share from m group by model_name""")
def a46_shares(spark, d):
    """Votes that name an alternative of their game, those dropped, and shares of circle votes and split games."""
    c = slots(spark, d).select("game_id", F.lower(F.trim("player")).alias("k")).distinct().withColumn("here", F.lit(True))
    m = stochastic(spark, d).withColumn("k", F.lower(F.trim("target"))).join(c, ["game_id", "k"], "left")
    known = (F.col("target") == "No Werewolf") | F.coalesce("here", F.lit(False))
    g = m.groupBy("model_name", "game_id").agg(F.count_if(known).alias("t"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("v"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("x"), F.sum(F.when(F.col("target") == "No Werewolf", F.col("n")).otherwise(0)).alias("o"))
    n = F.count_if(F.col("t") > 0)
    return g.groupBy("model_name").agg(n.alias("n_sets"), F.sum("v").alias("n_votes"), F.sum("x").alias("n_dropped"), F.try_divide(F.sum("o"), F.sum("v")).alias("circle_share"), F.try_divide(F.count_if(F.col("t") > 1), n).alias("split_share"))


@query("A16_greedy_support", f""", {DIST}, gr as (select model_name, game_id, min(target) as greedy from vv where decoding = 'greedy' group by all)
 select model_name, game_id, greedy, coalesce(max((target = greedy)::int), 0) = 1 as in_support, count(target) as n_targets from gr left join d using (model_name, game_id) group by all""")
def a16_greedy(spark, d):
    gr = valid_votes(spark, d).where("decoding = 'greedy'").groupBy("model_name", "game_id").agg(F.min("target").alias("greedy"))
    x = gr.join(stochastic(spark, d), ["model_name", "game_id"], "left")
    return x.groupBy("model_name", "game_id", "greedy").agg((F.coalesce(F.max((F.col("target") == F.col("greedy")).cast("int")), F.lit(0)) == 1).alias("in_support"), F.count("target").alias("n_targets"))


@query("A17_run_summary", " select model_name, run_label, count(*) as n_files, count_if(status = 'player_vote') as n_player, count_if(status = 'circle_vote') as n_circle, count_if(status not in ('player_vote', 'circle_vote')) as n_other, avg(case when status in ('player_vote', 'circle_vote') then is_correct::int end) as accuracy from v group by all")
def a17(spark, d):
    ok = F.col("status").isin("player_vote", "circle_vote")
    return votes(spark, d).groupBy("model_name", "run_label").agg(
        F.count("*").alias("n_files"), F.count_if(F.col("status") == "player_vote").alias("n_player"), F.count_if(F.col("status") == "circle_vote").alias("n_circle"),
        F.count_if(~ok).alias("n_other"), F.avg(F.when(ok, F.col("is_correct").cast("int"))).alias("accuracy"),
    )


@query("A18_coherence", """, s as (select * from vv where decoding = 'stochastic' and is_correct is not null), g1 as (select model_name, game_id, avg(is_correct::int) as p from s group by all), r1 as (select model_name, run_label, avg(is_correct::int) as a from s group by all)
 select model_name, mean_p, mean_run, mean_p - mean_run as gap from (select model_name, avg(p) as mean_p from g1 group by 1) join (select model_name, avg(a) as mean_run from r1 group by 1) using (model_name)""")
def a18(spark, d):
    s = valid_votes(spark, d).where("decoding = 'stochastic' and is_correct is not null").withColumn("c", F.col("is_correct").cast("int"))
    two = lambda k, out: s.groupBy("model_name", k).agg(F.avg("c").alias("m")).groupBy("model_name").agg(F.avg("m").alias(out))
    return two("game_id", "mean_p").join(two("run_label", "mean_run"), "model_name").withColumn("gap", F.col("mean_p") - F.col("mean_run"))


@query("A19_human_plurality", f", {HUM}, m as (select game_id, max(n) as most from h group by 1) select game_id, any_value(most) as most, case when any_value(most) < 2 then [-1] else list(target order by target) filter (where n = most) end as winners from h join m using (game_id) group by game_id")
def a19(spark, d):
    return V.plurality(human(spark, d), ["game_id"], circle=-1)


@query("A20_village_dispersion", """, x as (select s.game_id, s.vote as target, count(*) as n, sum(count(*)) over (partition by s.game_id) as t from slot s where vote is not null and start_role not in ('Werewolf', 'Minion', 'Tanner') group by all),
 y as (select game_id, cast(any_value(t) as bigint) as n_votes, max(n) * 1.0 / any_value(t) as top_share, sum(-(n * 1.0 / t) * ln(n * 1.0 / t)) as entropy from x group by game_id) select * from y""".replace("s.game_id, s.vote as target, count(*) as n, sum(count(*)) over (partition by s.game_id) as t", "game_id, target, n, sum(n) over (partition by game_id) as t").replace("from slot s where vote is not null and start_role not in ('Werewolf', 'Minion', 'Tanner') group by all", "from (select game_id, vote as target, count(*) as n from slot where vote is not null and start_role not in ('Werewolf', 'Minion', 'Tanner') group by all)"))
def a20(spark, d):
    v = slots(spark, d).where("vote is not null and start_role not in ('Werewolf', 'Minion', 'Tanner')").select("game_id", F.col("vote").alias("target"))
    return V.majority(V.distribution(v, ["game_id"]), ["game_id"]).select("game_id", "n_votes", "top_share", "entropy")


@query("A21_model_overview", f", {DIST}, m as (select model_name, game_id, max(p) as top, sum(-p * ln(p)) as entropy from d group by all) select model_name, count(*) as n_games, avg(top) as mean_top_share, avg(entropy) as mean_entropy, avg((top > 0.5)::int) as majority_rate from m group by 1")
def a21(spark, d):
    m = V.majority(stochastic(spark, d), ["model_name", "game_id"])
    return m.groupBy("model_name").agg(F.count("*").alias("n_games"), F.avg("top_share").alias("mean_top_share"), F.avg("entropy").alias("mean_entropy"), F.avg((F.col("top_share") > 0.5).cast("int")).alias("majority_rate"))


@query("A22_agreement", f""", {DIST}, u as (select distinct model_name, game_id from d), n as (select a.model_name as a, b.model_name as b, count(*) as n_units from u a join u b using (game_id) where a.model_name <= b.model_name group by all),
 s as (select x.model_name as a, y.model_name as b, sum(x.p * y.p) as mass from d x join d y using (game_id, target) where x.model_name <= y.model_name group by all) select a, b, n_units, coalesce(mass, 0) / n_units as agreement from n left join s using (a, b)""")
def a22(spark, d):
    return V.agreement(cut(stochastic(spark, d)), "game_id", "model_name")


DEST = "case when is_circle_vote then 'circle' when voted_player_end_role = 'Werewolf' then 'werewolf' when voted_player_start_role = 'Werewolf' then 'former_werewolf' when voted_player_end_role = 'Tanner' then 'tanner' else 'other' end"


@query("A23_destinations", f", k as (select model_name, game_id, {DEST} as destination, count(*) as n from vv where decoding = 'stochastic' group by all), t as (select model_name, game_id, sum(n) as total from k group by all), c as (select model_name, count(*) as n_games from t group by 1) select k.model_name, destination, sum(n * 1.0 / total) / any_value(n_games) as mean_mass from k join t on t.model_name = k.model_name and t.game_id = k.game_id join c on c.model_name = k.model_name group by all")
def a23(spark, d):
    v = valid_votes(spark, d).where("decoding = 'stochastic'")
    v = v.withColumn("target", V.destination(F.col("is_circle_vote"), F.col("is_correct"), F.col("voted_player_end_role"), F.col("voted_player_start_role")))
    dist = V.distribution(v, ["model_name", "game_id"])
    # The mean is over all games of a model; a game without a destination counts as no mass.
    n = dist.groupBy("model_name").agg(F.countDistinct("game_id").alias("n_games"))
    return dist.groupBy("model_name", F.col("target").alias("destination")).agg(F.sum("p").alias("mass")).join(n, "model_name").select("model_name", "destination", (F.col("mass") / F.col("n_games")).alias("mean_mass"))


@query("A24_wrong_roles", " select model_name, voted_player_end_role as role, count(*) as n, count(*) * 1.0 / sum(count(*)) over (partition by model_name) as share from vv where not is_circle_vote and not is_correct and voted_player_end_role is not null group by model_name, voted_player_end_role")
def a24(spark, d):
    v = valid_votes(spark, d).where("not is_circle_vote and not is_correct and voted_player_end_role is not null")
    x = V.distribution(v.withColumn("role", F.col("voted_player_end_role")), ["model_name"], "role")
    return x.select("model_name", "role", "n", F.col("p").alias("share"))


@query("A25_role_lift", f""", {DIST}, e as (select game_id, player as target, end_role from slot), ob as (select model_name, game_id, end_role, sum(p) as mass from d join e using (game_id, target) group by all),
 t as (select model_name, game_id, sum(mass) as whole from ob group by all), se as (select game_id, end_role, count(*) as k, any_value(n_players) as a from slot where end_role is not null group by all)
 select end_role, sum(coalesce(mass, 0)) as observed, sum(whole * k / a) as expected, sum(coalesce(mass, 0)) / sum(whole * k / a) as lift from t join se using (game_id) left join ob using (model_name, game_id, end_role) group by 1""")
def a25(spark, d):
    s = slots(spark, d)
    seat = s.where("end_role is not null").groupBy("game_id", "end_role").agg(F.count("*").alias("n_seats"), F.max("n_players").alias("n_all"))
    dist = cut(stochastic(spark, d))
    ob = dist.join(s.select("game_id", F.col("player").alias("target"), "end_role"), ["game_id", "target"]).groupBy("model_name", "game_id", "end_role").agg(F.sum("p").alias("mass"))
    models = dist.select("model_name", "game_id").distinct()
    return V.lift(ob, models.join(seat, "game_id"), ["model_name", "game_id"], "end_role")


@query("A26_tanner_follow", f", {HUM}, hm as (select game_id, max(n) as most from h group by 1), hw as (select h.game_id, s.player, s.end_role from h join hm on hm.game_id = h.game_id and h.n = hm.most join slot s on s.game_id = h.game_id and s.slot = h.target where most >= 2 and s.end_role = 'Tanner') select model_name, count(*) as n_votes, avg((v.target = hw.player)::int) as follow_rate from vv v join hw on hw.game_id = v.game_id where decoding = 'stochastic' group by 1")
def a26(spark, d):
    w = V.plurality(human(spark, d), ["game_id"], circle=-1).where("most >= 2").select("game_id", F.explode("winners").alias("slot"))
    t = w.join(slots(spark, d), ["game_id", "slot"]).where("end_role = 'Tanner'").select("game_id", "player")
    return valid_votes(spark, d).where("decoding = 'stochastic'").join(t, "game_id").groupBy("model_name").agg(F.count("*").alias("n_votes"), F.avg((F.col("target") == F.col("player")).cast("int")).alias("follow_rate"))


@query("A27_role_mass", " select model_name, count_if(voted_player_start_role = 'Werewolf') as start_wolf, count_if(voted_player_end_role = 'Werewolf') as end_wolf, count_if(voted_player_start_role = 'Werewolf' and voted_player_end_role is distinct from 'Werewolf') * 1.0 / nullif(count_if(voted_player_end_role is distinct from 'Werewolf'), 0) as defensible_share from vv where not is_circle_vote group by 1")
def a27(spark, d):
    s, e = F.col("voted_player_start_role").eqNullSafe("Werewolf"), F.col("voted_player_end_role").eqNullSafe("Werewolf")
    return valid_votes(spark, d).where("not is_circle_vote").groupBy("model_name").agg(F.count_if(s).alias("start_wolf"), F.count_if(e).alias("end_wolf"), F.try_divide(F.count_if(s & ~e), F.count_if(~e)).alias("defensible_share"))


@query("A28_solvability", ", c as (select game_id, avg(is_correct::int) as human from vv where decoding = 'greedy' group by 1) select model_name, case when human >= 0.5 then 'easy' when human > 0 then 'mixed' else 'unsolved' end as solvability, count(*) as n, avg(is_correct::int) as accuracy from vv join c using (game_id) where decoding = 'stochastic' and human is not null group by all")
def a28(spark, d):
    v = valid_votes(spark, d)
    c = v.where("decoding = 'greedy'").groupBy("game_id").agg(F.avg(F.col("is_correct").cast("int")).alias("human")).where("human is not null")
    k = F.when(F.col("human") >= 0.5, "easy").when(F.col("human") > 0, "mixed").otherwise("unsolved")
    return v.where("decoding = 'stochastic'").join(c, "game_id").groupBy("model_name", k.alias("solvability")).agg(F.count("*").alias("n"), F.avg(F.col("is_correct").cast("int")).alias("accuracy"))


@query("A28_pivoted", """, c as (select game_id, avg(is_correct::int) as human from vv where decoding = 'greedy' group by 1), x as (select model_name, game_id, is_correct::int as ok, human from vv join c using (game_id) where decoding = 'stochastic' and human is not null),
 gg as (select 'two' as grouping, model_name, case when human > 0 then 'solved' else 'unsolved' end as k, ok from x union all select 'three', model_name, case when human >= 0.5 then 'easy' when human > 0 then 'mixed' else 'unsolved' end, ok from x)
 select grouping, model_name, avg(ok) filter (where k = 'easy') as easy, avg(ok) filter (where k = 'mixed') as mixed, avg(ok) filter (where k = 'solved') as solved, avg(ok) filter (where k = 'unsolved') as unsolved from gg group by grouping, model_name""")
def a28_pivoted(spark, d):
    """Accuracy by how many greedy runs solve a game, in two and in three groups, one column each."""
    v = valid_votes(spark, d)
    c = v.where("decoding = 'greedy'").groupBy("game_id").agg(F.avg(F.col("is_correct").cast("int")).alias("human")).where("human is not null")
    three = F.when(F.col("human") >= 0.5, "easy").when(F.col("human") > 0, "mixed").otherwise("unsolved")
    two = F.when(F.col("human") > 0, "solved").otherwise("unsolved")
    x = v.where("decoding = 'stochastic'").join(c, "game_id").select("model_name", F.col("is_correct").cast("int").alias("ok"), F.explode(F.array(F.struct(F.lit("two").alias("grouping"), two.alias("k")), F.struct(F.lit("three").alias("grouping"), three.alias("k")))).alias("g"))
    return x.select("model_name", "ok", "g.*").groupBy("grouping", "model_name").pivot("k", ["easy", "mixed", "solved", "unsolved"]).agg(F.avg("ok"))


@query("A48_null", ", b as (select game_id, count(*) + 1 as m from slot group by 1), n as (select model_name, game_id, count(*) as n from vv where decoding = 'stochastic' group by all) select model_name, sum(-n * ln(m)) / sum(n) as null_ll, sum(n * 1.0 / m) / sum(n) as null_hit, sum(n)::bigint as n_votes from n join b using (game_id) group by 1")
def a48_null(spark, d):
    """Log-likelihood and hit rate of guessing evenly among a game's seats and nobody."""
    b = slots(spark, d).groupBy("game_id").agg((F.count("*") + 1).alias("m"))
    n = valid_votes(spark, d).where("decoding = 'stochastic'").groupBy("model_name", "game_id").agg(F.count("*").alias("n"))
    x = n.join(b, "game_id")
    return x.groupBy("model_name").agg((F.sum(-F.col("n") * F.log("m")) / F.sum("n")).alias("null_ll"), (F.sum(F.col("n") / F.col("m")) / F.sum("n")).alias("null_hit"), F.sum("n").alias("n_votes"))


@query("A46_vote_targets", """ select model_name, game_id, p.player as alternative, count(*) as n from vv join slot p using (game_id) where lower(trim(p.player)) = lower(trim(vv.target)) group by all
 union all select model_name, game_id, 'No Werewolf', count(*) from vv where is_circle_vote group by all""")
def a46(spark, d):
    v = valid_votes(spark, d).withColumn("k", name_key(F.col("target")))
    s = slots(spark, d).select("game_id", F.col("player").alias("alternative"), name_key(F.col("player")).alias("k"))
    named = v.join(s, ["game_id", "k"]).select("model_name", "game_id", "alternative")
    circle = v.where("is_circle_vote").select("model_name", "game_id", F.lit("No Werewolf").alias("alternative"))
    return named.unionByName(circle).groupBy("model_name", "game_id", "alternative").agg(F.count("*").alias("n"))


@query("A47_human_targets", " select s.game_id, t.player as alternative, count(*) as n from slot s join slot t on t.game_id = s.game_id and t.slot = s.vote where s.start_role not in ('Werewolf', 'Minion', 'Tanner') and s.game_id in (select game_id from slot where vote is not null and start_role not in ('Werewolf', 'Minion', 'Tanner') group by 1 having count(*) >= 2) group by all")
def a47(spark, d):
    s = slots(spark, d)
    village = s.where("vote is not null and start_role not in ('Werewolf', 'Minion', 'Tanner')").select("game_id", F.col("vote").alias("slot"))
    n = village.groupBy("game_id").agg(F.count("*").alias("voters")).where("voters >= 2")
    return village.join(n, "game_id", "left_semi").join(s.select("game_id", "slot", F.col("player").alias("alternative")), ["game_id", "slot"]).groupBy("game_id", "alternative").agg(F.count("*").alias("n"))


@query("A48_ceiling", f", {DIST}, c as (select model_name, game_id, sum(p * p) as simpson, max(p) as best, sum(-p * ln(p)) as entropy from d group by all) select model_name, avg(simpson) as agreement_ceiling, avg(best) as best_possible, avg(entropy) as irreducible_entropy, count(*) as n_games from c group by 1")
def a48(spark, d):
    from palaver.functions.mathx import entropy_term

    c = stochastic(spark, d).groupBy("model_name", "game_id").agg(F.sum(F.col("p") * F.col("p")).alias("s"), F.max("p").alias("m"), F.sum(entropy_term(F.col("p"))).alias("e"))
    return c.groupBy("model_name").agg(F.avg("s").alias("agreement_ceiling"), F.avg("m").alias("best_possible"), F.avg("e").alias("irreducible_entropy"), F.count("*").alias("n_games"))


@query("A49_rosters", " select array_to_string(list_sort(player_names), ',') as roster, count(*) as n_games from g where player_names is not null group by 1")
def a49(spark, d):
    return games(spark, d).where("player_names is not null").groupBy(F.array_join(F.array_sort("player_names"), ",").alias("roster")).agg(F.count("*").alias("n_games"))


@query("A51_role_change", " select coalesce(s.role, e.role) as role, coalesce(n_start, 0) as n_start, coalesce(n_end, 0) as n_end, coalesce(n_end, 0) - coalesce(n_start, 0) as delta from (select start_role as role, count(*) as n_start from slot where start_role is not null group by 1) s full join (select end_role as role, count(*) as n_end from slot where end_role is not null group by 1) e on s.role = e.role")
def a51(spark, d):
    both = slots(spark, d).select(F.explode(F.array(F.struct(F.col("start_role").alias("role"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("end_role").alias("role"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x")).select("x.*")
    return both.where("role is not null").groupBy("role").agg(F.sum("s").alias("n_start"), F.sum("e").alias("n_end")).withColumn("delta", F.col("n_end") - F.col("n_start"))


@query("A52_transition", " , r as (select start_role as role from slot where start_role is not null union select end_role from slot where end_role is not null) select a.role as start_role, b.role as end_role, count(s.game_no) as n from r a cross join r b left join slot s on s.start_role = a.role and s.end_role = b.role group by all".lstrip())
def a52(spark, d):
    c = cut(slots(spark, d).groupBy("start_role", "end_role").agg(F.count("*").alias("n")))
    # Roles are a closed list of a few names: counted pairs first, then the square of distinct names.
    r = F.broadcast(c.select(F.explode(F.array("start_role", "end_role")).alias("role")).where("role is not null").distinct())
    grid = r.select(F.col("role").alias("start_role")).crossJoin(r.select(F.col("role").alias("end_role")))
    return grid.join(c, ["start_role", "end_role"], "left").fillna(0, ["n"])


@query("A53_wolf_counts", " , w as (select game_no, count_if(start_role = 'Werewolf') as s, count_if(end_role = 'Werewolf') as e from slot group by 1) select coalesce(cast(s as varchar), 'all') as at_start, coalesce(cast(e as varchar), 'all') as at_end, count(*) as n from w group by cube(s, e)".lstrip())
def a53(spark, d):
    w = slots(spark, d).groupBy("game_no").agg(F.count_if(F.col("start_role") == "Werewolf").alias("s"), F.count_if(F.col("end_role") == "Werewolf").alias("e"))
    return w.cube("s", "e").agg(F.count("*").alias("n")).select(F.coalesce(F.col("s").cast("string"), F.lit("all")).alias("at_start"), F.coalesce(F.col("e").cast("string"), F.lit("all")).alias("at_end"), "n")


@query("A54_role_presence", " select role, count(*) as n_games, max(n) as most_copies from (select game_no, start_role as role, count(*) as n from slot where start_role is not null group by all) group by 1")
def a54(spark, d):
    return slots(spark, d).where("start_role is not null").groupBy("game_no", F.col("start_role").alias("role")).agg(F.count("*").alias("n")).groupBy("role").agg(F.count("*").alias("n_games"), F.max("n").alias("most_copies"))


@query("A55_decks", " select array_to_string(list_sort(start_roles), '+') as deck, count(*) as n from g where start_roles is not null group by 1")
def a55(spark, d):
    return games(spark, d).where("start_roles is not null").groupBy(F.array_join(F.array_sort("start_roles"), "+").alias("deck")).agg(F.count("*").alias("n"))


@query("P01_exclusion", " select game_no, case when list_contains(coalesce(warning, []), 'different game') then 'different_game' when list_contains(coalesce(start_roles, []), 'NA') or list_contains(coalesce(end_roles, []), 'NA') then 'na_role' else 'keep' end as reason from g")
def p01(spark, d):
    has = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    return games(spark, d).select("game_no", F.when(has("warning", "different game"), "different_game").when(has("start_roles", "NA") | has("end_roles", "NA"), "na_role").otherwise("keep").alias("reason"))


@query("P02_warnings", " select game_no, list_filter(coalesce(warning, []), lambda x: lower(trim(x)) not in ('', 'n/a', 'na', 'none')) as warnings from g")
def p02(spark, d):
    none = F.array().cast("array<string>")
    return games(spark, d).select("game_no", F.filter(F.coalesce("warning", none), lambda x: ~F.lower(F.trim(x)).isin("", "n/a", "na", "none")).alias("warnings"))


@query("P03_no_wolf_flag", " select game_no, case when not list_contains(coalesce(end_roles, []), 'Werewolf') and not list_contains(coalesce(warning, []), 'no werewolf at end') then list_append(coalesce(warning, []), 'no werewolf at end') else coalesce(warning, []) end as warnings from g")
def p03(spark, d):
    none = F.array().cast("array<string>")
    w, flag = F.coalesce("warning", none), "no werewolf at end"
    return games(spark, d).select("game_no", F.when(~F.array_contains(F.coalesce("end_roles", none), "Werewolf") & ~F.array_contains(w, flag), F.array_append(w, flag)).otherwise(w).alias("warnings"))


@query("P04_role_values", " select game_no, list_transform(end_roles, lambda x: case x when 'NA' then null when 'Seer' then 'Oracle' else x end) as roles from g")
def p04(spark, d):
    names = F.create_map(F.lit("Seer"), F.lit("Oracle"))
    return games(spark, d).select("game_no", F.transform("end_roles", lambda x: F.when(x != "NA", F.coalesce(names[x], x))).alias("roles"))


@query("P06_status_pivot", " select model_name, count_if(status = 'player_vote') as player_vote, count_if(status = 'circle_vote') as circle_vote, count_if(status = 'invalid_vote') as invalid_vote, count_if(status = 'error_record') as error_record, count_if(status in ('player_vote', 'circle_vote')) * 100.0 / count(*) as pct_valid from v group by 1")
def p06(spark, d):
    kinds = ["player_vote", "circle_vote", "invalid_vote", "error_record"]
    v = votes(spark, d)
    x = v.groupBy("model_name").pivot("status", [*kinds, "missing_ground_truth"]).count().fillna(0)
    return x.withColumn("pct_valid", (F.col("player_vote") + F.col("circle_vote")) * 100.0 / (sum((F.col(k) for k in kinds), F.lit(0)) + F.col("missing_ground_truth"))).drop("missing_ground_truth")


@query("J03_ground_truth", " select v.file_row_id, case when g.game_id is null then 'missing_ground_truth' when v.chosen_player_name is null then 'no_vote' when list_contains(g.player_names, v.chosen_player_name) then 'on_roster' else 'off_roster' end as truth from v left join (select game_id, any_value(player_names) as player_names from g group by 1) g on g.game_id = v.game_id")
def j03(spark, d):
    g = games(spark, d).groupBy("game_id").agg(F.first("player_names").alias("player_names"), F.lit(True).alias("known"))
    return votes(spark, d).join(g, "game_id", "left").select("file_row_id", F.when(F.col("known").isNull(), "missing_ground_truth").when(F.col("chosen_player_name").isNull(), "no_vote").when(F.array_contains("player_names", F.col("chosen_player_name")), "on_roster").otherwise("off_roster").alias("truth"))


@query("J04_unmatched", " select v.file_row_id, v.game_id from v anti join g on g.game_id = v.game_id")
def j04(spark, d):
    return votes(spark, d).join(games(spark, d).select("game_id"), "game_id", "left_anti").select("file_row_id", "game_id")


@query("J05_voter_candidates", " select a.game_id, a.slot as voter, b.slot as candidate, case when a.vote is null then 0 else (a.vote = b.slot)::int end as label, (a.slot = b.slot) as is_self from slot a join slot b on a.game_id = b.game_id")
def j05(spark, d):
    s = slots(spark, d)
    # Pairs within one game's seats, which are few; a voter is a candidate too.
    b = s.select("game_id", F.col("slot").alias("candidate"))
    return s.select("game_id", F.col("slot").alias("voter"), "vote").join(b, "game_id").select("game_id", "voter", "candidate", F.coalesce((F.col("vote") == F.col("candidate")).cast("int"), F.lit(0)).alias("label"), (F.col("voter") == F.col("candidate")).alias("is_self"))


@query("J07_games_village", f", {HUM}, m as (select game_id, max(n) as most from h group by 1), a as (select model_name, game_id, max(n) as top from (select model_name, game_id, target, count(*) as n from vv group by all) group by all) select model_name, game_id, top, most from a join m using (game_id)")
def j07(spark, d):
    m = human(spark, d).groupBy("game_id").agg(F.max("n").alias("most"))
    a = V.distribution(valid_votes(spark, d), ["model_name", "game_id"]).groupBy("model_name", "game_id").agg(F.max("n").alias("top"))
    return a.join(m, "game_id").select("model_name", "game_id", "top", "most")


@query("W02_group_filter", f", {DIST} select model_name, game_id, target, p from d where total >= 2")
def w02(spark, d):
    return stochastic(spark, d).where("total >= 2").select("model_name", "game_id", "target", "p")


@query("W05_top_target", f", {DIST} select model_name, game_id, target, n from d qualify row_number() over (partition by model_name, game_id order by n desc, target) = 1")
def w05(spark, d):
    w = W.partitionBy("model_name", "game_id").orderBy(F.desc("n"), "target")
    return stochastic(spark, d).withColumn("k", F.row_number().over(w)).where("k = 1").select("model_name", "game_id", "target", "n")


@query("X09_game_class", f""", {HUM}, m as (select game_id, max(n) as most, sum(n) as n_votes from h group by 1), w as (select game_id, list(target order by target) as winners from h join m using (game_id) where n = most group by 1),
 z as (select game_id, list(slot order by slot) filter (where end_role = 'Werewolf') as wolves, count_if(end_role = 'Werewolf') > 0 as has_wolf from slot group by 1)
 select z.game_id, case when not has_wolf then 'no_werewolf' when w.game_id is null then 'no_human_votes' when len(list_filter(winners, lambda x: not list_contains(wolves, x))) = 0 then 'aligned' when len(list_filter(winners, lambda x: list_contains(wolves, x))) = 0 then 'dissociated' else 'mixed_tie' end as class from z left join w using (game_id)""")
def x09(spark, d):
    wolves = slots(spark, d).groupBy("game_id").agg(F.sort_array(F.collect_list(F.when(F.col("end_role") == "Werewolf", F.col("slot")))).alias("wolves"))
    w = V.plurality(human(spark, d), ["game_id"], least=0, circle=-1)
    x = wolves.join(w, "game_id", "left")
    return x.select("game_id", V.game_class(F.size("wolves") > 0, F.col("most"), F.col("winners"), F.col("wolves")).alias("class"))


@query("X10_herding", f", {HUM}, m as (select game_id, max(n) as most from h group by 1), w as (select h.game_id, s.player from h join m using (game_id) join slot s on s.game_id = h.game_id and s.slot = h.target where n = most and most >= 2) select v.file_row_id, case when v.is_circle_vote then 'other' when v.target in (select player from w where w.game_id = v.game_id) then 'herded' when v.is_correct then 'independent' else 'other' end as class from vv v where v.game_id in (select game_id from w)")
def x10(spark, d):
    w = V.plurality(human(spark, d), ["game_id"], circle=-1).where("most >= 2").select("game_id", F.explode("winners").alias("slot"))
    names = w.join(slots(spark, d), ["game_id", "slot"]).groupBy("game_id").agg(F.collect_set("player").alias("top"))
    return valid_votes(spark, d).join(names, "game_id").select("file_row_id", F.when(F.col("is_circle_vote"), "other").when(F.array_contains("top", F.col("target")), "herded").when(F.col("is_correct"), "independent").otherwise("other").alias("class"))


@query("X20_chosen_vote", " select result_id, coalesce(nullif(trim(validation.chosen_vote), ''), nullif(trim(parsed_output.chosen_vote), '')) as vote from vote_results qualify row_number() over (partition by result_id order by created_at) = 1")
def x20(spark, d):
    from palaver.tables import first_delivery, table

    r = first_delivery(table(spark, d, "vote_results"), ["result_id"], "created_at", ["validation", "parsed_output"])
    return r.select("result_id", J.chosen_vote(F.col("validation.chosen_vote"), F.col("parsed_output.chosen_vote")).alias("vote"))


@query("F20_model_size", " select model_name, nullif(upper(regexp_extract(model_name, '(?i)(\\d+b)', 1)), '') as size, count(*) as n from v group by all")
def f20(spark, d):
    return votes(spark, d).groupBy("model_name", model_size(F.col("model_name")).alias("size")).agg(F.count("*").alias("n"))


@query("F39_roster_vote", " select file_row_id, case when list_contains(player_names, trim(chosen_vote_raw)) then trim(chosen_vote_raw) else list_filter(player_names, lambda x: lower(trim(x)) = lower(trim(chosen_vote_raw)))[1] end as name from v join (select game_id, any_value(player_names) as player_names from g group by 1) using (game_id)")
def f39(spark, d):
    g = games(spark, d).groupBy("game_id").agg(F.first("player_names").alias("player_names"))
    return votes(spark, d).join(g, "game_id").select("file_row_id", J.roster_name(F.col("chosen_vote_raw"), F.col("player_names")).alias("name"))
