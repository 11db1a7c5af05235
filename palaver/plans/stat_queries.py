"""Queries of tests, metrics and bootstraps: B01-B08, H01-H05, M03-M07, W03, W04, W12, F60, F61."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions.mathx import entropy_term, hypergeometric_two_or_more
from palaver.operators import bootstrap as B
from palaver.operators import stats as T
from palaver.operators.joins import pairings
from palaver.plans.event_queries import accusations
from palaver.plans.silver import lines, slots, sql, valid_votes, votes
from palaver.session import cut
from palaver.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
REPS = 2_000


def query(name: str, statement: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if statement:
            SQL[name] = sql(statement)
        return fn

    return keep


def _w(key: str) -> str:
    u = f"(cast('0x' || substr(md5(concat_ws(':', {key}, cast(rep as varchar))), 1, 8) as ubigint) / 4294967296.0)"
    return "case " + " ".join(f"when {u} < {b!r} then {k}" for k, b in enumerate(B.POISSON)) + " else 8 end"


_R = f"reps as (select unnest(range(0, {REPS})) as rep)"


def game_accuracy(spark, d):
    """Accuracy of each game and model."""
    return valid_votes(spark, d).where("decoding = 'stochastic' and is_correct is not null").groupBy("model_name", "game_id").agg(F.avg(F.col("is_correct").cast("int")).alias("p"))


GA = "ga as (select model_name, game_id, avg(is_correct::int) as p from vv where decoding = 'stochastic' and is_correct is not null group by all)"


@query("B01_mean_interval", f", {GA}, {_R}, x as (select model_name, rep, {_w('game_id')} as w, p from ga cross join reps), dr as (select model_name, rep, sum(w * p) / sum(w) as m from x where w > 0 group by all) select ga.model_name, avg(p) as mean, count(p) as n, any_value(n_draws) as n_draws, any_value(lo) as lo, any_value(hi) as hi from ga join (select model_name, count(*) as n_draws, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from dr group by 1) q on q.model_name = ga.model_name group by 1")
def b01(spark, d):
    return B.mean(cut(game_accuracy(spark, d)), "game_id", "p", REPS, ["model_name"])


@query("B02_difference", f", {GA}, {_R}, x as (select model_name, rep, {_w(chr(39) + chr(39) + ' || model_name || ' + chr(39) + '|' + chr(39) + ' || game_id')} as w, p from ga cross join reps where model_name is not null), dr as (select model_name, rep, sum(w * p) / sum(w) as m from x where w > 0 group by all), di as (select a.model_name as first, b.model_name as second, a.m - b.m as v from dr a join dr b on a.rep = b.rep and a.model_name < b.model_name), pt as (select model_name, avg(p) as m from ga group by 1) select first, second, (select m from pt where model_name = first) - (select m from pt where model_name = second) as difference, count(v) as n_draws, quantile_cont(v, 0.025) as lo, quantile_cont(v, 0.975) as hi from di group by all")
def b02(spark, d):
    return B.differences(cut(game_accuracy(spark, d)), "game_id", "p", "model_name", REPS)


def _pairs(spark, d):
    """Accuracies of both models of every pair over the games both have."""
    return pairings(game_accuracy(spark, d), ["game_id"], "model_name", ["p"]).select(F.col("a").alias("first"), F.col("b").alias("second"), "game_id", "p_a", "p_b")


_P = f"{GA}, pb as (select x.model_name as first, y.model_name as second, game_id, x.p as a, y.p as b from ga x join ga y using (game_id) where x.model_name < y.model_name)"


@query("B03_paired", f", {_P}, {_R}, x as (select first, second, rep, {_w('game_id')} as w, a - b as v from pb cross join reps), dr as (select first, second, rep, sum(w * v) / sum(w) as v from x where w > 0 group by all), pt as (select first, second, avg(a - b) as difference, count(*) as n from pb group by all) select pt.*, n_draws, case when n_draws >= {REPS} / 2 then lo end as lo, case when n_draws >= {REPS} / 2 then hi end as hi from pt join (select first, second, count(*) as n_draws, quantile_cont(v, 0.025) as lo, quantile_cont(v, 0.975) as hi from dr group by all) using (first, second)")
def b03(spark, d):
    return B.paired(cut(_pairs(spark, d)), "game_id", "p_a", "p_b", REPS, by=["first", "second"])


@query("B04_weighted_paired", f", {_P}, sl as (select game_id, count(*) as wt from slot group by 1), pw as (select pb.*, wt from pb left join sl using (game_id)), {_R}, x as (select first, second, rep, {_w('game_id')} as w, wt * (a - b) as num, wt as den from pw cross join reps), dr as (select first, second, rep, sum(w * num) / sum(w * den) as v from x where w > 0 group by all), pt as (select first, second, sum(wt * (a - b)) / sum(wt) as difference, count(*) as n from pw group by all) select pt.*, n_draws, case when n_draws >= {REPS} / 2 then lo end as lo, case when n_draws >= {REPS} / 2 then hi end as hi from pt join (select first, second, count(*) as n_draws, quantile_cont(v, 0.025) as lo, quantile_cont(v, 0.975) as hi from dr where v is not null group by all) using (first, second)")
def b04(spark, d):
    w = slots(spark, d).groupBy("game_id").agg(F.count("*").alias("wt"))
    return B.paired(cut(_pairs(spark, d).join(w, "game_id", "left")), "game_id", "p_a", "p_b", REPS, "wt", by=["first", "second"])


@query("B05_ratio", f", gl as (select source, game_id, count_if(list_contains(labels, 'Accusation'))::double as num, count(*)::double as den from line group by all), {_R}, x as (select source, rep, {_w('game_id')} as w, num, den from gl cross join reps), dr as (select source, rep, sum(w * num) / sum(w * den) * 100 as v from x where w > 0 group by all), q as (select source, count(*) as n_draws, quantile_cont(v, 0.00625) as lo, quantile_cont(v, 0.99375) as hi from dr group by 1) select gl.source, sum(num) / sum(den) * 100 as rate, any_value(n_draws) as n_draws, any_value(lo) as lo, any_value(hi) as hi from gl join q on q.source = gl.source group by 1")
def b05(spark, d):
    c = lines(spark, d).groupBy("source", "game_id").agg(F.count_if(F.array_contains("labels", "Accusation")).cast("double").alias("num"), F.count("*").cast("double").alias("den"))
    return B.ratio(cut(c), "game_id", "num", "den", REPS, ["source"], tests=4)


_B06 = f""", y as (select model_name, game_id, is_correct::int as label, (voted_player_start_role = 'Werewolf')::int as pred, least(99, floor(least(length(justification), 999) / 1000.0 * 100 + 1e-9))::int as b from vv where model_name is not null and is_correct is not null and not is_circle_vote and voted_player_start_role is not null and justification is not null),
c as (select model_name, game_id, b, count_if(label = 1) as p, count_if(label = 0) as n, count_if(label = 1 and pred = 1) as tp, count_if(pred = 1) as pp from y group by all), {_R},
x as (select c.*, rep, {_w('game_id')} as w from c cross join reps union all select c.*, -1, 1 from c),
cell as (select model_name, rep, b, sum(w * p) as p, sum(w * n) as n, sum(w * tp) as tp, sum(w * pp) as pp from x where w > 0 group by all),
run as (select *, coalesce(sum(n) over (partition by model_name, rep order by b rows between unbounded preceding and 1 preceding), 0) as below from cell),
dr as (select model_name, rep, 2.0 * sum(tp) / nullif(sum(p) + sum(pp), 0) as f1, sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0) as auc from run group by all),
lg as (select model_name as first, rep, 'f1' as metric, f1 as v from dr union all select model_name, rep, 'auc', auc from dr),
bo as (select first, '' as second, metric, rep, v from lg union all select a.first, b.first, metric, rep, a.v - b.v from lg a join lg b using (rep, metric) where a.first < b.first)
select z.first, z.second, z.metric, z.v as value, n_draws, lo, hi from bo z join (select first, second, metric, count(*) as n_draws, quantile_cont(v, 0.025) as lo, quantile_cont(v, 0.975) as hi from bo where rep >= 0 and v is not null group by all) q using (first, second, metric) where z.rep < 0"""


@query("B06_f1_interval", _B06)
def b06(spark, d):
    """F1 of the start-role rule and AUC of the length of justifications, by model and between models."""
    y = valid_votes(spark, d).where("model_name is not null and is_correct is not null and not is_circle_vote and voted_player_start_role is not null and justification is not null")
    y = y.select("model_name", "game_id", F.col("is_correct").cast("int").alias("label"), (F.col("voted_player_start_role") == "Werewolf").cast("int").alias("pred"), (F.least(F.length("justification"), F.lit(999)) / 1000.0).alias("score"))
    return B.f1_auc_intervals(cut(B.f1_auc_draws(y, "game_id", "model_name", "label", "pred", "score", REPS)), "model_name")


_ACC = """r as (select record_id, game_id, items from accusation_records qualify row_number() over (partition by record_id order by loaded_at) = 1),
l as (select game_id, unnest(it.relations) as re from (select game_id, unnest(items) as it from r) where it is not null), ac as (select game_id, a as accused, count(*) as n from (select game_id, unnest(re.accused) as a from l where re is not null) where a is not null and regexp_matches(a, '\\S') group by all),
ps as (select s.game_id, s.end_role, coalesce(n, 0) as n from slot s left join ac on ac.game_id = s.game_id and ac.accused = s.player),
gc as (select game_id, sum(case when end_role = 'Werewolf' then n else 0 end)::double as n1, count_if(end_role = 'Werewolf')::double as d1, sum(case when end_role is distinct from 'Werewolf' then n else 0 end)::double as n2, count_if(end_role is distinct from 'Werewolf')::double as d2 from ps group by 1)"""


@query("B07_contrast", f", {_ACC}, {_R}, x as (select rep, {_w('game_id')} as w, n1, d1, n2, d2 from gc cross join reps), dr as (select rep, sum(w * n1) / nullif(sum(w * d1), 0) - sum(w * n2) / nullif(sum(w * d2), 0) as v from x where w > 0 group by 1), s as (select list(v order by v) as v from dr where v is not null) select (select sum(n1) / sum(d1) - sum(n2) / sum(d2) from gc) as difference, len(v)::int as n_draws, v[floor(len(v) * 0.025)::int + 1] as lo, v[floor(len(v) * 0.975)::int] as hi from s")
def b07(spark, d):
    n = accusations(spark, d).groupBy("game_id", F.col("accused").alias("player")).agg(F.count("*").alias("n"))
    p = slots(spark, d).join(n, ["game_id", "player"], "left").fillna(0, ["n"])
    wolf = F.col("end_role").eqNullSafe("Werewolf")
    c = p.groupBy("game_id").agg(F.sum(F.when(wolf, F.col("n")).otherwise(0)).cast("double").alias("n1"), F.count_if(wolf).cast("double").alias("d1"), F.sum(F.when(~wolf, F.col("n")).otherwise(0)).cast("double").alias("n2"), F.count_if(~wolf).cast("double").alias("d2"))
    return B.contrast(cut(c), "game_id", "n1", "d1", "n2", "d2", REPS)


@query("B08_share_change", f", ch as (select game_id, start_role as role, count_if(start_role is distinct from end_role)::double as num, count(*)::double as den from slot where start_role is not null group by all), {_R}, x as (select role, rep, {_w('game_id')} as w, num, den from ch cross join reps), dr as (select role, rep, sum(w * num) / sum(w * den) * 100 as v from x where w > 0 group by all), q as (select role, count(*) as n_draws, quantile_cont(v, 0.025) as lo, quantile_cont(v, 0.975) as hi from dr group by 1) select ch.role, sum(num) / sum(den) * 100 as rate, any_value(n_draws) as n_draws, any_value(lo) as lo, any_value(hi) as hi from ch join q on q.role = ch.role group by 1")
def b08(spark, d):
    c = slots(spark, d).where("start_role is not null").groupBy("game_id", F.col("start_role").alias("role")).agg(F.count_if(~F.col("start_role").eqNullSafe(F.col("end_role"))).cast("double").alias("num"), F.count("*").cast("double").alias("den"))
    return B.ratio(cut(c), "game_id", "num", "den", REPS, ["role"])


@query("H01_chi_square", """, c as (select start_role as a, unnest(labels) as b from line join slot using (game_id, player)), t as (select a, b, count(*) as o from c where a is not null and b <> 'No Strategy' group by all), m as (select *, sum(o) over (partition by a) as r, sum(o) over (partition by b) as k, sum(o) over () as n from t), s as (select sum(o * o * n / (r * k)) - max(n) as chi2, max(n)::bigint as n, count(distinct a) as na, count(distinct b) as nb, min(r) * min(k) / max(n) as min_expected from m)
 select chi2, ((na - 1) * (nb - 1))::int as df, n, sqrt(chi2 / (n * least(na - 1, nb - 1))) as cramers_v, min_expected from s""")
def h01(spark, d):
    x = lines(spark, d).join(slots(spark, d).select("game_id", "player", "start_role"), ["game_id", "player"]).withColumn("label", F.explode("labels")).where("label <> 'No Strategy'")
    return T.chi_square(x, "start_role", "label").drop("p")


@query("H01_chi_square_p")
def h01_p(spark, d):
    return T.chi_square(votes(spark, d), "model_name", "status")


@query("H02_marginal_homogeneity")
def h02(spark, d):
    return spark.createDataFrame([T.marginal_homogeneity(slots(spark, d), "start_role", "end_role")], "statistic double, df int, p double")


@query("H03_mcnemar", """, m as (select start_role as a, end_role as b, count(*) as n from slot where start_role <> end_role group by all), c as (select category, sum(lost)::bigint as lost, sum(gained)::bigint as gained from (select a as category, n as lost, 0 as gained from m union all select b, 0, n from m) group by 1) select category, lost, gained from c""")
def h03(spark, d):
    return T.mcnemar(slots(spark, d), "start_role", "end_role").select("category", "lost", "gained")


@query("H03_mcnemar_p")
def h03_p(spark, d):
    return T.mcnemar(slots(spark, d), "start_role", "end_role")


@query("W12_holm", ", p as (select model_name, status, count(*) * 1.0 / sum(count(*)) over () as p from v group by model_name, status), s as (select *, least(1.0, (count(*) over () - row_number() over (order by p, model_name, status) + 1) * p) as s from p) select model_name, status, p, max(s) over (order by p, model_name, status rows unbounded preceding) as p_holm from s")
def w12(spark, d):
    from pyspark.sql.window import Window as W

    x = votes(spark, d).groupBy("model_name", "status").agg(F.count("*").alias("n"))
    x = x.select("model_name", "status", (F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("p"))
    return T.holm(x, "p", ["model_name", "status"])


@query("H04_spearman", ", x as (select length(utterance)::double as a, rec_id::double as b from line where utterance is not null), r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from x) select count(*) as n, corr(ra, rb) as rho from r")
def h04(spark, d):
    x = lines(spark, d, text=True).where("utterance is not null").select(F.length("utterance").alias("a"), F.col("rec_id").alias("b"))
    return T.spearman(cut(x), "a", "b").select("n", "rho")


@query("M05_auc", ", y as (select model_name, is_correct::int as label, length(justification) as score from vv where is_correct is not null and justification is not null), r as (select *, rank() over (partition by model_name order by score) + (count(*) over (partition by model_name, score) - 1) / 2.0 as rk from y) select model_name, sum(label)::bigint as n_pos, sum(1 - label)::bigint as n_neg, (sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0) as auc from r group by 1")
def m05(spark, d):
    y = valid_votes(spark, d).where("is_correct is not null and justification is not null").select("model_name", F.col("is_correct").cast("int").alias("label"), F.length("justification").alias("score"))
    return T.auc(y, "label", "score", ["model_name"])


_SC = "y as (select model_name, game_id, file_row_id, is_correct::int as label, least(length(justification), 999) / 1000.0 as score from vv where is_correct is not null and justification is not null)"


def _scored(spark, d):
    return valid_votes(spark, d).where("is_correct is not null and justification is not null").select("model_name", "game_id", "file_row_id", F.col("is_correct").cast("int").alias("label"), (F.least(F.length("justification"), F.lit(999)) / 1000.0).alias("score"))


@query("M03_best_threshold", f", {_SC}, t as (select unnest(range(1, 100)) as t), c as (select model_name, t, count_if(label = 1 and floor(score * 100 + 1e-9) >= t) as tp, count_if(floor(score * 100 + 1e-9) >= t) as pp, count_if(label = 1) as pos from y cross join t group by all), f as (select model_name, t / 100.0 as threshold, coalesce(2.0 * tp / nullif(pp + pos, 0), 0) as f1 from c) select model_name, threshold, f1 from f qualify row_number() over (partition by model_name order by f1 desc, threshold) = 1")
def m03(spark, d):
    return T.best_threshold(_scored(spark, d), "label", "score", ["model_name"])


@query("M04_classification", f", {_SC}, z as (select *, (score >= 0.3)::int as pred from y) select model_name, count(*) as n, coalesce(2.0 * count_if(label = 1 and pred = 1) / nullif(count_if(label = 1) + count_if(pred = 1), 0), 0) as f1, avg((label = pred)::int) as accuracy, avg(label) as positive_rate, avg(pred) as predicted_rate from z group by 1")
def m04(spark, d):
    return T.classification(_scored(spark, d).withColumn("pred", (F.col("score") >= 0.3).cast("int")), "label", "pred", ["model_name"])


@query("M06_ranking", f", {_SC}, k as (select *, rank() over (partition by model_name, game_id order by score desc) as r, row_number() over (partition by model_name, game_id order by score desc, file_row_id) as k from y) select avg(case when k = 1 then label end) as top1_accuracy, avg(case when label = 1 then 1.0 / r end) as mrr, count_if(k = 1) as n_groups from k")
def m06(spark, d):
    return T.ranking(_scored(spark, d), ["model_name", "game_id"], "label", "score", "file_row_id")


@query("M07_standardised", f", {_SC} select file_row_id, (score - (select avg(score) from y)) / (select case when coalesce(stddev_pop(score), 0) = 0 then 1 else stddev_pop(score) end from y) as score from y")
def m07(spark, d):
    return T.standardised(_scored(spark, d).select("file_row_id", "score"), ["score"])


@query("W03_within_set", f", {_SC} select file_row_id, score / sum(score) over (partition by model_name, game_id) as share from y")
def w03(spark, d):
    from pyspark.sql.window import Window as W

    return _scored(spark, d).select("file_row_id", (F.col("score") / F.sum("score").over(W.partitionBy("model_name", "game_id"))).alias("share"))


@query("F60_entropy", ", p as (select game_id, start_role, count(*) * 1.0 / sum(count(*)) over (partition by game_id) as p from slot where start_role is not null group by game_id, start_role) select game_id, sum(-p * ln(p)) as entropy from p group by 1")
def f60(spark, d):
    from pyspark.sql.window import Window as W

    c = slots(spark, d).where("start_role is not null").groupBy("game_id", "start_role").agg(F.count("*").alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("game_id"))).groupBy("game_id").agg(F.sum(entropy_term(F.col("p"))).alias("entropy"))


@query("F61_two_or_more", " , c as (select game_id, any_value(n_players) as n, count_if(end_role = 'Werewolf') as k from slot group by 1) select game_id, n::int as n, k::int as k, greatest(0, 1 - case when n - k < 3 then 0 else (n - k) * (n - k - 1) * (n - k - 2) * 1.0 / (n * (n - 1) * (n - 2)) end - k * case when n - k < 2 then 0 else 3.0 * (n - k) * (n - k - 1) / (n * (n - 1) * (n - 2)) end) as p from c where n >= 3".lstrip())
def f61(spark, d):
    c = slots(spark, d).groupBy("game_id").agg(F.max("n_players").cast("int").alias("n"), F.count_if(F.col("end_role") == "Werewolf").cast("int").alias("k")).where("n >= 3")
    return c.select("game_id", "n", "k", hypergeometric_two_or_more(F.col("n"), F.col("k"), F.lit(3)).alias("p"))


@query("A70_cube", " select coalesce(source, 'all') as source, coalesce(lang, 'all') as lang, count(*) as n from (select distinct doc_id, coalesce(lower(trim(source)), '?') as source, coalesce(lower(substr(lang, 1, 2)), '?') as lang from documents) group by cube(source, lang)")
def a70(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("?")).alias("source"), F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit("?")).alias("lang")).distinct()
    return x.cube("source", "lang").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("lang", F.lit("all")).alias("lang"), "n")
