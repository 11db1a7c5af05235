"""Queries of vote models: M01, M02, M08, M09, M11-M20, F54, F55."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.keys import hash_rank
from palaver.operators import choice as C
from palaver.operators.joins import summed_by_name
from palaver.plans.event_queries import ROLES, accused
from palaver.plans.silver import LABELS, NO_LABEL, roster, slots, spoken, sql, valid_votes
from palaver.session import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}

A = [f"pt_{k.lower().replace(' ', '_')}" for k in LABELS] + ["n_utterances"]
BB = ["acc_werewolf", "acc_deception", "acc_other"]


def query(name: str, statement: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if statement:
            SQL[name] = sql(statement)
        return fn

    return keep


def features(spark, d):
    """Strategy counts and received accusations of each seat.

    Lines are counted by game and speaker before they meet the roster, so the join is of counts.
    """
    said = spoken(spark, d).groupBy("game_id", "k").agg(F.count("*").alias("n_utterances"), *[F.count_if(F.array_contains("labels", k)).alias(f"pt_{k.lower().replace(' ', '_')}") for k in LABELS])
    pt = said.join(roster(spark, d), ["game_id", "k"])
    kind = F.coalesce("type", F.lit(""))
    ac = accused(spark, d).where("accused <> 'UNKNOWN'").groupBy("game_id", F.col("accused").alias("player")).agg(F.count_if(kind == "werewolf").alias("acc_werewolf"), F.count_if(kind == "deception").alias("acc_deception"), F.count_if(~kind.isin("werewolf", "deception")).alias("acc_other"))
    return summed_by_name(slots(spark, d).select("game_id", "slot", "player", "end_role", "vote"), [pt, ac], ["game_id"], "player", A + BB)


def counted(spark, d):
    """The stochastic votes of each model and game for each alternative."""
    return valid_votes(spark, d).where("decoding = 'stochastic'").groupBy(F.coalesce("model_name", F.lit("")).alias("model_name"), "game_id", F.col("target").alias("player")).agg(F.count("*").alias("n"))


def ballot(spark, d, circle: bool = True):
    """Alternatives of each model and game with the model's stochastic votes for them."""
    f = features(spark, d).withColumn("is_circle_option", F.lit(0.0)).select("game_id", "player", *A, *BB, "is_circle_option")
    if circle:
        none = f.select("game_id").distinct().select("game_id", F.lit("No Werewolf").alias("player"), *[F.lit(0.0).alias(c) for c in A + BB], F.lit(1.0).alias("is_circle_option"))
        f = f.unionByName(none)
    n = counted(spark, d)
    return n.select("model_name", "game_id").distinct().join(f, "game_id").join(n, ["model_name", "game_id", "player"], "left").fillna(0, ["n"])


def sets(spark, d, cols, circle=True):
    """The choice sets of :func:`ballot`."""
    f = features(spark, d).withColumn("is_circle_option", F.lit(0.0)).select("game_id", "player", *cols)
    none = {"No Werewolf": [float(c == "is_circle_option") for c in cols]} if circle else {}
    return C.sets_by_key(f, counted(spark, d), "game_id", "player", "n", cols, "model_name", none)


def fits(spark, d, cols=None, circle=True):
    """The fit of each model."""
    cols = cols or FULL
    return C.fitted_by(sets(spark, d, cols, circle), cols, (cols.index("is_circle_option"),) if circle else ())


FULL = A + BB + ["is_circle_option"]
BLOCKS = {"A": A, "B": BB, "both": A + BB}


@query("M08_features", f""", pt as (select game_id, lower(trim(player)) as k, count(*) as n, {', '.join(f"count_if(list_contains(labels, '{k}')) as c{i}" for i, k in enumerate(LABELS))} from line where player is not null group by all)
 select s.game_id, s.slot, s.player, coalesce(n, 0)::double as n_utterances, {', '.join(f"coalesce(c{i}, 0)::double as pt_{k.lower().replace(' ', '_')}" for i, k in enumerate(LABELS))} from slot s left join pt on pt.game_id = s.game_id and pt.k = lower(trim(s.player))""")
def m08(spark, d):
    return features(spark, d).select("game_id", "slot", "player", *A)


@query("F54_one_hot", " select game_id, slot, [" + ", ".join(f"(end_role = '{r}')::int" for r in ROLES) + "] as hot from slot where end_role is not null")
def f54(spark, d):
    return slots(spark, d).where("end_role is not null").select("game_id", "slot", F.array(*[(F.col("end_role") == r).cast("int") for r in ROLES]).alias("hot"))


_AC = """, rr as (select record_id, game_id, items from accusation_records qualify row_number() over (partition by record_id order by loaded_at) = 1),
rl as (select game_id, re.type as type, re.accused as accused from (select game_id, unnest(it.relations) as re from (select game_id, unnest(items) as it from rr) where it is not null) where re is not null),
ac as (select game_id, lower(trim(accused)) as k, count_if(type = 'werewolf')::double as a0, count_if(type = 'deception')::double as a1, count_if(coalesce(type, '') not in ('werewolf', 'deception'))::double as a2 from (select game_id, type, unnest(accused) as accused from rl) where accused is not null and regexp_matches(accused, '\\S') and accused <> 'UNKNOWN' group by all)"""


@query("F55_vectors", f""", pt as (select game_id, lower(trim(player)) as k, count(*)::double as n, {', '.join(f"count_if(list_contains(labels, '{k}'))::double as c{i}" for i, k in enumerate(LABELS))} from line where player is not null group by all) {_AC}
 select s.game_id, s.slot, [{', '.join(f"coalesce(c{i}, 0)" for i in range(len(LABELS)))}, coalesce(n, 0)] as technique, [{', '.join(f"coalesce(c{i}, 0)" for i in range(len(LABELS)))}, coalesce(n, 0), coalesce(a0, 0), coalesce(a1, 0), coalesce(a2, 0)] as enriched from slot s left join pt on pt.game_id = s.game_id and pt.k = lower(trim(s.player)) left join ac on ac.game_id = s.game_id and ac.k = lower(trim(s.player))""")
def f55(spark, d):
    return features(spark, d).select("game_id", "slot", F.array(*[F.col(c) for c in A]).alias("technique"), F.array(*[F.col(c) for c in A + BB]).alias("enriched"))


@query("M09_coefficients")
def m09(spark, d):
    return spark.createDataFrame([(m, f, float(b)) for m, fit in fits(spark, d).items() for f, b in zip(FULL, fit["beta"])], "model_name string, feature string, coefficient double")


@query("M11_choice_metrics")
def m11(spark, d):
    sums = [(m, fit["sums"]) for m, fit in fits(spark, d).items()]
    return spark.createDataFrame([(m, float(s.ll[0] / s.n[0]), float(s.hits[0] / s.n[0]), float(s.null[0] / s.n[0])) for m, s in sums], "model_name string, mean_ll double, hit_rate double, null_ll double")


@query("M12_cross_validation")
def m12(spark, d):
    """Every penalty by itself, and (penalty null) the one chosen in inner folds of each training set."""
    x = cut(sets(spark, d, FULL))
    free = (len(FULL) - 1,)
    rows = C.cross_validated(x, FULL, list(C.PENALTIES), free, ready=True)
    rows += [(m, None, ll, sd, hit, r2) for m, ll, sd, hit, _, r2 in C.tuned_metrics(C.tuned(x, FULL, free, ready=True))]
    return spark.createDataFrame(rows, "model_name string, penalty double, mean_ll double, sd_ll double, hit_rate double, pseudo_r2 double")


def rule_hits(b, score: str, draws: int = 25):
    """Hit rate of voting for the highest ``score`` of each ballot, averaged over random tie-breaks."""
    keys = ["model_name", "game_id"]
    r = b.groupBy(*keys).agg(F.collect_list(F.struct(F.col(score).alias("s"), F.col("player").alias("p"), F.col("n").cast("long").alias("n"))).alias("r"), F.sum("n").alias("n")).where("n > 0")
    # Only what is tied for the first place is drawn.
    top = r.withColumn("best", F.array_max("r")["s"]).select(*keys, "n", F.filter("r", lambda x: x["s"].eqNullSafe(F.col("best"))).alias("t"))
    drawn = lambda i: F.array_max(F.transform("t", lambda x: F.struct(hash_rank(F.col("model_name"), F.col("game_id"), x["p"], i).alias("h"), x["n"].alias("n"))))["n"]
    hit = F.when(F.size("t") == 1, F.col("t")[0]["n"] * draws).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(draws)), F.lit(0).cast("long"), lambda a, i: a + drawn(i)))
    return top.groupBy("model_name").agg((F.sum(hit) / (F.sum("n") * draws)).alias("hit_rate"))


@query("M15_grid")
def m15(spark, d):
    """Every block and learner, and the rules that vote for the most talkative or most accused player."""
    b = cut(ballot(spark, d))
    whole = cut(C.choice_sets(b, ["game_id"], "player", "n", FULL, "model_name"))
    rows = []
    for block, cols in BLOCKS.items():
        full = [*cols, "is_circle_option"]
        x = whole if full == FULL else cut(C.with_features(whole, FULL, full))
        for learner in ("clogit", "l2", "l1"):
            rows += [(m, block, learner, *r) for m, *r in C.tuned_metrics(C.tuned(x, full, (len(cols),), learner, ready=True))]
    for rule, score in (("most_talkative", "n_utterances"), ("most_accused", "acc_werewolf")):
        rows += [(r["model_name"], rule, "rule", None, None, float(r["hit_rate"]), None, None) for r in rule_hits(b, score).collect()]
    return spark.createDataFrame(rows, "model_name string, block string, learner string, mean_ll double, sd_ll double, hit_rate double, sd_hit double, pseudo_r2 double")


@query("M14_permutation")
def m14(spark, d):
    fit = C.tuned(sets(spark, d, FULL), FULL, (len(FULL) - 1,))
    return spark.createDataFrame(C.permutation_importance(fit), "model_name string, feature string, loss double, share_positive double")


@query("M16_odds_ratios")
def m16(spark, d):
    return spark.createDataFrame([(m, *r) for m, fit in fits(spark, d).items() for r in C.odds_table(fit)], "model_name string, feature string, odds_ratio double, lo double, hi double, z double, p double, p_bonferroni double")


@query("M17_block_test")
def m17(spark, d):
    return spark.createDataFrame([(m, t, *C.wald(fit, cols)) for m, fit in fits(spark, d).items() for t, cols in (("B over A", BB), ("A over B", A))], "model_name string, test string, chi2 double, df int, p double")


@query("M18_stability")
def m18(spark, d):
    return spark.createDataFrame(C.stability(sets(spark, d, FULL), FULL, 5, (len(FULL) - 1,), samples=200, tries=4), "model_name string, feature string, frequency double, penalty double")


@query("M19_block_bootstrap")
def m19(spark, d):
    """Held-out log-likelihood of one block less that of another, games resampled."""
    whole, score = cut(sets(spark, d, FULL)), None
    for name, cols in BLOCKS.items():
        full = [*cols, "is_circle_option"]
        x = whole if full == FULL else cut(C.with_features(whole, FULL, full))
        one = C.held_out_scores(C.tuned(x, full, (len(cols),), ready=True)).withColumnRenamed("ll", name)
        score = one if score is None else score.join(one, ["group", "key"])
    return C.score_bootstrap(score, [("A", "B"), ("B", "both"), ("A", "both")], 2000)


@query("M20_iia")
def m20(spark, d):
    full, rest = fits(spark, d), fits(spark, d, A + BB, circle=False)
    return spark.createDataFrame([(m, *C.iia(full[m], rest[m])) for m in full if m in rest], "model_name string, statistic double, df int, p double, verdict string")


def pairs(spark, d):
    """Voter and candidate rows with the candidate's features and the human label."""
    f = features(spark, d)
    v = f.select("game_id", F.col("slot").alias("voter"), F.col("vote"))
    return v.join(f.drop("vote"), "game_id").withColumn("label", F.coalesce((F.col("vote") == F.col("slot")).cast("int"), F.lit(0)).cast("double")).withColumn("g", F.pmod(F.xxhash64("game_id"), F.lit(10)))


@query("M01_binary_logit")
def m01(spark, d):
    p = cut(pairs(spark, d))
    model, _ = C.binary_logit(p.where("g < 8"), A + BB, "label")
    return spark.createDataFrame([*[(f, float(c)) for f, c in zip(A + BB, model.coefficients)], ("intercept", float(model.intercept))], "feature string, coefficient double")


@query("M02_grid_search")
def m02(spark, d):
    p = cut(pairs(spark, d))
    return spark.createDataFrame(C.grid_search(p.where("g < 8"), p.where("g >= 8"), A + BB, "label", [0.1, 1.0], [1.0, 3.0]), "c double, weight double, threshold double, f1 double, auc double")


@query("M13_boosted_ranker")
def m13(spark, d):
    """Hit rates on a fifth of the games, by rankers that are trained on the others."""
    from pyspark.ml.functions import vector_to_array

    b = cut(ballot(spark, d).withColumn("fold", F.pmod(hash_rank(F.col("game_id")), F.lit(5))).withColumn("label", (F.col("n") > 0).cast("double")).withColumn("w", F.greatest(F.col("n"), F.lit(1)).cast("double")))
    names = sorted(r[0] for r in b.select("model_name").distinct().collect())

    def one(m: str):
        mine = b.where(F.col("model_name") == m)
        model, _ = C.boosted_ranker(mine.where("fold <> 0"), FULL, "label", "w", trees=100)
        scored = model.transform(C.binary_logit_input(mine.where("fold = 0"), FULL)).select("game_id", "player", "n", vector_to_array("probability")[1].alias("p"))
        top = scored.groupBy("game_id").agg(F.max_by("n", F.struct("p", "player")).alias("hit"), F.sum("n").alias("n")).where("n > 0")
        return top.agg(F.lit(m).alias("model_name"), (F.sum("hit") / F.sum("n")).alias("hit_rate"), F.count("*").alias("n_games"))

    # A tree is a few short jobs that leave most cores idle: the models' jobs run side by side.
    with ThreadPoolExecutor(max(1, min(8, len(names)))) as pool:
        parts = list(pool.map(one, names))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "model_name string, hit_rate double, n_games long")
