"""Queries of the label family: A01-A09, A41-A43, A56, A57, W01-W11, F50, P11, U03, U06."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palaver.operators import labels as L
from palaver.plans.silver import LABELS, NO_LABEL, games, lines, slots, sql
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


E = "e as (select line_id, game_id, source, player, unnest(labels) as label from line)"


@query("A01_label_counts", f""", {E} select label, count(*) as n_assignments, count(distinct line_id) as n_rows, count(distinct game_id) as n_groups,
 count(*) * 100.0 / (select count(*) from e where label <> 'No Strategy') as pct_assignments, count(distinct line_id) * 100.0 / (select count(distinct line_id) from line) as pct_rows,
 count(distinct game_id) * 100.0 / (select count(distinct game_id) from line) as pct_groups from e where label <> 'No Strategy' group by label""")
def a01(spark, d):
    return L.label_counts(cut(lines(spark, d)), "line_id", "game_id", NO_LABEL)


@query("A02_label_share", f", {E} select source, label, count(*) as n, count(*) * 100.0 / sum(count(*)) over (partition by source) as pct from e group by source, label")
def a02(spark, d):
    return L.shares(L.exploded(lines(spark, d)), ["source"], "label")


@query("A03_ratio_summary", """ select count(*) as n_lines, count(distinct game_id) as n_games, count_if(labels <> ['No Strategy']) as n_labelled, count_if(labels <> ['No Strategy']) * 1.0 / count(*) as labelled_share,
 sum(case when labels = ['No Strategy'] then 0 else len(labels) end) * 1.0 / count_if(labels <> ['No Strategy']) as labels_per_labelled, count(player) * 1.0 / count(*) as player_share from line""")
def a03(spark, d):
    has = ~F.array_contains("labels", NO_LABEL)
    return lines(spark, d).agg(
        F.count("*").alias("n_lines"), F.countDistinct("game_id").alias("n_games"), F.count_if(has).alias("n_labelled"), F.avg(has.cast("double")).alias("labelled_share"),
        F.try_divide(F.sum(F.when(has, F.size("labels")).otherwise(0)), F.count_if(has)).alias("labels_per_labelled"), (F.count("player") / F.count("*")).alias("player_share"),
    )


_KIND = ", ".join(f"count_if(list_contains(labels, '{k}')) as n_{k.lower().replace(' ', '_')}" for k in LABELS)
_KNOWN = "['" + "', '".join(LABELS) + "']"
_COUNTS = f"count(*) as n_rows, count_if(list_has_any(labels, {_KNOWN})) as n_labelled, count_if(len(list_intersect(labels, {_KNOWN})) = 1) as n_single, {_KIND}"


@query("A04_game_features", f" select game_id, {_COUNTS} from line group by game_id")
def a04(spark, d):
    return L.conditional_counts(lines(spark, d), ["game_id"], LABELS)


@query("A05_speaker_features", f" select game_id, player, {_COUNTS} from line where player is not null group by game_id, player")
def a05(spark, d):
    return L.conditional_counts(lines(spark, d).where("player is not null"), ["game_id", "player"], LABELS)


@query("A06_role_rollup", f" select start_role, count(*) as n_speakers, sum(n_rows) as n_lines, sum(n_labelled) * 1.0 / sum(n_rows) as pooled_rate, avg(n_labelled * 1.0 / n_rows) as mean_rate from (select game_id, player, {_COUNTS} from line group by game_id, player) x left join slot using (game_id, player) group by start_role")
def a06(spark, d):
    f = L.conditional_counts(lines(spark, d), ["game_id", "player"], LABELS)
    x = f.join(slots(spark, d).select("game_id", "player", "start_role"), ["game_id", "player"], "left")
    return x.groupBy("start_role").agg(F.count("*").alias("n_speakers"), F.sum("n_rows").alias("n_lines"), (F.sum("n_labelled") / F.sum("n_rows")).alias("pooled_rate"), F.avg(F.col("n_labelled") / F.col("n_rows")).alias("mean_rate"))


@query("A07_lines_per_game", " select source, count(n_lines) as n, sum(n_lines) as total, avg(n_lines) as mean, stddev_samp(n_lines) as sd, min(n_lines) as min, quantile_cont(n_lines, 0.25) as q25, quantile_cont(n_lines, 0.5) as median, quantile_cont(n_lines, 0.75) as q75, quantile_cont(n_lines, 0.9) as p90, max(n_lines) as max from (select source, game_id, count(*) as n_lines from line group by all) group by source")
def a07(spark, d):
    return L.describe(lines(spark, d).groupBy("source", "game_id").agg(F.count("*").alias("n_lines")), "n_lines", ["source"])


_LENGTH = "select coalesce(source, 'all') as source, count(n) as n, sum(n) as total, avg(n) as mean, stddev_samp(n) as sd, min(n) as min, quantile_cont(n, 0.25) as q25, quantile_cont(n, 0.5) as median, quantile_cont(n, 0.75) as q75, quantile_cont(n, 0.9) as p90, max(n) as max"


@query("A08_length_summary", f" {_LENGTH} from (select source, length(utterance) as n from line) group by rollup(source)")
def a08(spark, d):
    x = lines(spark, d, text=True).select("source", F.length("utterance").alias("n_chars"))
    # One pass for the groups and their total: each row counts for its source and for "all".
    both = x.select(F.explode(F.array(F.col("source"), F.lit("all"))).alias("source"), "n_chars")
    return L.describe(both, "n_chars", ["source"])


@query("A09_label_histogram", " select case when labels = ['No Strategy'] then 0 else len(labels) end as n_labels, count(*) as n_rows from line group by 1")
def a09(spark, d):
    return L.histogram(lines(spark, d), NO_LABEL)


@query("A41_strategy_distribution", f""", {E}, c as (select game_id, player, count(*) as n from e where label <> 'No Strategy' and player is not null group by all),
 p as (select distinct game_id, player from line where player is not null)
 select p.game_id, p.player, {', '.join(f"coalesce(count_if(label = '{k}') * 1.0 / nullif(max(n), 0), 0) as p_{k.lower().replace(' ', '_')}" for k in LABELS)} from p left join e on e.game_id = p.game_id and e.player = p.player left join c on c.game_id = p.game_id and c.player = p.player group by p.game_id, p.player""")
def a41(spark, d):
    e = L.exploded(lines(spark, d).where("player is not null"))
    n = F.count_if(F.col("label") != NO_LABEL)
    return e.groupBy("game_id", "player").agg(*[F.coalesce(F.try_divide(F.count_if(F.col("label") == k).cast("double"), n), F.lit(0.0)).alias(f"p_{k.lower().replace(' ', '_')}") for k in LABELS])


@query("A42_own_halves", """, o as (select game_id, player, labels, row_number() over (partition by game_id, player order by rec_id, line_id) as i, count(*) over (partition by game_id, player) as n from line where player is not null)
 select game_id, player, case when i <= floor(n / 2) then 'early' else 'late' end as half, count(*) as n_lines, count_if(labels <> ['No Strategy']) as n_labelled from o group by all""")
def a42(spark, d):
    p = L.positions(lines(spark, d).where("player is not null"), ["game_id", "player"], ["rec_id", "line_id"])
    return p.groupBy("game_id", "player", L.own_half(F.col("position"), F.col("n")).alias("half")).agg(F.count("*").alias("n_lines"), F.count_if(~F.array_contains("labels", NO_LABEL)).alias("n_labelled"))


_POS = "o as (select *, row_number() over (partition by game_id order by rec_id, line_id) as i, count(*) over (partition by game_id) as n from line)"


@query("A43_technique_halves", f", {_POS} select game_id, player, count(*) as n_all, count_if(i * 2 <= n) as n_early, count_if(i * 2 > n) as n_late, count_if(list_contains(labels, 'Accusation')) as accusation, count_if(list_contains(labels, 'Accusation') and i * 2 <= n) as accusation_early, count_if(list_contains(labels, 'Accusation') and i * 2 > n) as accusation_late from o where player is not null group by all")
def a43(spark, d):
    p = L.positions(lines(spark, d), ["game_id"], ["rec_id", "line_id"]).where("player is not null")
    early, acc = L.half(F.col("position"), F.col("n")) == "early", F.array_contains("labels", "Accusation")
    return p.groupBy("game_id", "player").agg(F.count("*").alias("n_all"), F.count_if(early).alias("n_early"), F.count_if(~early).alias("n_late"), F.count_if(acc).alias("accusation"), F.count_if(acc & early).alias("accusation_early"), F.count_if(acc & ~early).alias("accusation_late"))


@query("A56_cooccurrence", f", {E} select a.label as label_a, b.label as label_b, count(*) as n_rows from e a join e b on a.line_id = b.line_id and a.label < b.label where a.label <> 'No Strategy' and b.label <> 'No Strategy' group by all")
def a56(spark, d):
    return L.cooccurrence(lines(spark, d), "line_id", NO_LABEL)


@query("A57_conditional", f", {E}, x as (select * from e where label <> 'No Strategy'), o as (select source, label, count(*) as n_given from x group by all) select a.source, a.label as row_label, b.label as col_label, count(*) as n_both, any_value(n_given) as n_given, count(*) * 100.0 / any_value(n_given) as pct from x a join x b on a.line_id = b.line_id and a.label <> b.label join o on o.source = a.source and o.label = a.label group by all")
def a57(spark, d):
    return L.conditional(lines(spark, d), NO_LABEL, ["source"])


@query("W08_segments", f", {_POS}, s as (select case when i * 3 <= n then 'beginning' when i * 3 <= n * 2 then 'middle' else 'end' end as segment, unnest(labels) as label from o) select segment, label, count(*) as n, count(*) * 100.0 / sum(count(*)) over (partition by segment) as pct from s group by 1, 2")
def w08(spark, d):
    p = L.positions(lines(spark, d), ["game_id"], ["rec_id", "line_id"])
    return L.shares(L.exploded(p.withColumn("segment", L.third(F.col("position"), F.col("n")))), ["segment"], "label")


@query("W09_halves", f", {_POS}, s as (select case when i * 2 <= n then 'early' else 'late' end as half, unnest(labels) as label from o) select half, label, count(*) as n, count(*) * 100.0 / sum(count(*)) over (partition by half) as pct from s group by 1, 2")
def w09(spark, d):
    p = L.positions(lines(spark, d), ["game_id"], ["rec_id", "line_id"])
    return L.shares(L.exploded(p.withColumn("half", L.half(F.col("position"), F.col("n")))), ["half"], "label")


@query("W10_rule_agreement", f", {_POS} select avg(((i * 2 <= n) = (rec_id * 2 <= n))::int) as agreement, count(*) as n_lines from o")
def w10(spark, d):
    p = L.positions(lines(spark, d), ["game_id"], ["rec_id", "line_id"])
    return p.agg(F.avg((L.half(F.col("position"), F.col("n")) == L.half(F.col("rec_id"), F.col("n"))).cast("double")).alias("agreement"), F.count("*").alias("n_lines"))


@query("W11_deviation", f""", {E}, r as (select start_role, label, count(*) * 100.0 / sum(count(*)) over (partition by start_role) as pct from e join slot using (game_id, player) where label <> 'No Strategy' group by start_role, label)
 select start_role, label, pct, pct - avg(pct) over (partition by label) as deviation from r""")
def w11(spark, d):
    e = L.exploded(lines(spark, d)).where(F.col("label") != NO_LABEL).join(slots(spark, d).select("game_id", "player", "start_role"), ["game_id", "player"])
    r = L.shares(e, ["start_role"], "label").drop("n")
    return r.withColumn("deviation", F.col("pct") - F.avg("pct").over(W.partitionBy("label")))


@query("P11_speaker_kind", " select case when player is not null then 'player' when k is null or k = '' then 'non_player' when k in ('announcer', 'narrator', 'app', 'audio', 'game audio', 'game app') then 'non_player' else 'unmatched' end as kind, count(*) as n from line group by 1")
def p11(spark, d):
    k = F.col("k")
    kind = F.when(F.col("player").isNotNull(), "player").when(F.coalesce(k, F.lit("")) == "", "non_player").when(k.isin("announcer", "narrator", "app", "audio", "game audio", "game app"), "non_player").otherwise("unmatched")
    return lines(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("P12_support", f", {E}, c as (select player, label, count(*) as n, count(distinct game_id) as n_games from e where player is not null group by all) select player, label, n from c where n_games >= 3 and label <> 'No Strategy'")
def p12(spark, d):
    e = L.exploded(lines(spark, d)).where("player is not null")
    return e.groupBy("player", "label").agg(F.count("*").alias("n"), F.countDistinct("game_id").alias("g")).where((F.col("g") >= 3) & (F.col("label") != NO_LABEL)).select("player", "label", "n")


@query("U06_vocabulary", f""", {E}, want as (select unnest({_KNOWN}) as label), have as (select distinct label from e where label <> 'No Strategy')
 select label, 'unexpected' as problem from have anti join want using (label) union all select label, 'missing' from want anti join have using (label)""")
def u06(spark, d):
    have = L.exploded(lines(spark, d)).select("label").where(F.col("label") != NO_LABEL).distinct()
    want = spark.createDataFrame([(k,) for k in LABELS], "label string")
    return have.join(want, "label", "left_anti").withColumn("problem", F.lit("unexpected")).unionByName(want.join(have, "label", "left_anti").withColumn("problem", F.lit("missing")))


@query("J14_usage_support", f""", {E}, r as (select game_id, player, start_role from slot), n as (select start_role, count(*) as n_speakers from (select distinct game_id, player from line where player is not null) join r using (game_id, player) group by 1)
 select start_role, label, count(*) as n, any_value(n_speakers) as n_speakers, count(*) * 1.0 / any_value(n_speakers) as per_speaker from e join r using (game_id, player) left join n using (start_role) where label <> 'No Strategy' group by start_role, label""")
def j14(spark, d):
    r = slots(spark, d).select("game_id", "player", "start_role")
    x = cut(lines(spark, d).where("player is not null").join(r, ["game_id", "player"]))
    n = x.select("game_id", "player", "start_role").distinct().groupBy("start_role").agg(F.count("*").alias("n_speakers"))
    use = L.exploded(x).where(F.col("label") != NO_LABEL).groupBy("start_role", "label").agg(F.count("*").alias("n"))
    return use.join(n, "start_role", "left").withColumn("per_speaker", F.col("n") / F.col("n_speakers"))


@query("A50_games_by_split", " select source, count_if(game_no % 10 < 8) as train, count_if(game_no % 10 = 8) as val, count_if(game_no % 10 = 9) as test from g group by source")
def a50(spark, d):
    s = F.when(F.col("game_no") % 10 < 8, "train").when(F.col("game_no") % 10 == 8, "val").otherwise("test")
    return games(spark, d).withColumn("split", s).groupBy("source").pivot("split", ["train", "val", "test"]).count().fillna(0, ["train", "val", "test"])
