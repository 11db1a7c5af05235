"""Queries on events, joins, sets and samples: A10-A15, A44, A45, A68, J01, J02, J06, J09-J13, J16-J20, K01-K10, P08-P15, U01-U09, S16, S20, X11, X22, X23, F50-F53."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palaver.functions import keys as K
from palaver.functions.text import role_mentions
from palaver.operators import events as E
from palaver.operators import joins as JN
from palaver.operators import sets as S
from palaver.operators.labels import half, positions
from palaver.plans.shred_queries import LEVELS
from palaver.plans.silver import games, lines, slots, sql, valid_votes, votes
from palaver.operators.shred import filled, shred
from palaver.session import cut
from palaver.tables import first_delivery, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
ROLES = ["Werewolf", "Villager", "Seer", "Robber", "Troublemaker", "Drunk", "Insomniac", "Minion", "Tanner", "Hunter"]


def query(name: str, statement: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if statement:
            SQL[name] = sql(statement)
        return fn

    return keep


def records(spark, d):
    return first_delivery(table(spark, d, "accusation_records"), ["record_id"], "loaded_at", ["game_id", "metadata", "items"])


def accusations(spark, d):
    t = shred(records(spark, d), "record_id", "records", LEVELS)
    up = ["record_id", "item_no", "relation_no"]
    a = t["accused"].select(*up, "accused_no", F.col("value").alias("accused"))
    return a.join(t["relations"].select(*up, "type"), up).join(t["items"].select(*up[:2], "line_number", "accuser"), up[:2]).join(t["records"].select("record_id", "game_id"), "record_id")


def accused(spark, d):
    """Game, type and name of each accusation, as :func:`accusations` has them: one walk down the records, no joins."""
    i = records(spark, d).where("record_id is not null").select("game_id", F.explode("items").alias("i")).where("i is not null")
    r = i.select("game_id", F.explode("i.relations").alias("r")).where("r is not null")
    return r.select("game_id", F.col("r.type").alias("type"), F.explode("r.accused").alias("accused")).where(filled(F.col("accused")))


REC = """r as (select record_id, game_id, metadata, items from accusation_records qualify row_number() over (partition by record_id order by loaded_at) = 1),
i as (select record_id, game_id, i as item_no, items[i] as it from (select *, unnest(range(1, coalesce(len(items), 0) + 1)) as i from r) where items[i] is not null),
l as (select record_id, game_id, item_no, it.line_number as line_number, it.accuser as accuser, j as relation_no, it.relations[j] as re from (select *, unnest(range(1, coalesce(len(it.relations), 0) + 1)) as j from i) where it.relations[j] is not null),
a as (select record_id, game_id, item_no, line_number, accuser, relation_no, re.type as type, k as accused_no, re.accused[k] as accused from (select *, unnest(range(1, coalesce(len(re.accused), 0) + 1)) as k from l) where re.accused[k] is not null and regexp_matches(re.accused[k], '\\S'))"""


@query("A10_accusation_totals", f""", {REC}, n as (select record_id, item_no, len(list_filter(coalesce(it.relations, []), lambda x: x is not null)) as n, list_filter(coalesce(it.relations, []), lambda x: x is not null and not list_contains(coalesce(x.accused, []), 'UNKNOWN')) as k from i),
 t as (select record_id, item_no, flatten(list_transform(k, lambda x: list_transform(coalesce(x.accused, []), lambda y: coalesce(x.type, '') || chr(1) || coalesce(y, '')))) as t, list_sum(list_transform(k, lambda x: case when len(coalesce(x.accused, [])) > 1 then len(x.accused) else 0 end)) as gr from n)
 select count(*) as instances, count_if(n = 0) as no_relation, count_if(n > 0) as with_relation, sum(n)::bigint as relations, sum(n - len(k))::bigint as unknown_relations, count_if(n > len(k)) as unknown_instances, count_if(n > 0 and len(k) = 0) as instances_lost,
 count_if(len(k) > 0) as kept_instances, sum(len(k))::bigint as kept_relations, sum(len(t))::bigint as accusations, sum(coalesce(gr, 0))::bigint as from_group, sum(len(t) - len(list_distinct(t)))::bigint as duplicates from n join t using (record_id, item_no)""")
def a10(spark, d):
    return E.accusation_totals(records(spark, d))


def claims(spark, d):
    """Roles named in lines labelled as identity declarations, by known players."""
    x = lines(spark, d, text=True).where(F.col("player").isNotNull() & F.array_contains("labels", "Identity Declaration"))
    return x.select("game_id", "player", "line_id", role_mentions(F.col("utterance"), ROLES).alias("roles"))


_ROLE_RE = "(?i)\\b(" + "|".join(ROLES) + ")\\b"
CL = f"cl as (select game_id, player, line_id, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(utterance, ''), '{_ROLE_RE}', 1), lambda x: upper(x[1]) || lower(x[2:])))) as roles from line where player is not null and list_contains(labels, 'Identity Declaration')), c1 as (select game_id, player, line_id, unnest(roles) as role from cl)"


@query("A11_claimed_roles", f", {CL} select case when len(roles) = 0 then 'empty' when len(roles) = 1 then roles[1] else 'multiple' end as claim, count(*) as n from cl group by 1")
def a11(spark, d):
    n = F.size("roles")
    return claims(spark, d).groupBy(F.when(n == 0, "empty").when(n == 1, F.get("roles", 0)).otherwise("multiple").alias("claim")).agg(F.count("*").alias("n"))


@query("A12_role_accusations", f", {REC}, n as (select game_id, accused, count(*) as n from a group by all) select end_role, count(*) as n_players, sum(coalesce(n, 0))::bigint as received, count_if(n > 0) as any_received from slot s left join n on n.game_id = s.game_id and n.accused = s.player group by 1")
def a12(spark, d):
    n = accusations(spark, d).groupBy("game_id", F.col("accused").alias("player")).agg(F.count("*").alias("n"))
    return slots(spark, d).join(n, ["game_id", "player"], "left").groupBy("end_role").agg(F.count("*").alias("n_players"), F.sum(F.coalesce("n", F.lit(0))).alias("received"), F.count_if(F.col("n") > 0).alias("any_received"))


@query("A13_role_conflicts", f", {CL} select game_id, role, list_sort(list(distinct player)) as players, count(distinct player) as n_players from c1 group by all having count(distinct player) >= 2")
def a13(spark, d):
    return E.role_conflicts(claims(spark, d).withColumn("role", F.explode("roles")), ["game_id"])


@query("A14_self_contradiction", f""", {CL}, s as (select * from cl where len(roles) > 0), n as (select game_id, player, count(*) as n_lines from s group by all having count(*) >= 2), x as (select game_id, player, role, count(*) as k from c1 group by all)
 select game_id, player, n_lines, not exists (select 1 from x where x.game_id = n.game_id and x.player = n.player and x.k = n.n_lines) as is_contradiction from n""")
def a14(spark, d):
    return E.self_contradictions(cut(claims(spark, d).where(F.size("roles") > 0)), ["game_id", "player"])


@query("A15_conflict_features", f""", {CL}, q as (select distinct game_id, player, role from c1), c as (select game_id, role, list(player) as ps from q group by all having count(*) >= 2)
 select q.game_id, q.player, list_sort(list(q.role)) as roles_claimed, count(*)::int as n_roles, count(c.role) > 0 as in_conflict, len(list_filter(list_distinct(flatten(coalesce(list(c.ps) filter (where c.ps is not null), []))), lambda x: x <> q.player))::int as n_claimants, coalesce(list_sort(list(c.role) filter (where c.role is not null)), []) as conflicting_roles
 from q left join c on c.game_id = q.game_id and c.role = q.role group by q.game_id, q.player""")
def a15(spark, d):
    return E.conflict_features(cut(claims(spark, d).select("game_id", "player", F.explode("roles").alias("role"))), ["game_id"])


@query("A44_accusations_by_half", f""", {REC}, n as (select game_id, count(*) as n_lines from line group by 1), p as (select a.*, n_lines, (select count(*) from line where line.game_id = a.game_id and line.rec_id <= a.line_number) as ord from a join n using (game_id) where line_number is not null)
 select game_id, accused as player, count_if(coalesce(type, '') = 'werewolf') as werewolf, count_if(coalesce(type, '') = 'werewolf' and ord * 2 <= n_lines) as werewolf_early, count_if(coalesce(type, '') = 'deception') as deception, count_if(coalesce(type, '') = 'deception' and ord * 2 <= n_lines) as deception_early from p where accused <> 'UNKNOWN' group by all""")
def a44(spark, d):
    ln = cut(lines(spark, d).select("game_id", "rec_id"))
    n = ln.groupBy("game_id").agg(F.count("*").alias("n_lines"))
    a = accusations(spark, d).where("line_number is not null and accused <> 'UNKNOWN'").join(n, "game_id")
    p = E.ordinal_at(a, ln, ["game_id"], "line_number", "rec_id", "at")
    early, kind = E.half_of_line(F.col("at"), F.col("n_lines")) == "early", lambda k: F.coalesce(F.col("type") == k, F.lit(False))
    return p.groupBy("game_id", F.col("accused").alias("player")).agg(F.count_if(kind("werewolf")).alias("werewolf"), F.count_if(kind("werewolf") & early).alias("werewolf_early"), F.count_if(kind("deception")).alias("deception"), F.count_if(kind("deception") & early).alias("deception_early"))


@query("A45_claim_flags", f", {CL} select game_id, player, max(list_contains(roles, 'Werewolf')::int) as claimed_werewolf, max(list_contains(roles, 'Villager')::int) as claimed_villager, count(*) as n_claims from cl where len(roles) > 0 group by all")
def a45(spark, d):
    flag = lambda k: F.max(F.array_contains("roles", k).cast("int"))
    return claims(spark, d).where(F.size("roles") > 0).groupBy("game_id", "player").agg(flag("Werewolf").alias("claimed_werewolf"), flag("Villager").alias("claimed_villager"), F.count("*").alias("n_claims"))


@query("A45_claims_by_half", f""", {CL}, o as (select line_id, case when 2 * row_number() over (partition by game_id order by rec_id, line_id) <= count(*) over (partition by game_id) then 'early' else 'late' end as half from line),
 h as (select game_id, player, half, list_sort(list_distinct(flatten(list(roles)))) as roles from cl join o using (line_id) where len(roles) > 0 group by all)
 select game_id, player, {', '.join(f"max((half = '{w}' and list_contains(roles, '{r}'))::int) as {w}_{r.lower().replace(' ', '_')}" for w in ('early', 'late') for r in ROLES)} from h group by all""")
def a45_by_half(spark, d):
    """Roles that a player claims in each half of a game, as flags: the union of a half's claims, then their maximum."""
    o = positions(lines(spark, d).select("game_id", "line_id", "rec_id"), ["game_id"], ["rec_id", "line_id"]).select("line_id", half(F.col("position"), F.col("n")).alias("half"))
    c = claims(spark, d).where(F.size("roles") > 0).join(o, "line_id")
    flag = lambda w, r: F.max(((F.col("half") == w) & F.array_contains("roles", r)).cast("int")).alias(f"{w}_{r.lower().replace(' ', '_')}")
    return c.groupBy("game_id", "player").agg(*[flag(w, r) for w in ("early", "late") for r in ROLES])


@query("A68_list_values", " select label, count(*) as n from (select unnest(labels) as label from line) group by 1")
def a68(spark, d):
    return lines(spark, d).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("J01_lookup", " select v.file_row_id, g.game_no from v join (select game_id, min(game_no) as game_no from g group by 1) g on g.game_id = v.game_id")
def j01(spark, d):
    return votes(spark, d).select("file_row_id", "game_id").join(games(spark, d).groupBy("game_id").agg(F.min("game_no").alias("game_no")), "game_id").select("file_row_id", "game_no")


@query("J02_strict", " select line_id, num_players from line join (select game_id, any_value(num_players) as num_players from g group by 1) using (game_id)")
def j02(spark, d):
    g = games(spark, d).groupBy("game_id").agg(F.first("num_players").alias("num_players"))
    return JN.strict(lines(spark, d).select("line_id", "game_id"), g, ["game_id"]).select("line_id", "num_players")


@query("J06_grid", ", m as (select distinct model_name from v), s as (select distinct status from v), c as (select model_name, status, count(*) as n from v group by all) select m.model_name, s.status, coalesce(n, 0) as n from m cross join s left join c using (model_name, status)")
def j06(spark, d):
    v = cut(votes(spark, d).select("model_name", "status"))
    return JN.grid(v.select("model_name").distinct(), v, v.groupBy("model_name", "status").agg(F.count("*").alias("n")), "model_name", "status", "n")


@query("J09_halves_onto_totals", ", o as (select *, row_number() over (partition by game_id order by rec_id, line_id) as i, count(*) over (partition by game_id) as n from line), t as (select game_id, player, count(*) as total from o where player is not null group by all), e as (select game_id, player, count(*) as early from o where player is not null and i * 2 <= n group by all) select game_id, player, total, coalesce(early, 0) as early, total - coalesce(early, 0) as late from t left join e using (game_id, player)")
def j09(spark, d):
    p = cut(positions(lines(spark, d), ["game_id"], ["rec_id", "line_id"]).where("player is not null").select("game_id", "player", half(F.col("position"), F.col("n")).alias("half")))
    t = p.groupBy("game_id", "player").agg(F.count("*").alias("total"))
    e = p.where("half = 'early'").groupBy("game_id", "player").agg(F.count("*").alias("early"))
    return t.join(e, ["game_id", "player"], "left").fillna(0, ["early"]).withColumn("late", F.col("total") - F.col("early"))


@query("J10_ballot", f""", {REC}, x as (select game_id, lower(trim(accused)) as k, count(*) as acc, 0 as lin from a group by all union all select game_id, lower(trim(player)), 0, count(*) from line where player is not null group by all), y as (select game_id, k, sum(acc) as acc, sum(lin) as lin from x group by all)
 select s.game_id, s.player, coalesce(acc, 0)::double as n_accused, coalesce(lin, 0)::double as n_lines from slot s left join y on y.game_id = s.game_id and y.k = lower(trim(s.player))""")
def j10(spark, d):
    a = accusations(spark, d).groupBy("game_id", F.col("accused").alias("player")).agg(F.count("*").alias("n_accused"))
    n = lines(spark, d).where("player is not null").groupBy("game_id", "player").agg(F.count("*").alias("n_lines"))
    return JN.summed_by_name(slots(spark, d).select("game_id", "player"), [a, n], ["game_id"], "player", ["n_accused", "n_lines"])


@query("J11_semi", ", t as (select game_id, model_name from vv where decoding = 'greedy' and is_correct group by all) select file_row_id from vv semi join t using (game_id, model_name)")
def j11(spark, d):
    v = valid_votes(spark, d)
    return v.join(v.where("decoding = 'greedy' and is_correct").select("game_id", "model_name"), ["game_id", "model_name"], "left_semi").select("file_row_id")


@query("J12_membership", ", w as (select game_id, list(player) as wolves from slot where end_role = 'Werewolf' group by 1) select file_row_id, coalesce(list_contains(wolves, target), false) as hits_wolf from vv left join w using (game_id)")
def j12(spark, d):
    w = slots(spark, d).where("end_role = 'Werewolf'").groupBy("game_id").agg(F.collect_set("player").alias("wolves"))
    return valid_votes(spark, d).join(w, "game_id", "left").select("file_row_id", JN.in_group(F.col("target"), F.col("wolves")).alias("hits_wolf"))


@query("J13_self_flag", ", f as (select game_id, max((end_role = 'Werewolf')::int) = 1 as has_wolf from slot group by 1) select slot.game_id, player, has_wolf from slot left join f using (game_id)")
def j13(spark, d):
    s = slots(spark, d)
    return s.select("game_id", "player").join(s.groupBy("game_id").agg((F.max((F.col("end_role") == "Werewolf").cast("int")) == 1).alias("has_wolf")), "game_id", "left")


@query("J15_pairings", ", c as (select model_name, game_id, count(*) as n from vv group by all) select x.game_id, x.model_name as a, y.model_name as b, x.n as n_a, y.n as n_b from c x join c y on x.game_id = y.game_id and x.model_name < y.model_name")
def j15(spark, d):
    return JN.pairings(cut(valid_votes(spark, d).groupBy("model_name", "game_id").agg(F.count("*").alias("n"))), ["game_id"], "model_name", ["n"])


@query("J17_truth_accusations", f", {REC}, n as (select game_id, lower(trim(accused)) as k, count(*) as n from a group by all), an as (select distinct game_id from r) select s.game_id, s.player, s.end_role, coalesce(n, 0) as n from slot s semi join an using (game_id) left join n on n.game_id = s.game_id and n.k = lower(trim(s.player))")
def j17(spark, d):
    n = accusations(spark, d).groupBy("game_id", K.name_key(F.col("accused")).alias("k")).agg(F.count("*").alias("n"))
    s = slots(spark, d).join(records(spark, d).select("game_id"), "game_id", "left_semi").withColumn("k", K.name_key(F.col("player")))
    return s.join(n, ["game_id", "k"], "left").select("game_id", "player", "end_role", F.coalesce("n", F.lit(0)).alias("n"))


@query("J17_unmatched_targets", f", {REC} select accused, count(*) as n from a anti join slot s on s.game_id = a.game_id and lower(trim(s.player)) = lower(trim(a.accused)) group by 1")
def j17_unmatched(spark, d):
    s = slots(spark, d).select("game_id", K.name_key(F.col("player")).alias("k"))
    return accusations(spark, d).withColumn("k", K.name_key(F.col("accused"))).join(s, ["game_id", "k"], "left_anti").groupBy("accused").agg(F.count("*").alias("n"))


@query("J18_ordinal", f", {REC} select record_id, item_no, it.line_number as line_number, (select count(*) from line where line.game_id = i.game_id and line.rec_id <= i.it.line_number) as ordinal from i where it.line_number is not null")
def j18(spark, d):
    t = shred(records(spark, d), "record_id", "records", LEVELS)
    p = t["items"].where("line_number is not null").select("record_id", "item_no", "line_number").join(t["records"].select("record_id", "game_id"), "record_id")
    return E.ordinal_at(p, lines(spark, d).select("game_id", "rec_id"), ["game_id"], "line_number", "rec_id", "ordinal").select("record_id", "item_no", "line_number", "ordinal")


@query("J18_asof_line", f", {REC}, u as (select game_id, rec_id, min(line_id) as line_id from line group by all) select record_id, item_no, i.it.line_number as line_number, u.line_id from (select *, it.line_number as ln from i where it.line_number is not null) i asof left join u on u.game_id = i.game_id and i.ln >= u.rec_id")
def j18_asof(spark, d):
    t = shred(records(spark, d), "record_id", "records", LEVELS)
    p = t["items"].where("line_number is not null").select("record_id", "item_no", "line_number").join(t["records"].select("record_id", "game_id"), "record_id")
    u = lines(spark, d).groupBy("game_id", "rec_id").agg(F.min("line_id").alias("line_id"))
    return E.as_of(p, u, ["game_id"], "line_number", "rec_id", ["line_id"]).select("record_id", "item_no", "line_number", "line_id")


@query("J19_context", ", t as (select distinct game_id, rec_id from line where list_contains(labels, 'Accusation') and list_contains(labels, 'Evidence')) select t.game_id, t.rec_id as target_at, line.rec_id, line_id from t join line on line.game_id = t.game_id and line.rec_id between t.rec_id - 2 and t.rec_id + 2")
def j19(spark, d):
    ln = cut(lines(spark, d).select("game_id", "rec_id", "line_id", "labels"))
    t = ln.where(F.array_contains("labels", "Accusation") & F.array_contains("labels", "Evidence")).select("game_id", "rec_id").distinct()
    return E.context(t, ln.drop("labels"), ["game_id"], "rec_id", 2).select("game_id", "target_at", "rec_id", "line_id")


@query("J20_line_speaker", f", {REC} select record_id, item_no, accuser, player from i join (select game_id, rec_id, max(player) as player from line group by all) u on u.game_id = i.game_id and u.rec_id = i.it.line_number".replace("item_no, accuser, player from i", "item_no, i.it.accuser as accuser, player from i"))
def j20(spark, d):
    t = shred(records(spark, d), "record_id", "records", LEVELS)
    p = t["items"].select("record_id", "item_no", "accuser", F.col("line_number").alias("rec_id")).join(t["records"].select("record_id", "game_id"), "record_id")
    return p.join(lines(spark, d).groupBy("game_id", "rec_id").agg(F.max("player").alias("player")), ["game_id", "rec_id"]).select("record_id", "item_no", "accuser", "player")


@query("X11_most_accused", f", {REC}, n as (select game_id, accused, count(*) as n from a where accused <> 'UNKNOWN' group by all), x as (select s.game_id, player, coalesce(n, 0) as n from slot s left join n on n.game_id = s.game_id and n.accused = s.player) select game_id, case when n > 0 then player end as player, n from x qualify row_number() over (partition by game_id order by n desc, player) = 1")
def x11(spark, d):
    n = accusations(spark, d).where("accused <> 'UNKNOWN'").groupBy("game_id", F.col("accused").alias("player")).agg(F.count("*").alias("n"))
    x = slots(spark, d).select("game_id", "player").join(n, ["game_id", "player"], "left").fillna(0, ["n"])
    return E.most_accused(x, ["game_id"], "player", "n")


@query("P14_flagged", f", {REC} select record_id, item_no, relation_no from l where re.accused is not null and list_contains(re.accused, 'UNKNOWN') and (select it.requires_review from i where i.record_id = l.record_id and i.item_no = l.item_no)")
def p14(spark, d):
    x = records(spark, d).select("record_id", F.posexplode("items").alias("i", "it")).where("it.requires_review")
    r = x.select("record_id", (F.col("i") + 1).alias("item_no"), F.posexplode("it.relations").alias("j", "re"))
    return r.where(F.array_contains("re.accused", "UNKNOWN")).select("record_id", "item_no", (F.col("j") + 1).alias("relation_no"))


@query("P15_coerced", " select file_row_id, try_cast(regexp_extract(run_label, 'run_t?(.*)', 1) as int) as run_no, case lower(cast(is_correct as varchar)) when 'true' then true when 'false' then false end as flag from v")
def p15(spark, d):
    return votes(spark, d).select("file_row_id", F.regexp_extract("run_label", "run_t?(.*)", 1).try_cast("int").alias("run_no"), F.col("is_correct").cast("string").try_cast("boolean").alias("flag"))


@query("P08_slice", " select game_no, game_id from g order by game_no limit 25 offset 10")
def p08(spark, d):
    return S.slice_rows(games(spark, d).select("game_no", "game_id"), ["game_no"], 10, 25)


@query("P09_missing_ids", " , w as (select unnest(range(1, 60)) as game_no) select game_no, game_no in (select game_no from g) as is_there from w".lstrip())
def p09(spark, d):
    w = spark.range(1, 60).withColumnRenamed("id", "game_no")
    g = games(spark, d).select("game_no", F.lit(True).alias("here"))
    return w.join(g, "game_no", "left").select("game_no", F.coalesce("here", F.lit(False)).alias("is_there"))


@query("U01_union", " select game_id, player as name, 'seat' as origin from slot union all select game_id, target, 'vote' from vv")
def u01(spark, d):
    return slots(spark, d).select("game_id", F.col("player").alias("name"), F.lit("seat").alias("origin")).unionByName(valid_votes(spark, d).select("game_id", F.col("target").alias("name"), F.lit("vote").alias("origin")))


@query("U02_keep_last", " select result_path, file_row_id, status from v qualify row_number() over (partition by result_path order by file_row_id desc) = 1")
def u02(spark, d):
    return S.keep_one(votes(spark, d).select("result_path", "file_row_id", "status"), ["result_path"], [F.col("file_row_id")], last=True)


@query("U03_first_game", " select game_id, game_no, source from g qualify row_number() over (partition by game_id order by game_no) = 1")
def u03(spark, d):
    return S.keep_one(games(spark, d).select("game_id", "game_no", "source"), ["game_id"], [F.col("game_no")])


@query("U04_line_sets", f", {REC}, x as (select record_id, coalesce(metadata.expected_line_numbers, []) as e, coalesce(list_filter(list_transform(items, lambda z: z.line_number), lambda z: z is not null), []) as got from r) select record_id, list_sort(list_filter(list_distinct(e), lambda z: not list_contains(got, z))) as missing, list_sort(list_filter(list_distinct(got), lambda z: not list_contains(e, z))) as extra, list_sort(list_distinct(list_filter(got, lambda z: len(list_filter(got, lambda w: w = z)) > 1))) as duplicated from x")
def u04(spark, d):
    got = F.filter(F.transform("items", lambda i: i["line_number"]), lambda x: x.isNotNull())
    return records(spark, d).select("record_id", S.set_report(F.filter("metadata.expected_line_numbers", lambda x: x.isNotNull()), got).alias("s")).select("record_id", "s.missing", "s.extra", "s.duplicated")


@query("U05_role_sets", " select game_no, list_sort(list_distinct(list_filter(start_roles, lambda x: list_contains(end_roles, x)))) as kept, list_sort(list_distinct(list_concat(start_roles, end_roles))) as all_roles from g where start_roles is not null and end_roles is not null")
def u05(spark, d):
    g = games(spark, d).where("start_roles is not null and end_roles is not null")
    solid = lambda a: F.filter(a, lambda x: x.isNotNull())
    return g.select("game_no", F.array_sort(solid(F.array_intersect("start_roles", "end_roles"))).alias("kept"), F.array_sort(solid(F.array_union("start_roles", "end_roles"))).alias("all_roles"))


@query("U09_leakage", ", x as (select game_id, game_no % 10 as f from g) select count(*) as n_shared from (select game_id from x where f < 8 intersect select game_id from x where f >= 8)")
def u09(spark, d):
    g = games(spark, d).withColumn("f", F.col("game_no") % 10)
    return S.overlap_count(g.where("f < 8"), g.where("f >= 8"), ["game_id"])


_H = "cast('0x' || substr(md5(concat_ws(':', cast({} as varchar), '0')), 1, 8) as ubigint)"


@query("K05_stratified", f" select file_row_id, model_name, status from v qualify row_number() over (partition by model_name, status order by {_H.format('file_row_id')}, file_row_id) <= 7")
def k05(spark, d):
    return S.stratified(votes(spark, d).select("file_row_id", "model_name", "status"), ["model_name", "status"], "file_row_id", 7)


@query("K05_pilot", f", o as (select * from vv where is_correct is not null and model_name is not null qualify row_number() over (partition by model_name, game_id order by {_H.format('file_row_id')}, file_row_id) = 1) select file_row_id, model_name, game_id, is_correct from o qualify row_number() over (partition by model_name, is_correct order by {_H.format('file_row_id')}, file_row_id) <= 6")
def k05_pilot(spark, d):
    """One run of each model and game, then the same number from each cell of model and correctness."""
    v = valid_votes(spark, d).where("is_correct is not null and model_name is not null").select("file_row_id", "model_name", "game_id", "is_correct")
    one = S.keep_one(v, ["model_name", "game_id"], [K.hash_rank(F.col("file_row_id"), F.lit(0)), F.col("file_row_id")])
    return S.stratified(one, ["model_name", "is_correct"], "file_row_id", 6)


@query("K06_topped_up", f", r as (select file_row_id, model_name, {_H.format('file_row_id')} as h from v), c as (select *, row_number() over (partition by model_name order by h, file_row_id) as k from r), o as (select *, k > 4 as is_top_up from c) select file_row_id, model_name, is_top_up from o order by is_top_up, h, file_row_id limit 40")
def k06_topped_up(spark, d):
    """Four rows of each model, topped up to forty by hash rank."""
    return S.topped_up(votes(spark, d).select("file_row_id", "model_name"), ["model_name"], "file_row_id", 4, 40)


@query("K05_allocation", ", c as (select status, count(*) as n from v group by 1), q as (select status, n * 100.0 / sum(n) over () as q from c), f as (select *, floor(q) as f, row_number() over (order by q - floor(q) desc, status) as k from q) select status, (f + (k <= 100 - sum(f) over ())::int)::int as n from f")
def k05_allocation(spark, d):
    return S.largest_remainder(votes(spark, d).groupBy("status").agg(F.count("*").alias("w")), 100, "status", "w").select("status", "n")


@query("K08_split", f", x as (select game_no, source, row_number() over (partition by source order by {_H.format('game_no')}, game_no) as k, count(*) over (partition by source) as n from g) select game_no, source, case when k <= round(n * 0.2) then 'val' else 'train' end as split from x")
def k08(spark, d):
    return S.split_by_share(games(spark, d).select("game_no", "source"), ["source"], "game_no", 0.2)


@query("K02_top_names", " select player, count(*) as n from slot group by 1 order by n desc, player limit 10")
def k02(spark, d):
    return slots(spark, d).groupBy("player").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "player").limit(10)


@query("K09_examples", " select model_name, status, file_row_id from v where justification is not null qualify row_number() over (partition by model_name, status order by length(justification), file_row_id) <= 3")
def k09(spark, d):
    w = W.partitionBy("model_name", "status").orderBy(F.length("justification"), "file_row_id")
    return votes(spark, d).where("justification is not null").withColumn("k", F.row_number().over(w)).where("k <= 3").select("model_name", "status", "file_row_id")


@query("K10_random", f" select file_row_id from v order by {_H.format('file_row_id')}, file_row_id limit 50")
def k10(spark, d):
    return votes(spark, d).select("file_row_id").orderBy(K.hash_rank(F.col("file_row_id"), F.lit(0)), "file_row_id").limit(50)


@query("K07_round_robin", f", x as (select file_row_id, run_label, game_id, {_H.replace(", '0'", "").format('file_row_id')} as h from v), a as (select *, row_number() over (partition by run_label, game_id order by h, file_row_id) as again from x), t as (select *, row_number() over (partition by run_label order by again, h, file_row_id) as turn from a) select file_row_id, run_label, game_id from t order by turn, run_label nulls first limit 40")
def k07(spark, d):
    return S.round_robin(votes(spark, d).select("file_row_id", "run_label", "game_id"), "run_label", "game_id", "file_row_id", 40)


@query("S20_pending", " select game_no, game_id from g anti join (select distinct game_id from vv) using (game_id)")
def s20(spark, d):
    return S.pending(games(spark, d).select("game_no", "game_id"), valid_votes(spark, d), ["game_id"]).select("game_no", "game_id")


@query("X22_upsert", " , n as (select file_row_id, 'reviewed' as status from v where decoding = 'greedy') select file_row_id, status from v anti join n using (file_row_id) union all select * from n".lstrip())
def x22(spark, d):
    v = votes(spark, d)
    return S.upsert(v.select("file_row_id", "status"), v.where("decoding = 'greedy'").select("file_row_id", F.lit("reviewed").alias("status")), ["file_row_id"])


@query("X23_patched", f", {REC} select record_id, item_no, len(list_filter(coalesce(it.relations, []), lambda x: x is not null and list_contains(coalesce(x.accused, []), 'UNKNOWN'))) > 0 as still_open from i")
def x23(spark, d):
    x = records(spark, d).select("record_id", F.posexplode("items").alias("i", "it")).where("it is not null")
    return x.select("record_id", (F.col("i") + 1).alias("item_no"), F.coalesce(F.exists("it.relations", lambda r: F.coalesce(F.array_contains(r["accused"], "UNKNOWN"), F.lit(False))), F.lit(False)).alias("still_open"))


@query("F52_role_of_vote", " select game_id, slot, vote, case when vote is null or vote < 0 then null else list_extract((select end_roles from g where g.game_no = s.game_no), vote + 1) end as voted_role from slot s")
def f52(spark, d):
    g = games(spark, d).select("game_no", "end_roles")
    return slots(spark, d).join(g, "game_no").select("game_id", "slot", "vote", F.get("end_roles", F.col("vote")).alias("voted_role"))


@query("F53_vote_lists", " select game_no, list_transform(voting_outcome, lambda x: case when x >= 0 then x end) as votes, len(list_filter(voting_outcome, lambda x: x is null)) as n_missing from g")
def f53(spark, d):
    return games(spark, d).select("game_no", F.transform("voting_outcome", lambda x: F.when(x >= 0, x)).alias("votes"), F.size(F.filter("voting_outcome", lambda x: x.isNull())).alias("n_missing"))


@query("F02_keys", " select distinct game_id, lower(regexp_replace(replace(trim(session_name), '#', ' '), '\\s+', ' ', 'g')) as session_key, 'game' || cast(regexp_extract(game_key, '(\\d+)', 1) as int) as game_key, lower(trim(regexp_replace(regexp_replace(session_name, '[#_\\-]', ' ', 'g'), '\\s+', ' ', 'g'))) as loose_key from game_index")
def f02(spark, d):
    g = table(spark, d, "game_index")
    return g.select("game_id", K.canonical_session(F.col("session_name")).alias("session_key"), K.canonical_game(F.col("game_key")).alias("game_key"), K.loose_session(F.col("session_name")).alias("loose_key")).distinct()


@query("S16_path_parts", " select distinct result_path, split_part(result_path, '/', 3) as model, regexp_extract(result_path, 'prompt_(v\\d+)', 1) as prompt_version, split_part(result_path, '/', 5) as source from v")
def s16(spark, d):
    p = F.split("result_path", "/")
    return votes(spark, d).select("result_path", F.get(p, 2).alias("model"), F.regexp_extract("result_path", r"prompt_(v\d+)", 1).alias("prompt_version"), F.get(p, 4).alias("source")).distinct()


@query("F46_content_hash", " select file_row_id, substr(sha256(concat_ws(chr(1), model_name, coalesce(justification, ''))), 1, 12) as hash from v")
def f46(spark, d):
    return votes(spark, d).select("file_row_id", F.substring(F.sha2(F.concat_ws("\u0001", "model_name", F.coalesce("justification", F.lit(""))), 256), 1, 12).alias("hash"))
