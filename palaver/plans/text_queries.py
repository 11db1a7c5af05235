"""Queries on texts, model output and graphs: A29-A40, A58-A67, F01-F20, F30-F47, S10-S14, X01-X08, X13-X18, X21."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import jsonx as J
from palaver.functions import keys as K
from palaver.functions import text as X
from palaver.operators import graphs as G
from palaver.operators import lexicon as LX
from palaver.operators.labels import shares
from palaver.plans.event_queries import ROLES, accusations
from palaver.plans.silver import lines, slots, sql, valid_votes, votes
from palaver.session import cut
from palaver.tables import first_delivery, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Connectives of the test texts by category.
LEXICON = {
    "although": "Comparison", "but": "Comparison", "yet": "Comparison", "because": "Contingency", "if": "Contingency", "since": "Contingency", "so": "Contingency", "therefore": "Contingency",
    "for": "Contingency", "and": "Expansion", "also": "Expansion", "or": "Expansion", "as well": "Expansion", "after": "Temporal", "before": "Temporal", "then": "Temporal", "when": "Temporal", "as": "Temporal", "as long as": "Contingency", "even if": "Comparison",
}


def query(name: str, statement: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if statement:
            SQL[name] = sql(statement)
        return fn

    return keep


def texts(spark, d):
    return votes(spark, d).where("justification is not null")


TX = "tx as (select * from v where justification is not null)"
_ALT = "(?i)\\b(" + "|".join(m.replace(" ", "\\s+") for m in sorted(LEXICON, key=lambda m: (-len(m), m))) + ")\\b"
_CATS = sorted(set(LEXICON.values()))


@query("F09_word_count", f", {TX} select file_row_id, len(regexp_extract_all(justification, '[\\pL\\pN_]+(?:[''’\\-][\\pL\\pN_]+)*')) as n_words from tx")
def f09(spark, d):
    return texts(spark, d).select("file_row_id", X.word_count(F.col("justification")).alias("n_words"))


@query("F10_space_words", f", {TX} select file_row_id, greatest(len(string_split_regex(trim(justification), '\\s+')), 1) as n_words, len(regexp_extract_all(justification, '(?i)\\bas\\b')) as n_as from tx")
def f10(spark, d):
    return texts(spark, d).select("file_row_id", X.space_words(F.col("justification")).alias("n_words"), X.word_hits(F.col("justification"), "as").alias("n_as"))


@query("F11_sentences", f", {TX} select file_row_id, len(list_filter(regexp_extract_all(justification, '[^.!?]+(?:[.!?]+|$)'), lambda c: regexp_matches(c, '[\\pL\\pN_]'))) as n_sentences from tx")
def f11(spark, d):
    return texts(spark, d).select("file_row_id", F.size(X.sentences(F.col("justification"))).alias("n_sentences"))


@query("F12_sentence_records", f", {TX}, p as (select file_row_id, list_filter(list_transform(regexp_extract_all(justification, '[^.!?]+(?:[.!?]+|$)'), lambda c: trim(c, ' \t\n\r')), lambda c: regexp_matches(c, '[\pL\pN_]')) as l from tx) select file_row_id, i::int as sentence_id, l[i] as text from (select *, unnest(range(1, len(l) + 1)) as i from p)")
def f12(spark, d):
    return texts(spark, d).select("file_row_id", F.explode(X.sentence_records(F.col("justification"))).alias("s")).select("file_row_id", "s.sentence_id", "s.text")


@query("F14_name_mentions", f", {TX} select file_row_id, s.player from tx join slot s using (game_id) where contains(' ' || regexp_replace(lower(justification), '[^\\pL\\pN]+', ' ', 'g') || ' ', ' ' || lower(s.player) || ' ')")
def f14(spark, d):
    s = slots(spark, d).select("game_id", "player")
    return texts(spark, d).join(s, "game_id").where(X.mentions(F.col("justification"), F.col("player"))).select("file_row_id", "player")


_ROLE_RE = "(?i)\\b(" + "|".join(ROLES) + ")\\b"
_RM = f"list_sort(list_distinct(list_transform(regexp_extract_all(justification, '{_ROLE_RE}', 1), lambda x: upper(x[1]) || lower(x[2:]))))"


@query("F15_role_mentions", f", {TX} select file_row_id, {_RM} as roles from tx")
def f15(spark, d):
    return texts(spark, d).select("file_row_id", X.role_mentions(F.col("justification"), ROLES).alias("roles"))


@query("F01_squeezed", " select distinct question_id, trim(regexp_replace(question, '\\s+', ' ', 'g')) as question, lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) as folded from prelim_results where question is not null")
def f01(spark, d):
    q = table(spark, d, "prelim_results").where("question is not null")
    return q.select("question_id", X.squeezed(F.col("question")).alias("question"), F.lower(X.squeezed(F.col("question"))).alias("folded")).distinct()


@query("F03_safe_names", " select distinct game_id, regexp_replace(trim(game_id), '[/\\\\: ]', '_', 'g') as path_name, regexp_replace(regexp_replace(lower(game_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from g")
def f03(spark, d):
    return slots(spark, d).select("game_id").distinct().select("game_id", K.safe_path(F.col("game_id")).alias("path_name"), K.slug(F.col("game_id")).alias("slug"))


@query("F06_folded", " select distinct lang, lower(strip_accents(trim(regexp_replace(substr(text, 1, 10000000), '\\s+', ' ', 'g')))) = '' as is_blank, count(*) as n from documents group by all")
def f06(spark, d):
    return table(spark, d, "documents").groupBy("lang", (K.folded(F.coalesce("text", F.lit(""))) == "").alias("is_blank")).agg(F.count("*").alias("n"))


@query("F19_path_kinds", " select case when regexp_matches(coalesce(error_type, ''), 'Memory') then 'memory' when regexp_matches(coalesce(error_type, ''), '.') then 'other' else 'none' end as kind, count(*) as n from (select distinct result_id, error_type from vote_results) group by 1")
def f19(spark, d):
    r = table(spark, d, "vote_results").select("result_id", "error_type").distinct()
    return r.groupBy(X.first_kind(F.coalesce("error_type", F.lit("")), [("Memory", "memory"), (".", "other")], "none").alias("kind")).agg(F.count("*").alias("n"))


@query("X03_alternation", f", {TX}, f as (select file_row_id, list_transform(regexp_extract_all(justification, '{_ALT}', 1), lambda w: regexp_replace(lower(w), '\\s+', ' ', 'g')) as f from tx) select file_row_id, " + ", ".join(f"len(list_filter(f, lambda w: w in ({', '.join(repr(m) for m, k in LEXICON.items() if k == c)})))::int as n_{c.lower()}" for c in _CATS) + " from f")
def x03(spark, d):
    return texts(spark, d).select("file_row_id", *[v.alias(f"n_{c.lower()}") for c, v in LX.alternation_counts(F.col("justification"), LEXICON).items()])


@query("X01_greedy_matches")
def x01(spark, d):
    m = LX.greedy_matcher(LEXICON)(F.col("justification"))
    return texts(spark, d).select("file_row_id", F.explode(m).alias("m")).select("file_row_id", "m.marker", "m.category", "m.start", "m.end")


@query("X02_greedy_rates")
def x02(spark, d):
    return LX.rates(texts(spark, d), "file_row_id", "justification", LEXICON)


@query("X04_marker_counts", f", {TX}, m as (select unnest({list(LEXICON)!r}) as marker) select model_name, marker, sum(len(regexp_extract_all(justification, '(?i)\\b' || replace(marker, ' ', '\\s+') || '\\b')))::bigint as n from tx cross join m group by all")
def x04(spark, d):
    per = F.array(*[F.struct(F.lit(m).alias("marker"), F.regexp_count("justification", F.lit(r"(?i)\b" + m.replace(" ", r"\s+") + r"\b")).alias("n")) for m in LEXICON])
    return texts(spark, d).select("model_name", F.explode(per).alias("p")).groupBy("model_name", "p.marker").agg(F.sum("p.n").alias("n"))


@query("X05_connective_between")
def x05(spark, d):
    m = LX.greedy_matcher(LEXICON)(F.col("justification"))
    x = texts(spark, d).select("model_name", "file_row_id", "justification", m.alias("m"))
    return x.groupBy("model_name").agg(F.count("*").alias("n"), F.count_if(LX.between(F.col("m"), F.col("justification"), r"\bWerewolf\b", r"\bvote\b")).alias("n_between"))


@query("X06_attribution", f", {TX}, y as (select model_name, {_RM} as r, voted_player_start_role as s, voted_player_end_role as e from tx where voted_player_start_role <> voted_player_end_role) select model_name, case when len(r) = 0 then 'no_mention' when list_contains(r, s) and list_contains(r, e) then 'both' when list_contains(r, e) then 'end_only' when list_contains(r, s) then 'start_only' else 'neither' end as class, count(*) as n from y group by all")
def x06(spark, d):
    y = texts(spark, d).where("voted_player_start_role <> voted_player_end_role")
    k = LX.attribution(X.role_mentions(F.col("justification"), ROLES), F.col("voted_player_start_role"), F.col("voted_player_end_role"))
    return y.groupBy("model_name", k.alias("class")).agg(F.count("*").alias("n"))


@query("X07_contradiction_flags", f", {TX}, y as (select file_row_id, {_RM} as r, list_distinct([voted_player_start_role, voted_player_end_role]) as t from tx where voted_player_start_role is not null and voted_player_end_role is not null) select file_row_id, case when len(r) = 0 then 'silent' when len(list_intersect(r, t)) = 0 then 'contradicts' when len(list_intersect(r, t)) = len(r) then 'consistent' else 'mixed' end as flag from y")
def x07(spark, d):
    r, t = X.role_mentions(F.col("justification"), ROLES), F.array_distinct(F.array("voted_player_start_role", "voted_player_end_role"))
    y = texts(spark, d).where("voted_player_start_role is not null and voted_player_end_role is not null").select("file_row_id", r.alias("r"), F.size(F.array_intersect(r, t)).alias("k"))
    return y.select("file_row_id", F.when(F.size("r") == 0, "silent").when(F.col("k") == 0, "contradicts").when(F.col("k") == F.size("r"), "consistent").otherwise("mixed").alias("flag"))


@query("X08_chance_adjusted")
def x08(spark, d):
    from palaver.functions.mathx import hypergeometric_two_or_more

    c = slots(spark, d).groupBy("game_id").agg(F.max("n_players").cast("int").alias("np"), F.count_if(F.col("end_role") == "Werewolf").cast("int").alias("k"))
    y = texts(spark, d).select("model_name", "game_id", F.size(X.role_mentions(F.col("justification"), ROLES)).alias("m")).join(c, "game_id")
    e = hypergeometric_two_or_more(F.col("np"), F.col("k"), F.least("m", "np"))
    g = y.groupBy("model_name", "game_id").agg(F.avg((F.col("m") >= 2).cast("double")).alias("obs"), F.avg(e).alias("chance"))
    return g.groupBy("model_name").agg(F.avg("obs").alias("observed"), F.avg("chance").alias("chance"), F.avg(F.col("obs") - F.col("chance")).alias("excess"))


_WC = "greatest(len(string_split_regex(trim(justification), '\\s+')), 1)"


@query("A29_run_metrics", f", {TX}, r as (select model_name, run_label, count(*) as n, avg({_WC}) as mean_words, avg(length(justification)) as mean_chars from tx group by all) select model_name, count(*) as n_runs, avg(mean_words) as mean_words, stddev_samp(mean_words) as sd_words, avg(mean_chars) as mean_chars from r group by 1")
def a29(spark, d):
    r = texts(spark, d).groupBy("model_name", "run_label").agg(F.avg(X.space_words(F.col("justification"))).alias("w"), F.avg(F.length("justification")).alias("c"))
    return r.groupBy("model_name").agg(F.count("*").alias("n_runs"), F.avg("w").alias("mean_words"), F.stddev_samp("w").alias("sd_words"), F.avg("c").alias("mean_chars"))


@query("A30_usage", f", {TX}, f as (select model_name, run_label, file_row_id, {_WC} as w, unnest({[c.lower() for c in _CATS]!r}) as category, unnest([" + ", ".join(f"len(list_filter(regexp_extract_all(justification, '{_ALT}', 1), lambda x: regexp_replace(lower(x), '\\s+', ' ', 'g') in ({', '.join(repr(m) for m, k in LEXICON.items() if k == c)})))" for c in _CATS) + "]) as n from tx), r as (select model_name, run_label, category, sum(n) * 100.0 / sum(w) as rate, avg((n > 0)::int) as coverage from f group by all) select model_name, category, count(*) as n_runs, avg(rate) as mean_rate, stddev_samp(rate) as sd_rate, avg(coverage) as mean_coverage from r group by all")
def a30(spark, d):
    per = F.array(*[F.struct(F.lit(c.lower()).alias("category"), v.alias("n")) for c, v in LX.alternation_counts(F.col("justification"), LEXICON).items()])
    x = cut(texts(spark, d).select("model_name", "run_label", X.space_words(F.col("justification")).alias("w"), per.alias("p")))
    totals = x.groupBy("model_name", "run_label").agg(F.count("*").alias("n_rows"), F.sum("w").alias("words"))
    hits = x.select("model_name", "run_label", F.explode("p").alias("h")).select("model_name", "run_label", "h.category", "h.n", (F.col("h.n") > 0).cast("int").alias("covered"))
    return LX.usage(hits, totals, ["run_label"], ["model_name"], "category", "n", "words")


@query("A31_marker_category", " , e as (select lower(label) as marker, source as category, count(*) as f from (select source, unnest(labels) as label from line) group by all) select marker, category, f::double as score, f * 1.0 / sum(f) over (partition by marker) as dominance_share, count_if(f = mx) over (partition by marker) > 1 as is_tie from (select *, max(f) over (partition by marker) as mx from e) qualify row_number() over (partition by marker order by f desc, category) = 1".lstrip())
def a31(spark, d):
    e = lines(spark, d).select("source", F.explode("labels").alias("label")).groupBy(F.lower("label").alias("marker"), F.col("source").alias("category")).agg(F.count("*").alias("f"))
    return LX.assigned_category(e, "marker", "category", "f")


@query("A33_category_list", " , c as (select distinct source, label from (select source, unnest(labels) as label from line)) select source, count(*) as n_labels, string_agg(label, ', ' order by label) as labels from c group by 1".lstrip())
def a33(spark, d):
    c = lines(spark, d).select("source", F.explode("labels").alias("label"))
    return c.groupBy("source").agg(F.countDistinct("label").alias("n_labels"), F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))


@query("A34_equal_weight", f", {TX}, i as (select model_name, game_id, avg(length(justification)) as m, count(*) as k, sum(length(justification)) as s from tx group by all) select model_name, avg(m) as mean_eqgame, sum(s) * 1.0 / sum(k) as mean_pooled, count(*) as n_games, sum(k)::bigint as n_rows from i group by 1")
def a34(spark, d):
    i = texts(spark, d).groupBy("model_name", "game_id").agg(F.avg(F.length("justification")).alias("m"), F.count("*").alias("k"), F.sum(F.length("justification")).alias("s"))
    return i.groupBy("model_name").agg(F.avg("m").alias("mean_eqgame"), (F.sum("s") / F.sum("k")).alias("mean_pooled"), F.count("*").alias("n_games"), F.sum("k").alias("n_rows"))


@query("A35_two_arms", f", {TX}, i as (select model_name, is_correct, game_id, avg({_WC}) as m, count(*) as k from tx where is_correct is not null group by all) select model_name, avg(m) filter (where is_correct) as mean_correct, avg(m) filter (where not is_correct) as mean_wrong, count_if(is_correct) as games_correct, count_if(not is_correct) as games_wrong, sum(k)::bigint as n_rows from i group by 1")
def a35(spark, d):
    i = texts(spark, d).where("is_correct is not null").groupBy("model_name", "is_correct", "game_id").agg(F.avg(X.space_words(F.col("justification"))).alias("m"), F.count("*").alias("k"))
    c = F.col("is_correct")
    return i.groupBy("model_name").agg(F.avg(F.when(c, F.col("m"))).alias("mean_correct"), F.avg(F.when(~c, F.col("m"))).alias("mean_wrong"), F.count_if(c).alias("games_correct"), F.count_if(~c).alias("games_wrong"), F.sum("k").alias("n_rows"))


@query("A36_weighted_contrast", f", {TX}, i as (select model_name, game_id, status, avg({_WC}) as m, count(*) as k from tx group by all), s as (select *, k * 1.0 / sum(k) over (partition by model_name, game_id) as share from i) select model_name, status, sum(share * m) / sum(share) as weighted_mean, sum(share) as weight from s group by all")
def a36(spark, d):
    from pyspark.sql.window import Window as W

    i = texts(spark, d).groupBy("model_name", "game_id", "status").agg(F.avg(X.space_words(F.col("justification"))).alias("m"), F.count("*").alias("k"))
    s = i.withColumn("share", F.col("k") / F.sum("k").over(W.partitionBy("model_name", "game_id")))
    return s.groupBy("model_name", "status").agg((F.sum(F.col("share") * F.col("m")) / F.sum("share")).alias("weighted_mean"), F.sum("share").alias("weight"))


@query("A37_mention_rates", f", {TX}, i as (select model_name, game_id, avg((len({_RM}) > 0)::int) as m from tx group by all) select model_name, avg(m) as mention_rate_eqgame, count(*) as n_games from i group by 1")
def a37(spark, d):
    i = texts(spark, d).groupBy("model_name", "game_id").agg(F.avg((F.size(X.role_mentions(F.col("justification"), ROLES)) > 0).cast("double")).alias("m"))
    return i.groupBy("model_name").agg(F.avg("m").alias("mention_rate_eqgame"), F.count("*").alias("n_games"))


@query("A38_class_counts", f", {TX}, y as (select model_name, len({_RM}) as k from tx) select model_name, count_if(k = 0) as none, count_if(k = 1) as one, count_if(k > 1) as several from y group by 1")
def a38(spark, d):
    k = F.size(X.role_mentions(F.col("justification"), ROLES))
    y = texts(spark, d).select("model_name", F.when(k == 0, "none").when(k == 1, "one").otherwise("several").alias("k"))
    return y.groupBy("model_name").pivot("k", ["none", "one", "several"]).count().fillna(0)


@query("A39_availability", " select count(*) as n_votes, count_if(justification is not null) as n_text, count_if(voted_player_end_role is not null and voted_player_end_role <> 'NA') as n_role, count_if(is_correct is not null) as n_correct from v")
def a39(spark, d):
    v = votes(spark, d)
    return v.agg(F.count("*").alias("n_votes"), F.count("justification").alias("n_text"), F.count_if(F.col("voted_player_end_role").isNotNull() & (F.col("voted_player_end_role") != "NA")).alias("n_role"), F.count("is_correct").alias("n_correct"))


@query("A40_corrected_gap", " , c as (select game_id, any_value(n_players) as n, count_if(end_role = 'Werewolf') as k from slot group by 1), o as (select model_name, game_id, avg((voted_player_end_role = 'Werewolf')::int) as obs from vv where not is_circle_vote and voted_player_end_role is not null group by all) select model_name, avg(obs - k * 1.0 / n) as gap, count(*) as n_games from o join c using (game_id) group by 1".lstrip())
def a40(spark, d):
    c = slots(spark, d).groupBy("game_id").agg(F.max("n_players").alias("n"), F.count_if(F.col("end_role") == "Werewolf").alias("k"))
    o = valid_votes(spark, d).where("not is_circle_vote and voted_player_end_role is not null").groupBy("model_name", "game_id").agg(F.avg((F.col("voted_player_end_role") == "Werewolf").cast("int")).alias("obs"))
    return o.join(c, "game_id").groupBy("model_name").agg(F.avg(F.col("obs") - F.col("k") / F.col("n")).alias("gap"), F.count("*").alias("n_games"))


def results(spark, d):
    return first_delivery(table(spark, d, "vote_results"), ["result_id"], "created_at", ["game_id", "player_names", "model_name", "max_new_tokens", "raw_response", "parsed_output", "validation", "soft_warnings", "debug_info", "error"])


RS = "rs as (select * from vote_results qualify row_number() over (partition by result_id order by created_at) = 1)"


@query("F30_unfenced", f", {RS}, t as (select result_id, regexp_replace(raw_response, '^\\s+|\\s+$', '', 'g') as t from rs where raw_response is not null) select result_id, case when starts_with(t, '```') then regexp_replace(regexp_replace(regexp_replace(t, '^```[^\\n]*\\n?', ''), '\\n?```[^\\n]*$', ''), '^\\s+|\\s+$', '', 'g') else t end as text from t")
def f30(spark, d):
    return results(spark, d).where("raw_response is not null").select("result_id", J.unfenced(F.col("raw_response")).alias("text"))


@query("F32_prepared")
def f32(spark, d):
    return results(spark, d).select("result_id", J.prepared(F.col("raw_response")).alias("text"), J.json_block(F.col("raw_response")).alias("block"))


@query("F34_vote_errors", f", {RS}, y as (select result_id, player_names, trim(parsed_output.justification) as j, trim(parsed_output.chosen_vote) as c, parsed_output as p from rs) select result_id, case when p is null then ['no_parseable_json'] else list_filter([case when p.justification is null then 'missing_justification' end, case when p.chosen_vote is null then 'missing_chosen_vote' end, case when coalesce(j, '') = '' then 'justification_not_nonempty_string' end, case when coalesce(c, '') = '' then 'chosen_vote_not_nonempty_string' when not list_contains(list_append(coalesce(player_names, []), 'No Werewolf'), c) then 'chosen_vote_not_in_player_list_or_circle_vote:' || c end], lambda x: x is not null) end as errors from y")
def f34(spark, d):
    p = F.col("parsed_output")
    return results(spark, d).select("result_id", J.vote_errors(p.isNotNull(), p["justification"], p["chosen_vote"], F.col("player_names")).alias("errors"))


@query("F35_answer_errors", ", rs as (select * from prelim_results qualify row_number() over (partition by prelim_id order by created_at) = 1) select prelim_id, case when parsed_output is null then ['no_parseable_json'] else list_filter([case when parsed_output.justification is null then 'missing_justification' end, case when parsed_output.answer is null then 'missing_answer' end, case when coalesce(trim(parsed_output.justification), '') = '' then 'justification_not_nonempty_string' end, case when coalesce(trim(parsed_output.answer), '') = '' then 'answer_not_nonempty_string' end], lambda x: x is not null) end as errors from rs")
def f35(spark, d):
    r = first_delivery(table(spark, d, "prelim_results"), ["prelim_id"], "created_at", ["parsed_output"])
    p = F.col("parsed_output")
    return r.select("prelim_id", J.answer_errors(p.isNotNull(), p["justification"], p["answer"]).alias("errors"))


@query("F36_soft_warnings")
def f36(spark, d):
    r = results(spark, d).where("raw_response is not null").withColumn("used", J.prepared(F.col("raw_response")))
    keys = F.coalesce(F.json_object_keys("used"), F.array().cast("array<string>"))
    n = F.size(X.sentences(F.get_json_object("used", "$.justification")))
    return r.select("result_id", J.soft_warnings(F.col("raw_response"), F.col("used"), F.col("debug_info.output_token_count"), F.col("max_new_tokens"), n, keys, ["justification", "chosen_vote"]).alias("warnings"))


@query("F37_repair")
def f37(spark, d):
    r = results(spark, d).withColumn("used", J.prepared(F.col("raw_response")))
    j, c = F.get_json_object("used", "$.justification"), F.get_json_object("used", "$.chosen_vote")
    obj = F.from_json("used", "map<string,string>").isNotNull()
    e = J.vote_errors(obj, j, c, F.col("player_names"))
    state = J.repair_state(F.col("validation.is_valid"), F.col("error"), obj, e)
    return r.groupBy("model_name", state.alias("state")).agg(F.count("*").alias("n"))


@query("F38_channels", f", {RS} select result_id, trim(case when regexp_extract(raw_response, '(?s)<\\|(?:channel\\|>)?final(?:<\\|message)?\\|>(.*)$', 1) <> '' then regexp_extract(raw_response, '(?s)<\\|(?:channel\\|>)?final(?:<\\|message)?\\|>(.*)$', 1) else raw_response end) as visible from rs where raw_response is not null")
def f38(spark, d):
    return results(spark, d).where("raw_response is not null").select("result_id", J.channels(F.col("raw_response"))["visible"].alias("visible"))


@query("F40_circle", " select file_row_id, coalesce(trim(chosen_vote_raw) = 'No Werewolf', false) as is_circle, coalesce(lower(trim(chosen_vote_raw)) in ('no werewolf', 'no werewolves', 'no one', 'nobody', 'none', 'circle', 'circle vote', 'middle', 'no vote', 'no-werewolf', 'no_werewolf'), false) as is_spelling from v")
def f40(spark, d):
    return votes(spark, d).select("file_row_id", J.is_circle(F.col("chosen_vote_raw")).alias("is_circle"), J.is_circle_spelling(F.col("chosen_vote_raw")).alias("is_spelling"))


@query("A58_flag_counts", f", {RS}, w as (select result_id, unnest(soft_warnings) as flag from rs) select flag, count(*) as n, count(distinct result_id) as n_results from w group by 1")
def a58(spark, d):
    return results(spark, d).select("result_id", F.explode("soft_warnings").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"), F.countDistinct("result_id").alias("n_results"))


@query("A59_category_by_model", f", {RS}, w as (select model_name, unnest(soft_warnings) as flag from rs) select model_name, flag, count(*) as n, count(*) * 100.0 / sum(count(*)) over (partition by model_name) as pct from w group by model_name, flag")
def a59(spark, d):
    return shares(results(spark, d).select("model_name", F.explode("soft_warnings").alias("flag")), ["model_name"], "flag")


@query("A60_accept_rate", f", {RS} select model_name, count(validation.is_valid) as reviewed, count_if(validation.is_valid) as accepted, count_if(validation.is_valid) * 1.0 / nullif(count(validation.is_valid), 0) as accept_rate from rs group by 1")
def a60(spark, d):
    ok = F.col("validation.is_valid")
    return results(spark, d).groupBy("model_name").agg(F.count(ok).alias("reviewed"), F.count_if(ok).alias("accepted"), F.try_divide(F.count_if(ok), F.count(ok)).alias("accept_rate"))


@query("A61_review_confusion", f", {RS} select coalesce(validation.is_valid, false) as claimed, parsed_output.chosen_vote is not null as parsed, count(*) as n from rs group by all")
def a61(spark, d):
    return results(spark, d).groupBy(F.coalesce("validation.is_valid", F.lit(False)).alias("claimed"), F.col("parsed_output.chosen_vote").isNotNull().alias("parsed")).agg(F.count("*").alias("n"))


@query("A62_token_usage", f", {RS} select model_name, avg(debug_info.output_token_count) as mean_tokens, max(debug_info.output_token_count) as max_tokens, sum(debug_info.output_token_count)::bigint as total_tokens, avg(debug_info.output_token_count) * 1000 as projected from rs group by 1")
def a62(spark, d):
    t = F.col("debug_info.output_token_count")
    return results(spark, d).groupBy("model_name").agg(F.avg(t).alias("mean_tokens"), F.max(t).alias("max_tokens"), F.sum(t).alias("total_tokens"), (F.avg(t) * 1000).alias("projected"))


@query("A64_spread", f", {RS}, t as (select model_name, list_sort(list(debug_info.output_token_count) filter (where debug_info.output_token_count is not null)) as t from rs group by 1) select model_name, t[1] as least, t[len(t) // 2 + 1] as middle, t[len(t)] as most from t")
def a64(spark, d):
    # The element at n div 2 of the sorted counts, from their histogram: counts are small integers.
    t = F.col("debug_info.output_token_count")
    h = results(spark, d).where(t.isNotNull()).groupBy("model_name", t.alias("t")).agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window as W

    w = W.partitionBy("model_name")
    x = h.withColumn("upto", F.sum("n").over(w.orderBy("t"))).withColumn("all", F.sum("n").over(w))
    return x.groupBy("model_name").agg(F.min("t").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("t"))).alias("middle"), F.max("t").alias("most"))


@query("A65_role_scores", " select end_role as role, count(*) as n, avg((start_role = end_role)::int) as accuracy from slot where end_role is not null and start_role is not null group by 1")
def a65(spark, d):
    return slots(spark, d).where("end_role is not null and start_role is not null").groupBy(F.col("end_role").alias("role")).agg(F.count("*").alias("n"), F.avg((F.col("start_role") == F.col("end_role")).cast("int")).alias("accuracy"))


@query("S14_merged_transcripts", " select game_id, string_agg('[' || rec_id || '] ' || coalesce(player, k, '?') || ': ' || coalesce(utterance, ''), chr(10) order by rec_id, line_id) as transcript, count(*) as n_lines from line group by 1")
def s14(spark, d):
    one = F.concat(F.lit("["), F.col("rec_id"), F.lit("] "), F.coalesce("player", "k", F.lit("?")), F.lit(": "), F.coalesce("utterance", F.lit("")))
    return lines(spark, d, text=True).groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("rec_id", "line_id", one.alias("t")))).alias("l")).select("game_id", F.array_join(F.col("l.t"), "\n").alias("transcript"), F.size("l").cast("long").alias("n_lines"))


@query("S11_parsed_lines", " , t as (select line_id, coalesce(k, '?') || ': ' || coalesce(utterance, '') as raw from line) select line_id, case when regexp_matches(raw, '^[^:]{1,40}:') then trim(regexp_extract(raw, '^([^:]{1,40}): ?(.*)$', 1)) end as who, case when regexp_matches(raw, '^[^:]{1,40}:') then trim(regexp_extract(replace(raw, chr(10), ' '), '^([^:]{1,40}):\\s*(.*)$', 2)) end as said from t".lstrip())
def s11(spark, d):
    from palaver.sources.transcripts import parsed_line

    raw = F.concat(F.coalesce("k", F.lit("?")), F.lit(": "), F.coalesce("utterance", F.lit("")))
    return lines(spark, d, text=True).select("line_id", parsed_line(raw).alias("p")).select("line_id", F.col("p.speaker").alias("who"), F.col("p.text").alias("said"))


def graph(spark, d):
    """Who accuses whom as a graph for each game: players are nodes, accusations edges."""
    a = accusations(spark, d).where("accused <> 'UNKNOWN'")
    e = a.select(F.col("game_id").alias("graph"), (F.col("record_id") * 1000000 + F.col("item_no") * 1000 + F.col("relation_no") * 20 + F.col("accused_no")).alias("pos"), F.col("accuser").alias("source"), F.col("accused").alias("target"), F.col("type").alias("relation"), F.concat(F.lit("x"), F.col("line_number")).alias("grp"))
    n = slots(spark, d).select(F.col("game_id").alias("graph"), F.col("slot").cast("long").alias("pos"), F.col("player").alias("id"), F.coalesce("end_role", F.lit("")).alias("role"), F.col("player").alias("text"))
    return n, e


GR = """r as (select record_id, game_id, items from accusation_records qualify row_number() over (partition by record_id order by loaded_at) = 1),
i0 as (select record_id, game_id, i as item_no, items[i] as it from (select *, unnest(range(1, coalesce(len(items), 0) + 1)) as i from r) where items[i] is not null),
l0 as (select record_id, game_id, item_no, it.line_number as line_number, it.accuser as accuser, j as relation_no, it.relations[j] as re from (select *, unnest(range(1, coalesce(len(it.relations), 0) + 1)) as j from i0) where it.relations[j] is not null),
ed as (select game_id as graph, record_id * 1000000 + item_no * 1000 + relation_no * 20 + k as pos, accuser as source, re.accused[k] as target, re.type as relation, 'x' || line_number as grp from (select *, unnest(range(1, coalesce(len(re.accused), 0) + 1)) as k from l0) where re.accused[k] is not null and regexp_matches(re.accused[k], '\\S') and re.accused[k] <> 'UNKNOWN')"""


@query("X17_cycles", f", {GR}, e as (select distinct graph, source, target from ed where source is not null), rc as (with recursive w as (select graph, source, target from e union select w.graph, w.source, e.target from w join e on e.graph = w.graph and e.source = w.target) select distinct graph from w where source = target) select * from rc")
def x17(spark, d):
    return G.cyclic(graph(spark, d)[1]).select("graph")


@query("X18_expected_groups", f", {GR}, g0 as (select graph, grp, list(source order by pos) as s, arg_min_null(target, pos) as target, arg_min_null(relation, pos) as relation, count(distinct coalesce(target, '')) > 1 as mixes_targets, count(distinct coalesce(relation, '')) > 1 as mixes_relations from ed where coalesce(grp, '') <> '' group by all) select graph, grp, len(list_distinct(s)) + (len(list_filter(s, lambda x: x is null)) > 0)::int as n_sources, target, relation, mixes_targets, mixes_relations from g0")
def x18(spark, d):
    g = G.expected_groups(graph(spark, d)[1])
    return g.select("graph", "grp", F.size("sources").alias("n_sources"), "target", "relation", "mixes_targets", "mixes_relations")


@query("X16_issues")
def x16(spark, d):
    n, e = graph(spark, d)
    return G.issues(n, e, ROLES, ["werewolf", "deception", "suspicion", "minion", "tanner"], "Tanner")


@query("X15_normalised")
def x15(spark, d):
    n, e = graph(spark, d)
    return G.normalised(n, e)[1]


@query("X15_repairs")
def x15_repairs(spark, d):
    return G.normalised(*graph(spark, d))[2]


@query("A66_graph_features", f", {GR}, dg as (select graph, id, sum(o) as o, sum(i) as i from (select graph, source as id, 1 as o, 0 as i from ed union all select graph, target, 0, 1 from ed) group by all), nn as (select distinct game_id as graph, player as id from slot), bn as (select nn.graph, count(*) as n_nodes, count_if(coalesce(i, 0) = 0 and coalesce(o, 0) > 0) as n_roots, count_if(coalesce(o, 0) = 0 and coalesce(i, 0) > 0) as n_leaves, count_if(coalesce(o, 0) = 0 and coalesce(i, 0) = 0) as n_isolated, max(coalesce(i, 0))::bigint as max_in, max(coalesce(o, 0))::bigint as max_out from nn left join dg on dg.graph = nn.graph and dg.id = nn.id group by 1), be as (select graph, count(*) as n_edges, count(distinct relation) as n_relations, count(distinct grp) as n_groups, count_if(coalesce(source = target, false)) as n_self from ed group by 1) select bn.*, coalesce(n_edges, 0) as n_edges, coalesce(n_relations, 0) as n_relations, coalesce(n_groups, 0) as n_groups, coalesce(n_self, 0) as n_self from bn left join be using (graph)")
def a66(spark, d):
    return G.features(*graph(spark, d))


@query("A66_group_features", f""", {GR}, g0 as (select graph, grp, len(list_distinct(list(source))) + (count(*) > count(source))::int as k, arg_min_null(target, pos) as target, arg_min_null(relation, pos) as relation from ed where coalesce(grp, '') <> '' group by all),
 pg as (select graph, count(*) as n_groups, count_if(k > 1) as n_linked_groups, count_if(relation = 'deception') as n_support_groups, count_if(relation = 'werewolf') as n_attack_groups from g0 group by 1),
 mt as (select graph, count(*) as m from (select graph, target from g0 group by all having count(*) > 1) group by 1),
 nd as (select game_id as graph, count_if(coalesce(end_role, '') = 'Tanner') as n_conclusions, list_sort(list_distinct(list(coalesce(end_role, '')))) as node_roles from slot group by 1),
 re as (select graph, bool_or(coalesce(relation = 'werewolf', false)) as has_attack, list_sort(list_distinct(list(relation) filter (relation is not null))) as edge_relations from ed group by 1)
 select nd.graph, n_conclusions, coalesce(n_groups, 0) as n_groups, coalesce(n_linked_groups, 0) as n_linked_groups, coalesce(n_support_groups, 0) as n_support_groups, coalesce(n_attack_groups, 0) as n_attack_groups, coalesce(m, 0) as n_targets_with_several_groups, coalesce(has_attack, false) as has_attack, node_roles, coalesce(edge_relations, []) as edge_relations from nd left join pg using (graph) left join mt using (graph) left join re using (graph)""")
def a66_groups(spark, d):
    return G.group_features(*graph(spark, d), "Tanner", "deception", "werewolf")


@query("A67_relation_shares", f", {GR} select source, relation, count(*) as n, count(*) * 100.0 / sum(count(*)) over (partition by source) as pct from ed where relation is not null and source is not null group by source, relation")
def a67(spark, d):
    return shares(graph(spark, d)[1].where("relation is not null and source is not null"), ["source"], "relation")


@query("X13_marked_transcripts", " select game_id, rec_id, line_id, '[' || rec_id || '] ' || coalesce(utterance, '') || case when list_contains(labels, 'Accusation') then ' <<ACCUSATION>>' else '' end as t from line")
def x13(spark, d):
    """The lines of marked transcripts; in order of rec_id and line_id they are a game's text."""
    from palaver.sources.transcripts import marked

    t = F.concat(F.lit("["), F.col("rec_id"), F.lit("] "), F.coalesce("utterance", F.lit("")))
    return lines(spark, d, text=True).select("game_id", "rec_id", "line_id", marked(t, F.array_contains("labels", "Accusation"), "<<ACCUSATION>>").alias("t"))
