"""Queries of single operators that no family query shows on its own."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palaver.functions import jsonx as J
from palaver.functions import keys as K
from palaver.functions import mathx as M
from palaver.functions import text as X
from palaver.operators import bootstrap as B
from palaver.operators import review as R
from palaver.operators.labels import positions, shares
from palaver.operators.sets import keep_one
from palaver.plans.event_queries import records
from palaver.plans.silver import games, lines, slots, sql, valid_votes, votes
from palaver.plans.stat_queries import GA, REPS, _R, _w, game_accuracy
from palaver.plans.text_queries import RS, results, texts
from palaver.session import cut
from palaver.sources import transcripts as TR
from palaver.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if statement:
            SQL[name] = sql(statement)
        return fn

    return keep


@query("P05_status_filter", " select file_row_id, target from vv")
def p05(spark, d):
    return valid_votes(spark, d).select("file_row_id", "target")


@query("P10_projection", " select game_no, source, game_key, num_players from g")
def p10(spark, d):
    return games(spark, d).select("game_no", "source", "game_key", "num_players")


@query("P13_sound_records", f", {RS} select result_id from rs where error is null and raw_response is not null")
def p13(spark, d):
    return results(spark, d).where("error is null and raw_response is not null").select("result_id")


@query("J08_export", " , c as (select model_name, game_id, count(*) as n from vv group by all), s as (select model_name, game_id, count_if(is_correct) as ok from vv group by all), st as (select game_id, count_if(start_role = 'Werewolf') as wolves from slot group by 1) select c.model_name, c.game_id, n, ok, wolves from c left join s on s.model_name = c.model_name and s.game_id = c.game_id left join st on st.game_id = c.game_id".lstrip())
def j08(spark, d):
    v = cut(valid_votes(spark, d).select("model_name", "game_id", "is_correct"))
    st = slots(spark, d).groupBy("game_id").agg(F.count_if(F.col("start_role") == "Werewolf").alias("wolves"))
    n = v.groupBy("model_name", "game_id").agg(F.count("*").alias("n"))
    return n.join(v.groupBy("model_name", "game_id").agg(F.count_if("is_correct").alias("ok")), ["model_name", "game_id"], "left").join(st, "game_id", "left").select("model_name", "game_id", "n", "ok", "wolves")


@query("J16_metric_merge", " , a as (select game_id, avg(is_correct::int) as model from vv group by 1), h as (select s.game_id, avg((t.end_role = 'Werewolf')::int) as human from slot s join slot t on t.game_id = s.game_id and t.slot = s.vote group by 1) select game_id, model, human from a join h using (game_id)".lstrip())
def j16(spark, d):
    s = slots(spark, d)
    h = s.select("game_id", F.col("vote").alias("slot")).join(s.select("game_id", "slot", "end_role"), ["game_id", "slot"]).groupBy("game_id").agg(F.avg((F.col("end_role") == "Werewolf").cast("int")).alias("human"))
    return valid_votes(spark, d).groupBy("game_id").agg(F.avg(F.col("is_correct").cast("int")).alias("model")).join(h, "game_id")


@query("A32_sum_or_null", " select source, sum(num_dropped_lines)::bigint as dropped, sum(case when num_turns < 0 then num_turns end)::bigint as none from g group by 1")
def a32(spark, d):
    return games(spark, d).join(table(spark, d, "game_index").groupBy("game_no").agg(F.max("num_dropped_lines").alias("nd")), "game_no").groupBy("source").agg(F.sum("nd").alias("dropped"), F.sum(F.when(F.col("num_turns") < 0, F.col("num_turns"))).alias("none"))


@query("A63_accuracy_summary", f", {RS} select model_name, count(*) as n, count_if(validation.is_valid and parsed_output is not null) as both, count_if(validation.is_valid and parsed_output is not null) * 1.0 / count(*) as accuracy from rs group by 1")
def a63(spark, d):
    ok = F.coalesce(F.col("validation.is_valid") & F.col("parsed_output").isNotNull(), F.lit(False))
    return results(spark, d).groupBy("model_name").agg(F.count("*").alias("n"), F.count_if(ok).alias("both"), (F.count_if(ok) / F.count("*")).alias("accuracy"))


@query("W01_share_of_group", " select model_name, status, count(*) as n, count(*) * 100.0 / sum(count(*)) over (partition by model_name) as pct from v group by model_name, status")
def w01(spark, d):
    return shares(votes(spark, d), ["model_name"], "status")


@query("W04_reciprocal_rank", " , k as (select model_name, game_id, target, count(*) as n from vv group by all), r as (select *, rank() over (partition by model_name, game_id order by n desc) as r from k) select model_name, avg(1.0 / r) as mrr from r group by 1".lstrip())
def w04(spark, d):
    k = valid_votes(spark, d).groupBy("model_name", "game_id", "target").agg(F.count("*").alias("n"))
    return k.withColumn("r", F.rank().over(W.partitionBy("model_name", "game_id").orderBy(F.desc("n")))).groupBy("model_name").agg(F.avg(1.0 / F.col("r")).alias("mrr"))


@query("W06_top_rows", " , k as (select model_name, game_id, count(*) as n from vv group by all) select model_name, game_id, n from k qualify row_number() over (partition by model_name order by n desc, game_id) <= 5".lstrip())
def w06(spark, d):
    k = valid_votes(spark, d).groupBy("model_name", "game_id").agg(F.count("*").alias("n"))
    return k.withColumn("k", F.row_number().over(W.partitionBy("model_name").orderBy(F.desc("n"), "game_id"))).where("k <= 5").drop("k")


@query("W07_positions", " select line_id, row_number() over (partition by game_id order by rec_id, line_id) as position from line")
def w07(spark, d):
    return positions(lines(spark, d), ["game_id"], ["rec_id", "line_id"]).select("line_id", F.col("position").cast("long").alias("position"))


@query("K01_sorted", " select source, game_no, num_players from g order by source, num_players desc, game_no")
def k01(spark, d):
    return games(spark, d).select("source", "game_no", "num_players").orderBy("source", F.desc("num_players"), "game_no")


@query("K03_category_order", " , o as (select unnest(['player_vote', 'circle_vote', 'invalid_vote', 'error_record']) as status, unnest([1, 2, 3, 4]) as sort_order) select status, coalesce(sort_order, 99) as sort_order, count(*) as n from v left join o using (status) group by all".lstrip())
def k03(spark, d):
    o = spark.createDataFrame([("player_vote", 1), ("circle_vote", 2), ("invalid_vote", 3), ("error_record", 4)], "status string, sort_order int")
    return votes(spark, d).groupBy("status").agg(F.count("*").alias("n")).join(F.broadcast(o), "status", "left").select("status", F.coalesce("sort_order", F.lit(99)).alias("sort_order"), "n").orderBy("sort_order")


@query("K04_longest_first", " , l as (select distinct unnest(labels) as label from line) select label, row_number() over (order by length(label) desc, label) as place from l".lstrip())
def k04(spark, d):
    l = lines(spark, d).select(F.explode("labels").alias("label")).distinct()
    return l.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc(F.length("label")), "label")).cast("long"))


@query("K06_stress_sample", f", {RS}, s as (select result_id, length(raw_response) // 100 + 5 * (not validation.is_valid)::int + len(coalesce(soft_warnings, [])) as stress_score from rs where raw_response is not null and validation.is_valid is not null) select * from s order by stress_score desc, result_id limit 30")
def k06(spark, d):
    r = results(spark, d).where("raw_response is not null and validation.is_valid is not null")
    parts = {"length": F.floor(F.length("raw_response") / 100), "invalid": 5 * (~F.col("validation.is_valid")).cast("int"), "warnings": F.size(F.coalesce("soft_warnings", F.array().cast("array<string>")))}
    return R.stress_sample(r, parts, "result_id", 30).select("result_id", "stress_score")


@query("U07_exact_records", " select record_id, count(*) as n_items, count(distinct to_json(x)) as n_distinct from (select record_id, unnest(items) as x from (select * from accusation_records qualify row_number() over (partition by record_id order by loaded_at) = 1)) where x is not null group by 1")
def u07(spark, d):
    x = records(spark, d).select("record_id", F.explode("items").alias("x")).where("x is not null")
    return x.groupBy("record_id").agg(F.count("*").alias("n_items"), F.countDistinct(F.to_json("x", {"ignoreNullFields": "false"})).alias("n_distinct"))


@query("U08_order_kept", " select line_id, labels from line")
def u08(spark, d):
    return lines(spark, d).select("line_id", "labels")


@query("F04_plain_quotes", " , t as (select * from v where justification is not null) select file_row_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(justification, '‘', ''''), '’', ''''), '“', '\"'), '”', '\"'), '–', '-'), '—', '-'), '…', '...'), '\\s+', ' ', 'g')) as text from t".lstrip())
def f04(spark, d):
    return texts(spark, d).select("file_row_id", X.plain_quotes(F.col("justification")).alias("text"))


@query("F05_renamed_ids", " , m as (select distinct message_id, content from messages where content is not null) select message_id, regexp_replace(regexp_replace(content, '\\bplayer1\\b', 'Ann', 'gi'), '\\bplayer2\\b', 'Bo', 'gi') as content from m".lstrip())
def f05(spark, d):
    m = table(spark, d, "messages").where("content is not null").select("message_id", "content").distinct()
    return m.select("message_id", X.renamed_ids(F.col("content"), {"player1": "Ann", "player2": "Bo"}).alias("content"))


@query("F07_word_roles", " select distinct dimension, array_to_string(list_transform(string_split(replace(dimension, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') as title from prelim_results where dimension is not null")
def f07(spark, d):
    return table(spark, d, "prelim_results").where("dimension is not null").select("dimension", K.word_role(F.replace("dimension", F.lit("_"), F.lit(" "))).alias("title")).distinct()


@query("F08_prompt_version", " select distinct result_path, 'v' || regexp_extract(regexp_extract(result_path, 'prompt_(v\\d+)', 1), '(\\d+)', 1) as version from v")
def f08(spark, d):
    return votes(spark, d).select("result_path", K.prompt_version(F.regexp_extract("result_path", r"prompt_(v\d+)", 1)).alias("version")).distinct()


@query("F13_phrase", " , t as (select * from v where justification is not null) select file_row_id, len(regexp_extract_all(justification, '(?i)\\bmy\\s+vote\\b'))::int as n from t".lstrip())
def f13(spark, d):
    return texts(spark, d).select("file_row_id", F.regexp_count("justification", F.lit(X.phrase_pattern("my vote"))).alias("n"))


@query("F16_rate", " , t as (select * from v where justification is not null) select model_name, greatest(sum(len(regexp_extract_all(justification, '(?i)\\bas\\b'))) - 1, 0)::bigint as n_as, sum(len(regexp_extract_all(justification, '(?i)\\bas\\b'))) * 100.0 / sum(greatest(len(string_split_regex(trim(justification), '\\s+')), 1)) as per_100 from t group by 1".lstrip())
def f16(spark, d):
    n = F.sum(X.word_hits(F.col("justification"), "as"))
    return texts(spark, d).groupBy("model_name").agg(F.greatest(n - 1, F.lit(0)).alias("n_as"), X.rate_per_100(n, F.sum(X.space_words(F.col("justification")))).alias("per_100"))


@query("F17_span_places", " , t as (select * from v where justification is not null and chosen_player_name is not null) select file_row_id, strpos(justification, chosen_player_name) - 1 as start, strpos(justification, chosen_player_name) - 1 + length(chosen_player_name) as end_ from t where strpos(justification, chosen_player_name) > 0".lstrip())
def f17(spark, d):
    s = X.span_at(F.col("justification"), F.col("chosen_player_name"))
    return texts(spark, d).withColumn("s", s).where("s is not null").select("file_row_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end_"))


@query("F18_verbatim", " , t as (select * from v where justification is not null and chosen_player_name is not null) select file_row_id, contains(justification, chosen_player_name) or contains(trim(regexp_replace(justification, '\\s+', ' ', 'g')), trim(regexp_replace(chosen_player_name, '\\s+', ' ', 'g'))) as found from t".lstrip())
def f18(spark, d):
    return texts(spark, d).where("chosen_player_name is not null").select("file_row_id", X.has_span(F.col("justification"), F.col("chosen_player_name")).alias("found"))


@query("F21_unmarked", " select line_id, contains(coalesce(utterance, ''), '[laughter]') as is_marked, trim(replace(coalesce(utterance, ''), '[laughter]', '')) as line from line")
def f21(spark, d):
    return lines(spark, d, text=True).select("line_id", TR.unmarked(F.coalesce("utterance", F.lit("")), "[laughter]").alias("u")).select("line_id", "u.is_marked", "u.line")


@query("F31_stopped", f", {RS} select result_id, regexp_replace(split_part(split_part(raw_response, '<|return|>', 1), '<|end|>', 1), '^\\s+|\\s+$', '', 'g') as text from rs where raw_response is not null")
def f31(spark, d):
    return results(spark, d).where("raw_response is not null").select("result_id", J.stopped(F.col("raw_response")).alias("text"))


@query("F33_first_block")
def f33(spark, d):
    return results(spark, d).where("raw_response is not null").select("result_id", J.json_block(F.col("raw_response")).alias("block"))


@query("F41_item_flags", " , r as (select record_id, items from accusation_records qualify row_number() over (partition by record_id order by loaded_at) = 1), i as (select record_id, i as item_no, items[i] as it from (select *, unnest(range(1, coalesce(len(items), 0) + 1)) as i from r) where items[i] is not null), x as (select *, coalesce(it.relations, []) as rel from i) select record_id, item_no::int as item_no, list_filter([case when it.line_number is null then 'missing_line_number' end, case when len(list_filter(rel, lambda y: y is null)) > 0 then 'null_relation' end, case when len(list_filter(rel, lambda y: y is not null and coalesce(y.type, '') not in ('werewolf', 'deception'))) > 0 then 'invalid_type' end, case when len(list_filter(rel, lambda y: y is not null and len(coalesce(y.accused, [])) = 0)) > 0 then 'empty_accused' end, case when len(list_filter(rel, lambda y: y is not null and list_contains(coalesce(y.accused, []), 'UNKNOWN') and len(y.accused) > 1)) > 0 then 'unknown_beside_names' end, case when coalesce(it.requires_review, false) <> (len(list_filter(rel, lambda y: y is not null and list_contains(coalesce(y.accused, []), 'UNKNOWN'))) > 0) then 'review_mark_inconsistent' end], lambda y: y is not null) as flags from x".lstrip())
def f41(spark, d):
    x = records(spark, d).select("record_id", F.posexplode("items").alias("i", "it")).where("it is not null")
    return x.select("record_id", (F.col("i") + 1).alias("item_no"), R.item_flags(F.col("it"), ["werewolf", "deception"]).alias("flags"))


def _annotations():
    """Annotations of one text with one defect each (or none), and the flags they must get."""
    a = lambda c="Claim", u="support", e="Ann lied", o=None: {"category": c, "use": u, "evidence_span": e, "other_description": o}
    s1 = lambda n=None, **k: {"sentence_id": 1, "text": "Ann lied.", "rule_mentioned": False, "annotations": [a()] if n is None else n} | k
    s2 = lambda **k: {"sentence_id": 2, "text": "I  vote for Ann.", "rule_mentioned": True, "annotations": []} | k
    whole = lambda *s, vote="Ann": {"vote": vote, "sentences": list(s)}
    return [
        (whole(s1(), s2()), ""), (None, "not_an_object"), (whole(s1(), s2(), vote="Bob"), "vote_not_preserved"), (whole(s1(), s2(), vote=" Ann "), ""), ({"vote": "Ann", "sentences": None}, "sentences_not_a_list"),
        (whole(s1(), s2(), None), "sentence_not_an_object"), (whole(s1()), "missing_sentence:2"), (whole(s1(), s2(), s2(sentence_id=7)), "unknown_sentence:7"), (whole(s1(), s2(), s2()), "repeated_sentence:2"),
        (whole(s1(), s2(text="I vote for Bob.")), "altered_text:2"), (whole(s1(), s2(text="I vote for Ann. ")), ""), (whole(s1(rule_mentioned=None), s2()), "rule_mentioned_not_boolean:1"), (whole(s1(annotations=None), s2()), "annotations_not_a_list:1"),
        (whole(s1([a(), None]), s2()), "annotation_not_an_object:1"), (whole(s1([a(c="Guess")]), s2()), "invalid_category:1"), (whole(s1([a(u=None)]), s2()), "invalid_use:1"), (whole(s1([a(e=" ")]), s2()), "missing_span:1"),
        (whole(s1(), s2(annotations=[a(e="I vote")])), "span_but_for_spacing:2"), (whole(s1([a(e="Ann told lies")]), s2()), "span_not_verbatim:1"), (whole(s1([a(c="Other")]), s2()), "other_without_description:1"), (whole(s1([a(c="Other", o="tone")]), s2()), ""),
        (whole(s1([a(o="tone")]), s2()), "description_without_other:1"), (whole(s1([a(), a()]), s2()), "repeated_annotation:1"), (whole(s1([a(), a(u="rebut")]), s2()), ""), (whole(s1([a(c="Guess", e="x")]), s2(text="?")), "altered_text:2,invalid_category:1,span_not_verbatim:1"),
    ]


@query("F42_sentence_flags", "")
def f42(spark, d):
    """The flags of annotations with one defect each: a fixture, as the tables hold no annotations."""
    import json

    rows = spark.createDataFrame([(i, json.dumps(x) if x else None) for i, (x, _) in enumerate(_annotations())], "case_no int, doc string")
    given = F.array(F.struct(F.lit(1).alias("sentence_id"), F.lit("Ann lied.").alias("text")), F.struct(F.lit(2).alias("sentence_id"), F.lit("I  vote for Ann.").alias("text")))
    got = F.from_json("doc", "vote string, sentences " + R.ANNOTATED.split("sentences:", 1)[1][:-1])
    x = rows.withColumn("got", F.when(F.col("doc").isNotNull(), got))
    return x.select("case_no", F.array_join(R.sentence_flags(given, F.lit("Ann"), F.col("got"), ["Claim"], ["support", "rebut"]), ",").alias("flags"))


SQL["F42_sentence_flags"] = "select * from (values " + ", ".join(f"({i}, '{f}')" for i, (_, f) in enumerate(_annotations())) + ") t(case_no, flags)"


@query("F56_label_columns", " select distinct label, trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') as column_name from (select unnest(labels) as label from line)")
def f56(spark, d):
    """Labels as safe column suffixes."""
    name = F.regexp_replace(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return lines(spark, d).select(F.explode("labels").alias("label")).distinct().select("label", name.alias("column_name"))


@query("F64_iso_timestamps", " select file_row_id, strftime(loaded_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as loaded_at_iso from (select file_row_id, min(loaded_at) as loaded_at from vote_file_level group by 1) where loaded_at is not null")
def f64(spark, d):
    """Timestamps as UTC ISO text with microseconds."""
    x = table(spark, d, "vote_file_level").groupBy("file_row_id").agg(F.min("loaded_at").alias("t")).where("t is not null")
    return x.select("file_row_id", F.concat(F.date_format(F.col("t").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("loaded_at_iso"))


@query("F50_normalised_labels", " select labels, count(*) as n from line group by 1")
def f50(spark, d):
    return lines(spark, d).groupBy("labels").agg(F.count("*").alias("n"))


@query("F51_slots", " select game_no, slot, player, start_role, end_role, start_role is distinct from end_role as changed from slot")
def f51(spark, d):
    return slots(spark, d).select("game_no", F.col("slot").cast("long").alias("slot"), "player", "start_role", "end_role", (~F.col("start_role").eqNullSafe(F.col("end_role"))).alias("changed"))


@query("F62_clipped", " select game_no, case when num_turns is not null then least(greatest(num_turns::double, 40.0), 90.0) end as turns, ln(num_turns) as ln_turns, sqrt(abs(num_turns - 60)) as root from g where num_turns is null or num_turns > 0")
def f62(spark, d):
    n = F.col("num_turns")
    return games(spark, d).where("num_turns is null or num_turns > 0").select("game_no", M.clipped(n.cast("double"), 40.0, 90.0).alias("turns"), F.ln(n).alias("ln_turns"), F.sqrt(F.abs(n - 60)).alias("root"))


@query("X12_predictability", " , ac as (select game_id, a as accused, count(*) as n from (select game_id, unnest(re.accused) as a from (select game_id, unnest(it.relations) as re from (select game_id, unnest(items) as it from (select * from accusation_records qualify row_number() over (partition by record_id order by loaded_at) = 1)) where it is not null) where re is not null) where a is not null and regexp_matches(a, '\\S') and a <> 'UNKNOWN' group by all), m as (select game_id, accused from ac qualify row_number() over (partition by game_id order by n desc, accused) = 1) select model_name, count(*) as n, avg((target = accused)::int) as proxy_hit_rate from vv join m using (game_id) group by 1".lstrip())
def x12(spark, d):
    from palaver.operators.events import most_accused
    from palaver.plans.event_queries import accusations

    n = accusations(spark, d).where("accused <> 'UNKNOWN'").groupBy("game_id", F.col("accused").alias("player")).agg(F.count("*").alias("n"))
    m = most_accused(n, ["game_id"], "player", "n").select("game_id", "player")
    return valid_votes(spark, d).join(m, "game_id").groupBy("model_name").agg(F.count("*").alias("n"), F.avg((F.col("target") == F.col("player")).cast("int")).alias("proxy_hit_rate"))


@query("X21_review_sheet", " select line_id, labels as annotation, true as is_labelled from line where labels <> ['No Strategy'] union all select line_id, null, false from line where labels = ['No Strategy']")
def x21(spark, d):
    x = cut(lines(spark, d).select("line_id", F.col("labels").alias("annotation")))
    return R.review_sheet(x, x.where(~F.array_contains("annotation", "No Strategy")), ["line_id"], ["annotation"])


@query("H05_interval_table", f", {GA}, {_R}, x as (select model_name, rep, {_w('model_name || ' + chr(39) + '|' + chr(39) + ' || game_id')} as w, p from ga cross join reps), dr as (select model_name, rep, sum(w * p) / sum(w) as m from x where w > 0 group by all), pr as (select a.model_name as a, b.model_name as b, a.m - b.m as v from dr a join dr b on a.rep = b.rep and a.model_name < b.model_name), pt as (select model_name, avg(p) as m from ga group by 1) select a, b, (select m from pt where model_name = a) - (select m from pt where model_name = b) as difference, quantile_cont(v, 0.025) as lo, quantile_cont(v, 0.975) as hi from pr group by a, b")
def h05(spark, d):
    ga = cut(game_accuracy(spark, d).withColumn("k", F.concat_ws("|", "model_name", "game_id")))
    dr = B.replicate_sums(ga, "k", ["p"], REPS, ["model_name"]).select("model_name", "rep", (F.col("p") / F.col("w")).alias("m"))
    pr = dr.select("rep", F.col("model_name").alias("a"), F.col("m").alias("ma")).join(dr.select("rep", F.col("model_name").alias("b"), F.col("m").alias("mb")), "rep").where("a < b")
    pt = ga.groupBy("model_name").agg(F.avg("p").alias("m"))
    ci = B.interval(pr, F.col("ma") - F.col("mb"), ["a", "b"])
    return ci.join(pt.select(F.col("model_name").alias("a"), F.col("m").alias("x")), "a").join(pt.select(F.col("model_name").alias("b"), F.col("m").alias("y")), "b").select("a", "b", (F.col("x") - F.col("y")).alias("difference"), "lo", "hi")


@query("S12_processed_lines", " select game_id, count(*) as n_turns from line group by 1")
def s12(spark, d):
    one = F.concat(F.lit("["), F.col("rec_id"), F.lit("] "), F.coalesce("player", F.lit("?")), F.lit(": "), F.coalesce("utterance", F.lit("")))
    t = lines(spark, d, text=True).select("game_id", TR.processed_turn(one).alias("t"))
    return t.where("t is not null").groupBy("game_id").agg(F.count("*").alias("n_turns"))


@query("S10_headers", " select game_no, g.source as source, trim(split_part(game_id, ' / ', 2)) as session, game_key as game, player_names as players from g where player_names is not null and len(player_names) > 0")
def s10(spark, d):
    head = F.concat_ws("\n", F.concat(F.lit("Source: "), "source"), F.concat(F.lit("Session: "), K.game_parts(F.col("game_id"))["session"]), F.concat(F.lit("Game: "), "game_key"), F.concat(F.lit("Players: "), F.array_join("player_names", ", ")), F.lit("\nTranscript:"))
    return games(spark, d).where("size(player_names) > 0").select("game_no", TR.header(head).alias("h")).select("game_no", "h.*")
