"""Parsing, validation and repair of model output."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Generation stops, and the label of a vote for nobody.
STOPS = ("<|return|>", "<|end|>")
CIRCLE = "No Werewolf"
# Spellings of that label.
CIRCLE_SPELLINGS = ("no werewolf", "no werewolves", "no one", "nobody", "none", "circle", "circle vote", "middle", "no vote", "no-werewolf", "no_werewolf")


def unfenced(x: Column) -> Column:
    """Without a leading code fence line and its closing line."""
    t = F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?```[^\n]*$", "")
    return F.when(t.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(t)


def stopped(x: Column) -> Column:
    """The text before the first stop token."""
    for s in STOPS:
        x = F.substring_index(x, s, 1)
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def first_object(text: str | None) -> str | None:
    """The first stretch of ``text`` that a JSON parser reads as an object; None without one."""
    parser, at = json.JSONDecoder(), -1
    while isinstance(text, str) and (at := text.find("{", at + 1)) >= 0:
        try:
            return text[at : parser.raw_decode(text, at)[1]]
        except (ValueError, RecursionError):
            pass
    return None


def brace_span(text: str) -> str | None:
    """From the first opening brace to the one with which closing braces draw level, quotes or not."""
    level, begin = 0, text.find("{")
    for m in re.finditer("[{}]", text[begin:]) if begin >= 0 else ():
        level += 1 if m[0] == "{" else -1
        if not level:
            return text[begin : begin + m.end()]
    return None


def fenced_object(text: str) -> str | None:
    """The content of the first code fence that is one braced block, fences tagged json before others."""
    inside = [re.fullmatch(r"(\w*)\s*(.*?)\s*", part, re.S) for part in text.split("```")[1:-1:2]]
    blocks = [(m[1].lower(), m[2]) for m in inside if m and m[2].startswith("{") and m[2].endswith("}")]
    return next((b for tag in ("json", "") for t, b in blocks if t == tag), None)


@F.pandas_udf(T.StringType())
def balanced_object(x: pd.Series) -> pd.Series:
    """The first object in a text that parses, whatever braces its strings hold (F32)."""
    return x.map(first_object).astype(object)


@F.pandas_udf(T.StringType())
def json_block(x: pd.Series) -> pd.Series:
    """The object in a code fence, else the first one by braces alone; it need not parse."""
    return x.map(lambda t: (fenced_object(t) or brace_span(t)) if isinstance(t, str) else None).astype(object)


def prepared(raw: Column) -> Column:
    """A response without fence, stops and surrounding talk: its object if there is one (F32)."""
    t = stopped(unfenced(raw))
    return F.coalesce(balanced_object(t), t)


def _is_text(x: Column) -> Column:
    return F.coalesce(F.trim(x) != "", F.lit(False))


def vote_errors(obj: Column, justification: Column, vote: Column, roster: Column) -> Column:
    """The errors of a vote in their order (F34); ``obj`` is whether the output parsed."""
    v = F.trim(vote)
    allowed = F.array_contains(F.array_union(F.coalesce(roster, F.array().cast("array<string>")), F.array(F.lit(CIRCLE))), v)
    errs = F.array(
        F.when(justification.isNull(), "missing_justification"), F.when(vote.isNull(), "missing_chosen_vote"),
        F.when(~_is_text(justification), "justification_not_nonempty_string"),
        F.when(~_is_text(vote), "chosen_vote_not_nonempty_string").when(~F.coalesce(allowed, F.lit(False)), F.concat(F.lit("chosen_vote_not_in_player_list_or_circle_vote:"), v)),
    )
    return F.when(obj, F.filter(errs, lambda e: e.isNotNull())).otherwise(F.array(F.lit("no_parseable_json")))


def answer_errors(obj: Column, justification: Column, answer: Column) -> Column:
    """The errors of a preliminary answer in their order."""
    errs = F.array(
        F.when(justification.isNull(), "missing_justification"), F.when(answer.isNull(), "missing_answer"),
        F.when(~_is_text(justification), "justification_not_nonempty_string"), F.when(~_is_text(answer), "answer_not_nonempty_string"),
    )
    return F.when(obj, F.filter(errs, lambda e: e.isNotNull())).otherwise(F.array(F.lit("no_parseable_json")))


def legacy_answer(doc: Column) -> Column:
    """``answer`` of a JSON text, else the legacy ``final_answer``."""
    return F.coalesce(F.get_json_object(doc, "$.answer"), F.get_json_object(doc, "$.final_answer"))


def soft_warnings(raw: Column, used: Column, tokens: Column, cap: Column, n_sentences: Column, keys: Column, expected: list[str], low: int = 3, high: int = 5) -> Column:
    """Warnings that do not make an output invalid, in their order."""
    extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in expected])))
    w = F.array(
        F.when(raw.contains("```"), "response_contains_code_fence"), F.when(F.trim(used) != F.trim(raw), "response_was_cleaned_before_parsing"),
        F.when(tokens >= cap, "output_token_count_hit_max_new_tokens"),
        F.when(n_sentences < low, f"justification_may_be_shorter_than_{low}_sentences"), F.when(n_sentences > high, f"justification_may_exceed_{high}_sentences"),
        F.when(F.size(extra) > 0, F.concat(F.lit("response_contains_unexpected_fields:"), F.array_join(extra, ","))),
    )
    return F.filter(w, lambda x: x.isNotNull())


def repair_state(valid: Column, error: Column, obj: Column, errors: Column) -> Column:
    """already_valid, error_record, needs_rerun, repaired_valid or invalid_schema."""
    return (
        F.when(error.isNotNull(), "error_record").when(F.coalesce(valid, F.lit(False)), "already_valid").when(~obj, "needs_rerun")
        .when(F.size(errors) == 0, "repaired_valid").otherwise("invalid_schema")
    )


def channels(x: Column) -> Column:
    """(thoughts, visible) of a text with reasoning marks of either grammar."""
    a, b = r"(?s)<\|channel\|>analysis<\|message\|>(.*?)<\|", r"(?s)<think>(.*?)</think>"
    fin = F.regexp_extract(x, r"(?s)<\|(?:channel\|>)?final(?:<\|message)?\|>(.*)$", 1)
    thoughts = F.when(F.regexp_extract(x, a, 1) != "", F.regexp_extract(x, a, 1)).otherwise(F.regexp_extract(x, b, 1))
    return F.struct(F.nullif(F.trim(thoughts), F.lit("")).alias("thoughts"), F.trim(F.when(fin != "", fin).otherwise(F.regexp_replace(x, b, ""))).alias("visible"))


def roster_name(vote: Column, roster: Column) -> Column:
    """The roster's spelling of a vote: exact, else without regard to case; null if neither."""
    v = F.trim(vote)
    same = F.filter(roster, lambda n: F.lower(F.trim(n)) == F.lower(v))
    return F.when(F.array_contains(roster, v), v).otherwise(F.get(same, 0))


def is_circle(vote: Column) -> Column:
    """Whether a vote is exactly the label for nobody."""
    return F.coalesce(F.trim(vote) == CIRCLE, F.lit(False))


def is_circle_spelling(vote: Column) -> Column:
    """Whether a vote is any spelling of the label for nobody."""
    return F.coalesce(F.lower(F.trim(vote)).isin(*CIRCLE_SPELLINGS), F.lit(False))


def same_map(a: Column, b: Column) -> Column:
    """Whether two JSON objects of texts have the same entries (F44); null if one does not parse."""
    e = lambda x: F.array_sort(F.map_entries(F.from_json(x, "map<string,string>")))
    return e(a) == e(b)


def completion(names: Column, values: Column) -> Column:
    """A JSON object of parallel arrays."""
    return F.to_json(F.map_from_arrays(names, values))


def chosen_vote(validated: Column, parsed: Column) -> Column:
    """The validated vote, else the parsed one; blank counts as none."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(clean(validated), clean(parsed))
