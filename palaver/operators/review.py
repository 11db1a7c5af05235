"""Annotation checks, review sheets and stress samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_flags(item: Column, kinds: list[str], unknown: str = "UNKNOWN") -> Column:
    """The flags of an annotated item in their order (F41): no line, bad kind, empty or mixed targets,
    and a review mark that does not fit."""
    rel = F.coalesce(item["relations"], F.array().cast("array<struct<type:string,accused:array<string>,evidence:string>>"))
    acc = lambda r: F.coalesce(r["accused"], F.array().cast("array<string>"))
    is_unknown = lambda r: F.exists(acc(r), lambda a: a.eqNullSafe(unknown))
    flags = F.array(
        F.when(item["line_number"].isNull(), "missing_line_number"), F.when(F.exists(rel, lambda r: r.isNull()), "null_relation"),
        F.when(F.exists(rel, lambda r: r.isNotNull() & ~F.coalesce(r["type"].isin(*kinds), F.lit(False))), "invalid_type"),
        F.when(F.exists(rel, lambda r: r.isNotNull() & (F.size(acc(r)) == 0)), "empty_accused"),
        F.when(F.exists(rel, lambda r: r.isNotNull() & is_unknown(r) & (F.size(acc(r)) > 1)), "unknown_beside_names"),
        F.when(F.coalesce(item["requires_review"], F.lit(False)) != F.exists(rel, lambda r: r.isNotNull() & is_unknown(r)), "review_mark_inconsistent"),
    )
    return F.filter(flags, lambda f: f.isNotNull())


ANNOTATED = (
    "struct<vote:string,sentences:array<struct<sentence_id:int,text:string,rule_mentioned:boolean,"
    "annotations:array<struct<category:string,use:string,evidence_span:string,other_description:string>>>>>"
)


def sentence_flags(sentences: Column, vote: Column, got: Column, categories: list[str], uses: list[str], other: str = "Other") -> Column:
    """The flags of a sentence annotation (F42), sorted, each ``<check>`` or ``<check>:<sentence id>``.

    ``sentences`` are the (sentence_id, text) that were given, ``vote`` the vote to be kept, ``got``
    the annotation as :data:`ANNOTATED`. Checked are the object, the vote, the list of sentences,
    null sentences, ids that are missing, unknown or repeated, altered text, the rule mark, the list
    of annotations, categories, uses, spans that are missing, not verbatim or so but for spacing,
    ``other`` without or others with a description, and repeated annotations. Spacing never counts
    where texts are compared.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    given = F.transform(sentences, lambda s: s["sentence_id"])
    back = F.filter(F.coalesce(got["sentences"], F.array().cast("array<struct<sentence_id:int,text:string,rule_mentioned:boolean,annotations:array<struct<category:string,use:string,evidence_span:string,other_description:string>>>>")), lambda s: s.isNotNull())
    ids = F.filter(F.transform(back, lambda s: s["sentence_id"]), lambda i: i.isNotNull())
    tag = lambda name, i: F.concat(F.lit(f"{name}:"), F.coalesce(i.cast("string"), F.lit("?")))

    def notes(s: Column, text: Column) -> Column:
        seen = F.filter(F.coalesce(s["annotations"], F.array().cast("array<struct<category:string,use:string,evidence_span:string,other_description:string>>")), lambda a: a.isNotNull())
        key = lambda a: F.struct(a["category"], a["use"], a["evidence_span"])
        some = lambda test: F.exists(seen, test)
        inside = lambda a: F.coalesce(F.contains(text, a["evidence_span"]), F.lit(False))
        loosely = lambda a: F.coalesce(F.contains(flat(text), flat(a["evidence_span"])), F.lit(False))
        told = text.isNotNull()
        return F.array(
            F.when(s["annotations"].isNull(), "annotations_not_a_list"), F.when(F.exists(s["annotations"], lambda a: a.isNull()), "annotation_not_an_object"),
            F.when(some(lambda a: ~F.coalesce(a["category"].isin(*categories, other), F.lit(False))), "invalid_category"), F.when(some(lambda a: ~F.coalesce(a["use"].isin(*uses), F.lit(False))), "invalid_use"),
            F.when(some(lambda a: blank(a["evidence_span"])), "missing_span"), F.when(told & some(lambda a: ~blank(a["evidence_span"]) & ~inside(a) & loosely(a)), "span_but_for_spacing"),
            F.when(told & some(lambda a: ~blank(a["evidence_span"]) & ~inside(a) & ~loosely(a)), "span_not_verbatim"),
            F.when(some(lambda a: a["category"].eqNullSafe(other) & (F.coalesce(a["other_description"], F.lit("")) == "")), "other_without_description"),
            F.when(some(lambda a: ~a["category"].eqNullSafe(other) & (F.coalesce(a["other_description"], F.lit("")) != "")), "description_without_other"),
            F.when(F.size(F.array_distinct(F.transform(seen, key))) < F.size(seen), "repeated_annotation"),
        )

    def of(s: Column) -> Column:
        text = F.get(F.transform(F.filter(sentences, lambda g: g["sentence_id"] == s["sentence_id"]), lambda g: g["text"]), 0)
        known = F.array_contains(given, s["sentence_id"])
        own = F.array(F.when(F.coalesce(known, F.lit(False)) & (flat(s["text"]) != flat(text)), "altered_text"), F.when(s["rule_mentioned"].isNull(), "rule_mentioned_not_boolean"))
        return F.transform(F.filter(F.concat(own, notes(s, text)), lambda f: f.isNotNull()), lambda f: F.concat(f, F.lit(":"), F.coalesce(s["sentence_id"].cast("string"), F.lit("?"))))

    whole = F.filter(F.array(
        F.when(got.isNull(), "not_an_object"), F.when(got.isNotNull() & (flat(got["vote"]) != flat(vote)), "vote_not_preserved"), F.when(got.isNotNull() & got["sentences"].isNull(), "sentences_not_a_list"),
        F.when(F.exists(got["sentences"], lambda s: s.isNull()), "sentence_not_an_object"),
    ), lambda f: f.isNotNull())
    sets = F.concat(
        F.transform(F.array_except(given, ids), lambda i: tag("missing_sentence", i)), F.transform(F.array_except(ids, given), lambda i: tag("unknown_sentence", i)),
        F.transform(F.filter(F.array_distinct(ids), lambda i: F.size(F.filter(ids, lambda j: j == i)) > 1), lambda i: tag("repeated_sentence", i)),
    )
    checked = F.when(got.isNotNull() & got["sentences"].isNotNull(), F.concat(sets, F.flatten(F.transform(back, of)))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(whole, checked)))


def review_sheet(items: DataFrame, labelled: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """All annotations, and every item without one (X21): ``is_labelled`` tells them apart."""
    some = labelled.select(*keys, *columns).withColumn("is_labelled", F.lit(True))
    none = items.select(*keys).join(labelled, keys, "left_anti").withColumn("is_labelled", F.lit(False))
    return some.unionByName(none, allowMissingColumns=True)


def stress_sample(df: DataFrame, parts: dict[str, Column], row_id: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest sum of scores, ties by id."""
    score = sum((F.coalesce(c, F.lit(0)) for c in parts.values()), F.lit(0))
    return df.withColumn("stress_score", score).orderBy(F.desc("stress_score"), row_id).limit(n)
