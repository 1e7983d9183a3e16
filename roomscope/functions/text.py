"""Labels, classes, question texts and model output as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases and the category that the first of them gives a question; zones' endings.
CATEGORIES = [
    (r"^how many\b", "counting"), (r"\bnear\b", "proximity"), (r"\b(left|right|above|below)\b", "relative_position"), (r"\b(in front of|behind)\b", "relative_position"),
    (r"\bon the .*\bwall\b", "zone"), (r"^where (is|are)\b", "zone"),
]
ZONE_PARTS = ("_wall", "_floor", "_zone", "_ceiling")
ALWAYS_3D = ("zone", "multi_instance", "out_of_view", "counting", "negative")


def class_norm(label: Column) -> Column:
    """A label's class family: lower case, hyphens for blanks and underscores, no number at the end."""
    x = F.regexp_replace(F.lower(F.trim(label)), r"\s+", " ")
    x = F.regexp_replace(F.regexp_replace(x, "_", "-"), r"[-\s]+[0-9]+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, " ", "-"), "-+", "-"), "^-|-$", "")


def class_candidates(hypotheses: Column, display: Column, aliases: Column) -> Column:
    """Class families of hypotheses, display label and aliases, in this order, each once; empty ones left out."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.concat(F.coalesce(hypotheses, none), F.array(display), F.coalesce(aliases, none)), class_norm), lambda x: x != ""))


def first_allowed(candidates: Column, allowed: list[str]) -> Column:
    return F.get(F.filter(candidates, lambda x: x.isin(*allowed)), F.lit(0))


def answer_type(expected: Column, zones: list[str], labels: list[str]) -> Column:
    """label, zone, both or unknown for an array of expectations (normalised): one type if all agree, else both."""
    is_zone = lambda e: e.isin(*zones)
    like = lambda e: F.exists(F.array(*[F.lit(x) for x in labels]), lambda x: (x == e) | ((F.contains(x, e) | F.contains(e, x)) & (F.least(F.length(x), F.length(e)) >= 4)))
    kinds = F.array_distinct(F.transform(expected, lambda e: F.when(is_zone(e) & like(e), "both").when(is_zone(e), "zone").when(like(e), "label").otherwise("unknown")))
    return F.when(F.size(kinds) == 1, kinds[0]).otherwise("both")


def strict_match(kind: Column, zone: Column, label: Column, expected: Column) -> Column:
    return F.when(kind == "zone", zone == expected).when(kind == "label", label == expected).when(kind == "both", (zone == expected) | (label == expected)).otherwise(F.lit(False))


def category(text: Column, expected: Column) -> Column:
    by_phrase = F.coalesce(*[F.when(F.lower(text).rlike(r), c) for r, c in CATEGORIES], F.lit("relative_position"))
    return F.when(F.size(expected) == 0, "negative").otherwise(by_phrase)


def expected_type(expected: Column) -> Column:
    zone = F.exists(expected, lambda e: F.lit(False) if not ZONE_PARTS else e.rlike("|".join(ZONE_PARTS)))
    return F.when(F.size(expected) == 0, "none").when(zone, "location").when(F.size(expected) > 1, "entity_list").otherwise("entity")


def ambiguity(expected: Column, kind: Column) -> Column:
    return F.when(F.size(expected) == 0, "none").when(kind.isin("entity", "location") & (F.size(expected) == 1), "one_of").otherwise("all_of")


def needs_3d(kind: Column, expected: Column) -> Column:
    return kind.isin(*ALWAYS_3D) | (F.size(expected) > 1)


def bare_json(text: Column) -> Column:
    """Model output without the fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def json_fault(text: Column, required: list[str], intents: list[str], relations: list[str]) -> Column:
    """Why a model's output is no parse (null: it is one): not JSON, no object, missing or unknown keys, an intent or relation that isn't allowed."""
    bare = bare_json(text)
    keys = F.json_object_keys(bare)
    relation = F.get_json_object(bare, "$.spatial_relation")
    return (
        F.when(F.try_parse_json(bare).isNull(), "invalid JSON").when(F.schema_of_variant(F.try_parse_json(bare)).rlike("^OBJECT") == F.lit(False), "JSON root not an object")
        .when(F.size(F.array_except(F.array(*[F.lit(k) for k in required]), keys)) > 0, "missing keys").when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in required]))) > 0, "unknown keys")
        .when(~F.coalesce(F.get_json_object(bare, "$.intent"), F.lit("")).isin(*intents), "invalid intent").when(relation.isNotNull() & ~relation.isin(*relations), "invalid spatial_relation")
    )
