"""Features of structured profiles: births, places, passports, aliases, identifiers. A missing array reads as empty."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from knotwork.functions.names import fold, name_tokens, phonetic, token_pairs

PROFILE = (
    "struct<data:struct<names:array<struct<name:string,name_type:string>>,births:array<struct<min_date:string,max_date:string>>,"
    "locations:array<struct<original_name:string,country_code:string,country:string>>,passports:array<struct<passport:string>>,"
    "nationalities:array<struct<country_code:string>>,aml_types:array<struct<aml_type:string>>,display_fields:array<struct<title:string,value:string>>,"
    "occupations:array<struct<occupation:string>>,addresses:array<struct<original_address:string,value:string,name:string,country:string>>,"
    "entity_types:array<struct<entity_type:string>>>,meta:struct<source_entity_ids:array<string>>>"
)


def parsed(raw: Column) -> Column:
    return F.from_json(raw, PROFILE)


def each(arr: Column, field: str) -> Column:
    """Distinct non-null values of one field of an array of structs, sorted."""
    vals = F.coalesce(F.transform(arr, lambda x: x[field]), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(vals, lambda v: v.isNotNull())))


def alias_features(names: Column) -> dict[str, Column]:
    alias = each(names, "name")
    toks = F.transform(alias, name_tokens)
    many = lambda c: F.array_sort(F.array_distinct(c))
    return {
        "alias": alias, "alias_keyword": many(F.transform(toks, lambda t: F.array_join(t, "+"))), "alias_phonetic": many(F.transform(toks, lambda t: F.array_join(phonetic(t), "+"))),
        "alias_bigrams": many(F.flatten(F.transform(toks, token_pairs))), "alias_phonetic_bigrams": many(F.flatten(F.transform(toks, lambda t: token_pairs(phonetic(t))))),
    }


def primary_features(names: Column) -> dict[str, Column]:
    primary = each(F.filter(names, lambda n: n["name_type"] == "primary"), "name")
    return {"primary": primary, "primary_keyword": F.transform(primary, lambda n: F.array_join(name_tokens(n), "+"))}


def years_of_birth(births: Column) -> Column:
    """Every year from the earliest to the latest first date; dates whose year is not a number do not count."""
    first = F.filter(F.transform(births, lambda b: F.substring(b["min_date"], 1, 4)), lambda y: F.regexp_like(y, F.lit("^[0-9]+$")))
    years = F.transform(first, lambda y: y.cast("int"))
    return F.when(F.size(years) > 0, F.sequence(F.array_min(years), F.array_max(years))).otherwise(F.array().cast("array<int>"))


def known_years(births: Column) -> Column:
    """Years that are stated: both ends if each is the first of January, else the first date's year."""
    both = F.filter(births, lambda b: b["min_date"].isNotNull() & b["max_date"].isNotNull())
    new_year = lambda d: F.substring(d, 6, 5) == "01-01"
    of = lambda b: F.when(new_year(b["min_date"]) & new_year(b["max_date"]), F.array(F.substring(b["min_date"], 1, 4), F.substring(b["max_date"], 1, 4))).otherwise(F.array(F.substring(b["min_date"], 1, 4)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(both, of))))


def birth_days(births: Column) -> Column:
    return each(F.filter(births, lambda b: b["min_date"] == b["max_date"]), "min_date")


def country_codes(locations: Column) -> Column:
    """Codes of all locations; nothing if any location is called International."""
    world = F.coalesce(F.exists(locations, lambda x: x["original_name"] == "International"), F.lit(False))
    return F.when(world, F.array().cast("array<string>")).otherwise(each(locations, "country_code"))


def passport_ids(passports: Column) -> Column:
    """Per passport its alphanumeric tokens of five or more characters with a digit, sorted, joined by ``+``, lower case."""
    def of(p: Column) -> Column:
        toks = F.filter(F.split(F.regexp_replace(F.lower(p["passport"]), "[^a-z0-9]+", " "), " +"), lambda t: (F.length(t) > 4) & F.regexp_like(t, F.lit("[0-9]")))
        return F.array_join(F.array_sort(toks), "+")

    return F.array_sort(F.array_distinct(F.filter(F.transform(passports, of), lambda s: s != "")))


def display(fields: Column, titles: list[str]) -> Column:
    """Values of display fields with an allowed title, in order, joined by dots."""
    want = F.array(*map(F.lit, titles))
    return F.array_join(F.transform(F.filter(fields, lambda f: F.array_contains(want, f["title"])), lambda f: f["value"]), ".")


def display_terms(fields: Column, titles: list[str], most: int = 2000) -> dict[str, Column]:
    """Value of each listed title (in upper snake case), cut at ``most`` characters."""
    snake = lambda t: F.upper(F.regexp_replace(F.trim(t), r"\s+", "_"))

    def of(title: str) -> Column:
        return F.transform(F.filter(fields, lambda f: snake(f["title"]) == title), lambda f: F.substring(f["value"], 1, most))

    return {t: of(t) for t in titles}


def full_text(fields: Column, occupations: Column) -> Column:
    vals = F.concat(F.coalesce(F.transform(fields, lambda f: f["value"]), F.array().cast("array<string>")), F.coalesce(F.transform(occupations, lambda o: o["occupation"]), F.array().cast("array<string>")))
    return F.array_join(F.transform(F.filter(vals, lambda v: v.isNotNull()), lambda v: F.concat(v, F.lit("."))), " ")


def organisation_ids(fields: Column) -> Column:
    """Registration numbers: tokens of five or more characters, digits from the third on, not ending in 1001."""
    vals = F.transform(F.filter(fields, lambda f: f["title"] == "Registration Number"), lambda f: F.split(F.trim(f["value"]), r"[\s,;]+"))
    ok = lambda t: (F.length(t) >= 5) & F.regexp_like(t, F.lit("^..[0-9]+$")) & ~t.endswith("1001")
    return F.array_sort(F.array_distinct(F.filter(F.flatten(vals), ok)))


def designation_years(fields: Column) -> Column:
    vals = F.transform(F.filter(fields, lambda f: f["title"] == "Designation Date"), lambda f: F.regexp_extract_all(f["value"], F.lit(r"\b([0-9]{4})\b"), F.lit(1)))
    return F.array_sort(F.array_distinct(F.flatten(vals)))


ORGANISATION_STOP = frozenset("the of and for in company limited ltd llc inc corp corporation co group".split())


def organisation_alias(name: str) -> list[str]:
    """Aliases of an organisation's name: what brackets hold, parts around "a.k.a.", tokens sorted and joined by ``+``."""
    out: list[str] = []
    inner = re.search(r"\(([^()]*)\)", name)
    if inner:
        return sorted({*organisation_alias(inner[1]), *organisation_alias((name[: inner.start()] + " " + name[inner.end() :]).strip())})
    for part in re.split(r"a\.k\.a\.?", name, flags=re.I):
        words = re.sub(r"[^\w&]+", " ", part.lower().replace("&", " and ")).split()
        kept = sorted(w for w in words if w not in ORGANISATION_STOP and (w.isdigit() or len(w) > 2))
        if kept:
            out.append("+".join(kept))
    return sorted(set(out))


@pandas_udf(T.ArrayType(T.StringType()))
def organisation_aliases(s: pd.Series) -> pd.Series:
    return s.map(lambda x: organisation_alias(x) if x else [])


ADDRESS_STOP = ("street", "road", "avenue", "building", "floor", "district", "province", "city")


def address_tokens(addresses: Column) -> Column:
    """Tokens of all address texts that are numbers or longer than three letters, without common address words."""
    text = lambda a: F.concat_ws(" ", a["original_address"], a["value"], a["name"], a["country"])
    toks = F.flatten(F.transform(addresses, lambda a: F.split(F.regexp_replace(fold(text(a)), r"[^\p{L}\p{N}]+", " "), " +")))
    return F.array_sort(F.array_distinct(F.filter(toks, lambda t: (F.regexp_like(t, F.lit("^[0-9]+$")) | (F.length(t) > 3)) & ~t.isin(*ADDRESS_STOP))))
