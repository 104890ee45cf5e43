"""Place names to countries by one lookup table, built once with a stated priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.ranks import ordered_codes

#: Kinds of names in the order in which they win over each other.
KINDS = ("country", "alias", "code", "division", "capital")


def lookup(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, country)`` from tables ``(name, country)`` by kind; of equal names the first kind wins, then the smaller country."""
    out = None
    for k, kind in enumerate(KINDS):
        if kind in tables:
            t = tables[kind].select(F.lower(F.trim("name")).alias("name"), F.col("country"), F.lit(k).alias("kind"))
            out = t if out is None else out.union(t)
    return out.groupBy("name").agg(F.min_by("country", F.struct("kind", "country")).alias("country"))


def resolve(values: DataFrame, keys: list[str], value: str, table: DataFrame) -> DataFrame:
    """Each value's country, or the value itself if it is unknown, as a sorted set per key."""
    v = values.select(*keys, F.trim(F.col(value)).alias("value"))
    v = v.join(table, F.lower("value") == F.col("name"), "left")
    return v.groupBy(*keys).agg(F.array_sort(F.collect_set(F.coalesce("country", "value"))).alias("places"))


def numbered(table: DataFrame, value: str) -> DataFrame:
    """Category codes of the distinct values in order, from 0."""
    return ordered_codes(table, value, "code")


def country_rows(countries: DataFrame) -> DataFrame:
    """``(name, country)`` of a country list ``(name, code)``: every country is its own name, in lower case."""
    return countries.where(F.col("name").isNotNull()).select(F.lower(F.trim("name")).alias("name"), F.lower(F.trim("name")).alias("country")).distinct()


def code_rows(countries: DataFrame) -> DataFrame:
    """``(name, country)`` of the codes in a country list; a code listed twice belongs to the smaller country."""
    rows = countries.where(F.col("name").isNotNull() & F.col("code").isNotNull()).select(F.lower(F.trim("code")).alias("name"), F.lower(F.trim("name")).alias("country"))
    return rows.groupBy("name").agg(F.min("country").alias("country"))


def alias_rows(aliases: DataFrame, known: DataFrame) -> DataFrame:
    """``(name, country)`` of other names, from ``(name, aliases array)`` and the known countries ``(name, country)``.

    Where the name itself is no known country but an alias is, the alias is the home: the name and the other aliases lead to
    it. With several known aliases the smallest is the home. A row with neither leads nowhere and gives no rows.
    """
    rows = aliases.select(F.lower(F.trim("name")).alias("own"), F.transform("aliases", lambda a: F.lower(F.trim(a))).alias("others")).where("own is not null")
    names = rows.select("own", F.explode(F.array_union(F.array("own"), F.coalesce("others", F.array().cast("array<string>")))).alias("name")).where("name is not null")
    home = names.join(known, "name").groupBy("own").agg(F.min_by("country", F.struct(F.col("name") != F.col("own"), "name")).alias("country"))
    return names.join(home, "own").where(F.col("name") != F.col("country")).groupBy("name").agg(F.min("country").alias("country"))


def place_rows(places: DataFrame, codes: DataFrame, place: str) -> DataFrame:
    """``(name, country)`` of places listed by country code ``(code, <place>)``: divisions, capitals. Unknown codes give no rows."""
    rows = places.where(F.col(place).isNotNull()).select(F.lower(F.trim("code")).alias("code"), F.lower(F.trim(place)).alias("place"))
    return rows.join(codes.select(F.col("name").alias("code"), "country"), "code").groupBy(F.col("place").alias("name")).agg(F.min("country").alias("country"))


def full_lookup(countries: DataFrame, aliases: DataFrame, divisions: DataFrame, capitals: DataFrame) -> DataFrame:
    """The whole lookup in build order: the list, aliases, codes, divisions, capitals."""
    known, codes = country_rows(countries), code_rows(countries)
    return lookup({"country": known, "alias": alias_rows(aliases, known), "code": codes, "division": place_rows(divisions, codes, "name"), "capital": place_rows(capitals, codes, "capital")})
