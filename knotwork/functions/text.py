"""Text and metadata features as column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quote(token: Column) -> Column:
    """A token as a literal in a regular expression."""
    return F.concat(F.lit(r"\Q"), F.replace(token, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def as_utf8(text: Column) -> Column:
    """The bytes of a text; one that is no valid UTF-8 loses all that is not a word character first."""
    return F.encode(F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_replace(F.make_valid_utf8(text), r"\W", "")), "UTF-8")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<.*?>", "")


def url_domain(url: Column) -> Column:
    """The network location as a one-element set; empty if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(F.length(host) > 0, F.array(host)).otherwise(F.array().cast("array<string>"))


def force_scheme(url: Column, scheme: str = "http") -> Column:
    return F.regexp_replace(url, "^[^:]+:", f"{scheme}:")


def meta_value(props: Column, key: str) -> Column:
    """One key of a JSON object as a one-element set; missing or null is empty."""
    v = F.get_json_object(props, f"$.{key}")
    return F.when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<string>"))


def keywords_in(text: Column, keywords: list[str]) -> Column:
    """Keywords (stripped, lower case) that occur in the lower-cased text as substrings, in list order."""
    words = sorted({k.strip().lower() for k in keywords if k.strip()})
    return F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(F.lower(text), k))


def mentions_name(text: Column, name: Column) -> Column:
    return F.contains(text, name)


def drop_name_values(values: Column, name: Column) -> Column:
    """Values in which no token of the name stands as a word, whatever the case. Two-character tokens ending in a dot are skipped."""
    toks = F.filter(F.split(name, " "), lambda t: (F.length(t) > 0) & ~((F.length(t) == 2) & t.endswith(".")))
    return F.filter(values, lambda v: ~F.exists(toks, lambda t: F.regexp_like(v, F.concat(F.lit(r"(?i)\b"), quote(t), F.lit(r"\b")))))


def remove_names(text: Column, persons: Column, name: Column) -> Column:
    """Without persons nothing changes; else every token of persons and name, sorted, is removed as a plain substring."""
    toks = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(F.array_union(persons, F.array(name)), lambda p: F.split(p, " "))), lambda t: F.length(t) > 0)))
    return F.when(F.coalesce(F.size(persons), F.lit(0)) == 0, text).otherwise(F.aggregate(toks, text, lambda acc, t: F.replace(acc, t, F.lit(""))))


def replace_name(text: Column, name: Column, by: str | Column) -> Column:
    """Each token of the name, as a word and whatever the case, becomes ``by``; a token that ends in a dot needs no word end."""
    toks = F.filter(F.split(name, " "), lambda t: F.length(t) > 0)
    end = lambda t: F.when(t.endswith("."), F.lit("")).otherwise(F.lit(r"\b"))
    return F.aggregate(toks, text, lambda acc, t: F.regexp_replace(acc, F.concat(F.lit(r"(?i)\b"), quote(t), end(t)), F.lit(by)))


def feature_string(features: dict[str, Column]) -> Column:
    """``FEATURE-value`` strings of all set features joined by ``_-_``."""
    def tagged(name: str, values: Column) -> Column:
        return F.transform(F.array_sort(values.cast("array<string>")), lambda v: F.concat(F.lit(f"{name}-"), v))

    return F.array_join(F.flatten(F.array(*[tagged(n, c) for n, c in features.items()])), "_-_")


SENTENCE_END = r"(?<=[.!?])\s+"


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), SENTENCE_END), lambda s: F.length(s) > 0)


def selected_text(df: DataFrame, keys: list[str], text: str, name: str, before: int = 1, after: int = 1) -> DataFrame:
    """Sentences that contain the name, with their neighbours, each distinct sentence once, in order, joined by a space."""
    s = df.select(*keys, F.col(name).alias("__name"), F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-after, before)
    s = s.withColumn("near", F.max(F.contains(F.col("sentence"), F.col("__name")).cast("int")).over(w)).where("near = 1")
    s = s.groupBy(*keys, "sentence").agg(F.min("pos").alias("pos"))
    return s.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("selected"))


#: Time patterns in the order tried; a later success wins over an earlier one.
TIME_PATTERNS = ("h:mm a", "h a", "h:mma", "ha", "HH:mm")


def standard_time(value: Column) -> Column:
    """``HH:mm:ss`` of a time of day in one of the known patterns; null if none fits."""
    v = F.upper(F.regexp_replace(F.regexp_replace(F.trim(value), r"(?i)a\.\s?m\.?", "AM"), r"(?i)p\.\s?m\.?", "PM"))
    tried = [F.date_format(F.try_to_timestamp(v, F.lit(p)), "HH:mm:ss") for p in reversed(TIME_PATTERNS)]
    return F.coalesce(*tried)


def times_in(text: Column) -> Column:
    """Times of day in a text, standardised; what looks like one and can't be read stays as it is."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{1,2}:?(?:\d{2})?\s?(?:AM|PM|am|pm))"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: F.coalesce(standard_time(t), t))))


def capital_runs(text: Column) -> Column:
    """A rule in place of a trained tagger: runs of two or more capitalised words are taken for names of persons."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"((?:\p{Lu}\p{Ll}+ )+\p{Lu}\p{Ll}+)"), F.lit(1))))


def agreed_date(value: Column) -> Column:
    """``Y-M-D`` with ``None`` for parts a text does not give; only where day-first and month-first readings agree."""
    iso = F.regexp_extract(value, r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$", 0)
    part = lambda k: F.nullif(F.regexp_extract(value, r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$", k), F.lit(""))
    num = lambda c: F.coalesce(c.cast("int").cast("string"), F.lit("None"))
    worded = F.try_to_timestamp(value, F.lit("d MMMM yyyy"))
    us = F.try_to_timestamp(value, F.lit("MMMM d, yyyy"))
    month = F.try_to_timestamp(F.concat(F.lit("1 "), value), F.lit("d MMMM yyyy"))
    full = F.coalesce(worded, us)
    return (
        F.when(F.length(iso) > 0, F.concat_ws("-", part(1), num(part(2)), num(part(3))))
        .when(full.isNotNull(), F.concat_ws("-", F.year(full), F.month(full), F.dayofmonth(full)))
        .when(month.isNotNull(), F.concat(F.concat_ws("-", F.year(month), F.month(month)), F.lit("-None")))
    )


def professions(text: Column, name: Column, occupations: list[str]) -> Column:
    """Occupations (lower case, in order) that a sentence holds which also holds a token of the name.

    A rule in place of a parser: the sentence stands for the noun phrase that a parser would find.
    """
    toks = F.filter(F.split(name, " "), lambda t: F.length(t) > 0)
    own = F.filter(sentences(text), lambda s: F.exists(toks, lambda t: F.contains(s, t)))
    words = sorted({o.strip().lower() for o in occupations if o.strip()})
    return F.filter(F.array(*map(F.lit, words)), lambda o: F.exists(own, lambda s: F.contains(F.lower(s), o)))


def linked_entities(df: DataFrame, keys: list[str], names: str, table: DataFrame) -> DataFrame:
    """``(*keys, tuples, uris)``: the entities of a lookup table ``(name, uri, similarity)`` that the names in an array lead to.

    A look-up join in place of an annotation service; names are compared in lower case. Rows without a link have empty sets.
    """
    found = df.select(*keys, F.explode(F.array_distinct(names)).alias("surface"))
    t = table.select(F.lower("name").alias("own_name"), "uri", "similarity")
    found = found.join(t, F.lower("surface") == F.col("own_name")).groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("uri", "surface", "similarity"))).alias("tuples"), F.array_sort(F.collect_set("uri")).alias("uris"))
    return df.select(*keys).join(found, keys, "left").select(*keys, F.coalesce("tuples", F.expr("filter(array(struct('' as uri, '' as surface, 0D as similarity)), x -> false)")).alias("tuples"), F.coalesce("uris", F.array().cast("array<string>")).alias("uris"))


STOP = tuple("a an the of and or to in on at by for with from as is are was were be been it its this that these those he she they we you i not no but if".split())


def top_phrases(df: DataFrame, key: str, text: str, n: int = 10, longest: int = 4) -> DataFrame:
    """``(key, phrase, score)``: the ``n`` best terms of each text by length * ln(frequency) + 0.75 * containing + 0.1 * contained.

    Candidates are runs of words without stop words and marks, in pieces of ``longest`` words; ``containing`` counts the
    text's other candidates that hold the term, ``contained`` those that it holds. Equal scores: the smaller phrase first.
    """
    runs = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}\s'-]+|(?<![\p{L}\p{N}'-])(?:" + "|".join(STOP) + r")(?![\p{L}\p{N}'-])"), lambda r: F.length(F.trim(r)) > 0)
    words = lambda r: F.filter(F.split(F.trim(r), r"\s+"), lambda w: F.length(w) > 0)
    pieces = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / longest).cast("int")), lambda i: F.array_join(F.slice(w, i * longest + 1, longest), " "))
    terms = df.select(key, F.explode(F.flatten(F.transform(runs, lambda r: pieces(words(r))))).alias("phrase")).where("phrase <> ''")
    freq = terms.groupBy(key, "phrase").agg(F.count("*").alias("n"), F.first(F.size(F.split("phrase", " "))).alias("size"))
    w = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.transform(F.sequence(F.lit(1), F.col("size") - i + 1), lambda m: F.array_join(F.slice(w, i, m), " "))))
    inner = freq.select(key, F.col("phrase").alias("outer"), F.explode(F.array_distinct(spans)).alias("phrase")).where("phrase <> outer")
    inner = inner.join(freq.select(key, "phrase"), [key, "phrase"])
    holds = inner.groupBy(key, F.col("outer").alias("phrase")).agg(F.count("*").alias("contained"))
    held = inner.groupBy(key, "phrase").agg(F.count("*").alias("containing"))
    score = F.col("size") * F.log("n") + 0.75 * F.coalesce("containing", F.lit(0)) + 0.1 * F.coalesce("contained", F.lit(0))
    scored = freq.join(held, [key, "phrase"], "left").join(holds, [key, "phrase"], "left").withColumn("score", F.round(score, 6))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "phrase"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "phrase", "score")
