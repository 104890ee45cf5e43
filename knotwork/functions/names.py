"""Name tokens, phonetic codes, pairs of tokens, and how common a name is."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
MARKS = ",/)(.-;`'"


@pandas_udf(T.StringType())
def transliterate(s: pd.Series) -> pd.Series:
    """Accents removed by decomposition; other scripts stay as they are (no table is shipped for them)."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def fold(c: Column) -> Column:
    """Lower case without the usual Latin accents, JVM-side."""
    return F.translate(F.lower(c), ACCENTS, PLAIN)


def name_tokens(name: Column) -> Column:
    """Sorted tokens of more than two letters; if none is left, the folded name as it is."""
    low = fold(name)
    toks = F.array_sort(F.filter(F.split(F.translate(low, MARKS, " " * len(MARKS)), " +"), lambda t: F.length(t) > 2))
    return F.when(F.size(toks) > 0, toks).otherwise(F.array(low))


def phonetic(tokens: Column) -> Column:
    return F.array_sort(F.transform(tokens, F.soundex))


def token_pairs(tokens: Column) -> Column:
    """All pairs of a token and a later one, joined by ``+``."""
    return F.flatten(F.transform(tokens, lambda a, i: F.transform(F.slice(tokens, i + 2, F.greatest(F.size(tokens) - i - 1, F.lit(0))), lambda b: F.concat(a, F.lit("+"), b))))


def father_phonetic(alias: Column) -> Column:
    """What follows the first "ben" or "s/o" (unless it is the last token), as sorted phonetic codes joined by ``+``; else null."""
    toks = F.split(F.lower(alias), " +")
    at = F.array_min(F.filter(F.array(F.array_position(toks, F.lit("ben")), F.array_position(toks, F.lit("s/o"))), lambda p: p > 0))
    rest = F.slice(toks, at.cast("int") + 1, F.greatest(F.size(toks) - at.cast("int"), F.lit(0)))
    return F.when(at.isNotNull() & (at < F.size(toks)), F.array_join(phonetic(rest), "+"))


def token_frequency(names: DataFrame, name: str) -> DataFrame:
    return names.select(F.explode(F.split(fold(F.col(name)), " ")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("freq"))


def commonness(names: DataFrame, name: str, frequency: DataFrame) -> DataFrame:
    """Product of each distinct token's share of all tokens; 0 if a token is unknown."""
    total = F.broadcast(frequency.agg(F.sum("freq").alias("total")))  # one row
    q = names.select(name).distinct().withColumn("toks", F.array_distinct(F.filter(F.split(fold(F.col(name)), " "), lambda t: t != "")))
    q = q.select(name, F.size("toks").alias("n_toks"), F.explode("toks").alias("token")).join(frequency, "token").crossJoin(total)
    known = q.groupBy(name, "n_toks").agg(F.product(F.col("freq") / F.col("total")).alias("p"), F.count("*").alias("k"))
    out = names.select(name).distinct().join(known, name, "left")
    return out.select(name, F.when(F.col("k") == F.col("n_toks"), F.col("p")).otherwise(0.0).alias("commonness"))


def row_key(*parts: Column, bits: int = 224) -> Column:
    """Identifier of a row: SHA-2 of its parts, null as empty."""
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), bits)
