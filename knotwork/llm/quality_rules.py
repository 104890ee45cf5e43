"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document in one pass; the ledger keeps the measurements and a bit for each rule that
failed. A policy is a versioned mask of rules that matter, so applying another policy or asking what a rule costs
(ablation) is bitwise arithmetic on the ledger and never reads a text again.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.llm.common import digest_input, prepare, slices, table, tidy, utf8_buffers

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_bars")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
WINDOW, MARK = 5, "__rule_"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Rules in bit order: name and what fails. Bits keep their place; new rules are added at the end.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 8 * n_words and n_symbols >= 10",
    "shouting": "n_letters >= 100 and 100 * n_upper > 60 * n_letters",
    "repeated_lines": "n_words >= 10 and n_dup_lines >= 5 and 4 * n_dup_lines > n_words",
    "long_words": "word_chars > 40 * n_words",
}
#: Policies by version: the rules that reject. The base of the contract comes first; later versions only add.
POLICIES = {"base": ("few_words", "repeated_words"), "v1": ("few_words", "repeated_words", "symbols", "shouting", "long_words")}


def mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    order = list(RULES)
    return sum(1 << order.index(n) for n in names)


def _per_doc(hit: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(hit)))
    return total[offs[1:]] - total[offs[:-1]]


def _rank(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Whether each word is covered by a window found twice or more in its text. Windows are ranked exactly, by pairs."""
    k = len(ids) - WINDOW + 1
    if k < 2:
        return np.zeros(len(ids), bool)
    m = np.int64(ids.max() + 1)
    two = _rank(ids[:-1] * m + ids[1:])
    m2 = np.int64(two.max() + 1)
    four = _rank(two[:-2] * m2 + two[2:])
    five = _rank(four[:k] * m + ids[WINDOW - 1 :])
    own = doc[:k] == doc[WINDOW - 1 :]
    key = _rank(five * np.int64(n_docs) + doc[:k])
    often = own & (np.bincount(key[own], minlength=key.max() + 1)[key] > 1)
    step = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(often)
    step[at] += 1
    np.subtract.at(step, at + WINDOW, 1)
    return np.cumsum(step[:-1]) > 0


def _measure(batches, name: str = "text", kept: tuple[str, ...] = ("doc_id",), mark: str = ""):
    """Measurements of each row's text beside the columns ``kept``."""
    for whole in batches:
        for b in slices(whole, name, 1 << 20):
            text = b.column(b.schema.get_field_index(name)).fill_null("")
            n = b.num_rows
            raw, offs = utf8_buffers(text)
            blank = _BLANK[raw]
            coded, doc = coded_words(raw, offs, blank)
            n_words = np.bincount(doc, minlength=n)
            lead = (raw & 0xC0) != 0x80
            chars = _per_doc(lead & ~blank, offs)
            lines = pc.list_flatten(s := pc.split_pattern(text, "\n"))
            line_doc = pc.list_parent_indices(s).to_numpy()
            has_word = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
            code = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
            pair = code[has_word] * n + line_doc[has_word]
            _, first = np.unique(pair, return_index=True)
            again = np.ones(len(pair), bool)
            again[first] = False
            n_dup = np.bincount(line_doc[has_word][again], minlength=n)
            got = (n_words, chars, _per_doc(_SYMBOL[raw], offs), n_dup, np.bincount(doc[repeated_words(coded, doc, n)], minlength=n), _per_doc(_UPPER[raw], offs), _per_doc(_LETTER[raw], offs), _per_doc(raw == ord("|"), offs))
            yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in kept), *(pa.array(x, pa.int64()) for x in got)], names=[*kept, *(mark + m for m in MEASURES)])


def coded_words(raw: np.ndarray, offs: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dictionary code of each word (exact: equal codes are equal bytes) and its text's index."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = ~blank, ~blank
    start[1:] &= blank[:-1]
    end[:-1] &= blank[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner] = ~blank[inner]
    end[inner - 1] = ~blank[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    # The words back to back, without what is between them, as one Arrow array over the same bytes.
    length = e - s
    at = np.concatenate(([0], np.cumsum(length)))
    arr = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw[~blank].tobytes())])
    return arr.dictionary_encode().indices.to_numpy().astype(np.int64), np.searchsorted(offs, s, "right") - 1


def quality_ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the measurements, and ``failed``, the bits of the rules of ``RULES`` that failed.

    Words are runs outside ``[\\x20\\x09-\\x0D]``; null text has none (``few_words`` fails). Null ids stay null; repeated
    rows have a row each. An empty table gives an empty ledger; other columns are ignored.
    """
    prepare(df.sparkSession)
    return digest_input(df, id_col, text_col).mapInArrow(tidy(_measure), SCHEMA).withColumn("failed", _bits(""))


def _bits(prefix: str):
    bits = F.lit(0).cast("long")
    for k, test in enumerate(RULES.values()):
        test = re.sub(r"\b(" + "|".join(MEASURES) + r")\b", lambda m: prefix + m[0], test)
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def filter_documents(df: DataFrame, text_col: str = "text", policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """The rows of ``df`` that pass the policy, with all their columns, in one pass without a shuffle."""
    prepare(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *(T.StructField(MARK + m, T.LongType()) for m in MEASURES)])
    m = df.mapInArrow(tidy(partial(_measure, name=text_col, kept=tuple(df.columns), mark=MARK)), schema)
    return m.where(_bits(MARK).bitwiseAND(F.lit(mask(policy))) == 0).select(*df.columns)


def apply_policy(ledger: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """The ledger with ``kept``: no bit of the policy is set."""
    return ledger.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(ledger: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """For each rule of the policy: documents it fails, documents only it fails, and documents kept without it.

    The ledger is first counted by its bits, so what is compared with the rules is at most 2^rules rows.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    all_bits = mask(names)
    counts = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(all_bits)).alias("bits")).agg(F.count("*").alias("n"))
    rules = ledger.sparkSession.createDataFrame([(n, 1 << list(RULES).index(n)) for n in names], "rule string, bit long")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    rest = F.col("bits").bitwiseAND(F.lit(all_bits) - F.col("bit"))
    return rules.join(F.broadcast(counts), F.lit(True), "left").groupBy("rule").agg(total(has).alias("failed"), total(has & (rest == 0)).alias("only_this"), total(rest == 0).alias("kept_without"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    ledger = apply_policy(quality_ledger(table(spark, sf_dir, "documents")), "v1")
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0).alias("base_failed"), "kept", "failed")


ORACLE_OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, i + 4 AS j, list_slice(w, i, i + 4) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM g) WHERE k > 1),
p AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS at FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
      length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
      FROM d LEFT JOIN p USING (doc_id) LEFT JOIN u USING (doc_id)),
b AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
      + (CASE WHEN 10 * n_symbols > 8 * n_words AND n_symbols >= 10 THEN 4 ELSE 0 END) + (CASE WHEN n_letters >= 100 AND 100 * n_upper > 60 * n_letters THEN 8 ELSE 0 END)
      + (CASE WHEN n_words >= 10 AND n_dup_lines >= 5 AND 4 * n_dup_lines > n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 47) = 0 AS kept, failed FROM b
"""
