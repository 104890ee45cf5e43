"""Exact dedup by a content sort.

Sampled splitters range-partition the normalised bytes, Spark's external sort puts equal texts next to each other, and a
comparison of every text with its whole neighbour finds the runs. The sort key begins with a bounded piece of the
content (first bytes, then a hash of all of it), so that the splitters sampled to the driver stay small however long
the texts are; within equal keys the full text decides. A salt ends the key, so a text that a third of all rows share
is spread over many partitions; the runs that touch a partition's ends (two for each partition at most) are united in
a second, small step.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import cut, digest_input, prepare, strip_white, tidy, unlike

HEAD, ROWS = 16, 1 << 16
SCHEMA = "doc_id long, sha string, keep_id long, keep_len long, size long, edge boolean"


def _runs(batches):
    """Rows of one sorted partition -> a row each with the run's winner; only ids and lengths of the open run are held.

    A run that may go on in another partition is an ``edge``: the first and the last, and runs beside another text of the
    same hash (the salt ends the key that parts partitions, while whole texts order the rows in one).
    """
    text, code, before = None, 0, None  # the open run's text and hash, and the hash of the run before it
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    first = True

    def close(after):
        nonlocal first
        i, z, n = (np.concatenate(x) for x in zip(*held, strict=True))
        k = np.lexsort((i, z, -n))[0]
        edge = first or after is None or code in (before, after)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = False
        for a in range(0, len(i), ROWS):
            own = slice(a, a + ROWS)
            m = len(i[own])
            yield _rows(i[own], z[own], pa.repeat(pa.scalar(sha), m), np.full(m, i[k]), np.full(m, z[k]), np.full(m, n[k]), np.full(m, len(i)), np.full(m, edge))

    for b in batches:
        if not b.num_rows:
            continue
        norm = b.column(0)
        z = b.column(1).is_null().to_numpy(zero_copy_only=False)
        i = b.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        h = b.column(3).to_numpy(zero_copy_only=False)
        new = np.ones(len(i), bool)
        if len(i) > 1:
            new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, len(i) - 1)).to_numpy(zero_copy_only=False)
        new[0] = text is None or norm[0].as_py() != text
        starts = np.flatnonzero(new)
        head = starts[0] if len(starts) else len(i)
        if head:
            held.append((i[:head], z[:head], n[:head]))
        if not len(starts):
            continue
        if text is not None:
            yield from close(int(h[starts[0]]))
            before = code
        if len(starts) > 1:  # runs that begin and end in this batch
            lo, hi = starts[0], starts[-1]
            run = np.cumsum(new[lo:hi]) - 1
            size = np.diff(starts)
            order = np.lexsort((i[lo:hi], z[lo:hi], -n[lo:hi], run))
            win = order[np.concatenate(([0], np.cumsum(size)[:-1]))] + lo
            names = pa.array([hashlib.sha256(norm[int(s)].as_py().encode()).hexdigest() for s in starts[:-1]])
            own = h[starts]
            clash = np.zeros(len(starts), bool)
            clash[1:] = own[1:] == own[:-1]
            edge = clash[:-1] | clash[1:]
            edge[0] |= first or int(own[0]) == before
            first = False
            yield _rows(i[lo:hi], z[lo:hi], names.take(pa.array(run)), i[win][run], z[win][run], n[win][run], size[run], edge[run])
            before = int(own[-2])
        at = starts[-1]
        text, code = norm[int(at)].as_py(), int(h[at])
        held = [(i[at:], z[at:], n[at:])]
    if text is not None:
        yield from close(None)


def _rows(i, z, sha, keep, keep_null, keep_len, size, edge) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(i, pa.int64(), mask=z), sha, pa.array(keep, pa.int64(), mask=keep_null), pa.array(keep_len, pa.int64()), pa.array(size, pa.int64()), pa.array(edge)],
        names=["doc_id", "sha", "keep_id", "keep_len", "size", "edge"],
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are identical without ``[\\x20\\x09-\\x0D]``; of equal texts the one with most code points
    stays, then the smallest id. Null text counts as empty (all empty texts are one group). A null id sorts after all
    others, and is kept only in a group without ids. Rows that repeat an id within a group: all rows with the winner's id
    count as kept. An empty table gives an empty result; other columns are ignored.
    """
    prepare(df.sparkSession)
    d = digest_input(df, id_col, text_col)
    norm = strip_white(F.col("text"))
    d = d.select(norm.alias("norm"), "doc_id", F.length("text").cast("long").alias("n"))
    d = d.select("norm", "doc_id", "n", F.substring(F.encode("norm", "utf-8"), 1, HEAD).alias("head"), F.xxhash64("norm").alias("h"), F.xxhash64(F.lit(7), "doc_id").alias("salt"))
    d = d.repartitionByRange("head", "h", "salt").sortWithinPartitions("head", "h", "norm", "salt")
    runs = cut(d.select("norm", "doc_id", "n", "h").mapInArrow(tidy(_runs), SCHEMA))
    # Two runs for each partition (and what shares a hash with them); partial aggregation leaves one row for each run and task.
    ends = runs.where("edge").groupBy("sha").agg(F.count("*").alias("all_size"), F.min(F.struct((-F.col("keep_len")).alias("l"), F.col("keep_id").isNull().alias("z"), F.col("keep_id").alias("k"))).alias("w"))
    ends = F.broadcast(ends.select(F.col("sha").alias("end_sha"), "all_size", F.col("w.k").alias("all_keep"), F.lit(True).alias("met")))
    out = runs.join(ends, F.col("edge") & (F.col("sha") == F.col("end_sha")), "left")
    keep = F.when(F.col("met"), F.col("all_keep")).otherwise(F.col("keep_id"))
    size = F.coalesce("all_size", "size")
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from knotwork.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each text that differs without white space, with all its columns: the row that stays.

    If the id that stays is repeated in its group, the row with the longest text is taken, of equal ones the first text.
    A null id counts as an id here.
    """
    key, sha, want, rank = unlike(df, "id_kept", "sha_own", "sha_kept", "rank_own")
    kept = exact_dedup(df, id_col, text_col).where("kept").groupBy(F.col("doc_id").alias(key), F.col("text_sha256").alias(want)).agg(F.count("*").alias("rows"))
    kept = cut(kept)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.withColumn(sha, F.sha2(strip_white(text), 256))
    same = rows[id_col].cast("long").eqNullSafe(F.col(key)) & (F.col(sha) == F.col(want))
    out = rows.join(kept.where("rows = 1").drop("rows"), same, "left_semi").select(*df.columns)
    again = kept.where("rows > 1").drop("rows")
    if again.isEmpty():
        return out
    order = Window.partitionBy(F.col(id_col).cast("long"), sha).orderBy(F.length(text).desc(), text)
    more = rows.join(again, same, "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return out.union(more.select(*df.columns))
