"""Session helpers: where shared files go, and how lineage is cut."""

from __future__ import annotations

import os
import re
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, bool] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none (tests, notebooks on one machine) a local default is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = current.get() if current.isDefined() else f"file:///tmp/checkpoints/{sc.applicationId}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pieces(spark: SparkSession) -> int:
    """Partitions for heavy work: enough that a few large ones do not hold up the rest."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def pieces_of(df: DataFrame, each: int = 4 << 20) -> int:
    """Partitions in which what ``df`` reads comes in shares of ``each`` bytes (of files), or as many as a checkpoint has."""
    leaves, size, n = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0, 1
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.nodeName().startswith("LogicalRelation"):
            size += int(str(leaf.stats().sizeInBytes()))
        elif hasattr(leaf, "rdd") and "RDD" in leaf.getClass().getSimpleName():
            n = max(n, leaf.rdd().getNumPartitions())
    return max(n, -(-size // each))


def spread(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """``df`` by keys in ``n`` partitions (else ``pieces_of``), so a task's share stays as it is when tables grow.

    Where the session's own number is enough, nothing changes. Only for keys with few rows each.
    """
    n = n or pieces_of(df)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unlike(df: DataFrame, *names: str) -> list[str]:
    """Names for own columns beside those of ``df``, whatever these are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers whatever their working folder is (once per application)."""
    sc = spark.sparkContext
    if _SHIPPED.get(sc.applicationId):
        return
    root = Path(__file__).resolve().parent
    target = Path(os.environ.get("TMPDIR", "/tmp")) / f"knotwork-{sc.applicationId}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED[sc.applicationId] = True
