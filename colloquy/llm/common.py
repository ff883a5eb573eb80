"""Shared helpers: reading tables, cutting lineage, bounded statistics."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, and the word pattern.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over the cores where its files give a quarter of them or
    fewer a task, as one small file of a single row group does. Tables of many
    files are read as they lie, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() <= cores else df


#: Folders of local sessions that name none, by application id.
_OWN: dict[str, str] = {}
#: Stashes of the innermost ``temporary`` block.
_MADE: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. A
    local session, as in tests, may go without and gets one; a cluster may not,
    as its executors share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="spark-scratch-")
    return _OWN[key]


def stash(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, runs the plan once (a checkpoint() of an unpersisted
    plan runs its last stage twice), and survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _MADE:
        _MADE[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(spark: SparkSession, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """``stash(make())``, after which the stashes that this made are deleted."""
    made: list[str] = []
    _MADE.append(made)
    try:
        out, path = stash(make())
    finally:
        _MADE.pop()
    for other in made:
        if other != path:
            discard(spark, other)
    return out, path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stash that no later plan reads."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(name: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % folds == 0, F.lit(False))



def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
