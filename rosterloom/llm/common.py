"""Helpers that several training-data operators share.

The operators follow one rule for columns: the columns an operator adds replace input columns of
the same name (compared without case, as Spark does), all others pass through unchanged.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, as the cluster names it.

    Only a local session, whose executors are the driver, gets one of its own where none is named.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or f"{Path(tempfile.mkdtemp(prefix='rosterloom-')).as_uri()}")
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, at: str) -> DataFrame:
    """``df`` as a table at a path below the shared folder, read back."""
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.parquet(at)


def forget(df: DataFrame, *paths: str) -> None:
    """Deletes tables that no later step reads; ``df`` only lends its session."""
    spark = df.sparkSession
    for at in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder; it outlives executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Frees the disk of shuffles and checkpoints that nothing refers to any more.

    Spark's cleaner deletes them when the driver's collector finds their handles, which it may not do for
    as long as the heap has room.
    """
    gc.collect()
    spark._jvm.System.gc()


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def carried(df: DataFrame, used: list[Column], f: Callable[..., DataFrame], back: dict[int, str]) -> DataFrame:
    """``f`` of the columns ``used`` alone, with all others carried beside them in one struct.

    Inside, the used columns are called ``__u0``, ``__u1``, ...; so no name of the input can clash with
    a name of the operator. ``back`` gives the used columns that come back, by their place, and the
    names that they get. Other columns of the input come back as they were, but for those that the
    operator adds anew.
    """
    taken = {n.lower() for n in back.values()}
    rest = [c for c in df.columns if c.lower() not in taken]
    names = [f"__u{i}" for i in range(len(used))]
    packed = df.select(*[c.alias(n) for c, n in zip(used, names)], *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__carried")] if rest else []))
    out = f(packed, *names)
    added = [c for c in out.columns if c not in (*names, "__carried")]
    new = {c.lower() for c in added}
    whole = [F.col(names[i]).alias(n) for i, n in back.items() if names[i] in out.columns and n.lower() not in new]
    kept = [F.col("__carried").getField(c).alias(c) for c in rest if c.lower() not in new]
    return out.select(*whole, *kept, *[F.col(f"`{c}`") for c in added])


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
