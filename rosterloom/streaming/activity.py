"""Activity as a stream: replayed files, exactly-once by id, folds equal to the batch ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG_SCHEMA = "event_id bigint, rep bigint, advisor bigint, direction string, classification string, occurred_at timestamp"


def read_log(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once(stream: DataFrame, key: str = "event_id", stamp: str = "occurred_at", overlap: str = "10 minutes") -> DataFrame:
    """Each event once, however often the overlap brings it again."""
    return stream.withWatermark(stamp, overlap).dropDuplicatesWithinWatermark([key])


def known_parties(stream: DataFrame, parties: DataFrame, key: str = "advisor") -> DataFrame:
    """Events of unknown parties leave no trace."""
    return stream.join(parties.select(key).distinct(), key, "left_semi")


FOLD_OUT = "rep long, advisor long, last_out timestamp, last_in timestamp, last_reply timestamp, last_bounce timestamp, events long"
#: Stamps as microseconds, exactly; -1 for none.
_STATE = "last_out long, last_in long, last_reply long, last_bounce long, events long"
_NONE = -1


def _fold_group(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = list(state.get) if state.exists else [_NONE] * 4 + [0]
    for f in frames:
        at = f["occurred_at"].astype("datetime64[us]").astype("int64")
        inbound = f["direction"] == "inbound"
        marks = (f["direction"] == "outbound", inbound, inbound & (f["classification"] == "reply"), inbound & (f["classification"] == "bounce"))
        for k, mask in enumerate(marks):
            if mask.any():
                held[k] = max(held[k], int(at[mask].max()))
        held[4] = int(held[4] + len(f))
    state.update(tuple(held))
    yield pd.DataFrame([[*key, *[pd.NaT if x == _NONE else pd.to_datetime(x, unit="us") for x in held[:4]], held[4]]], columns=["rep", "advisor", "last_out", "last_in", "last_reply", "last_bounce", "events"])


def fold(stream: DataFrame) -> DataFrame:
    """The engagement projection per (rep, advisor), kept as state and emitted on change."""
    cols = stream.select("rep", "advisor", "direction", "classification", "occurred_at")
    return cols.groupBy("rep", "advisor").applyInPandasWithState(_fold_group, FOLD_OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table that ``upsert_into`` writes, in order."""
    at, fs = _files(spark, path)
    if not fs.exists(at):
        return []
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(at)]
    done = [int(n[1:]) for n, p in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(_files(spark, f"{p}/_SUCCESS")[0])]
    return sorted(done)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version."""
    return spark.read.parquet(f"{path}/v{versions(spark, path)[-1]}")


def upsert_into(path: str, keys: list[str], order: str, keep: int = 2):
    """A foreachBatch sink: the newest row per key replaces what the table at ``path`` holds.

    Every batch writes a version of its own from the newest complete one of an earlier batch, so a
    batch that runs again after a failure gives the same table. A version counts once its write has
    succeeded; older ones than ``keep`` go. A batch older than a version that is there already is
    refused: its table belongs to another checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        from ..operators.relational import first_row, upsert

        spark = batch.sparkSession
        done = versions(spark, path)
        if done and number < done[-1]:
            raise ValueError(f"batch {number} comes after version {done[-1]} of {path}")
        new = first_row(batch, keys, F.desc(order))
        before = [v for v in done if v < number]
        if before:
            new = upsert(spark.read.parquet(f"{path}/v{before[-1]}"), new, keys)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")
        for old in before[: max(0, len(before) + 1 - keep)]:
            at, fs = _files(spark, f"{path}/v{old}")
            fs.delete(at, True)

    return write


def sessions(events: DataFrame, key: str = "advisor", stamp: str = "occurred_at", gap: str = "30 minutes") -> DataFrame:
    """Beyond the domain's own needs: activity sessions; works on batches and streams."""
    return events.groupBy(key, F.session_window(stamp, gap)).agg(F.count("*").alias("events"))
