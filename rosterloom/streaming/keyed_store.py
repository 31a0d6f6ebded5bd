"""A keyed table on files: buckets by key, copied only when touched, one manifest a version.

``data/<id>/bucket=<n>`` holds the rows of a bucket as one write left them; ``versions/<n>.json`` names
the folder of every bucket. A write reads the buckets that its keys fall into, writes those anew and
commits a manifest that is the old one but for them, so its bytes follow the batch and not the table.
A manifest is created and never replaced: of two writers that began at the same version one finds the
next version there and is refused (``Conflict``). A manifest names the batch that it comes from, so a
batch that runs again after a failure changes nothing.

Rows carry ``etag``, the version that wrote them last. A write may demand of each row the ``etag``
that its writer has seen; rows that have moved since are left as they are and returned.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import cut, first_row

BUCKETS = 64
ETAG = "etag"
_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer committed first; nothing of this write counts."""


@dataclass(frozen=True)
class Manifest:
    version: int
    batch: int
    buckets: int
    folders: dict[int, str]
    schema: str


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    at, fs = _fs(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The manifest of a version, the newest if none is named."""
    known = versions(spark, path)
    if not known:
        return None
    at, fs = _fs(spark, f"{path}/versions/{known[-1] if version is None else version}.json")
    stream = fs.open(at)
    try:
        held = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(held["version"], held["batch"], held["buckets"], {int(k): v for k, v in held["folders"].items()}, held["schema"])


def _commit(spark: SparkSession, path: str, new: Manifest) -> None:
    """Creates the manifest; a file that is there already is another writer's."""
    at, fs = _fs(spark, f"{path}/versions/{new.version}.json")
    body = json.dumps({"version": new.version, "batch": new.batch, "buckets": new.buckets, "folders": new.folders, "schema": new.schema})
    try:
        out = fs.create(at, False)
    except Exception as e:
        if fs.exists(at):
            raise Conflict(f"version {new.version} of {path} is there already") from e
        raise
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()


def _rows(spark: SparkSession, path: str, held: Manifest, buckets: list[int] | None = None) -> DataFrame:
    wanted = [held.folders[b] for b in (held.folders if buckets is None else buckets) if b in held.folders]
    if not wanted:
        return spark.createDataFrame([], held.schema)
    return spark.read.schema(held.schema).parquet(*[f"{path}/{w}" for w in wanted])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version with their ``etag``."""
    held = manifest(spark, path, version)
    if held is None:
        raise FileNotFoundError(f"no version of a keyed table at {path}")
    return _rows(spark, path, held)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def put(rows: DataFrame, path: str, keys: list[str], order: str | None = None, *, merge: bool = False, guard: str | None = None, expect: int | None = None, batch: int = -1, buckets: int = BUCKETS, keep: int = 2) -> DataFrame | None:
    """Writes ``rows`` by key and returns those that ``guard`` refused (None without a guard).

    Of several rows of a key the one latest by ``order`` counts, and it must not be older than the
    stored one. ``merge`` keeps stored values where a row has nulls; else the row replaces the
    stored one. ``guard`` names a column with the ``etag`` that the writer saw (null: the key must be
    new). ``expect`` is the version that the table must have. Rows of null keys are keys like others.
    """
    spark = rows.sparkSession
    held = manifest(spark, path)
    version = held.version if held else 0
    if expect is not None and expect != version:
        raise Conflict(f"{path} is at version {version}, not {expect}")
    if held and batch >= 0 and batch <= held.batch:
        return None  # this batch is in the table
    buckets = held.buckets if held else buckets
    columns = [c for c in rows.columns if c not in (guard, ETAG)]
    new = rows if order is None else first_row(rows, keys, F.desc_nulls_last(order))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = cut(new.select(*columns, *([F.col(guard).alias("__guard")] if guard else []), bucket.alias(_BUCKET)))
    touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]  # no more than there are buckets
    if not touched:
        return rows.limit(0) if guard else None
    old = _rows(spark, path, held, touched) if held else spark.createDataFrame([], f"{_ddl(new.select(*columns))}, {ETAG} bigint")
    stored = old.select(*[F.col(c).alias(f"__{c}") for c in old.columns], F.lit(True).alias("__there"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = new.withColumn("__here", F.lit(True)).join(stored, same, "full")
    there, here = F.coalesce("__there", F.lit(False)), F.coalesce("__here", F.lit(False))
    fits = here if not guard else here & F.col("__guard").eqNullSafe(F.col(f"__{ETAG}"))
    newer = F.lit(True) if order is None else ~there | F.coalesce(F.col(order) >= F.col(f"__{order}"), F.col(f"__{order}").isNull())
    wins = fits & newer
    was = lambda c: F.col(f"__{c}") if c in old.columns else F.lit(None)
    value = lambda c: F.when(wins, F.when(there, F.coalesce(F.col(c), was(c))).otherwise(F.col(c)) if merge else F.col(c)).otherwise(was(c))
    more = [c for c in old.columns if c not in (*columns, ETAG)]
    kept = [F.when(wins & F.lit(not merge), F.lit(None)).otherwise(F.col(f"__{c}")).alias(c) for c in more]
    after = both.filter(wins | there).select(*[value(c).alias(c) for c in columns], *kept, F.when(wins, F.lit(version + 1)).otherwise(F.col(f"__{ETAG}")).cast("bigint").alias(ETAG))
    after = after.withColumn(_BUCKET, bucket)
    folder = f"data/{uuid.uuid4().hex}"
    after.repartition(min(len(touched), int(spark.conf.get("spark.sql.shuffle.partitions"))), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{folder}")
    folders = {b: f for b, f in (held.folders if held else {}).items() if b not in touched}
    at, fs = _fs(spark, f"{path}/{folder}")
    written = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if s.isDirectory()}
    folders |= {b: f"{folder}/{_BUCKET}={b}" for b in written}
    _commit(spark, path, Manifest(version + 1, batch if batch >= 0 else (held.batch if held else -1), buckets, folders, _ddl(after.drop(_BUCKET))))
    _forget(spark, path, keep)
    return both.filter(here & ~fits).select(*columns, F.col("__guard").alias(guard)) if guard else None


def _forget(spark: SparkSession, path: str, keep: int) -> None:
    """Manifests older than the newest ``keep``, and the folders that only they name."""
    known = versions(spark, path)
    live = [manifest(spark, path, v) for v in known[-keep:]]
    used = {f for m in live for f in m.folders.values()}
    for v in known[:-keep]:
        for f in set(manifest(spark, path, v).folders.values()) - used:
            at, fs = _fs(spark, f"{path}/{f}")
            fs.delete(at, True)
        at, fs = _fs(spark, f"{path}/versions/{v}.json")
        fs.delete(at, False)


def sink(path: str, keys: list[str], order: str, **more):
    """A foreachBatch sink: the newest row of each key, each batch once."""

    def write(rows: DataFrame, number: int) -> None:
        put(rows, path, keys, order, batch=number, **more)

    return write
