"""Stateful operators over streams: rate limits, bounded session memory and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.sessions import Limiter, session_key


def stream_rate_limited(calls: DataFrame, key: str, at: str, limit: int, seconds: float = 60.0) -> DataFrame:
    """Calls of a stream with ``allowed`` and ``retry_after``: ``key, at, allowed, retry_after``.

    State of a key: the times of its accepted calls within ``seconds``, ``limit`` at most; it goes when the key has
    been silent for that long. Within a batch the calls of a key are taken by time. Null keys and times are left out."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = Limiter(limit, seconds, list(state.get[0]) if state.exists else [])
        rows = pd.concat(list(frames)).sort_values("at")
        found = [limiter.check(t.timestamp()) for t in rows["at"]]
        state.update((list(limiter.log),))
        state.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame({"key": [str(k[0])] * len(rows), "at": rows["at"].to_numpy(), "allowed": [ok for ok, _ in found], "retry_after": [w for _, w in found]})

    named = calls.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"))
    return named.groupBy("key").applyInPandasWithState(step, "key string, at timestamp, allowed boolean, retry_after int", "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_session_memory(turns: DataFrame, most: int = 20, hours: int = 24) -> DataFrame:
    """The ids of each session's last ``most`` turns, given out again whenever they change: ``session_id, turn_ids``.

    ``turns``: ``id, session_id``. A session that is silent for ``hours`` is forgotten."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids = set(state.get[0] if state.exists else ())
        for f in frames:
            ids = set(sorted(ids | set(f["id"].tolist()))[-most:])
        kept = sorted(ids)
        state.update((kept,))
        state.setTimeoutDuration(hours * 3_600_000)
        yield pd.DataFrame({"session_id": [k[0]], "turn_ids": [kept]})

    named = turns.select(F.col("id").cast("long").alias("id"), session_key(F.col("session_id")).alias("session_id")).where("id is not null and session_id is not null and session_id != ''")
    return named.groupBy("session_id").applyInPandasWithState(step, "session_id string, turn_ids array<long>", "ids array<long>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def stream_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events and their value by type and window; rows later than ``late`` are left out, as the watermark says."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def upsert_newest(path: str, key: str, order: str, buckets: int = 64):
    """A ``foreachBatch`` sink that keeps the newest row of each key as a Parquet table, read by ``read_upserted``.

    Keys are spread over ``buckets``. A batch writes only the buckets that it touches anew, beside the old ones; a small
    file names the version that counts of each bucket, so readers see a batch whole or not at all and a lost one is
    simply done again. Versions that no bucket needs any more, but for the batch before, are deleted."""
    from tessera.sources.files import drop_versions, read_manifest_file, write_manifest_file

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.where(F.col(key).isNotNull()).withColumn("_bucket", F.pmod(F.hash(F.col(key).cast("string")), F.lit(buckets)))
        touched = [r[0] for r in placed.select("_bucket").distinct().collect()]  # ``buckets`` at most
        current = read_manifest_file(spark, path)
        old = [f"{path}/{current[str(b)]}/_bucket={b}" for b in touched if str(b) in current]
        if old:
            placed = placed.unionByName(spark.read.option("basePath", path).parquet(*old).select(*batch.columns).withColumn("_bucket", F.pmod(F.hash(F.col(key).cast("string")), F.lit(buckets))))
        rest = [c for c in batch.columns if c != key]
        newest = placed.groupBy("_bucket", key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select("_bucket", key, "_r.*")
        version = f"batch-{number}"
        newest.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/{version}")
        new = current | {str(b): version for b in touched}
        write_manifest_file(spark, path, new)
        drop_versions(spark, path, {*current.values(), *new.values()})

    return write


def read_upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that ``upsert_newest`` keeps, or None."""
    from tessera.sources.files import read_manifest_file

    current = read_manifest_file(spark, path)
    if not current:
        return None
    return spark.read.parquet(*[f"{path}/{v}/_bucket={b}" for b, v in current.items()])
