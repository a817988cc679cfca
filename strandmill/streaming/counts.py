"""Counts of transitions over streams of events.

Counts are additive, so what micro-batches add up to equals the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandmill.operators.counts import with_bucket

_OUT = "family long, x string, y string, t double"
_STATE = "state string, us long, id long"
_HELD = "last_us binary, last_kind array<string>, last_user binary, held_us binary, held_id binary, held_kind array<string>, held_user binary"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A user's transitions, given the last event seen before."""
    rows = pd.concat(list(batches)).sort_values(["us", "event_id"], kind="stable")
    before = pd.DataFrame([state.get], columns=["event_type", "us", "event_id"]) if state.exists else rows.head(0)[["event_type", "us", "event_id"]]
    chain = pd.concat([before, rows[["event_type", "us", "event_id"]]]) if len(before) else rows[["event_type", "us", "event_id"]]
    last = chain.iloc[-1]
    state.update((str(last["event_type"]), int(last["us"]), int(last["event_id"])))
    yield pd.DataFrame({"family": key[0], "x": chain["event_type"].to_numpy()[:-1], "y": chain["event_type"].to_numpy()[1:], "t": np.diff(chain["us"].to_numpy()) / 8.64e10})


def transitions(events: DataFrame) -> DataFrame:
    """(family, x, y, t) of a stream of events (event_id, ts, user_id, event_type) that comes in order for each user.

    The state of a user is one event.
    """
    rows = events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(_follow, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def _numbers(packed: bytes | None) -> np.ndarray:
    return np.frombuffer(packed or b"", np.int64)


def _released(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Transitions of a bucket's users between events that the watermark has passed; the others are held."""
    now = state.getCurrentWatermarkMs()
    last_us, last_kind, last_user, held_us, held_id, held_kind, held_user = state.get if state.exists else (None, [], None, None, None, [], None)
    rows = list(batches)
    user, us, ids = (np.concatenate([_numbers(old), *(r[c].to_numpy(np.int64) for r in rows)]) for old, c in ((held_user, "user"), (held_us, "us"), (held_id, "event_id")))
    kind = np.concatenate([np.array(held_kind, object), *(r["event_type"].to_numpy(object) for r in rows)])
    order = np.lexsort((ids, us, user))
    user, us, ids, kind = user[order], us[order], ids[order], kind[order]
    ready = us < now * 1000
    # a user's last event taken before, then those ready in order
    by, at, x = np.concatenate([_numbers(last_user), user[ready]]), np.concatenate([_numbers(last_us), us[ready]]), np.concatenate([np.array(last_kind, object), kind[ready]])
    order = np.argsort(by, kind="stable")
    by, at, x = by[order], at[order], x[order]
    same = by[1:] == by[:-1]
    if same.any():
        yield pd.DataFrame({"family": None if key[1] else by[1:][same], "x": x[:-1][same], "y": x[1:][same], "t": np.diff(at)[same] / 8.64e10})
    end, open_ = np.ones(len(by), bool), ~ready
    end[:-1] = ~same
    state.update((at[end].tobytes(), x[end].tolist(), by[end].tobytes(), us[open_].tobytes(), ids[open_].tobytes(), kind[open_].tolist(), user[open_].tobytes()))
    if open_.any():
        state.setTimeoutTimestamp(max(int(us[open_].min()) // 1000, now) + 1)


#: Groups of users that share a state.
BUCKETS = 1 << 14


def late_transitions(events: DataFrame, delay: str) -> DataFrame:
    """(family, x, y, t) of a stream of events (event_id, ts, user_id, event_type) that come in any order within `delay`.

    A user's events are held until the watermark has passed them, then taken in order of time and id; the state is those
    and the last one taken.  Users share a state by a hash, as calls of Python and of a state store cost much more than
    events: they are BUCKETS at most in a batch, and a state goes to Python and back with its users' rows.  Events
    later than the watermark are dropped, as everywhere in Spark, and so are those without a time.  A timeout at the
    earliest held event's time releases them, so users who send nothing more are not forgotten.  States together may
    be larger than memory, so the session is set to keep them in RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).where("ts is not null").withWatermark("ts", delay)
    number = lambda c, none: F.coalesce(F.col(c).cast("long"), F.lit(none))
    rows = rows.select("ts", "event_type", F.unix_micros("ts").alias("us"), number("event_id", -1 << 63).alias("event_id"), number("user_id", 0).alias("user"), F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).alias("bucket"), F.col("user_id").isNull().alias("nobody"))
    return rows.groupBy("bucket", "nobody").applyInPandasWithState(_released, _OUT, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def counts(pairs: DataFrame, points: list[float]) -> DataFrame:
    """(bucket, x, y, n) of a stream of transitions, for update or complete mode."""
    return with_bucket(pairs, points).groupBy("bucket", "x", "y").agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Everything that a stream has now: rows appended to Parquet files (append), or the last whole result (complete)."""
    if mode not in ("append", "complete"):
        raise ValueError(f"no mode {mode}")
    out = f"{folder}/out"
    if mode == "append":
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", out)
    else:
        writer = stream.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out))
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
