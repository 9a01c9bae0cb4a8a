"""Streams: new documents against known hashes, requests per user, sessions, and a token bucket with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathom.functions.text import content_hash


def first_seen(stream: DataFrame, text: str, at: str, watermark: str = "1 hour") -> DataFrame:
    """A stream without texts whose hash came within the watermark before; the state is bounded by it."""
    return stream.withColumn("content_hash", content_hash(F.col(text))).withWatermark(at, watermark).dropDuplicatesWithinWatermark(["content_hash"])


def into_table(path: str, text: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the texts whose hash the table at ``path`` doesn't have."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("content_hash", content_hash(F.col(text)))
        first = new.groupBy("content_hash").agg(F.min_by(F.struct(*new.columns), key).alias("r")).select("r.*")
        try:
            known = spark.read.parquet(path).select("content_hash")
            first = first.join(known, "content_hash", "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        first.write.mode("append").parquet(path)

    return write


def requests_within(df: DataFrame, user: str, at: str, seconds: int = 60) -> DataFrame:
    """``df`` with the number of the user's requests in the seconds up to and including each."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(user).orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("_us", us).withColumn("n_recent", F.count("*").over(w)).drop("_us")


def sessions(df: DataFrame, user: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """(user, start, end, n): runs of events no further apart than the gap. Works on batches and on streams with a watermark."""
    s = df.groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return s.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def counts_per_window(df: DataFrame, at: str, width: str, slide: str | None, by: list[Column | str]) -> DataFrame:
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def token_bucket(stream: DataFrame, user: str, at: str, rate: float, capacity: float) -> DataFrame:
    """(user, at, granted, tokens) per event: a bucket per user fills at ``rate`` a second up to ``capacity``; an event takes one. The
    state is two numbers a user and times out after an hour of processing time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        for b in batches:
            rows = []
            for t in sorted(b[at]):
                now = pd.Timestamp(t).timestamp()
                tokens = min(capacity, tokens + (max(0.0, now - last) * rate if last is not None else 0.0))
                last = max(now, last or now)
                ok = tokens >= 1
                tokens -= ok
                rows.append((key[0], t, ok, tokens))
            yield pd.DataFrame(rows, columns=[user, at, "granted", "tokens"])
        state.update((float(tokens), float(last or 0.0)))
        state.setTimeoutDuration(3_600_000)

    kinds = stream.schema[user].dataType.simpleString(), stream.schema[at].dataType.simpleString()
    return stream.groupBy(user).applyInPandasWithState(step, f"{user} {kinds[0]}, {at} {kinds[1]}, granted boolean, tokens double", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def token_bucket_trace(df: DataFrame, user: str, at: str, key: str, rate: float, capacity: float) -> DataFrame:
    """(user, key, granted) of a finished log: a pass over rows sorted by user and time that holds one user's two numbers at a time, so no
    user's log is ever gathered. Rows without a time are left out."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    e = df.where(F.col(at).isNotNull()).select(F.col(user).alias("u"), F.col(key).alias("k"), us.alias("us")).repartition("u").sortWithinPartitions("u", "us", "k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who: object = None
        tokens, last = capacity, None
        for b in batches:
            granted = []
            for u, t in zip(b["u"], b["us"]):
                if u != who or last is None:
                    who, tokens, last = u, capacity, t
                tokens = min(capacity, tokens + (t - last) / 1e6 * rate)
                last = t
                ok = tokens >= 1
                tokens -= ok
                granted.append(ok)
            yield pd.DataFrame({"u": b["u"], "k": b["k"], "granted": granted})

    kinds = df.schema[user].dataType.simpleString(), df.schema[key].dataType.simpleString()
    return e.mapInPandas(run, f"u {kinds[0]}, k {kinds[1]}, granted boolean").withColumnsRenamed({"u": user, "k": key})
