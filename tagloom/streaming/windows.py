"""Stream operators that event time alone decides: submit batches as session windows, messages during runs as an interval join.

Both keep no state code of their own. Rows behind the watermark (``delay``) are dropped by Spark; where every late row must be
accounted for, the live tags write a late table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.schemas import DEBOUNCE_SECONDS, KEY
from tagloom.streaming.live import key_text
from tagloom.streaming.readiness import DELAY, timed

BUCKET_SECONDS = 600
LONGEST = 2 * 86_400  # seconds; a cutoff frees a run within a day


def submit_batches(requests: DataFrame, key: str, gap_seconds: int = DEBOUNCE_SECONDS, delay: str = DELAY) -> DataFrame:
    """Requests submitted together, as they close: (key, first_us, last_us, n, submit_us).

    ``requests`` is a stream with ``key`` and ``ts``; a row without a key, such as a heartbeat, only moves the watermark on. A
    batch comes out once no request can join it any more. Requests are merged per partition before the shuffle, so a frequency
    that a third of the tags have sends one row per task and session.
    """
    gap = gap_seconds * 1_000_000
    # sessions that touch are one, but a request that comes just when a batch is submitted opens the next one
    session = F.session_window("ts", f"{gap - 1} microseconds")
    us = F.unix_micros("ts")
    # a condition on the key alone would be pushed below the watermark, which then never saw a heartbeat
    asked = F.when(F.col("ts").isNotNull(), F.col(key)).isNotNull()
    closed = timed(requests, delay).filter(asked).groupBy(key, session).agg(
        F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count(F.lit(1)).alias("n"))
    return closed.select(key, "first_us", "last_us", "n", (F.col("last_us") + gap).alias("submit_us"))


def ignored_messages(messages: DataFrame, dependencies: DataFrame, reports: DataFrame, bucket_seconds: int = BUCKET_SECONDS,
                     longest_seconds: int = LONGEST, delay: str = DELAY) -> DataFrame:
    """(event_id, tag_id, seq) of messages that arrive while an attempt of the tag runs, one row per message and attempt.

    ``messages`` (event_id, ts, key) and ``reports`` (tag_id, seq, start_time, finish_time in epoch seconds, of ended attempts)
    are streams, ``dependencies`` a table. An attempt is placed into the time buckets it touches, so the interval becomes an
    equi-join on key and bucket and a key that all tags need is spread over time. A message is kept for ``longest_seconds``
    after it, an attempt until the messages of its time have come; of a longer attempt the last ``longest_seconds`` count.
    """
    width = bucket_seconds * 1_000_000
    arrived = timed(messages, delay).select(
        "event_id", "ts", key_text().alias("key"), F.floor(F.unix_micros("ts") / width).alias("bucket"))
    ended = reports.withColumn("ended", F.timestamp_seconds("finish_time")).withWatermark("ended", delay).withColumn(
        "began", F.timestamp_seconds(F.greatest("start_time", F.col("finish_time") - longest_seconds))).filter("began < ended")
    span = F.sequence(F.floor(F.unix_micros("began") / width), F.floor(F.unix_micros("ended") / width))
    needed = dependencies.select("tag_id", key_text().alias("_key"))
    busy = ended.join(needed, "tag_id").select("tag_id", "seq", "began", "ended", "_key", F.explode(span).alias("_bucket"))
    within = (F.col("ts") >= F.col("began")) & (F.col("ts") < F.col("ended"))
    # said again with the watermarked columns alone, for Spark to see when kept rows can go
    bounded = F.col("ended") <= F.col("ts") + F.make_dt_interval(secs=F.lit(longest_seconds))
    return arrived.join(busy, (F.col("key") == F.col("_key")) & (F.col("bucket") == F.col("_bucket")) & within & bounded).select(
        "event_id", "tag_id", "seq")
